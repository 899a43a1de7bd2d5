"""Quality/cost frontiers: domination, skylines, admission of sessions."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import statistics as S
from framewright.storage import materialize


def dominated_by(cached: DataFrame, dense: DataFrame, by: Sequence[str], acc: str, cost: str, order: str) -> DataFrame:
    """``cached`` plus ``winner``: the first dense point (by ``order``) that it dominates.

    Dominating: at least as accurate, at most as costly, and better in one.  Both
    sides meet on ``by`` only; a dense curve has one row per budget.
    """
    d = dense.select(*[F.col(c).alias(f"_d_{c}") for c in by], F.col(acc).alias("_da"), F.col(cost).alias("_dc"), F.col(order).alias("_do"))
    on = (F.col(acc) >= F.col("_da")) & (F.col(cost) <= F.col("_dc")) & ((F.col(acc) > F.col("_da")) | (F.col(cost) < F.col("_dc")))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    keyed = cached.withColumn("_id", F.struct(*cached.columns))
    won = keyed.join(d, on, "left").groupBy("_id").agg(F.min("_do").alias("winner"))
    return won.select("_id.*", "winner")


def skyline(points: DataFrame, cost: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Points no other beats: none of less or equal cost and greater or equal score, better in one.

    Equal points all stay.  Only the best score of each cost matters, and of
    those the ones above all cheaper.  Costs are swept cell by cell; the best
    score of the cells below is added, so no task takes all costs.
    """
    best = points.filter(F.col(cost).isNotNull() & F.col(score).isNotNull()).groupBy(*by, cost).agg(F.max(score).alias(score)).withColumn("_cell", S.cell(F.col(cost)))
    cells = best.groupBy(*by, "_cell").agg(F.max(score).alias("_top"))
    up = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # some thousand cells
    below = cells.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_cell").alias("_at"), F.max("_top").over(up).alias("_below"))
    on = F.col("_cell") == F.col("_at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    w = Window.partitionBy(*by, "_cell").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    top = best.join(below, on).withColumn("_m", F.greatest(F.max(score).over(w), F.col("_below"))).filter(F.col("_m").isNull() | (F.col(score) > F.col("_m")))
    return points.join(top.select(*by, cost, score), [*by, cost, score], "left_semi")


class _Stair:
    """Pairs (x, y) that no other is at or below in both: ascending x, descending y."""

    def __init__(self):
        self.x: list[float] = []
        self.y: list[float] = []

    def covers(self, x: float, y: float) -> bool:
        i = bisect_right(self.x, x)
        return i > 0 and self.y[i - 1] <= y

    def add(self, x: float, y: float) -> None:
        i = bisect_left(self.x, x)
        j = i
        while j < len(self.x) and self.y[j] >= y:
            j += 1
        self.x[i:j], self.y[i:j] = [x], [y]


def skyline_3d(points: DataFrame, cost: str, score: str, second: str) -> DataFrame:
    """Skyline with a second score to be high.

    A sweep by cost keeps the stairs of (score, second) seen so far, so a point
    costs a binary search.  Each partition drops points its own sweep beats (a
    beaten point beats nothing that its better doesn't).  The others are ranged by
    cost; a range gives its stairs, and its points are swept after the stairs of
    the ranges below.  Stairs are as long as the skyline of two scores.
    """
    src = points.filter(F.col(cost).isNotNull() & F.col(score).isNotNull() & F.col(second).isNotNull())

    def sweep(rows, stair: _Stair):
        for c, s, t in sorted(rows):
            if not stair.covers(s, t):
                stair.add(s, t)
                yield c, s, t

    def local(batches):
        left: set = set()
        for pdf in batches:
            left |= set(zip(pdf["c"], -pdf["s"], -pdf["t"]))
            if len(left) > 100_000:
                left = set(sweep(left, _Stair()))
        yield pd.DataFrame([(c, -s, -t) for c, s, t in sweep(left, _Stair())], columns=["c", "s", "t"])

    cand = src.select(F.col(cost).cast("double").alias("c"), F.col(score).cast("double").alias("s"), F.col(second).cast("double").alias("t"))
    cand = materialize(cand.mapInPandas(local, "c double, s double, t double").distinct())
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # points of one cost stay in one range
    ranged = materialize(cand.repartitionByRange(parts, "c").withColumn("_p", F.spark_partition_id()))

    def stairs(pdf: pd.DataFrame) -> pd.DataFrame:
        stair = _Stair()
        for s, t in sorted(zip(-pdf["s"], -pdf["t"])):
            if not stair.covers(s, t):
                stair.add(s, t)
        return pd.DataFrame({"_p": pdf["_p"].iloc[0], "s": [-x for x in stair.x], "t": [-y for y in stair.y]})

    low = ranged.groupBy("_p").applyInPandas(stairs, "_p int, s double, t double")
    spread = low.select(F.explode(F.sequence(F.col("_p") + 1, F.greatest(F.lit(parts), F.col("_p") + 1))).alias("_p"), F.lit(float("-inf")).alias("c"), "s", "t")

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(c, -s, -t) for c, s, t in sweep(zip(pdf["c"], -pdf["s"], -pdf["t"]), _Stair()) if c != float("-inf")]
        return pd.DataFrame(out, columns=["_c", "_s", "_t"])

    top = ranged.select("_p", "c", "s", "t").unionByName(spread).groupBy("_p").applyInPandas(final, "_c double, _s double, _t double")
    return src.join(top, (F.col(cost).cast("double") == F.col("_c")) & (F.col(score).cast("double") == F.col("_s")) & (F.col(second).cast("double") == F.col("_t")), "left_semi")


def session_pairs(arms: DataFrame, pruned: str = "pruned_q0", dense: str = "dense_q0") -> DataFrame:
    """One row per session with both arms: ``session_key, duration, split`` and structs ``pruned``, ``dense``.

    An arm delivered more than once counts as delivered last.  Sessions without
    one of the arms are left out.
    """
    cols = [c for c in arms.columns if c not in ("session_key", "arm_name", "ingested_at")]
    row = F.max(F.when(F.col("arm_name") == pruned, F.struct("ingested_at", *cols))), F.max(F.when(F.col("arm_name") == dense, F.struct("ingested_at", *cols)))
    g = arms.filter("session_key IS NOT NULL").groupBy("session_key").agg(row[0].alias("pruned"), row[1].alias("dense"))
    return g.filter("pruned IS NOT NULL AND dense IS NOT NULL").select("session_key", F.coalesce("pruned.duration", "dense.duration").alias("duration"), F.coalesce("pruned.split", "dense.split").alias("split"), "pruned", "dense")


#: Rules that choose the dense arm of a session.
def policy_suite() -> dict[str, Column]:
    """Whether a session runs dense, by policy name."""
    d = F.col("duration")
    dense = {"all_pruned": F.lit(False), "all_dense": F.lit(True)}
    for s in ("short", "medium", "long"):
        dense[f"dense_on_{s}"] = d == s
    for a, b in (("short", "medium"), ("short", "long"), ("medium", "long")):
        dense[f"dense_on_{a}_{b}"] = d.isin(a, b)
    dense["dense_if_q0_gains"] = F.col("dense.q0_stream_correct") > F.col("pruned.q0_stream_correct")
    dense["dense_if_session_gains"] = F.col("dense.stream_correct") > F.col("pruned.stream_correct")
    return {k: F.coalesce(v, F.lit(False)) for k, v in dense.items()}


def evaluate_policies(pairs: DataFrame, policies: dict[str, Column], queries: int = 3, delta: float = 0.05, rescue: float = -0.10, speedup: float = 3.0) -> DataFrame:
    """Totals and pass flags of every policy, in one pass over the sessions.

    Each session is exploded into one row per policy; the aggregate combines on
    the map side.  ``n_queries`` is ``queries`` per session.
    """
    chosen = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.when(c, F.col("dense")).otherwise(F.col("pruned")).alias("arm"), c.alias("is_dense")) for n, c in policies.items()]))
    g = pairs.select(chosen.alias("x")).select("x.*").groupBy("policy").agg(
        F.count("*").alias("n_sessions"), F.count_if("is_dense").alias("n_dense"), F.sum("arm.stream_correct").alias("stream_correct"), F.sum("arm.cold_correct").alias("cold_correct"),
        F.sum("arm.stream_total_ms").alias("stream_ms"), F.sum("arm.cold_total_ms").alias("cold_ms"), F.sum("arm.parse_failures").alias("parse_failures"), F.sum("arm.degenerates").alias("degenerates"),
    )
    nq = F.col("n_sessions") * queries
    acc = (F.col("stream_correct") - F.col("cold_correct")) / nq
    x = F.when(F.col("stream_ms") > 0, F.col("cold_ms") / F.col("stream_ms"))
    return g.select("*", nq.alias("n_queries"), acc.alias("delta"), x.alias("speedup"), ((F.abs(acc) <= delta) & (x >= speedup)).alias("passes"), ((acc >= rescue) & (x >= speedup)).alias("rescues"))


#: Sums that a point of the frontier carries along its chosen arms, after its slack.
TOTALS = ("stream_ms", "cold_ms", "n_dense", "parse_failures", "degenerates")
#: Sessions folded in one part, and parts joined in one task.
PART, FAN = 400, 8


class _Frontier:
    """Greatest slack per change of correct answers, with the totals of the arms that give it; changes from ``low`` on."""

    def __init__(self, low: int, table: np.ndarray):
        self.low, self.table = low, table  # rows: changes; columns: slack and totals

    @classmethod
    def of(cls, options: Sequence[tuple[int, Sequence[float]]]) -> _Frontier:
        """One choice; of options with the same change and slack the first stays."""
        low, high = min(d for d, _ in options), max(d for d, _ in options)
        table = np.full((high - low + 1, 1 + len(TOTALS)), -np.inf)
        for d, row in options:
            if row[0] > table[d - low, 0]:
                table[d - low] = row
        return cls(low, table)

    def plus(self, other: _Frontier) -> _Frontier:
        """Max-plus convolution: both choices made."""
        a, b = (self, other) if len(self.table) >= len(other.table) else (other, self)
        out = np.full((len(a.table) + len(b.table) - 1, a.table.shape[1]), -np.inf)
        for i, row in enumerate(b.table):
            if row[0] == -np.inf:
                continue
            view = out[i : i + len(a.table)]
            better = a.table[:, 0] + row[0] > view[:, 0]
            view[better] = a.table[better] + row
        return _Frontier(a.low + b.low, out)

    def frame(self, keys: dict) -> pd.DataFrame:
        at = np.flatnonzero(self.table[:, 0] > -np.inf)
        pdf = pd.DataFrame({"delta": at + self.low, "slack": self.table[at, 0]})
        for i, c in enumerate(TOTALS):
            pdf[c] = self.table[at, i + 1]
        return pdf.assign(**keys)[[*keys, "delta", "slack", *TOTALS]]


def admission_frontier(pairs: DataFrame, target: float = 3.0, by: Sequence[str] = ("split",)) -> DataFrame:
    """Greatest time slack for every reachable change of correct answers: ``by, delta, slack`` and ``TOTALS``.

    For each session one arm is taken; the slack of an arm is cold time minus
    ``target`` times stream time, its delta stream minus cold correct.  The totals
    are those of the chosen arms.  Groups fold exactly: parts of ``PART`` sessions
    give partial frontiers, ``FAN`` of which combine at a time by max-plus
    convolution, whose size is that of the delta range.  Of equal slacks the
    totals of either may come out.  Sessions with a null in either arm's deltas
    or times are left out; other nulls count as 0.
    """
    keys = list(by)
    number = lambda a, c: F.coalesce(F.col(f"{a}.{c}").cast("double"), F.lit(0.0))
    cols = []
    for a, n in (("pruned", 0), ("dense", 1)):
        slack = F.col(f"{a}.cold_total_ms") - F.lit(float(target)) * F.col(f"{a}.stream_total_ms")
        cols += [(F.col(f"{a}.stream_correct") - F.col(f"{a}.cold_correct")).cast("int").alias(f"d{n}"), F.array(slack, F.col(f"{a}.stream_total_ms"), F.col(f"{a}.cold_total_ms"), F.lit(float(n)), number(a, "parse_failures"), number(a, "degenerates")).alias(f"r{n}"), slack.alias(f"s{n}")]
    flat = pairs.select(*keys, "session_key", *cols).filter("d0 IS NOT NULL AND s0 IS NOT NULL AND d1 IS NOT NULL AND s1 IS NOT NULL").drop("s0", "s1")
    flat = materialize(flat)
    parts = max(1, -(-flat.count() // PART))
    flat = flat.withColumn("_part", F.pmod(F.xxhash64("session_key"), F.lit(parts)).cast("int")).drop("session_key")
    ddl = ", ".join([*(f"`{k}` {flat.schema[k].dataType.simpleString()}" for k in keys), "_part int, delta int, slack double", *(f"{c} double" for c in TOTALS)])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        f = None
        for d0, r0, d1, r1 in zip(pdf.d0, pdf.r0, pdf.d1, pdf.r1):
            one = _Frontier.of([(d0, r0), (d1, r1)])
            f = one if f is None else f.plus(one)
        return f.frame({k: pdf[k].iloc[0] for k in [*keys, "_part"]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        f = None
        for _, part in pdf.groupby("_from"):
            one = _Frontier.of(list(zip(part.delta, part[["slack", *TOTALS]].to_numpy())))
            f = one if f is None else f.plus(one)
        return f.frame({k: pdf[k].iloc[0] for k in [*keys, "_part"]})

    out = flat.groupBy(*keys, "_part").applyInPandas(fold, ddl)
    while parts > 1:
        parts = -(-parts // FAN)
        out = out.withColumnRenamed("_part", "_from").withColumn("_part", (F.col("_from") / F.lit(FAN)).cast("int")).groupBy(*keys, "_part").applyInPandas(join, ddl)
    return out.drop("_part")


def frontier_points(frontier: DataFrame, sessions: DataFrame, by: Sequence[str] = ("split",), queries: int = 3) -> DataFrame:
    """``frontier`` with the accuracy delta, speed-up and pass flags of its points; ``sessions``: ``by, n_sessions``."""
    f = frontier.alias("f").join(sessions.alias("n"), S._same(list(by), "f", "n")).select("f.*", "n.n_sessions")
    acc, speed = F.col("delta") / (F.col("n_sessions") * queries), F.when(F.col("stream_ms") > 0, F.col("cold_ms") / F.col("stream_ms"))
    f = f.withColumns({"accuracy_delta": acc, "speedup": speed, "format_pass": (F.col("parse_failures") == 0) & (F.col("degenerates") == 0)})
    return f.withColumns({"strict_pass": (F.abs("accuracy_delta") <= 0.05) & (F.col("speedup") >= 3.0), "rescue_pass": (F.col("accuracy_delta") >= -0.10) & (F.col("speedup") >= 3.0)})


def best_points(points: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """``by, pick`` and the point that is best under each of six constraints; null where none qualifies.

    Of equal points the one of the lowest change is taken.
    """
    picks = {
        "best_strict": (F.col("strict_pass"), "accuracy_delta"), "best_rescue": (F.col("rescue_pass"), "accuracy_delta"), "best_strict_with_format": (F.col("strict_pass") & F.col("format_pass"), "accuracy_delta"), "best_rescue_with_format": (F.col("rescue_pass") & F.col("format_pass"), "accuracy_delta"),
        "best_speed_at_or_above_rescue_floor": (F.col("accuracy_delta") >= -0.10, "speedup"), "best_accuracy_at_or_above_3x": (F.col("speedup") >= 3.0, "accuracy_delta"),
    }
    row = F.struct("delta", "accuracy_delta", "speedup", "slack", *TOTALS)
    aggs = [F.max_by(F.when(ok, row), F.when(ok, F.struct(F.col(c), -F.col("delta")))).alias(n) for n, (ok, c) in picks.items()]
    g = points.groupBy(*by).agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("pick"), F.col(n).alias("point")) for n in picks]))
    return g.select(*by, each.alias("x")).select(*by, "x.pick", "x.point.*")


def setup_inclusive_speedup(setup: Column, follow: Column, cold: Column, queries: Column) -> Column:
    """Cold time of ``queries`` queries over setup plus their warm time."""
    total = setup + queries * follow
    return F.when(total > 0, queries * cold / total)


def ceiling(share: Column, reduction: Column) -> Column:
    """Speed-up if only a share of the time shrinks by ``reduction``."""
    return 1 / F.nullif(1 - share * reduction, F.lit(0.0))
