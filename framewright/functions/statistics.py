"""Statistical column expressions and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.storage import materialize

#: Fixed value: the 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def wilson(k: Column, n: Column, clamp: bool = False) -> tuple[Column, Column]:
    """95 % Wilson interval of ``k`` of ``n``; (0, 0) for no trials, or null if clamped."""
    z2 = Z95 * Z95
    p = k / n
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    none = F.lit(None).cast("double") if clamp else F.lit(0.0)
    lo, hi = centre - half, centre + half
    if clamp:
        lo, hi = F.greatest(F.lit(0.0), lo), F.least(F.lit(1.0), hi)
    return F.when(n > 0, lo).otherwise(none), F.when(n > 0, hi).otherwise(none)


def binomial_se(p: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n))


def mean_or_zero(c: Column) -> Column:
    """Mean of a flag or number over its non-null values, 0 where there are none."""
    return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))


#: Cells per doubling of a value: the rows of a group are ordered cell by cell.
CELLS_PER_OCTAVE = 128


def cell(v: Column) -> Column:
    """Number of a value's cell, ordered as the values; NaN is the greatest value."""
    d = v.cast("double")
    mag = F.floor(F.log2(F.abs(d)) * CELLS_PER_OCTAVE).cast("bigint") + F.lit(1100 * CELLS_PER_OCTAVE)
    far = F.lit(1 << 40)
    return F.when(F.isnan(d), far + 1).when(d == float("inf"), far).when(d == float("-inf"), -far).when(d > 0, mag).when(d < 0, -mag).otherwise(F.lit(0).cast("bigint"))


def _same(keys: Sequence[str], a: str, b: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def _below(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``cells`` (``keys, _cell, _m``) plus ``_before``, the rows of the group in lower cells, and ``_n``, those of the group."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    up = w.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_before", F.coalesce(F.sum("_m").over(up), F.lit(0))).withColumn("_n", F.sum("_m").over(w))


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``keys`` and, per name, the value of a rank (from 0) of each group.

    A rank is given as a function of the number of non-null values.  Counts per
    cell tell which cells hold the ranks; only their rows are ordered, cell by
    cell, so no task takes a group.  Groups without values have no row.
    """
    d = materialize(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), cell(F.col(value)).alias("_cell")))
    below = _below(d.groupBy(*keys, "_cell").agg(F.count("*").alias("_m")), keys)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("_n")).cast("bigint").alias("rank")) for name, f in ranks.items()]))
    held = below.select(*keys, "_cell", "_before", "_m", wanted.alias("w")).filter("w.rank >= _before AND w.rank < _before + _m").select(*keys, "_cell", F.col("w.name").alias("_name"), (F.col("w.rank") - F.col("_before")).alias("_k"))
    held = materialize(held)
    both = [*keys, "_cell"]
    rows = d.alias("x").join(held.select(*both).distinct().alias("h"), _same(both, "x", "h"), "left_semi").groupBy(*both, "_v").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*both).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto)
    j = rows.alias("x").join(held.alias("h"), _same(both, "x", "h") & (F.col("h._k") < F.col("x._upto")) & (F.col("h._k") >= F.col("x._upto") - F.col("x._m")))
    return j.groupBy(*[F.col(f"x.{k}").alias(k) for k in keys]).agg(*[F.max(F.when(F.col("h._name") == name, F.col("x._v"))).alias(name) for name in ranks])


def index_percentile(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``sorted[int(p * (n - 1))]`` per group: neither of the built-in percentile rules."""
    return select_ranks(df, keys, value, {name: (lambda n, p=p: F.floor(F.lit(p) * (n - 1))) for name, p in shares.items()})


def percentile(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and the interpolated percentiles of each group; the median is the share 0.5."""
    at = lambda n, p: F.lit(float(p)) * (n - 1)
    ranks = {f"{name}{end}": (lambda n, p=p, f=f: f(at(n, p))) for name, p in shares.items() for end, f in (("_lo", F.floor), ("_hi", F.ceil))}
    d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    got = select_ranks(d, keys, "_v", ranks)
    n = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    j = got.alias("g").join(n.alias("n"), _same(keys, "g", "n"))
    part = lambda p: at(F.col("_n"), p) - F.floor(at(F.col("_n"), p))
    return j.select(*[F.col(f"g.{k}").alias(k) for k in keys], *[(F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * part(p)).alias(name) for name, p in shares.items()])


def with_percentiles(groups: DataFrame, df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``groups``, one row per group, plus ``percentile`` of ``df``; null for a group without values."""
    p = percentile(df, keys, value, shares)
    return groups.alias("a").join(p.alias("p"), _same(keys, "a", "p"), "left").select("a.*", *[F.col(f"p.{n}") for n in shares])


def with_position(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[Column] = ()) -> DataFrame:
    """``df`` plus ``_i``, the place (from 0) of a row by ``value`` and ``ties`` in its group, ``_first``, that of the first of its value, ``_last`` and ``_n``.

    Rows are ordered cell by cell; the counts of lower cells are added.  Nulls
    come first, as a cell of their own.
    """
    d = materialize(df.withColumn("_cell", F.coalesce(cell(F.col(value)), F.lit(-(1 << 41)))))
    below = _below(d.groupBy(*keys, "_cell").agg(F.count("*").alias("_m")), keys)
    both = [*keys, "_cell"]
    j = d.alias("x").join(below.alias("b"), _same(both, "x", "b")).select("x.*", "b._before", "b._n")
    w = Window.partitionBy(*both)
    first = F.rank().over(w.orderBy(value)) - 1
    peers = F.count("*").over(Window.partitionBy(*both, value))
    out = j.withColumn("_i", F.col("_before") + F.row_number().over(w.orderBy(value, *ties)) - 1).withColumn("_first", F.col("_before") + first).withColumn("_last", F.col("_first") + peers - 1)
    return out.drop("_cell", "_before")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 with ties at their mean."""
    return with_position(df, keys, value).withColumn(name, (F.col("_first") + F.col("_last")) / 2.0 + 1).drop("_i", "_first", "_last", "_n")


def value_counts(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Rows with label 1 (``pos``) and 0 (``neg``) per distinct score: what AUC, thresholds and filters need.

    It is a map-side aggregate; everything after works on distinct scores.
    """
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return d.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def auc(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """``keys, auc``: share of (positive, negative) pairs in order, ties count half; null if a class is empty."""
    c = value_counts(df, keys, score, label)
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = c.withColumn("_w", F.col("pos") * (below + F.col("neg") / 2))
    p, n = F.sum("pos"), F.sum("neg")
    return won.groupBy(*keys).agg(F.when((p > 0) & (n > 0), F.sum("_w") / (p * n)).alias("auc"))


def safe_filter(df: DataFrame, keys: Sequence[str], score: str, label: str, floor: float) -> DataFrame:
    """The threshold of greatest coverage whose precision (share of label 0 at or above it) reaches ``floor``.

    ``keys, threshold, coverage, precision``; of equal coverage the lowest
    threshold; groups without one have no row.
    """
    c = value_counts(df, keys, score, label)
    down = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    n = F.sum(F.col("pos") + F.col("neg")).over(down)
    d = c.select(*keys, F.col(score).alias("threshold"), (n / F.sum(F.col("pos") + F.col("neg")).over(all_)).alias("coverage"), (F.sum("neg").over(down) / n).alias("precision"))
    ok = d.filter(F.col("precision") >= floor)
    best = Window.partitionBy(*keys).orderBy(F.desc("coverage"), "threshold")
    return ok.withColumn("_i", F.row_number().over(best)).filter("_i = 1").drop("_i")


def equal_count_bins(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[Column], bins: int, name: str = "bin") -> DataFrame:
    """Bins of the ranks with edges ``round(i * n / bins)``, halves to even; not ``ntile``."""
    d = with_position(df, keys, value, ties)
    edges = [F.bround(F.lit(i) * F.col("_n") / F.lit(bins)) for i in range(1, bins)]
    at = F.lit(0)
    for e in edges:
        at = at + F.when(F.col("_i") >= e, 1).otherwise(0)
    return d.withColumn(name, at).drop("_i", "_first", "_last", "_n")


def kappa(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa of two ratings, null being a category; 1 where chance agreement is certain."""
    cells = df.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    marg_a, marg_b = F.sum("_n").over(Window.partitionBy(*keys, "_a")), F.sum("_n").over(Window.partitionBy(*keys, "_b"))
    c = cells.select(*keys, "_a", "_b", "_n", total.alias("_t"), marg_a.alias("_ma"), marg_b.alias("_mb"))
    side_a = c.select(*keys, F.col("_a").alias("_c"), "_ma").distinct()
    side_b = c.select(*keys, F.col("_b").alias("_d"), "_mb").distinct()
    on = F.col("x._c").eqNullSafe(F.col("y._d"))
    for k in keys:
        on = on & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    chance = side_a.alias("x").join(side_b.alias("y"), on).groupBy(*[F.col(f"x.{k}").alias(k) for k in keys]).agg(F.sum(F.col("_ma") * F.col("_mb")).alias("_e"))
    seen = c.groupBy(*keys).agg(F.sum(F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("_n")).otherwise(0)).alias("_o"), F.max("_t").alias("_t"))
    j = seen.join(chance, list(keys), "left") if keys else seen.crossJoin(chance)
    o, e = F.col("_o") / F.col("_t"), F.coalesce("_e", F.lit(0)) / (F.col("_t") * F.col("_t"))
    return j.select(*keys, F.when(e >= 1, 1.0).otherwise((o - e) / (1 - e)).alias("kappa"))


def _poisson(replicates: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """Poisson(1) weights (clusters x replicates) from the hashes of clusters."""
    # inverse of the distribution, cut where 1e-8 of it is left
    steps, term = [], 0.36787944117144233
    for k in range(1, 12):
        steps.append((steps[-1] if steps else 0.0) + term)
        term /= k
    cum = np.array(steps)

    # one hash of (replicate, seed) mixed with that of the cluster: splitmix64
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    draw = mix((np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))

    def weights(h: np.ndarray) -> np.ndarray:
        u = (mix(h[:, None] ^ draw[None, :]) >> np.uint64(11)) / float(1 << 53)
        return np.searchsorted(cum, u, side="right").astype(float)

    return weights


def bootstrap(df: DataFrame, keys: Sequence[str], cluster: str, value: str, replicates: int, seed: int = 20260427, low: float = 0.025, high: float = 0.975, rule: str = "B") -> DataFrame:
    """Percentile interval of a mean over resampled clusters: ``keys, mean, low, high``.

    For a paired difference ``value`` is the difference of each pair.

    Clusters are drawn by Poisson(1) weights from a hash of (seed, replicate,
    cluster): the distributed form of drawing with replacement, with no draw
    table.  A partition adds its clusters up per group and replicate in arrays, so
    it sends one row per group and replicate.  The index rule ``B`` is
    ``int(p * (replicates - 1))``, ``A`` is ``int(low * replicates)`` and
    ``int(high * replicates) - 1``.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count("*").alias("_c"))
    weights = _poisson(replicates, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            g, h = b.column("_g").to_numpy(), b.column("_h").to_numpy().astype(np.uint64)
            both = np.stack([b.column(n).to_numpy().astype(float) for n in ("_s", "_c")])
            for k in np.unique(g):
                at = np.flatnonzero(g == k)
                acc = total.setdefault(int(k), np.zeros((2, replicates)))
                for x in range(0, len(at), 256):
                    part = at[x : x + 256]
                    acc += both[:, part] @ weights(h[part])
        for k, (x, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(replicates, k), pa.int64()), pa.array(np.arange(1, replicates + 1), pa.int32()), pa.array(x), pa.array(n)], names=["_g", "_r", "_x", "_n"])

    # the groups go as hashes; their keys come back from the table of groups
    group = F.xxhash64(*[F.col(k) for k in keys], F.lit(0))
    c = c.withColumn("_g", group)
    parts = c.select("_g", F.xxhash64(F.lit(seed), *keys, cluster).alias("_h"), "_s", F.col("_c").cast("double").alias("_c")).mapInArrow(run, "_g bigint, _r int, _x double, _n double")
    sums = parts.groupBy("_g", "_r").agg((F.sum("_x") / F.nullif(F.sum("_n"), F.lit(0.0))).alias("_m"))
    if rule == "A":
        ci = select_ranks(sums, ["_g"], "_m", {"low": lambda n: F.floor(F.lit(low) * n), "high": lambda n: F.floor(F.lit(high) * n) - 1})
    else:
        ci = index_percentile(sums, ["_g"], "_m", {"low": low, "high": high})
    point = c.groupBy("_g", *keys).agg((F.sum("_s") / F.sum("_c")).alias("mean"))
    return point.join(ci, "_g").drop("_g")


#: Cells of ``cell`` that one task of ``bootstrap_auc`` takes.
AUC_CELLS = 16


def bootstrap_auc(df: DataFrame, keys: Sequence[str], cluster: str, score: str, label: str, replicates: int, seed: int = 20260427, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of an AUC over resampled clusters: ``keys, auc, low, high``.

    Clusters have the weights of ``bootstrap``.  Scores are taken cell by cell: a
    cell gives, per replicate, the weights of both labels and the pairs in order
    within it; the cells of a group, at most some thousand, add up in order.
    Replicates without one of the labels do not count.  The index rule is
    ``int(p * (n - 1))``.  The point value has weight 1 for every row.
    """
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*keys, F.floor(cell(F.col(score)) / AUC_CELLS).alias("_cell"), F.xxhash64(F.lit(seed), *keys, cluster).alias("_h"), F.col(score).cast("double").alias("_s"), (F.col(label) == 1).alias("_y"))
    d = d.withColumn("_g", F.xxhash64(*[F.col(k) for k in keys], F.lit(0)))
    weights = _poisson(replicates, seed)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s", kind="stable")
        y, s, h = pdf["_y"].to_numpy(bool), pdf["_s"].to_numpy(), pdf["_h"].to_numpy().astype(np.uint64)
        pos, neg, won = (np.zeros(replicates + 1) for _ in range(3))
        tie_pos, tie_neg, last = np.zeros(replicates + 1), np.zeros(replicates + 1), None
        below = np.zeros(replicates + 1)
        for x in range(0, len(s), 512):
            w = np.concatenate([np.ones((len(s[x : x + 512]), 1)), weights(h[x : x + 512])], axis=1)
            for k in range(len(w)):
                if s[x + k] != last:
                    won += tie_pos * (below + tie_neg / 2)
                    below, last = below + tie_neg, s[x + k]
                    tie_pos, tie_neg = np.zeros(replicates + 1), np.zeros(replicates + 1)
                if y[x + k]:
                    tie_pos = tie_pos + w[k]
                    pos += w[k]
                else:
                    tie_neg = tie_neg + w[k]
                    neg += w[k]
        won += tie_pos * (below + tie_neg / 2)
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "_cell": [pdf["_cell"].iloc[0]], "_p": [pos], "_n": [neg], "_w": [won]})

    cells = d.select("_g", "_cell", "_h", "_s", "_y").groupBy("_g", "_cell").applyInPandas(within, "_g bigint, _cell bigint, _p array<double>, _n array<double>, _w array<double>")

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        below, pos, won = 0.0, 0.0, 0.0
        for p, n, w in zip(*(pdf.sort_values("_cell")[c] for c in ("_p", "_n", "_w"))):
            won, below, pos = won + np.asarray(w) + np.asarray(p) * below, below + np.asarray(n), pos + np.asarray(p)
        pairs = np.asarray(pos * below)
        auc = np.divide(won, pairs, out=np.full(len(pairs), np.nan), where=pairs > 0)
        drawn = np.sort(auc[1:][np.isfinite(auc[1:])])
        at = lambda p: float(drawn[int(p * (len(drawn) - 1))]) if len(drawn) else None
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "auc": [auc[0] if np.isfinite(auc[0]) else None], "low": [at(low)], "high": [at(high)]})

    got = cells.groupBy("_g").applyInPandas(total, "_g bigint, auc double, low double, high double")
    return d.select("_g", *keys).distinct().join(got, "_g").drop("_g")


def excess(c: Column, limit: float) -> Column:
    """How far a value is above a limit, 0 below it."""
    return F.greatest(F.lit(0.0), c - limit)


def piecewise(c: Column, pieces: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first piece whose condition holds; null where ``c`` is null."""
    out = F.when(c.isNull(), F.lit(None).cast("double"))
    for condition, value in pieces:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def linear(terms: Sequence[tuple[float, Column]]) -> Column:
    """A weighted sum of columns; null if one is null."""
    total = F.lit(0.0)
    for weight, c in terms:
        total = total + weight * c
    return total


def softmax_entropy(logits: Column, floor: float = 1e-12) -> Column:
    """Natural entropy of the softmax of an array."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    z = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(e, F.lit(0.0), lambda a, x: a - (x / z) * F.ln(F.greatest(x / z, F.lit(floor))))


def top_gap(values: Column) -> Column:
    """Greatest minus second greatest value; null for fewer than two."""
    s = F.sort_array(values, asc=False)
    return F.when(F.size(values) >= 2, F.try_element_at(s, F.lit(1)) - F.try_element_at(s, F.lit(2)))


def logistic_fit(df: DataFrame, features: Sequence[str], label: str, steps: int = 30, rate: float = 0.5, l2: float = 1e-3) -> list[float]:
    """Weights (bias first) of a logistic regression by full-batch gradient descent.

    Every step is one aggregate over all rows; only the gradient, as long as the
    feature list, reaches the driver.  The bias is not regularised.
    """
    w = [0.0] * (len(features) + 1)
    for _ in range(steps):
        err = logistic_score(features, w) - F.col(label).cast("double")
        row = df.agg(F.count("*").alias("n"), F.sum(err).alias("g0"), *[F.sum(err * F.col(f)).alias(f"g{i + 1}") for i, f in enumerate(features)]).first()
        if not row.n:
            return w
        w = [x - rate * ((row[f"g{i}"] or 0.0) / row.n + (l2 * x if i else 0.0)) for i, x in enumerate(w)]
    return w


def logistic_optimum(df: DataFrame, features: Sequence[str], label: str, l2: float = 0.01, tolerance: float = 1e-10) -> list[float]:
    """Weights (bias first) at the optimum that ``logistic_fit`` goes towards, by Newton's method.

    Every pass is one aggregate of loss, gradient and Hessian; a step that raises
    the loss is halved.  The bias is not regularised.  A fit whose gradient does
    not reach ``tolerance`` is an error.
    """
    k = len(features) + 1
    cols = [F.lit(1.0), *[F.col(f) for f in features]]
    y = F.col(label).cast("double")
    ridge = np.array([0.0, *[l2] * len(features)])
    w = best = np.zeros(k)
    low, step = np.inf, np.zeros(k)
    for _ in range(100):
        p = logistic_score(features, w.tolist())
        sums = [F.sum((p - y) * c).alias(f"g{i}") for i, c in enumerate(cols)] + [F.sum(p * (1 - p) * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        row = df.filter(y.isNotNull()).agg(F.count("*").alias("n"), F.sum(-F.ln(F.when(y > 0, p).otherwise(1 - p))).alias("loss"), *sums).first()
        if not row.n:
            return w.tolist()
        loss = row.loss / row.n + float(ridge @ (w * w)) / 2
        if loss > low + 1e-12:
            step = step / 2
            w = best + step
            continue
        best, low = w, loss
        g = np.array([row[f"g{i}"] for i in range(k)]) / row.n + ridge * w
        if np.abs(g).max() <= tolerance:
            return w.tolist()
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / row.n + np.diag(ridge)
        step = -np.linalg.lstsq(h, g, rcond=None)[0]
        w = best + step
    raise ValueError("the regression has not converged")


def logistic_score(features: Sequence[str], weights: Sequence[float]) -> Column:
    """Probability by given weights; the logit is held within 50."""
    z = F.lit(float(weights[0]))
    for f, w in zip(features, weights[1:]):
        z = z + F.col(f) * F.lit(float(w))
    z = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))
    return 1 / (1 + F.exp(-z))
