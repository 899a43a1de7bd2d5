"""Problem 5: exact percentiles of very large columns by bisection.

Per group a *summary* counts the values in cells of fixed relative width.  The
counts are the numbers of rows below the cell borders, so summaries of separate
runs or days add up (``summarize``, ``merge``) and give any percentile with a
relative error of at most ``error_bound()`` (``estimate``).  For exact results
``bisect_percentiles`` starts from the merged cells: each target rank has the
value interval of its cell; every further pass counts the rows below the
midpoints of all open intervals, and narrows them to the smallest and greatest
value of the part that holds the rank, until that is a single value.

Nulls are ignored; a group without values has no row.  NaN and infinite values
count as nulls unless ``to_long`` is told to keep them; then NaN is the greatest
value of all, as in SQL.  The percentile q/1000 of n values is the
ceil(n*q/1000)-th smallest (at least the first), always a value of the column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.storage import materialize

#: Cells per doubling of the value in a summary.
CELLS_PER_OCTAVE = 128
#: Parts into which one pass splits an interval.
PARTS = 1024
#: Open intervals up to this many are broadcast (some 100 bytes each); more are joined by shuffle, the rows of a group dealt over salts.
BROADCAST_INTERVALS = 50_000
SALTS = 16


def error_bound() -> float:
    """Greatest relative distance of a summary's estimate from the exact percentile."""
    return 2.0 ** (1.0 / CELLS_PER_OCTAVE) - 1.0


def finite(c: Column) -> Column:
    """``c`` as double; null for NaN and the infinities."""
    d = c.cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)  # NaN is greater than any value


def to_long(df: DataFrame, groups: Sequence[str], metrics: Sequence[str], extra: Sequence[str] = (), finite_only: bool = True) -> DataFrame:
    """``groups``, ``extra``, ``metric`` and ``value``: one row per finite value, or per value that is not null."""
    value = finite if finite_only else lambda c: c.cast("double")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), value(F.col(m)).alias("value")) for m in metrics])
    return df.select(*groups, *extra, F.explode(pairs).alias("_m")).select(*groups, *extra, "_m.metric", "_m.value").filter("value IS NOT NULL")


def _cell(v: Column) -> Column:
    """Cell number, ordered as the values; zero, NaN and the infinities have cells of their own."""
    # 1100 octaves keep the numbers of the smallest magnitudes above zero, 2200 lie above the greatest
    mag = F.floor(F.log2(F.abs(v)) * CELLS_PER_OCTAVE).cast("bigint") + F.lit(1100 * CELLS_PER_OCTAVE)
    end, inf = F.lit(2200 * CELLS_PER_OCTAVE).cast("bigint"), F.lit(float("inf"))
    return F.when(F.isnan(v), end + 1).when(v == inf, end).when(v == -inf, -end).when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0).cast("bigint"))


def summarize(long: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Cell counts: ``groups, metric, cell, n, lo, hi``; ``lo`` and ``hi`` are values of the cell."""
    return long.groupBy(*groups, "metric", _cell(F.col("value")).alias("cell")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def merge(summary: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds up summaries (their union) over all columns but ``groups``."""
    return summary.groupBy(*groups, "metric", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _targets(summary: DataFrame, groups: Sequence[str], permille: Sequence[int]) -> DataFrame:
    """One row per group, metric and percentile with the cell that holds its rank."""
    g = [*groups, "metric"]
    run = Window.partitionBy(*g).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*g)
    cum = summary.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(all_))
    q = cum.withColumn("permille", F.explode(F.array(*[F.lit(int(p)) for p in permille])))
    q = q.withColumn("rank", F.greatest(F.lit(1), F.expr("(total * permille + 999) div 1000")))
    held = q.filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    return held.select(*g, "permille", "total", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi")


def estimate(summary: DataFrame, groups: Sequence[str], permille: Sequence[int]) -> DataFrame:
    """Percentiles from merged summaries alone, within ``error_bound()``."""
    # the geometric middle of a cell's values of one sign
    mid = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.signum("lo") * F.sqrt(F.abs("lo")) * F.sqrt(F.abs("hi")))
    return _targets(summary, groups, permille).select(*groups, "metric", "permille", F.col("total").alias("n_values"), mid.alias("value"))


def _part(v: Column, lo: Column, hi: Column) -> Column:
    """Part of the interval that holds ``v``; its ends have one sign, so their difference is finite, and above zero."""
    return F.least(F.lit(PARTS - 1), F.floor((v - lo) / (hi - lo) * PARTS).cast("int"))


def bisect_percentiles(long: DataFrame, groups: Sequence[str], permille: Sequence[int], summary: DataFrame | None = None) -> DataFrame:
    """Exact percentiles ``groups, metric, permille, n_values, value``.

    ``long`` is read once per pass; hand in a written table.  ``summary`` are its
    cell counts where they exist already.
    """
    g = [*groups, "metric"]
    out = [*g, "permille", F.col("total").alias("n_values"), F.col("lo").alias("value")]
    state = materialize(_targets(merge(summary, groups) if summary is not None else summarize(long, groups), groups, permille))
    done = state.filter("lo = hi").select(*out)
    state = state.filter("lo < hi")
    while n := state.count():
        on = [F.col(f"x.{c}").eqNullSafe(F.col(f"s.{c}")) for c in g]
        x, s = long, F.broadcast(state)
        if n > BROADCAST_INTERVALS:
            x = long.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
            s = state.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
            on.append(F.col("x._salt") == F.col("s._salt"))
        within = on + [F.col("x.value") >= F.col("s.lo"), F.col("x.value") <= F.col("s.hi")]
        cond = within[0]
        for c in within[1:]:
            cond = cond & c
        parts = (
            x.alias("x").join(s.alias("s"), cond)
            .groupBy(*[F.col(f"s.{c}").alias(c) for c in g], "permille", "total", "rank", _part(F.col("x.value"), F.col("s.lo"), F.col("s.hi")).alias("part"))
            .agg(F.count("*").alias("n"), F.min("x.value").alias("lo"), F.max("x.value").alias("hi"))
        )
        run = Window.partitionBy(*g, "permille").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        held = parts.withColumn("upto", F.sum("n").over(run)).filter("rank <= upto AND rank > upto - n")
        state = materialize(held.select(*g, "permille", "total", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi"))
        done = done.unionByName(state.filter("lo = hi").select(*out))
        state = state.filter("lo < hi")
    return done
