"""Sequence operators: prefixes, spans, islands, cut plans, session windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays; null if one is null."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.slice(same, 1, F.greatest(n, F.lit(1))), False)
    length = F.when(n == 0, 0).when(first > 0, (first - 1).cast("int")).otherwise(n)
    return F.when(a.isNotNull() & b.isNotNull(), length)


def gaps(time: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Time since the row before, null for the first."""
    return time - F.lag(time).over(Window.partitionBy(*keys).orderBy(*order))


#: Numbers of an ordering column that are numbered together: a task holds as many distinct ones at most.
STRETCH = 1 << 16


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """``df`` plus ``name``: the place (from 0) of a row in its key by the whole number ``order``.

    A key is numbered in stretches of ``order``; the counts of the stretches
    before are added, so a key of any length spreads over the tasks.
    """
    d = df.withColumn("_at", F.floor(F.col(order) / stretch))
    n = d.groupBy(*keys, "_at").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_at").alias("_to"), before.alias("_before"))
    on = F.col("_at").eqNullSafe(F.col("_to"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_at").orderBy(order)) - 1 + F.col("_before")
    return d.join(n, on).withColumn(name, place.cast("bigint")).select(*df.columns, name)


def sessions(df: DataFrame, keys: Sequence[str], seconds: str, gap: float, order: Sequence[str]) -> DataFrame:
    """Numbers the sessions of a key (``session``, from 0): a pause longer than ``gap`` begins one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.col(seconds) - F.lag(seconds).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def turn_buckets(df: DataFrame, keys: Sequence[str], turn: str, size: int, metrics: Sequence[Column]) -> DataFrame:
    """Tumbling buckets of a turn number; empty ones have no row."""
    return df.groupBy(*keys, F.floor(F.col(turn) / size).alias("bucket")).agg(F.count("*").alias("n"), *metrics)


def spans(df: DataFrame, keys: Sequence[str], at: str, stretch: int = STRETCH) -> DataFrame:
    """``span_from``, ``span_to``: from after the sample before to the sample itself.

    ``at`` are whole numbers.  The samples of a key are ordered in stretches; the
    greatest of the stretches before goes to the first of the next.
    """
    d = df.withColumn("_at", F.floor(F.col(at) / stretch))
    ends = d.groupBy(*keys, "_at").agg(F.max(at).alias("_end"))
    last = F.max("_end").over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_at").alias("_to"), last.alias("_last"))
    on = F.col("_at").eqNullSafe(F.col("_to"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    before = F.coalesce(F.lag(at).over(Window.partitionBy(*keys, "_at").orderBy(at)), F.col("_last"))
    return d.join(ends, on).withColumns({"span_from": F.coalesce(before + 1, F.col(at)), "span_to": F.col(at)}).select(*df.columns, "span_from", "span_to")


def offsets(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: str) -> DataFrame:
    """``start`` and ``end`` of consecutive segments; lengths that are not positive are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.filter(F.col(length) > 0).withColumn("end", F.sum(length).over(w))
    return d.withColumn("start", F.col("end") - F.col(length))


def cut_plan(segments: DataFrame, keys: Sequence[str], keep_last: int) -> DataFrame:
    """``keys, cut, total``: tokens kept as a prefix if the last ``keep_last`` segments are made anew.

    ``segments`` come from ``offsets``.  With fewer segments the cut is 0.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("end"))
    d = segments.withColumn("_i", F.row_number().over(w))
    cut = F.max(F.when(F.col("_i") == keep_last, F.col("start"))) if keep_last else F.max("end")
    return d.groupBy(*keys).agg(F.coalesce(cut, F.lit(0)).alias("cut"), F.max("end").alias("total"))


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``keys, value, start, length`` of maximal runs of equal values; ``order`` begins with a position."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    d = df.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min(order[0]).alias("start"), F.count("*").alias("length")).drop("_run")


def window_join(events: DataFrame, points: DataFrame, keys: Sequence[str], at: str, point: str, length: float) -> DataFrame:
    """Events within ``length`` before each point: an interval join by time buckets.

    Both sides get the bucket ``floor(time / length)``; a point looks into its
    own bucket and the one before, so the join is an equi-join, and a hot key is
    split by its buckets.
    """
    e = events.withColumn("_b", F.floor(F.col(at) / length))
    p = points.withColumn("_b", F.explode(F.array(F.floor(F.col(point) / length), F.floor(F.col(point) / length) - 1)))
    return p.join(e, [*keys, "_b"]).filter((F.col(at) <= F.col(point)) & (F.col(at) > F.col(point) - length)).drop("_b")


def sequence_digest(df: DataFrame, keys: Sequence[str], index: str, value: Column, chunk: int = 1024) -> DataFrame:
    """``keys, n, digest``: an order-dependent SHA-256 of a sequence of any length.

    ``index`` counts from 0 without gaps.  Chunks are hashed on their own, then
    the hashes of the chunks in order, so no task holds a whole sequence.
    """
    part = df.select(*keys, F.floor(F.col(index) / chunk).alias("_c"), F.struct(F.col(index), value.alias("_v")).alias("_s"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["_v"]), "|"), 256)
    chunks = part.groupBy(*keys, "_c").agg(joined("_s").alias("_h"), F.count("*").alias("_n"))
    return chunks.groupBy(*keys).agg(F.sum("_n").alias("n"), joined(F.struct("_c", F.col("_h").alias("_v"))).alias("digest"))


def assign_segments(positions: DataFrame, segments: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Adds the ``start`` of the segment that holds each position; positions outside have none.

    Starts and positions go through one sorted window per key.
    """
    cols = positions.columns
    p = positions.select("*", F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("_end"), F.lit(1).alias("_side"), F.col(position).cast("bigint").alias("_at"))
    s = segments.select(*[F.col(c) if c in keys else F.lit(None).cast(positions.schema[c].dataType).alias(c) for c in cols], F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("_end"), F.lit(0).alias("_side"), F.col("start").cast("bigint").alias("_at"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    d = p.unionByName(s).select(*cols, "_side", "_at", F.last("start", ignorenulls=True).over(w).alias("_s"), F.last("_end", ignorenulls=True).over(w).alias("_e"))
    return d.filter("_side = 1").select(*cols, F.when(F.col("_at") < F.col("_e"), F.col("_s")).alias("start"))
