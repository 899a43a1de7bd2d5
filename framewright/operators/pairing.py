"""Pairing of runs: strict and lenient joins, agreement, set overlap, quotas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_key(a: str, b: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of key columns of two aliased tables."""
    on = None
    for k in keys:
        c = F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        on = c if on is None else on & c
    return on


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of more than one row, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, then by all other columns.

    A map-side maximum, so a hot key costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the least by ``order``."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def pairing_errors(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What keeps two tables from strict 1:1 pairing: ``keys, error``.

    ``error`` is ``duplicate_left``, ``duplicate_right``, ``missing_left`` or
    ``missing_right``; no rows: they pair.
    """
    a = left.groupBy(*keys).agg(F.count("*").alias("_n")).alias("a")
    b = right.groupBy(*keys).agg(F.count("*").alias("_m")).alias("b")
    j = a.join(b, same_key("a", "b", keys), "full_outer")
    errors = F.array_compact(F.array(F.when(F.col("_n") > 1, "duplicate_left"), F.when(F.col("_m") > 1, "duplicate_right"), F.when(F.col("_n").isNull(), "missing_left"), F.when(F.col("_m").isNull(), "missing_right")))
    return j.select(*[F.when(F.col("_n").isNull(), F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys], F.explode(errors).alias("error"))


def strict_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """1:1 pairs with the other columns prefixed by ``names``; raises if the tables don't pair."""
    if bad := pairing_errors(left, right, keys).take(5):
        raise ValueError(f"no strict pairing: {[tuple(r) for r in bad]}")
    return inner_pairs(left, right, keys, names)


def inner_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("a", "b"), how: str = "inner") -> DataFrame:
    """Pairs over keys of both; the other columns are prefixed by ``names``, so none clash."""
    x = left.select(*[F.col(k).alias(f"_x_{k}") for k in keys], *[F.col(c).alias(f"{names[0]}_{c}") for c in left.columns if c not in keys], F.lit(1).alias("_in"))
    y = right.select(*[F.col(k).alias(f"_y_{k}") for k in keys], *[F.col(c).alias(f"{names[1]}_{c}") for c in right.columns if c not in keys])
    on = None
    for k in keys:
        c = F.col(f"_x_{k}").eqNullSafe(F.col(f"_y_{k}"))
        on = c if on is None else on & c
    j = x.join(y, on, how)
    return j.select(*[F.when(F.col("_in").isNull(), F.col(f"_y_{k}")).otherwise(F.col(f"_x_{k}")).alias(k) for k in keys], *[c for c in j.columns if not c.startswith(("_x_", "_y_", "_in"))])


def overlap_stats(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: sizes, intersection, union, differences and Jaccard (1 for two empty sets)."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)).alias("a"), right.select(*keys).distinct().withColumn("_r", F.lit(1)).alias("b")
    j = a.join(b, same_key("a", "b", keys), "full_outer").agg(F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("n_both"), F.count("*").alias("n_union"))
    return j.select("*", (F.col("n_left") - F.col("n_both")).alias("left_only"), (F.col("n_right") - F.col("n_both")).alias("right_only"), F.when(F.col("n_union") == 0, 1.0).otherwise(F.col("n_both") / F.col("n_union")).alias("jaccard"))


def confusion(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Counts of both right, only one right and both wrong; a null counts as wrong."""
    x, y = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(x & y).alias("both_right"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("both_wrong"))


def slices(metrics: Mapping[str, Column], predicates: Mapping[str, Column]) -> list[Column]:
    """Every metric for every slice in one pass: ``<slice>_<metric>`` columns.

    A metric is a column whose mean is taken where the slice's predicate holds.
    """
    return [F.avg(F.when(p, m.cast("double"))).alias(f"{s}_{n}") for s, p in predicates.items() for n, m in metrics.items()]


def as_of_floor(left: DataFrame, right: DataFrame, budget: str, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the ``value`` of the greatest ``key`` not above ``budget``, else of the least ``key``.

    ``right`` holds one row per ``by`` and ``key``.  Both sides go through one
    sorted window per ``by``: no range join, no broadcast.
    """
    cols = left.columns
    l = left.select("*", F.col(budget).cast("double").alias("_at"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    r = right.select(*[F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in by else F.col(c) for c in cols], F.col(key).cast("double").alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    parts = list(by) or [F.lit(0)]
    w = Window.partitionBy(*parts).orderBy("_at", "_side")
    least = F.min(F.when((F.col("_side") == 0), F.struct("_at", "_v"))).over(Window.partitionBy(*parts))["_v"]
    return l.unionByName(r).withColumn("_f", F.coalesce(F.last("_v", ignorenulls=True).over(w), least)).filter("_side = 1").select(*cols, F.col("_f").alias(value))
