"""Problem 2: differences between two copies of a table.

A checksum matrix (key bucket x column) is aggregated for each copy.  A cell is
two sums of 40-bit parts of independent hashes of (key, value) per row, so it is
additive over partitions and blind to row order.  The first matrix has coarse
buckets, whose rows combine on the map side.  Where most of its buckets are
equal, a second one with buckets of a few rows is made of the unequal ones.  Only
buckets with an unequal cell are read again and joined, and of those only the
columns with an unequal cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.storage import materialize

#: Rows of a bucket, of the first and the second matrix.
COARSE, FINE = 256, 4
#: Up to this share of unequal coarse buckets a second matrix is made.
SPARSE = 0.5
#: Bits of a hash that a sum takes: 2^23 rows of a bucket cannot overflow it.
BITS = (1 << 40) - 1


def latest(df: DataFrame, keys: Mapping[str, Column], values: Mapping[str, Column], version: str) -> DataFrame:
    """The current row of each key: greatest ``version`` (nulls are oldest).

    Rows equal in key and version are settled by the greatest values, so the
    result does not depend on row order.  ``max`` over a struct combines on the
    map side, hence a hot key costs no more than any other.
    """
    cols = {**{f"k_{k}": c for k, c in keys.items()}, **{f"v_{k}": c for k, c in values.items()}}
    flat = df.select(*[c.alias(n) for n, c in cols.items()], F.col(version).alias("_at"))
    row = F.struct("_at", *[F.col(f"v_{v}") for v in values])
    got = flat.groupBy(*[f"k_{k}" for k in keys]).agg(F.max(row).alias("_r"))
    return got.select(*[f"k_{k}" for k in keys], *[F.col(f"_r.v_{v}").alias(f"v_{v}") for v in values])


def _with_bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn("_b", F.pmod(F.xxhash64(*[F.col(f"k_{k}") for k in keys]), F.lit(buckets)))


def checksum_matrix(df: DataFrame, keys: Sequence[str], values: Sequence[str], buckets: int) -> DataFrame:
    """One row per bucket with the row count ``n`` and per column two additive checksums."""
    key = [F.col(f"k_{k}") for k in keys]

    def wide(seed: int, *cols: Column) -> Column:
        # a null differs from every value: its presence is hashed too
        parts = [x for c in cols for x in (c.isNull(), c)]
        return F.sum(F.xxhash64(F.lit(seed), *parts).bitwiseAND(F.lit(BITS)))

    cells = [F.count("*").alias("n"), wide(1, *key).alias("c_"), wide(2, *key).alias("d_")]
    for v in values:
        cells += [wide(3, *key, F.col(f"v_{v}")).alias(f"c_{v}"), wide(4, *key, F.col(f"v_{v}")).alias(f"d_{v}")]
    return _with_bucket(df, keys, buckets).groupBy("_b").agg(*cells)


def unequal_buckets(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], buckets: int) -> DataFrame:
    """``_b, _cells``: buckets whose checksums differ, with the columns that do (the empty name: the keys)."""
    cells = ["", *values]
    a, b = (checksum_matrix(d, keys, values, buckets).alias(n) for d, n in ((left, "a"), (right, "b")))
    unequal = {c: ~(F.col(f"a.c_{c}").eqNullSafe(F.col(f"b.c_{c}")) & F.col(f"a.d_{c}").eqNullSafe(F.col(f"b.d_{c}"))) for c in cells}
    flags = F.filter(F.array(*[F.when(unequal[c], F.lit(c)) for c in cells]), lambda x: x.isNotNull())
    return a.join(b, F.col("a._b") == F.col("b._b"), "full_outer").select(F.coalesce("a._b", "b._b").alias("_b"), flags.alias("_cells")).filter(F.size("_cells") > 0)


def copy_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], names: tuple[str, str], rows: tuple[int, int] = (COARSE, FINE)) -> DataFrame:
    """Rows missing on either side and unequal fields of rows on both.

    ``left`` and ``right`` come from ``latest``: columns ``k_*`` and ``v_*``, one
    row per key.  ``rows``: rows of a coarse and of a fine bucket.  Returns
    ``k_*`` and ``difference``, which is ``missing_in_<name>`` or the name of a
    value column.  Null equals null and differs from any value, in keys too.
    Equal copies give no rows; an empty copy lacks every key.
    """
    left, right = materialize(left), materialize(right)
    most = max(left.count(), right.count())  # from the Parquet footers
    buckets = max(16, most // rows[0])
    hot = materialize(unequal_buckets(left, right, keys, values, buckets))
    if hot.count() <= SPARSE * buckets:
        fine = max(buckets, most // rows[1])
        few = [_with_bucket(d, keys, buckets).join(hot.select("_b"), "_b", "left_semi").drop("_b") for d in (left, right)]
        hot, buckets = materialize(unequal_buckets(*few, keys, values, fine)), fine

    def read(df: DataFrame, side: str) -> DataFrame:
        # a column that is equal in a bucket is neither moved nor compared
        d = _with_bucket(df, keys, buckets).join(hot, "_b")
        held = [F.when(F.array_contains("_cells", v), F.col(f"v_{v}")).alias(f"{side}v_{v}") for v in values]
        return d.select(*[F.col(f"k_{k}").alias(f"{side}k_{k}") for k in keys], *held, F.lit(1).alias(f"{side}in"))

    x, y = read(left, "l_"), read(right, "r_")
    on = None
    for k in keys:
        c = F.col(f"l_k_{k}").eqNullSafe(F.col(f"r_k_{k}"))
        on = c if on is None else on & c
    j = x.join(y, on, "full_outer")
    differing = F.filter(F.array(*[F.when(~F.col(f"l_v_{v}").eqNullSafe(F.col(f"r_v_{v}")), F.lit(v)) for v in values]), lambda c: c.isNotNull())
    what = F.when(F.col("l_in").isNull(), F.array(F.lit(f"missing_in_{names[0]}"))).when(F.col("r_in").isNull(), F.array(F.lit(f"missing_in_{names[1]}"))).otherwise(differing)
    out = [F.when(F.col("l_in").isNull(), F.col(f"r_k_{k}")).otherwise(F.col(f"l_k_{k}")).alias(f"k_{k}") for k in keys]
    return j.select(*out, F.explode(what).alias("difference"))
