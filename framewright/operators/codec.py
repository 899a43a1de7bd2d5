"""Codec metadata: macroblocks, packets, geometry and index plans as column expressions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.frames import NOVEL, SHIFTED, STATIC

#: Partition kinds by the greatest sub-block of a macroblock.
PARTITIONS = {"16x16": 0, "16x8": 1, "8x16": 2, "8x8": 3, "sub8x8": 4}


def partition_type(width: Column, height: Column) -> Column:
    """Kind of a macroblock by its greatest sub-block dimensions."""
    return (
        F.when((width >= 16) & (height >= 16), PARTITIONS["16x16"]).when((width >= 16) & (height >= 8), PARTITIONS["16x8"])
        .when((width >= 8) & (height >= 16), PARTITIONS["8x16"]).when((width >= 8) & (height >= 8), PARTITIONS["8x8"]).otherwise(PARTITIONS["sub8x8"])
    )


def macroblocks(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Area-weighted mean motion vector, magnitude and partition of each macroblock.

    ``vectors``: ``keys`` and ``dx, dy, w, h`` of every sub-block; rows without
    an area count nothing; a macroblock without any has null vectors.
    """
    area = F.col("w") * F.col("h")
    total = F.nullif(F.sum(area), F.lit(0))
    g = vectors.groupBy(*keys).agg((F.sum(F.col("dx") * area) / total).alias("mv_x"), (F.sum(F.col("dy") * area) / total).alias("mv_y"), partition_type(F.max("w"), F.max("h")).alias("partition_type"))
    return g.withColumn("mv_magnitude", F.hypot("mv_x", "mv_y"))


def best_direction(forward: Column, backward: Column) -> Column:
    """Residual of both directions: the lesser one, where both exist."""
    return F.least(forward, backward)


def macroblock_flags(residual: Column, magnitude: Column, cbf_at: float, still: float) -> tuple[Column, Column]:
    """Whether residual is coded, and whether the block is skipped (nothing coded and no motion)."""
    cbf = F.coalesce(residual > cbf_at, F.lit(True))
    return cbf, ~cbf & F.coalesce(magnitude <= still, F.lit(False))


def classify_macroblock(skip: Column, cbf: Column, intra: Column) -> Column:
    """Skipped is static; coded or intra is novel; the rest is shifted."""
    return F.when(skip, STATIC).when(cbf | intra, NOVEL).otherwise(SHIFTED)


def mean_key_size(size: Column, kind: Column, key: Column) -> Column:
    """Mean size of intra frames with a positive size; 0 without any."""
    return F.coalesce(F.avg(F.when((size > 0) & (key | (kind == "I")), size)), F.lit(0.0))


def early_exit(size: Column, key: Column, kind: Column, mean_key: Column, share: float = 0.02) -> Column:
    """``ALL_STATIC`` for inter frames that are tiny beside the mean intra frame, else null."""
    return F.when(~key & (kind != "I") & (mean_key > 0) & (size / mean_key < share), "ALL_STATIC")


def resized(width: Column, height: Column, longest: int, multiple: int) -> tuple[Column, Column]:
    """Dimensions of an aspect-keeping resize, rounded (half to even) to multiples of a block, at least one."""
    scale = F.lit(float(longest)) / F.greatest(width, height)
    side = lambda x: (F.greatest(F.lit(1), F.bround(x * scale / multiple)) * multiple).cast("int")
    return side(width), side(height)


def letterbox(width: Column, height: Column, side: int) -> list[Column]:
    """Box ``left, top, right, bottom`` of an image scaled into a square and centred."""
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    w, h = F.bround(width * scale).cast("int"), F.bround(height * scale).cast("int")
    left, top = F.floor((side - w) / 2).cast("int"), F.floor((side - h) / 2).cast("int")
    return [left.alias("left"), top.alias("top"), (left + w).alias("right"), (top + h).alias("bottom")]


def block_inside(row: Column, col: Column, block: int, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Whether a block lies fully inside a box."""
    return (col * block >= left) & (row * block >= top) & ((col + 1) * block <= right) & ((row + 1) * block <= bottom)


def token_index(x: Column, y: Column, k: int, cols: int) -> Column:
    """Token of a patch where ``k`` x ``k`` patches make one."""
    stride = -(-cols // k)
    return (F.floor(x / k) + stride * F.floor(y / k)).cast("int")


def keep_rate(q: Column, duration: Column, base: float, follow: float, overrides: dict[str, float]) -> Column:
    """Keep rate of a query: 1 for none to prune, an override by duration, else by position."""
    for v in (base, follow, *overrides.values()):
        if not 0 < v <= 1:
            raise ValueError("a keep rate lies in (0, 1]")
    by = F.lit(None).cast("double")
    for name, v in overrides.items():
        by = F.when(duration == name, v).otherwise(by)
    return F.when(q == 0, base).otherwise(F.coalesce(by, F.lit(follow)))


def components(frames: DataFrame, mask: str, cols: int) -> DataFrame:
    """``clip, t, n_components, largest_share``: 4-connected components of a boolean grid.

    A grid is one array in one row, so it needs no other row.
    """
    src = frames.select("clip", "t", mask)
    clip = src.schema["clip"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for grid in pdf[mask]:
                todo = {i for i, v in enumerate(grid) if v}
                total, sizes = len(todo), []
                while todo:
                    queue, n = deque([todo.pop()]), 0
                    while queue:
                        i = queue.popleft()
                        n += 1
                        for j in (i - cols, i + cols, i - 1 if i % cols else -1, i + 1 if i % cols < cols - 1 else -1):
                            if j in todo:
                                todo.remove(j)
                                queue.append(j)
                    sizes.append(n)
                out.append((len(sizes), max(sizes) / total if sizes else 0.0))
            yield pd.DataFrame({"clip": pdf["clip"], "t": pdf["t"], "n_components": [o[0] for o in out], "largest_share": [o[1] for o in out]})

    return src.mapInPandas(run, f"clip {clip}, t bigint, n_components int, largest_share double")


def masked_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two boolean columns over a group; 1 where both are empty."""
    both, either = F.count_if(a & b), F.count_if(a | b)
    return F.when(either == 0, 1.0).otherwise(both / either)


def weighted_mean(mean: Column, n: Column) -> Column:
    """Mean of means by their counts; null without any."""
    return F.sum(F.when(mean.isNotNull(), mean * n)) / F.nullif(F.sum(F.when(mean.isNotNull(), n)), F.lit(0))


def one_value(c: Column) -> Column:
    """The value of a group if there is only one, else null."""
    return F.when(F.count_distinct(c) == 1, F.min(c))
