"""Frame and block analytics on planes held as arrays.

A frame is one row ``clip, t, plane`` (row-major array of height x width
numbers).  Block statistics, neighbourhoods and pooling are array expressions
inside that row, so the only shuffle of the whole chain is the one that brings
a frame and its predecessor together, and that one is split into chunks of a
clip, so one clip may be as long as it likes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATIC, SHIFTED, NOVEL = 0, 1, 2
#: Frames of one clip that are ordered together.
CHUNK = 4096


def seq(n: int) -> Column:
    """0 .. n-1."""
    return F.sequence(F.lit(0), F.lit(n - 1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_previous(frames: DataFrame, name: str = "prev", chunk: int = CHUNK) -> DataFrame:
    """Adds the plane of frame ``t - 1`` (null for the first of a clip).

    ``t`` counts frames of a clip without gaps.  Chunks of a clip are shuffled
    apart; the last frame of a chunk goes to the next one too.
    """
    at = F.floor(F.col("t") / chunk)
    last = F.when((F.col("t") + 1) % chunk == 0, F.array(at, at + 1)).otherwise(F.array(at))
    spread = frames.withColumn("_chunk", F.explode(last))
    w = Window.partitionBy("clip", "_chunk").orderBy("t")
    return spread.withColumn(name, F.lag("plane").over(w)).filter(F.floor(F.col("t") / chunk) == F.col("_chunk")).drop("_chunk")


def abs_diff(a: str = "plane", b: str = "prev") -> Column:
    """Absolute difference of two planes, as doubles; null where one is missing."""
    return F.zip_with(F.col(a), F.col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))


def channel_mean(channels: Sequence[Column]) -> Column:
    """One plane from several channel planes by their mean."""
    total = channels[0]
    for c in channels[1:]:
        total = F.zip_with(total, c, lambda x, y: x + y)
    return F.transform(total, lambda x: x / float(len(channels)))


def block_values(plane: Column, width: int, height: int, block: int) -> Column:
    """Array (blocks, row-major) of arrays (values of the block); blocks that do not fill the plane are an error."""
    if width % block or height % block:
        raise ValueError("the block does not divide the plane")
    cols, rows = width // block, height // block

    def values(b: Column) -> Column:
        first = F.floor(b / cols) * (block * width) + (b % cols) * block
        return F.transform(seq(block * block), lambda k: F.element_at(plane, (first + F.floor(k / block) * width + k % block + 1).cast("int")))

    return F.transform(seq(rows * cols), values)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(values))


def max_abs(values: Column) -> Column:
    return F.array_max(values)


def changed_fraction(threshold: float) -> Callable[[Column], Column]:
    """Share of values strictly above ``threshold``."""
    return lambda values: F.size(F.filter(values, lambda x: x > threshold)) / F.size(values)


def top_k_mean(k: int) -> Callable[[Column], Column]:
    """Mean of the ``k`` greatest values, or of all if there are fewer."""
    return lambda values: mean(F.slice(F.sort_array(values, asc=False), 1, k))


STATISTICS: dict[str, Callable[..., Callable[[Column], Column] | Column]] = {"mean": mean, "max_abs": max_abs}


def block_scores(diff: Column, statistic: Callable[[Column], Column], width: int, height: int, block: int) -> Column:
    """Score per block, row-major, of a difference plane."""
    return F.transform(block_values(diff, width, height, block), statistic)


def classify(scores: Column, static: float, shifted: float) -> Column:
    """Class per block: below ``static``, below ``shifted``, else novel."""
    if shifted < static:
        raise ValueError("the shifted threshold is below the static one")
    return F.transform(scores, lambda s: F.when(s < static, STATIC).when(s < shifted, SHIFTED).otherwise(NOVEL))


def neighbour_max(grid: Column, cols: int, rows: int, reach: int = 1, include_self: bool = False) -> Column:
    """Greatest value among the neighbours within ``reach``; cells beyond the border do not exist."""

    cells = [
        [(r + dr) * cols + c + dc + 1 for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1) if (include_self or dr or dc) and 0 <= r + dr < rows and 0 <= c + dc < cols]
        for r in range(rows)
        for c in range(cols)
    ]
    table = F.array(*[F.array(*[F.lit(i) for i in near]) for near in cells])  # fixed by the grid's shape
    return let(grid, lambda g: F.transform(table, lambda near: F.array_max(F.transform(near, lambda i: F.try_element_at(g, i)))))


def quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of an array (null for an empty one)."""

    def at(s: Column) -> Column:
        h = (F.size(s) - 1) * F.lit(q)
        lo = F.floor(h)
        a = F.try_element_at(s, (lo + 1).cast("int"))
        b = F.try_element_at(s, F.least(lo + 2, F.size(s).cast("bigint")).cast("int"))
        return a + (b - a) * (h - lo)

    return let(F.sort_array(values), at)


def halo_veto(classes: Column, scores: Column, cols: int, rows: int, percentile: float, reach: int = 1) -> Column:
    """Static blocks next to a score above the frame's quantile become novel."""

    def veto(s: Column) -> Column:
        near = neighbour_max(s, cols, rows, reach)
        return let(quantile(s, percentile), lambda limit: F.zip_with(classes, near, lambda c, n: F.when((c == STATIC) & (n > limit), NOVEL).otherwise(c)))

    return let(scores, veto)


def count_class(classes: Column, k: int) -> Column:
    return F.size(F.filter(classes, lambda c: c == k))


def ratio(part: Column, total: Column) -> Column:
    """``part / total``, 0 where the total is 0."""
    return F.when(total == 0, 0.0).otherwise(part / total)


def class_summary(classes: Column) -> list[Column]:
    """Counts per class and the reused and novel ratios of a class grid."""
    n = F.size(classes)
    s, m, v = (count_class(classes, k) for k in (STATIC, SHIFTED, NOVEL))
    return [s.alias("n_static"), m.alias("n_shifted"), v.alias("n_novel"), ratio(s + m, n).alias("reused_ratio"), ratio(v, n).alias("novel_ratio")]


def pool(plane: Column, width: int, height: int, cols: int, rows: int) -> Column:
    """Mean-pools a plane to a ``rows`` x ``cols`` grid that divides it."""
    if width % cols or height % rows:
        raise ValueError("the grid does not divide the plane")
    bw, bh = width // cols, height // rows

    def cell(i: Column) -> Column:
        first = F.floor(i / cols) * (bh * width) + (i % cols) * bw
        return mean(F.transform(seq(bw * bh), lambda k: F.element_at(plane, (first + F.floor(k / bw) * width + k % bw + 1).cast("int")).cast("double")))

    return F.transform(seq(rows * cols), cell)


def overlap_table(spark, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """``cell, token, area``: overlap of every source cell with every target cell of the unit square.

    Its size is that of the two grids, whatever the number of frames.
    """
    (sr, sc), (dr, dc) = src, dst
    rows = [
        (i * sc + j, k * dc + m, h * w)
        for i in range(sr)
        for k in range(dr)
        if (h := min((i + 1) / sr, (k + 1) / dr) - max(i / sr, k / dr)) > 1e-12
        for j in range(sc)
        for m in range(dc)
        if (w := min((j + 1) / sc, (m + 1) / dc) - max(j / sc, m / dc)) > 1e-12
    ]
    return spark.createDataFrame(rows, "cell int, token int, area double")


def area_mean(frames: DataFrame, grid: str, overlaps: DataFrame) -> DataFrame:
    """``clip, t, token, value``: area-weighted means of a grid column on the target grid."""
    cells = frames.select("clip", "t", F.posexplode(grid).alias("cell", "v")).join(F.broadcast(overlaps), "cell")
    return cells.groupBy("clip", "t", "token").agg((F.sum(F.col("v") * F.col("area")) / F.sum("area")).alias("value"))


def touched_mean(frames: DataFrame, grid: str, overlaps: DataFrame) -> DataFrame:
    """As ``area_mean`` but every touched cell weighs alike."""
    cells = frames.select("clip", "t", F.posexplode(grid).alias("cell", "v")).join(F.broadcast(overlaps), "cell")
    return cells.groupBy("clip", "t", "token").agg(F.avg("v").alias("value"))


def area_majority(frames: DataFrame, grid: str, overlaps: DataFrame) -> DataFrame:
    """``clip, t, token, cls``: the class with the greatest area; ties go to the higher class."""
    cells = frames.select("clip", "t", F.posexplode(grid).alias("cell", "cls")).join(F.broadcast(overlaps), "cell")
    area = cells.groupBy("clip", "t", "token", "cls").agg(F.round(F.sum("area"), 9).alias("area"))
    return area.groupBy("clip", "t", "token").agg(F.max(F.struct("area", "cls"))["cls"].alias("cls"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; null where a norm is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / n)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def shifted_residual(cur: Column, prev: Column, width: int, height: int, block: int, dx: int, dy: int) -> Column:
    """Mean absolute residual per block against the previous plane moved by (dx, dy), borders held."""

    def moved(p: Column) -> Column:
        order = [(min(max(y + dy, 0), height - 1)) * width + min(max(x + dx, 0), width - 1) + 1 for y in range(height) for x in range(width)]
        return F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.element_at(p, i))

    diff = let(prev, lambda p: F.zip_with(cur, moved(p), lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return F.transform(block_values(diff, width, height, block), mean)


def bicubic(frames: DataFrame, grid: str, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """``clip, t, plane``: a grid resized by the cubic kernel (a = -0.5), borders held.

    The weights depend on the shapes alone, so a batch of frames is one matrix
    product.
    """
    import numpy as np
    import pandas as pd

    def weights(n: int, m: int) -> np.ndarray:
        out = np.zeros((m, n))
        for i in range(m):
            x = (i + 0.5) * n / m - 0.5
            for k in range(int(np.floor(x)) - 1, int(np.floor(x)) + 3):
                d = abs(x - k)
                w = (1.5 * d - 2.5) * d * d + 1 if d <= 1 else ((-0.5 * d + 2.5) * d - 4) * d + 2 if d < 2 else 0.0
                out[i, min(max(k, 0), n - 1)] += w
        return out

    both = np.kron(weights(src[0], dst[0]), weights(src[1], dst[1]))
    s = frames.select("clip", "t", grid)

    def run(batches):
        for pdf in batches:
            x = np.array(pdf[grid].tolist(), float).reshape(len(pdf), -1)
            yield pd.DataFrame({"clip": pdf["clip"], "t": pdf["t"], "plane": list(x @ both.T) if len(pdf) else []})

    return s.mapInPandas(run, f"clip {s.schema['clip'].dataType.simpleString()}, t bigint, plane array<double>")
