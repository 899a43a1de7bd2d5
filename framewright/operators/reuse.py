"""Temporal reuse of blocks: refresh, sticky latch, age gate and their metrics.

The sequential rules have closed forms over windows.  For one block, frame
``t`` counted from 1 and ``r`` whether its class may be reused:

* epoch = t div refresh; a refresh frame is fresh and resets all state;
* sticky: reusable only while no frame of the same window (t div sticky) and
  epoch was fresh before it;
* age gate: in a run of reusable frames every (max_age + 1)-th is fresh.

All windows share the partitioning by (clip, block), so one shuffle serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reuse_states(blocks: DataFrame, sticky: int | None = None, refresh: int | None = None, max_age: int | None = None) -> DataFrame:
    """Adds ``eff`` (reusable), ``allowed`` (reused) and ``src`` (frame the content comes from).

    ``blocks``: ``clip, t, b, r`` with t = 1, 2, ... per (clip, b); frame 0 is
    always fresh and not part of the input.  A null ``r`` counts as fresh.
    """
    for name, v in (("sticky", sticky), ("refresh", refresh), ("max_age", max_age)):
        if v is not None and v < 1:
            raise ValueError(f"{name} must be positive")
    key = ["clip", "b"]
    d = blocks.repartition("clip", "b").withColumn("_r", F.coalesce("r", F.lit(False)))
    t = F.col("t")
    d = d.withColumn("_epoch", F.floor(t / refresh) if refresh else F.lit(0).cast("bigint"))
    at_refresh = (t % refresh == 0) if refresh else F.lit(False)
    eff = F.col("_r") & ~at_refresh
    if sticky:
        d = d.withColumn("_win", F.floor(t / sticky))
        latch = F.max(~F.col("_r") & ~at_refresh).over(Window.partitionBy(*key, "_epoch", "_win").orderBy("t"))
        eff = eff & ~latch
    d = d.withColumn("eff", eff)
    run = Window.partitionBy(*key).orderBy("t")
    d = d.withColumn("_island", F.sum((~F.col("eff")).cast("int")).over(run))
    pos = F.row_number().over(Window.partitionBy(*key, "_island").orderBy("t")) - F.when(F.col("_island") > 0, 1).otherwise(0)
    d = d.withColumn("_pos", pos)
    allowed = F.col("eff") & (F.col("_pos") % (max_age + 1) != 0 if max_age is not None else F.lit(True))
    d = d.withColumn("allowed", allowed)
    src = F.coalesce(F.last(F.when(~F.col("allowed"), t), ignorenulls=True).over(run), F.lit(0).cast("bigint"))
    return d.withColumn("src", src).drop("_r", "_epoch", "_win", "_island", "_pos")


def longest_run(states: DataFrame, flag: str = "allowed") -> DataFrame:
    """``clip, b, longest``: frames of the longest run with ``flag``; 0 where it never holds."""
    w = Window.partitionBy("clip", "b").orderBy("t")
    runs = states.withColumn("_i", F.sum((~F.col(flag)).cast("int")).over(w)).groupBy("clip", "b", "_i").agg(F.count_if(F.col(flag)).alias("n"))
    return runs.groupBy("clip", "b").agg(F.max("n").alias("longest"))


def effective_fresh(n_frames: Column, reuse: Column) -> Column:
    """Frames' worth of fresh content: 1 + (n - 1)(1 - reuse); n itself for at most one frame."""
    return F.when(n_frames <= 1, n_frames.cast("double")).otherwise(1 + (n_frames - 1) * (1 - reuse))


def entropy(count: str, keys: list[str]) -> tuple[Column, Column]:
    """Share of a count within ``keys`` and the term of its natural entropy."""
    p = F.col(count) / F.sum(count).over(Window.partitionBy(*keys))
    return p, F.when(p > 0, -p * F.ln(p)).otherwise(0.0)
