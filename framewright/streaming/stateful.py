"""Structured Streaming twins of the sequential operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewright.storage import shared_path


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming table over what its sources hold now and returns the result.

    Append mode writes Parquet with exactly-once commits.  Complete mode
    replaces the result in every batch.
    """
    spark = stream.sparkSession
    at = shared_path(spark, "stream")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", f"{at}/out").start()
    else:
        q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def reuse_stream(blocks: DataFrame, sticky: int | None = None, refresh: int | None = None, max_age: int | None = None) -> DataFrame:
    """The reuse rules on a live stream of ``clip, t, b, r``; agrees with ``reuse.reuse_states``.

    State per (clip, block): last frame, age, latch with its window and epoch,
    source frame.  A frame not after the last one of its block is late and
    dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, age, latched, win, epoch, src = state.get if state.exists else (0, 0, False, 0, 0, 0)
        out = []
        for t, r in sorted((int(t), bool(r)) for pdf in batches for t, r in zip(pdf["t"], pdf["r"].fillna(False))):
            if t <= last:
                continue
            last = t
            e, w = (t // refresh if refresh else 0), (t // sticky if sticky else 0)
            if e != epoch or w != win:
                latched = False
            if e != epoch:
                age = 0
            epoch, win = e, w
            fresh_now = bool(refresh) and t % refresh == 0
            eff = r and not fresh_now
            if sticky and not fresh_now:
                latched = latched or not r
                eff = eff and not latched
            allowed = eff and (max_age is None or age < max_age)
            age = age + 1 if allowed else 0
            src = src if allowed else t
            out.append((key[0], t, key[1], eff, allowed, src))
        state.update((last, age, latched, win, epoch, src))
        yield pd.DataFrame(out, columns=["clip", "t", "b", "eff", "allowed", "src"])

    clip = blocks.schema["clip"].dataType.simpleString()
    return blocks.select("clip", "t", "b", "r").groupBy("clip", "b").applyInPandasWithState(step, f"clip {clip}, t bigint, b int, eff boolean, allowed boolean, src bigint", "last bigint, age bigint, latched boolean, win bigint, epoch bigint, src bigint", "append", GroupStateTimeout.NoTimeout)


def prefix_stream(prompts: DataFrame, reset_every: int | None = None) -> DataFrame:
    """``session, q, hit, recomputed``: tokens shared with the session's prompt before.

    ``prompts``: ``session, q, tokens`` (array of bigint).  ``reset_every`` clears
    the state at every so many queries (1: no reuse at all).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, before = state.get if state.exists else (-1, [])
        out = []
        for q, toks in sorted(((int(q), list(t)) for pdf in batches for q, t in zip(pdf["q"], pdf["tokens"])), key=lambda x: x[0]):
            if q <= last:
                continue
            if reset_every and q % reset_every == 0:
                before = []
            hit = 0
            while hit < min(len(toks), len(before)) and toks[hit] == before[hit]:
                hit += 1
            out.append((key[0], q, hit, len(toks) - hit))
            last, before = q, toks
        state.update((last, [int(x) for x in before]))
        yield pd.DataFrame(out, columns=["session", "q", "hit", "recomputed"])

    s = prompts.schema["session"].dataType.simpleString()
    return prompts.groupBy("session").applyInPandasWithState(step, f"session {s}, q bigint, hit bigint, recomputed bigint", "last bigint, before array<bigint>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window; rows later than the watermark are dropped from closed windows."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), key, "n", "total")
