"""Problem 7: filling containers of fixed capacity with texts.

Bounded-space online best-fit: items come in order of their id, at most
``OPEN`` containers are open, kept in a bitset keyed by free space.  An item
goes to the open container with the least sufficient space; if none has it and
all are open, the fullest closes.  Shards pack independently; what their open
containers hold at the end is packed again as whole items, many shards in one
task, so sharding costs next to no space.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.storage import materialize

#: Containers open at a time.
OPEN = 64
#: Tokens that one packing task takes, and open containers that one task of the second round takes.
TOKENS_PER_SHARD = 4_000_000
LEFT_PER_TASK = 50_000

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern published with this vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a rank file; one per Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` without its text, plus ``n_tokens`` (0 for null and empty texts)."""
    keep = [c for c in docs.columns if c != text]
    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return docs.select(*keep, text).mapInArrow(run, ddl)


def best_fit(sizes: Iterable[int], capacity: int, open_bins: int = OPEN) -> tuple[list[int], list[int], set[int]]:
    """Container and offset of each item, and the containers still open at the end.

    Sizes are between 0 and ``capacity``.  A full container closes at once.
    """
    bins: list[int] = []
    offsets: list[int] = []
    free_of: dict[int, list[int]] = {}  # free space -> open containers
    mask = n_open = made = 0
    for size in sizes:
        fit = mask >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            stack = free_of[free]
            bin_ = stack.pop()
            if not stack:
                mask &= ~(1 << free)
        else:
            if n_open == open_bins:
                least = (mask & -mask).bit_length() - 1
                stack = free_of[least]
                stack.pop()
                if not stack:
                    mask &= ~(1 << least)
                n_open -= 1
            free, bin_ = capacity, made
            made += 1
            n_open += 1
        left = free - size
        if left:
            free_of.setdefault(left, []).append(bin_)
            mask |= 1 << left
        else:
            n_open -= 1
        bins.append(bin_)
        offsets.append(capacity - free)
    return bins, offsets, {b for stack in free_of.values() for b in stack}


def _pieces(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """Items of each spec: whole texts, or the pieces of a text beyond the capacity."""
    cap = F.col("capacity_tokens")
    j = sizes.crossJoin(F.broadcast(specs.select("spec_id", "capacity_tokens").filter("capacity_tokens > 0")))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / cap)).cast("int"))).alias("piece_no")
    j = j.select("spec_id", "capacity_tokens", "doc_id", "n_tokens", "_row", piece)
    start = F.col("piece_no").cast("bigint") * cap
    return j.select("spec_id", "capacity_tokens", "doc_id", "_row", "piece_no", start.alias("first_token"), F.least(cap.cast("bigint"), F.col("n_tokens") - start).alias("n_tokens"))


def pack(docs: DataFrame, specs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, open_bins: int = OPEN) -> DataFrame:
    """Container and place of each text (or piece) for each spec.

    Returns ``spec_id, container_id, offset_tokens, doc_id, piece_no,
    first_token, n_tokens``.  Every row of ``docs`` is placed exactly once per
    spec, repeated and null ids included; a text of 0 tokens takes no space.  A
    text is split only if it exceeds the capacity, into pieces of the capacity
    and a rest.  Specs without a positive capacity place nothing.

    ``specs`` is broadcast: TESTDATA fixes it at 4 rows; more than 10,000 are
    refused.
    """
    if specs.limit(10_001).count() > 10_000:
        raise ValueError("too many container specs to broadcast")
    sizes = token_counts(docs.select("doc_id", text), text, tokenizer)
    # row ids are fixed by writing them: a recomputed task reads the same ids
    sizes = materialize(sizes.withColumn("_row", F.monotonically_increasing_id()))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, math.ceil(total / TOKENS_PER_SHARD))
    items = _pieces(sizes, specs).withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int"))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "_row", "piece_no"], kind="stable", na_position="last")
        bins, offsets, still = best_fit(pdf.n_tokens.tolist(), int(pdf.capacity_tokens.iloc[0]), open_bins)
        return pdf.assign(_bin=bins, offset_tokens=offsets, _open=[b in still for b in bins])[["spec_id", "capacity_tokens", "_shard", "_bin", "_open", "offset_tokens", "doc_id", "piece_no", "first_token", "n_tokens"]]

    placed = materialize(items.groupBy("spec_id", "_shard").applyInPandas(first, "spec_id int, capacity_tokens int, _shard int, _bin bigint, _open boolean, offset_tokens bigint, doc_id bigint, piece_no int, first_token bigint, n_tokens bigint"))

    # at most ``open_bins`` of a shard are left open: items of the second round
    left = placed.filter("_open").groupBy("spec_id", "capacity_tokens", "_shard", "_bin").agg(F.sum("n_tokens").alias("used"))
    groups = max(1, math.ceil(shards * open_bins / LEFT_PER_TASK))
    left = left.withColumn("_group", (F.col("_shard") % groups).cast("int"))

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["used", "_shard", "_bin"], ascending=[False, True, True], kind="stable")
        bins, offsets, _ = best_fit(pdf.used.tolist(), int(pdf.capacity_tokens.iloc[0]), open_bins)
        return pdf.assign(_to=bins, _shift=offsets)[["spec_id", "_shard", "_bin", "_group", "_to", "_shift"]]

    moved = left.groupBy("spec_id", "_group").applyInPandas(second, "spec_id int, _shard int, _bin bigint, _group int, _to bigint, _shift bigint")
    where = F.when(F.col("_to").isNull(), F.concat_ws("-", F.lit("c"), "_shard", "_bin")).otherwise(F.concat_ws("-", F.lit("m"), "_group", "_to"))
    return placed.join(moved, ["spec_id", "_shard", "_bin"], "left").select("spec_id", where.alias("container_id"), (F.col("offset_tokens") + F.coalesce("_shift", F.lit(0))).alias("offset_tokens"), "doc_id", "piece_no", "first_token", "n_tokens")
