"""Problem 8: documents that contain text of held-out passages.

Winnowing: of the k-gram hashes of a document the minimum of each sliding
window is kept and joined with the k-grams of the passages; collinear hits are
chained and extended by word alignment.  Every run of ``K + WINDOW - 1`` shared
words gives a hit, so every long shared span is found although single words
differ.

Passages that fit a block of proven size are broadcast: one narrow pass over the
documents, without a shuffle.  More are joined: the documents are still read once,
those with fingerprints of any passage are written with their words, and their
fingerprints meet those of the passages by hash, large hashes in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import winnow
from framewright.storage import materialize

K, WINDOW = 3, 4
#: A leak covers at least this share of the passage's words, and this many words.
LEAST_SHARE, LEAST_WORDS = 0.38, 18
#: Least share of equal words in an aligned stretch.
SAME = 0.82
#: Hits of one chain, at least: LEAST_WORDS shared words have LEAST_WORDS - K + 1 k-grams, one in WINDOW of them is kept for sure.
SEEDS = 3
#: Passages that are broadcast, at most, and their characters.
BLOCK, BLOCK_CHARS = 20_000, 32_000_000
#: Positions of one fingerprint in passages that are joined in one block.
HOT = 1000


class Index:
    """All k-grams of passages, sorted by hash."""

    def __init__(self, block: Sequence[tuple[int, str]]):
        self.ids = [k for k, _ in block]
        self.words = [np.array([winnow.word_hash(w) for w in winnow.words(t)], np.uint64) for _, t in block]
        grams = [winnow.kgram_hashes(h, K) for h in self.words]
        self.hash = np.concatenate([*grams, np.zeros(0, np.uint64)])
        self.passage = np.concatenate([*(np.full(len(g), i, np.int32) for i, g in enumerate(grams)), np.zeros(0, np.int32)])
        self.pos = np.concatenate([*(np.arange(len(g), dtype=np.int32) for g in grams), np.zeros(0, np.int32)])
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.passage, self.pos = self.hash[order], self.passage[order], self.pos[order]


def _document(index: Index, h: np.ndarray, at: np.ndarray, grams: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """Leaks of one document: passage, its words covered, first word, words of the passage, share of equal words.

    ``at`` are the positions of kept k-grams that some passage holds.
    """
    lo, hi = np.searchsorted(index.hash, grams, "left"), np.searchsorted(index.hash, grams, "right")
    n = hi - lo
    start = np.cumsum(n) - n
    row = np.arange(int(n.sum())) - np.repeat(start - lo, n)
    passage, j_all, i_all = index.passage[row], index.pos[row], np.repeat(at, n)
    # SEEDS hits are the fewest that a leak can have
    for p in np.flatnonzero(np.bincount(passage) >= SEEDS).tolist():
        mine = passage == p
        i, j = i_all[mine].tolist(), j_all[mine].tolist()
        w = index.words[p]
        if best := _extend(h, w, i, j):
            yield (p, *best)


def _extend(h: np.ndarray, w: np.ndarray, i: Sequence[int], j: Sequence[int]) -> tuple[int, int, int, float] | None:
    """The best leak of a passage ``w`` in a document ``h`` by seeds at ``i`` and ``j``: words covered, first word, words of the passage, share of equal words."""
    need = max(LEAST_WORDS, LEAST_SHARE * len(w))
    best = None
    for i0, i1, j0, j1, n in winnow.chains(i, j):
        if n < SEEDS or j1 - j0 < LEAST_WORDS // 3:
            continue
        a = max(0, i0 - j0 - 10)
        b = min(len(h), i1 + (len(w) - j1) + 10)
        score, d0, d1, p0, p1 = winnow.best_local(h[a:b], w)
        same = (score + (d1 - d0)) / (2 * max(1, d1 - d0))  # equal words, were the rest mismatches
        if p1 - p0 >= need and same >= SAME and (best is None or score > best[0]):
            best = (score, p1 - p0, p0, len(w), same)
    return best[1:] if best else None


def _kept(text: str | None, hasher: winnow.Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a document, and positions and hashes of its kept k-grams."""
    ws = winnow.words(text)
    h = np.fromiter(map(hasher.__getitem__, ws), np.uint64, len(ws))
    g = winnow.kgram_hashes(h, K)
    at = np.flatnonzero(winnow.window_minima(g, WINDOW)) if len(ws) >= LEAST_WORDS // 2 else np.zeros(0, np.int64)
    return h, at, g[at]


def find_leaks(docs: DataFrame, passages: DataFrame, text: str = "text", key: str = "doc_id", passage_key: str = "passage_id", passage_text: str = "text") -> DataFrame:
    """``doc_id, passage_id, covered_words, first_word, passage_words, equal_share`` of every leak.

    A repeated document or passage row is compared on its own, so its rows come
    out as often.  Null and empty texts hold nothing; a passage shorter than
    ``LEAST_WORDS`` words cannot leak; no passages give no rows.
    """
    id_type, p_type = docs.schema[key].dataType.simpleString(), passages.schema[passage_key].dataType.simpleString()
    ddl = f"doc_id {id_type}, passage_id {p_type}, covered_words int, first_word int, passage_words int, equal_share double"
    src = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    ps = passages.select(F.col(passage_key).alias("_key"), F.col(passage_text).alias("_text")).filter("_text IS NOT NULL")
    size = ps.agg(F.count("*").alias("n"), F.sum(F.length("_text")).alias("c")).first()
    if not size.n:
        return docs.sparkSession.createDataFrame([], ddl)
    if size.n <= BLOCK and size.c <= BLOCK_CHARS:
        return _by_broadcast(src, ps, ddl)
    return _by_join(src, ps, ddl)


def _by_broadcast(src: DataFrame, ps: DataFrame, ddl: str) -> DataFrame:
    shared = src.sparkSession.sparkContext.broadcast(Index([(r._key, r._text) for r in ps.collect()]))  # its size is checked
    types = [_arrow(t.split()[1]) for t in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        known = np.unique(index.hash)
        hasher = winnow.Hasher()
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for k, t in zip(b.column("_key").to_pylist(), b.column("_text").to_pylist()):
                h, at, kept = _kept(t, hasher)
                ix = np.searchsorted(known, kept)
                ix[ix == len(known)] = 0
                hit = known[ix] == kept if len(known) else np.zeros(len(kept), bool)
                if np.count_nonzero(hit) < SEEDS:
                    continue
                for p, covered, first, n, same in _document(index, h, at[hit], kept[hit]):
                    for o, v in zip(out, (k, index.ids[p], covered, first, n, same)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, ty) for o, ty in zip(out, types)], names=["doc_id", "passage_id", "covered_words", "first_word", "passage_words", "equal_share"])

    return src.mapInArrow(run, ddl)


def _by_join(src: DataFrame, ps: DataFrame, ddl: str) -> DataFrame:
    longs = pa.list_(pa.int64())
    signed = lambda x: x.astype(np.int64)
    names = [t.split()[1] for t in ddl.split(", ")[:2]]

    def of_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = winnow.Hasher()
        for b in batches:
            hs = [np.fromiter(map(hasher.__getitem__, w), np.uint64, len(w)) for w in map(winnow.words, b.column("_text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array([signed(h) for h in hs], longs), pa.array([signed(winnow.kgram_hashes(h, K)) for h in hs], longs)], names=["passage_id", "p_words", "grams"])

    p = ps.mapInArrow(of_passages, f"passage_id {names[1]}, p_words array<bigint>, grams array<bigint>").filter(F.size("p_words") >= LEAST_WORDS)
    p = materialize(p.withColumn("_p", F.monotonically_increasing_id()))
    grams = p.select("_p", F.posexplode("grams").alias("j", "hash"))
    # the leading 26 bits of the hashes, in 2^20 words of 64: at most 16 MB reach the driver
    bits = grams.selectExpr("shiftrightunsigned(hash, 44) AS w", "shiftleft(1L, CAST(shiftrightunsigned(hash, 38) & 63 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << 20, np.uint64)
    table[bits.column("w").to_numpy()] = bits.column("b").to_numpy().astype(np.uint64)
    shared = src.sparkSession.sparkContext.broadcast(table)

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = winnow.Hasher()
        known = shared.value
        for b in batches:
            rows, at_, grams_, words_ = [], [], [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                h, at, kept = _kept(t, hasher)
                hit = np.flatnonzero((known[kept >> np.uint64(44)] >> ((kept >> np.uint64(38)) & np.uint64(63))) & np.uint64(1))
                if len(hit) >= SEEDS:
                    rows.append(i)
                    at_.append(at[hit].astype(np.int32))
                    grams_.append(signed(kept[hit]))
                    words_.append(signed(h))
            yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(rows, pa.int32())), pa.array(at_, pa.list_(pa.int32())), pa.array(grams_, longs), pa.array(words_, longs)], names=["doc_id", "at", "grams", "d_words"])

    d = src.mapInArrow(of_documents, f"doc_id {names[0]}, at array<int>, grams array<bigint>, d_words array<bigint>")
    d = materialize(d.withColumn("_d", F.monotonically_increasing_id()))
    kept = d.select("_d", F.explode(F.arrays_zip("at", "grams")).alias("x")).select("_d", F.col("x.at").alias("i"), F.col("x.grams").alias("hash"))
    n = grams.groupBy("hash").agg((F.floor(F.count("*") / HOT).cast("int") + 1).alias("blocks"))
    left = kept.join(n, "hash").select("hash", "_d", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = grams.join(n, "hash").select("hash", "_p", "j", F.pmod(F.xxhash64("_p"), "blocks").cast("int").alias("block"))
    hits = left.join(right, ["hash", "block"])
    # the seeds of one document and one passage: as many as their words at most
    pairs = hits.groupBy("_d", "_p").agg(F.collect_list(F.struct("i", "j")).alias("seeds")).filter(F.size("seeds") >= SEEDS)
    both = pairs.join(p.select("_p", "passage_id", "p_words"), "_p").join(d.select("_d", "doc_id", "d_words"), "_d").select("doc_id", "passage_id", "seeds", "d_words", "p_words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, got = [], []
            for r, (seeds, h, w) in enumerate(zip(*(b.column(c).to_pylist() for c in ("seeds", "d_words", "p_words")))):
                found = _extend(np.array(h, np.int64).view(np.uint64), np.array(w, np.int64).view(np.uint64), [s["i"] for s in seeds], [s["j"] for s in seeds])
                if found:
                    rows.append(r)
                    got.append(found)
            take = pa.array(rows, pa.int32())
            cols = [pa.array([g[c] for g in got], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("passage_id").take(take), *cols], names=["doc_id", "passage_id", "covered_words", "first_word", "passage_words", "equal_share"])

    return both.mapInArrow(align, ddl)


def _arrow(t: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[t]
