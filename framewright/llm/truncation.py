"""Problem 6: texts that were cut off in a word or a sentence.

Three kinds of evidence, all from statistics over every row:

* near copies: min-hash banding over the word shingles of beginnings finds texts
  that begin alike; in verified pairs (``SIMILAR`` of the shorter's shingles are
  in the longer) the copy whose alignment ends early, inside a word or sentence
  of the other, was cut;
* closing words: for texts that end without a sentence end, how often the last
  word and its context close a sentence elsewhere.  A context is the sentence so
  far with every word but the commonest reduced to a placeholder, so a sentence
  frame counts once for all its nouns; shorter contexts step in for rare ones;
* limits: a source cuts at a length (characters, bytes or tokens) where its
  texts without a sentence end pile up; at such a length a text that looks
  complete is one more cut text, if there are more of them than at the
  lengths around it.

Count tables are hashed into slots, more for more text but of a bounded number,
so they may be collected and broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm import winnow
from framewright.storage import materialize, scratch

#: Contexts tried, the most telling first: words, and how many of the commonest words
#: stand for themselves, the rest being placeholders.  999 words: the sentence so far.
CONTEXTS = ((999, 400), (999, 200), (999, 70), (6, 200), (4, 70), (3, 200), (2, 200))
COMMON = 400
#: So many of them are tried before the others.
SPECIFIC = 4
#: Slots of a count table: the power of two next to one per ``TEXT_PER_SLOT`` characters, between these.
LEAST_SLOTS, MOST_SLOTS, TEXT_PER_SLOT = 1 << 19, 1 << 21, 1 << 11
#: Each context is counted in two slots; the lesser count holds (a count-min sketch).
HASHES = 2
#: A context counts from this many sightings on.
SEEN = 6
#: A word can close a sentence if it closes at least so many, and this share of all sentences.
CLOSES, CLOSES_SHARE = 2, 2e-6
#: Marks that exports put where they cut: an ellipsis after text, a broken escape, a replacement character.
MARKS = "…\\�"
SIMILAR, SHINGLE = 0.8, 5
ROWS, BANDS = 3, 5
#: Words of the beginnings that are signed: each text has those it is long enough for, an open one is looked up by its longest.
BEGINNINGS = tuple(9 << i for i in range(24))
#: Words before the last of open texts too short for that: up to so many, no shingle of them may differ, so they are looked up word for word.
SHORT = (6, 7, 8)
#: Texts of a bucket in one block of the join.
BLOCK = 1000

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*|[.!?…]+|[,;:]|\n|\x00|[“”«»\"]|[-–—]$")
_QUOTES = set("\n“”«»\"")
_END = set(".!?…")
_OTHER, _NUMBER, _STOP, _LINE, _SEP = 1, 2, 3, 4, 5
_PUNCT = {",": 6, ";": 7, ":": 8, "-": 9, "–": 9, "—": 9}
_FIRST = 16
_B = np.uint64(0x9E3779B97F4A7C15)


def text_of(c: str | Column) -> Column:
    """The text without white space and export marks at its end."""
    return F.rtrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\n\r\x0b\f\u00a0\u200b" + MARKS))


def unterminated(c: Column) -> Column:
    """Whether a text of some words ends without a sentence end (quotes and brackets aside)."""
    stop = F.right(F.rtrim(c, F.lit("\"'”’»)]*")), F.lit(1)).isin(".", "!", "?")
    return F.coalesce(~stop & F.contains(F.ltrim(c), F.lit(" ")), F.lit(False))


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _word(token: str) -> str:
    """Case does not count, but for single letters: an option is no article."""
    return token if len(token) == 1 else token.lower()


def common_words(texts: DataFrame) -> list[str]:
    """The ``COMMON`` commonest words of a one-column table of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            c: Counter[str] = Counter()
            for w, n in raw.items():
                c[_word(w)] += n
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["w", "n"])

        for b in batches:
            raw.update(_tokens("\x00".join(t for t in b.column(0).to_pylist() if t)))
            if len(raw) > 500_000:
                yield flush()
                raw.clear()
        yield flush()

    counts = texts.mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("w").rlike(r"^\p{L}")).orderBy(F.desc("n"), "w").limit(COMMON).collect()
    return [r.w for r in top]


class _Vocabulary(dict):
    """Token -> its class and two word slots in one number, remembered up to a bounded number of words."""

    def __init__(self, common: Sequence[str], slots: int):
        self.common = {w: _FIRST + i for i, w in enumerate(common)}
        self.slots = slots

    def __missing__(self, w: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        c = w[0]
        if w == "\x00":
            k = _SEP
        elif c in _QUOTES:
            k = _LINE
        elif c in _END:
            k = _STOP
        elif c in _PUNCT:
            k = _PUNCT[c]
        elif c.isdigit():
            k = _NUMBER
        else:
            k = self.common.get(_word(w), _OTHER)
        h = winnow.word_hash(_word(w))
        n = self.slots
        v = self[w] = (k * n + ((h >> 40) & (n - 1))) * n + (h & (n - 1))
        return v


def _encode(texts: Sequence[str], vocab: _Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, two word slots, and for every context the slots of that which ends at a token."""
    toks = _tokens("\x00".join(["", *texts, ""]))
    both = np.fromiter(map(vocab.__getitem__, toks), np.int64, len(toks))
    size = vocab.slots
    cls, word = both // (size * size), np.stack([both % size, both // size % size])
    n = len(cls)
    pos = np.arange(n)
    border = (cls == _STOP) | (cls == _LINE) | (cls == _SEP)
    last = np.maximum.accumulate(np.where(border, pos, -1))
    start = np.where(border, pos, last + 1)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B, np.uint64)]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_B), -1, 1 << 64)), np.uint64)]))
    prefix = {}
    for level in {v for _, v in CONTEXTS}:
        seen = np.where(cls < _FIRST + level, cls, _OTHER).astype(np.uint64)
        prefix[level] = np.concatenate([[np.uint64(0)], np.cumsum(seen * power[:n])])
    ctx = np.zeros((len(CONTEXTS), HASHES, n), np.int64)
    for i, (k, level) in enumerate(CONTEXTS):
        a = np.maximum(start, pos - k + 1)
        h = (prefix[level][pos + 1] - prefix[level][a]) * inverse[a]
        h = (h + (a == start).astype(np.uint64) * np.uint64(77) + np.uint64(i)) * _B
        h ^= h >> np.uint64(31)
        ctx[i, 0] = (h & np.uint64(size - 1)).astype(np.int64)
        ctx[i, 1] = ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)
    return cls, word, ctx


_LETTERS = np.array([winnow.word_hash(chr(c)) & (LEAST_SLOTS - 1) for c in range(65, 91)])


def _chunks(texts: list[str], chars: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters, each text whole."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


@dataclass
class Closings:
    """Sightings of contexts and words, closing a sentence and not."""

    common: list[str]
    context: np.ndarray  # contexts x 2 x slots
    word: np.ndarray  # 2 x slots
    sentences: float  # sightings in all, closing and not
    inner: float

    def vocabulary(self) -> _Vocabulary:
        return _Vocabulary(self.common, self.word.shape[-1])


def count_closings(texts: DataFrame) -> Closings:
    """Counts over all sentences of a one-column table of texts.

    The end of a text without a sentence end does not count: it may be cut.
    """
    common = common_words(texts)
    n_tables = len(CONTEXTS) + 1
    chars = texts.agg(F.sum(F.length(texts.columns[0]))).first()[0] or 0
    slots = LEAST_SLOTS
    while slots < min(MOST_SLOTS, chars / TEXT_PER_SLOT):
        slots *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _Vocabulary(common, slots)
        total = np.zeros((n_tables, 2, slots), np.int64)
        for b in batches:
            for ts in _chunks([t for t in b.column(0).to_pylist() if t]):
                cls, word, ctx = _encode(ts, vocab)
                nxt = np.concatenate([cls[1:], [_SEP]])
                inner = (cls == _OTHER) | (cls == _NUMBER) | (cls >= 6)
                closes = inner & ((nxt == _STOP) | (nxt == _LINE))
                goes_on = inner & ((nxt == _OTHER) | (nxt == _NUMBER) | (nxt >= 6))
                for side, m in ((0, np.flatnonzero(closes)), (1, np.flatnonzero(goes_on))):
                    for k in range(len(CONTEXTS)):
                        for at in ctx[k]:
                            total[k, side] += np.bincount(at[m], minlength=slots)
                for at in word:
                    total[-1, 0] += np.bincount(at[closes], minlength=slots)
                    total[-1, 1] += np.bincount(at[goes_on], minlength=slots)
        flat = total.reshape(-1)
        at = np.flatnonzero(flat)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(flat[part].astype(np.int64))], names=["slot", "n"])

    # ratios matter: a count of any size is held to seven digits
    counts = texts.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").cast("float").alias("n"))
    total = np.zeros(n_tables * 2 * slots, np.float32)
    got = counts.toArrow()  # at most 34 million slots of 12 bytes, whatever the data
    total[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    total = total.reshape(n_tables, 2, slots)
    sums = total[-1].sum(axis=1, dtype=np.float64) / HASHES
    return Closings(common, total[:-1], total[-1], float(sums[0]), float(sums[1]))


def closing_score(texts: Sequence[str], c: Closings, vocab: _Vocabulary) -> np.ndarray:
    """Probability that each text's end closes a sentence; 0 after a word that never closes one.

    A complete text ends where sentences close, a cut one anywhere: the odds are
    those of the context, set against those of all words.
    """
    if not texts:
        return np.zeros(0)
    cls, word, ctx = _encode(texts, vocab)
    seps = np.flatnonzero(cls == _SEP)
    end = seps[1:] - 1  # last token of each text
    empty = end == seps[:-1]
    p = np.full(len(texts), np.nan)
    sure = np.zeros(len(texts))  # the most telling context decides
    settled = np.zeros(len(texts), bool)
    base = np.log((c.inner + 1) / (c.sentences + 1))
    for k in range(len(CONTEXTS)):
        a, b = (c.context[k, side][ctx[k][:, end]].min(axis=0).astype(float) for side in (0, 1))
        odds = np.log((a + 0.5) / (b + 0.5)) + base
        if k == SPECIFIC:
            settled = sure > 0
        use = (a + b >= SEEN) & (np.abs(odds) > sure) & ~settled
        p[use] = 1 / (1 + np.exp(-odds[use]))
        sure[use] = np.abs(odds[use])
    wa, wb = (c.word[side][word[:, end]].min(axis=0).astype(float) for side in (0, 1))
    p = np.where(np.isnan(p), 1 / (1 + np.exp(-np.log((wa + 0.5) / (wb + 0.5)) - base)), p)
    is_word = (cls[end] == _OTHER) | (cls[end] >= _FIRST)
    p[is_word & (wa < np.maximum(max(CLOSES, CLOSES_SHARE * c.sentences), 0.002 * wb))] = 0  # no sentence ends in this word: it was cut itself
    p[(cls[end] >= 6) & (cls[end] < _FIRST)] = 0  # comma, colon, dash
    # a lone letter after a sentence is the beginning of another
    before = np.maximum(end - 1, 0)
    p[is_word & (cls[before] == _STOP) & (end - seps[:-1] > 6) & np.isin(word[0, end] & (LEAST_SLOTS - 1), _LETTERS)] = 0
    # some words and a letter are a short answer, whatever the corpus
    stops = np.cumsum(cls == _STOP)
    p[np.isin(word[0, end] & (LEAST_SLOTS - 1), _LETTERS) & (end - seps[:-1] <= 6) & (stops[end] == stops[seps[:-1]])] = 1
    p[empty] = 1
    p[(cls[end] == _STOP) | (cls[end] == _LINE)] = 1
    return p


def score_ends(rows: DataFrame, text: str, closings: Closings) -> DataFrame:
    """``rows`` plus ``p_close``, the closing score of the column ``text``."""
    ddl = T.StructType([*rows.schema.fields, T.StructField("p_close", T.DoubleType())])
    shared = rows.sparkSession.sparkContext.broadcast(closings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        vocab = c.vocabulary()
        for b in batches:
            p = closing_score([t or "" for t in b.column(text).to_pylist()], c, vocab)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "p_close"])

    return rows.mapInArrow(run, ddl)


#: A limit: at least this many cut texts, and this many times the mean of the lengths around it.
PILE, TIMES, AROUND = 20, 6.0, 12


def limits(scored: DataFrame) -> DataFrame:
    """``source, measure, value`` where cut texts pile up, and more that look complete than around.

    ``scored`` has ``source, chars, bytes, tokens, p_close`` of the texts without
    a sentence end.  The counts per length are few beside the rows.
    """
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("bigint").alias("value")) for m in ("chars", "bytes", "tokens")]))
    n = scored.select("source", "p_close", measures.alias("m")).select("source", "m.*", "p_close").filter("value IS NOT NULL").groupBy("source", "measure", "value").agg(F.count_if(F.col("p_close") < 0.5).alias("n"), F.count_if(F.col("p_close") >= 0.5).alias("whole"))
    n = materialize(n)
    spread = n.select("source", "measure", F.explode(F.sequence(F.col("value") - AROUND, F.col("value") + AROUND)).alias("value"), F.col("value").alias("of"), "n", "whole").filter("value <> of")
    around = spread.groupBy("source", "measure", "value").agg((F.sum("n") / (2 * AROUND)).alias("n_around"), (F.sum("whole") / (2 * AROUND)).alias("whole_around"))
    j = n.join(around, ["source", "measure", "value"], "left").fillna(0.0, ["n_around", "whole_around"])
    piled = (F.col("n") >= PILE) & (F.col("n") >= TIMES * F.col("n_around"))
    return j.filter(piled & (F.col("whole") > 2 * F.greatest(F.lit(1.0), F.col("whole_around")))).select("source", "measure", "value")


def _beginnings(words: Sequence[list[str]], hasher: winnow.Hasher, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts given as words: rows of text, number of its beginning, its words in all, the min-hashes of the beginning (rows x permutations), and bits of shingles.

    The bits are those of the first shingles, as many as a text looked up by this
    beginning can have, and those of all shingles that leave out the last word.
    Texts of fewer words than the least beginning have none.
    """
    at = np.array([i for i, w in enumerate(words) if len(w) >= BEGINNINGS[0]], np.int64)
    n = np.array([len(words[i]) for i in at], np.int64)
    if not len(at):
        return at, n, n, np.zeros((0, len(a)), np.uint64), np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)
    flat = np.fromiter((hasher[w] for i in at for w in words[i]), np.uint64, int(n.sum()))
    g = winnow.kgram_hashes(flat, SHINGLE)
    start = np.cumsum(n) - n
    # shingles of a text: up to a beginning's last; cuts of the reduction at each beginning
    kinds = [np.full(int((n >= w).sum()), i) for i, w in enumerate(BEGINNINGS) if (n >= w).any()]
    owner = np.concatenate([np.flatnonzero(n >= w) for w in BEGINNINGS[: len(kinds)]])
    kind = np.concatenate(kinds)
    order = np.lexsort((kind, owner))
    owner, kind = owner[order], kind[order]
    ends = np.array(BEGINNINGS)[kind] - SHINGLE + 1
    before = np.where(kind > 0, np.array((SHINGLE - 1, *BEGINNINGS))[kind] - SHINGLE + 1, 0)
    # pairs of (from, to); reduceat takes every other segment
    cuts = np.stack([start[owner] + before, start[owner] + ends], axis=1).ravel()
    sig = np.empty((len(owner), len(a)), np.uint64)
    for k, (x, y) in enumerate(zip(a, b)):
        h = np.append(g * x + y, np.uint64(0))
        sig[:, k] = np.minimum.reduceat(h, cuts)[::2]
    # a longer beginning holds the shorter ones
    for i in range(1, len(kinds)):
        rows = np.flatnonzero(kind == i)
        sig[rows] = np.minimum(sig[rows], sig[rows - 1])
    place = g >> np.uint64(57)
    bit = [np.append(np.where(place >> np.uint64(6) == i, np.uint64(1) << (place & np.uint64(63)), np.uint64(0)), np.uint64(0)) for i in (0, 1)]

    def some(ends: np.ndarray) -> np.ndarray:
        cuts = np.stack([start[owner], start[owner] + ends], axis=1).ravel()
        return np.stack([np.bitwise_or.reduceat(x, cuts)[::2].astype(np.int64) for x in bit])

    first = np.minimum(n[owner] - SHINGLE + 1, 2 * np.array(BEGINNINGS)[kind] + 1)
    return at[owner], kind, n[owner], sig, some(first), some(np.maximum(n[owner] - SHINGLE, 1))


def _short_keys(words: Sequence[list[str]], hasher: winnow.Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of text, words of the beginning, and a key of those words and the next one's first letter."""
    at, size, key = [], [], []
    for i, ws in enumerate(words):
        h = 0
        for k, w in enumerate(ws[: SHORT[-1]]):
            h = ((h ^ hasher[w]) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            if k + 1 in SHORT and len(ws) > k + 1:
                at.append(i)
                size.append(k + 1)
                key.append(h ^ ord(ws[k + 1][0]) ^ (k + 1 << 32))
    return np.array(at, np.int64), np.array(size, np.int64), np.array(key, np.uint64)


def near_copies(texts: DataFrame) -> DataFrame:
    """Texts of which a longer near copy goes on where they end.

    ``texts``: distinct rows ``t``, ``open`` (no sentence end).  A cut copy is
    alike only to a beginning of the whole, so beginnings of ``BEGINNINGS`` words
    are signed: shingles of ``SHINGLE`` words, min-hash in ``BANDS`` bands of
    ``ROWS``.  An open text is looked up by the longest that leaves out its last
    word, and is paired with every other text of the bucket that has at least its
    words and may have enough of its shingles, as bits tell; the open texts of a large bucket come in blocks.  Pairs are verified by
    ``ends_early``.  Returns ``t``.  Texts below the least beginning have no
    near copies.
    """
    rng = np.random.default_rng(11)
    a = rng.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
    b0 = rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)
    lengths = np.array(BEGINNINGS)
    texts = materialize(texts.select(F.xxhash64("t").alias("id"), "t", "open"))  # read four times

    def rows(ts: list[str], h: winnow.Hasher) -> Iterator[tuple[np.ndarray, ...]]:
        """Text, key, words, whether a text of these words asks by it, bits and own bits."""
        words = [winnow.words(t) for t in ts]
        at, kind, n, sig, bits, mine = _beginnings(words, h, a, b0)
        k = np.zeros((len(at), BANDS), np.uint64)
        for c in range(ROWS):
            k = (k ^ sig[:, c::ROWS]) * _B
        k ^= np.arange(BANDS, dtype=np.uint64) + (kind.astype(np.uint64) << np.uint64(8))[:, None]
        asks = (n > lengths[kind]) & ((kind + 1 == len(lengths)) | (n <= lengths[np.minimum(kind + 1, len(lengths) - 1)]))
        wide = lambda x: np.repeat(x, BANDS, axis=-1)
        yield wide(at), k.ravel(), wide(n), wide(asks), wide(bits), wide(mine)
        x, size, key = _short_keys(words, h)
        n = np.array([len(ws) for ws in words], np.int64)[x]
        none = np.zeros((2, len(x)), np.int64)
        yield x, key, n, n == size + 1, none, none

    def reader(seen=None):
        """Rows of open texts that ask, or, given the bits of their keys, the rows of all texts that may be asked for."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h = winnow.Hasher()
            table = None if seen is None else seen.value
            for b in batches:
                first = 0
                for ts in _chunks([t or "" for t in b.column("t").to_pylist()]):
                    for at, key, n, asks, bits, mine in rows(ts, h):
                        keep = np.flatnonzero(asks if table is None else (table[key >> np.uint64(44)] >> ((key >> np.uint64(38)) & np.uint64(63))) & np.uint64(1))
                        cols = [pa.array(key[keep].astype(np.int64)), b.column("id").take(pa.array(at[keep] + first)), pa.array(n[keep].astype(np.int32)), *(pa.array(x[keep]) for x in (mine if table is None else bits))]
                        yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "n", "bits0", "bits1"])
                    first += len(ts)

        return run

    ddl = "key bigint, id bigint, n int, bits0 bigint, bits1 bigint"
    asks = materialize(texts.filter("open").mapInArrow(reader(), ddl))
    # the leading 26 bits of the keys that are asked for, in 2^20 words of 64: at most 16 MB reach the driver
    words = asks.selectExpr("shiftrightunsigned(key, 44) AS w", "shiftleft(1L, CAST(shiftrightunsigned(key, 38) & 63 AS INT)) AS b")
    table = np.zeros(1 << 20, np.uint64)
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint64)
    held = texts.mapInArrow(reader(texts.sparkSession.sparkContext.broadcast(table)), ddl)
    sizes = asks.groupBy("key").agg((F.floor(F.count("*") / BLOCK).cast("int") + 1).alias("blocks"))
    a_side = asks.join(sizes, "key").select("key", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "n", F.col("bits0").alias("mine0"), F.col("bits1").alias("mine1"))
    b_side = held.join(sizes, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("longer"), F.col("n").alias("m"), "bits0", "bits1")
    # a bit that the longer lacks is a shingle that it lacks
    lacks = sum((F.bit_count(F.col(f"mine{i}").bitwiseAND(F.bitwise_not(f"bits{i}"))) for i in (0, 1)), F.lit(0))
    may = lacks <= F.lit(1 - SIMILAR) * (F.col("n") - SHINGLE) + F.lit(1e-9)
    # the short ones are equal word for word
    may = (F.col("m") >= F.col("n")) & (F.col("id") != F.col("longer")) & ((F.col("n") <= SHORT[-1] + 1) | may)
    pairs = a_side.join(b_side, ["key", "block"]).filter(may).select("id", "longer").distinct()
    # a fixed number of partitions: the pairs are small beside the work they make
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    short = texts.filter("open").select("id", F.col("t").alias("a"))
    both = pairs.join(short, "id").repartition(parts, "longer").join(texts.select(F.col("id").alias("longer"), F.col("t").alias("b")), "longer").select("id", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist())):
                keep.append(i) if ends_early(x, y) else None
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep, pa.int32()))], names=["t"])

    return both.mapInArrow(verify, "t string").distinct()


def _find(words: list[str], run: list[str], near: int) -> int:
    """Place of a run of words, the nearest to ``near``; -1 for none."""
    at = [i for i in range(len(words) - len(run) + 1) if words[i] == run[0] and words[i : i + len(run)] == run]
    return min(at, key=lambda i: abs(i - near), default=-1)


def ends_early(short: str, long: str) -> bool:
    """Whether ``short`` is a near copy of a beginning of ``long`` that stops inside one of its words or sentences.

    The last word of ``short`` may be broken, so its shingles are those of the words before.
    """
    last = short.rfind(" ") + 1
    if long.startswith(short[:last]) and not long.startswith(short.rstrip(" .,;:…\\�"), 0):
        return False  # word for word, and then another word
    x, y = winnow.words(short), winnow.words(long)
    more = len(y)
    y = y[: 2 * len(x) + SHINGLE]  # where a beginning of so many like words can end
    whole = {tuple(y[i : i + SHINGLE]) for i in range(len(y) - SHINGLE + 1)}
    sx = [tuple(x[i : i + SHINGLE]) for i in range(len(x) - SHINGLE)]
    if not sx or sum(s in whole for s in sx) < SIMILAR * len(sx):
        return False
    same = 0
    while same < min(len(x), len(y)) and x[same] == y[same]:
        same += 1
    if same >= len(x) - 1:  # word for word
        a1 = b1 = same
    elif (at := _find(y, x[-4:-1], len(x) - 4)) >= 0:  # the words before the last tell where it ends
        a1 = len(x) - 1
        b1 = at + 3
        if b1 < len(y) and x[-1] == y[b1]:
            a1, b1 = a1 + 1, b1 + 1
    elif x[-2] not in y and x[-1] not in y:
        return False  # an alignment ends with equal words
    else:
        hx, hy = (np.array([winnow.word_hash(w) for w in ws], np.uint64) for ws in (x, y))
        _, _, a1, _, b1 = winnow.best_local(hx, hy)
    if len(x) - a1 > 1 or b1 >= more:
        return False  # more than a broken word is left of the shorter, or nothing of the longer
    if a1 == len(x) - 1:
        return b1 < len(y) and y[b1].startswith(x[-1]) and y[b1] != x[-1]  # ends in a word of the longer
    toks = _tokens(long)
    seen = -1
    for i, t in enumerate(toks):
        if t[0].isalnum():
            seen += len(winnow.words(t))
        if seen >= b1 - 1:
            return i + 1 < len(toks) and toks[i + 1][0] not in _END and toks[i + 1] != "\n"
    return False


def cut_texts(rows: DataFrame, text: str = "text", source: str = "source", tokens: str | None = "generation_tokens", copies=near_copies) -> DataFrame:
    """Rows of ``rows`` whose text was cut in a word or a sentence, with the evidence.

    Adds ``cut_by``: ``mark``, ``copy``, ``closing`` or ``limit``.  ``copies`` is
    the operator that finds cut copies in a table of texts.  Texts of less than
    two words, null and empty ones are not judged.  Repeated rows are judged
    alike; no rows give no rows; the other columns are kept, so they must not
    be named ``cut_by``, nor begin with ``_``.
    """
    closings = count_closings(rows.select(text_of(text).alias("t")))
    open_ = rows.withColumn("_t", text_of(text)).filter(unterminated(F.col("_t")))
    marked = F.rtrim(F.col(text)).rlike(rf"[\p{{L}}\p{{N}},\s][{re.escape(MARKS)}]+$")
    scored = score_ends(open_.withColumns({"_mark": marked}), "_t", closings)
    scored = materialize(scored)
    lengths = scored.select(F.col(source).alias("source"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), (F.col(tokens) if tokens else F.lit(None).cast("int")).alias("tokens"), "p_close").filter("NOT _mark")
    lim = materialize(limits(lengths))
    with scratch() as keep:
        copied = keep(materialize(copies(rows.select(F.col(text).alias("t")).filter(F.col(text).isNotNull()).distinct().withColumn("open", unterminated(text_of("t"))))))
    s = scored
    for m, c in (("chars", F.length(text)), ("bytes", F.octet_length(text)), ("tokens", F.col(tokens) if tokens else F.lit(None))):
        at = lim.filter(F.col("measure") == m).select(F.col("source").alias("_src"), F.col("value").alias("_val"), F.lit(True).alias(f"_{m}"))
        s = s.join(at, (F.col(source) == F.col("_src")) & (c.cast("bigint") == F.col("_val")), "left").drop("_src", "_val")
    s = s.join(copied.select(F.col("t").alias("_copy")), F.col(text) == F.col("_copy"), "left")
    by = F.when(F.col("_mark"), "mark").when(F.col("_copy").isNotNull(), "copy").when(F.col("p_close") < 0.5, "closing").when(F.coalesce("_chars", "_bytes", "_tokens"), "limit")
    return s.withColumn("cut_by", by).filter("cut_by IS NOT NULL").select(*rows.columns, "cut_by")
