"""Problem 9: languages of documents and of their paragraphs, with a confidence.

Sparse multinomial logistic regression on TF-IDF character n-grams, trained
with follow-the-regularised-leader (per-coordinate rates, elastic net) and
calibrated by a temperature on held-out paragraphs.  The classifier is fitted
on a bounded sample of labelled documents (``PER_LANGUAGE`` documents of at most
``FIT_CHARS`` characters for each language, a documented bound); it then reads
every document whole, in one narrow pass without a shuffle.

The n-gram weights of all classes form one table of fixed size, so a paragraph
costs a table look-up per character, done for whole Arrow batches at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "ru")
#: Names of the languages as labels write them (ISO 639-1 and -2, English and own names).
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "русский"),
}
ORDERS = (2, 3, 4)
DIM = 1 << 16
PER_LANGUAGE = 400
FIT_CHARS = 20_000
FIT_PARAGRAPHS = 6_000
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")


def named_language(label: Column) -> Column:
    """The language that a label names, e.g. ``en`` for ``EN``, ``eng``, ``en-US``, ``English``; else null."""
    base = F.lower(F.regexp_extract(F.trim(label), r"^([\p{L}]+)(?:[-_][\p{L}\d]+)*$", 1))
    alias = [(n, k) for k, names in NAMES.items() for n in names]
    table = F.create_map(*[F.lit(x) for pair in alias for x in pair])
    return F.element_at(table, base)  # null where the map lacks it


def paragraphs(text: str) -> list[str]:
    """The parts of a text between blank lines, without empty ones."""
    return [p for p in _BLANK.split(text) if p.strip()]


def _letter_table() -> np.ndarray:
    t = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        if chr(c).isalpha():
            t[c] = c
    return t


_LETTERS: np.ndarray | None = None


def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts (orders x characters) and the start of each text.

    Whatever is no letter counts as a space; texts are set apart by spaces, and
    grams of spaces alone have number 0, which weighs nothing.
    """
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letter_table()
    low = [t.lower() for t in texts]
    pad = max(ORDERS)
    joined = "".join(" " + t + " " * pad for t in low)
    starts = np.cumsum([0, *(len(t) + 1 + pad for t in low)])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    x = _LETTERS[np.minimum(codes, 0xFFFF)]
    n = len(x)
    out = np.zeros((len(ORDERS), n), np.uint16)
    h = np.zeros(n, np.uint32)
    alone = np.ones(n, bool)
    blank = x == 0
    for k in range(pad):
        h[: n - k] = h[: n - k] * np.uint32(0x9E3779B1) + x[k:] * np.uint32(0x85EBCA6B) + np.uint32(1)
        alone[: n - k] &= blank[k:]
        if k + 1 in ORDERS:
            g = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.uint16)
            # one gram of each order starts at a character; a run of spaces starts none
            g[alone | ((x == 0) & np.roll(blank, -1))] = 0
            out[ORDERS.index(k + 1)] = g
    return out, starts


@dataclass
class Model:
    """Weights (n-gram x language) with the IDF folded in, bias and temperature."""

    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """Calibrated log-odds (texts x languages); zeros for texts without letters."""
        if not texts:
            return np.zeros((0, len(LANGUAGES)), np.float32)
        g, starts = grams(texts)
        total = np.zeros((len(texts), len(LANGUAGES)), np.float32)
        count = np.zeros(len(texts), np.float32)
        for row in g:
            total += np.add.reduceat(self.table[row], starts[:-1], axis=0)
            count += np.add.reduceat((row > 0).astype(np.float32), starts[:-1])
        s = total / np.maximum(count, 1)[:, None] * SCALE + self.bias
        s[count == 0] = 0
        return s / self.temperature


#: Weight of the L1 penalty: a gram weighs in a language only if its gradients add up to more.
L1 = 0.3
#: Term frequencies are relative; this brings them to the size of the rates below.
SCALE = 5.0


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sparse(texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    g, starts = grams(texts)
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        f, c = np.unique(g[:, a:b].ravel(), return_counts=True)
        keep = f > 0
        f, c = f[keep].astype(np.int64), c[keep].astype(np.float32)
        out.append((f, c / max(1.0, c.sum())))
    return out


def fit(texts: Sequence[str], labels: Sequence[str], docs: Sequence | None = None, alpha: float = 0.1, beta: float = 1.0, l1: float = L1, l2: float = 1e-3, epochs: int = 2, batch: int = 32, seed: int = 7) -> Model:
    """FTRL-proximal with elastic net on paragraphs; those of every fifth document are held out for the temperature.

    ``docs`` names the document of each paragraph (none: each its own).  IDF and
    weights come from the others alone.  The held-out labels stay
    as they are, see ``_temperature``.
    Languages without a sample get no weight; without any sample every text
    scores alike.
    """
    k = len(LANGUAGES)
    if not texts:
        return Model(np.zeros((DIM, k), np.float32), np.zeros(k, np.float32), 1.0)
    y = np.array([LANGUAGES.index(x) for x in labels])
    feats = _sparse(texts)
    rng = np.random.default_rng(seed)
    ids = list(range(len(texts))) if docs is None else list(docs)
    names = sorted(set(ids), key=str)
    out = {names[i] for i in rng.permutation(len(names))[: len(names) // 5]} if len(names) >= 20 else set()
    order = rng.permutation(len(texts))
    apart = np.array([ids[i] in out for i in order])
    held, train = order[apart], order[~apart]
    df = np.zeros(DIM, np.float32)
    for i in train:
        df[feats[i][0]] += 1
    idf = np.log((1 + len(train)) / (1 + df)).astype(np.float32) + 1
    n_of = np.bincount(y[train], minlength=k)
    cost = np.where(n_of > 0, len(train) / (k * np.maximum(n_of, 1)), 0).astype(np.float32)  # languages weigh alike

    def run(train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, n = np.zeros((DIM + 1, k), np.float32), np.zeros((DIM + 1, k), np.float32)

        def weights(rows: np.ndarray) -> np.ndarray:
            zz, nn = z[rows], n[rows]
            return np.where(np.abs(zz) <= l1, 0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)).astype(np.float32)

        for _ in range(epochs):
            rng.shuffle(train)
            for i in range(0, len(train), batch):
                rows = train[i : i + batch]
                cat = np.concatenate([feats[r][0] for r in rows] + [np.array([DIM])])
                uniq, inv = np.unique(cat, return_inverse=True)
                w = weights(uniq)
                grad = np.zeros((len(uniq), k), np.float32)
                at = 0
                for r in rows:
                    f, tf = feats[r]
                    v = (tf * idf[f] * SCALE).astype(np.float32)
                    ix = inv[at : at + len(f)]
                    at += len(f)
                    p = softmax((v @ w[ix] + w[-1])[None])[0]
                    p[y[r]] -= 1
                    p *= cost[y[r]]
                    grad[ix] += v[:, None] * p
                    grad[-1] += p
                sq = grad * grad
                sigma = (np.sqrt(n[uniq] + sq) - np.sqrt(n[uniq])) / alpha
                z[uniq] += grad - sigma * w
                n[uniq] += sq
        w = weights(np.arange(DIM + 1))
        return w[:DIM] * idf[:, None], w[DIM]

    table, bias = run(train)
    # labels are wrong at times: fit again without paragraphs that the first fit clearly contradicts
    m = Model(table.astype(np.float32), bias, 1.0)
    s = m.scores(texts)
    ok = s[np.arange(len(y)), y] >= s.max(axis=1) - 1.0
    table, bias = run(train[ok[train]])
    m = Model(table.astype(np.float32), bias, 1.0)
    m.table[0] = 0
    if len(held):
        held = held[np.argsort([names.index(ids[i]) for i in held], kind="stable")]
        m.temperature = _temperature(m.scores([texts[i] for i in held]), y[held], np.array([names.index(ids[i]) for i in held]))
    return m


def _temperature(s: np.ndarray, y: np.ndarray, doc: np.ndarray) -> float:
    """The likeliest temperature of scores whose paragraphs are sorted by document.

    A document has one language, which its label names but for a share of wrong
    labels; a paragraph has it but for a share of changes.  Both shares are
    fitted along, so no paragraph is left out for contradicting its label.
    """
    k = s.shape[1]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    label = y[first]
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 60):
        p = softmax(s / t)
        for change in (0.005, 0.02, 0.05, 0.1, 0.2):
            of = np.add.reduceat(np.log((1 - change) * p + change / (k - 1) * (1 - p) + 1e-12), first, axis=0)
            for wrong in (0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3):
                prior = np.full(of.shape, np.log(wrong / (k - 1)))
                prior[np.arange(len(label)), label] = np.log(1 - wrong)
                loss = -np.logaddexp.reduce(of + prior, axis=1).sum()
                best = min(best, (loss, float(t)))
    return best[1]


def calibration_error(model: Model, texts: Sequence[str], labels: Sequence[str], bins: int = 10) -> float:
    """Expected calibration error: the mean distance of confidence and accuracy over bins of confidence."""
    p = softmax(model.scores(texts))
    top, conf = p.argmax(axis=1), p.max(axis=1)
    right = np.array([LANGUAGES[i] == x for i, x in zip(top, labels)])
    at = np.minimum((conf * bins).astype(int), bins - 1)
    return float(sum(abs(conf[at == b].mean() - right[at == b].mean()) * (at == b).mean() for b in range(bins) if (at == b).any()))


def fit_on(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """A model from a bounded sample of the labelled documents.

    The sample is drawn by a hash of ``key``, so it is the same on every run;
    it is collected (at most ``per_language`` x 8 documents, in expectation, of
    ``FIT_CHARS`` characters).
    """
    named = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), named_language(F.col(label)).alias("l")).filter("l IS NOT NULL AND t IS NOT NULL")
    sizes = {r.l: r.n for r in named.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], [])
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    u = F.pmod(F.xxhash64("k", F.lit(1)), F.lit(1_000_003)) / 1_000_003.0
    rows = named.filter((u < F.element_at(share, F.col("l"))) & (F.length("t") <= FIT_CHARS)).orderBy(F.xxhash64("k")).limit(2 * per_language * len(LANGUAGES)).collect()
    pairs = [(p, r.l, i) for i, r in enumerate(rows) for p in paragraphs(r.t)]
    if len(pairs) > FIT_PARAGRAPHS:
        pick = np.random.default_rng(3).permutation(len(pairs))[:FIT_PARAGRAPHS]
        pairs = [pairs[i] for i in sorted(pick)]
    return fit([p for p, _, _ in pairs], [x for _, x, _ in pairs], [i for _, _, i in pairs])


#: A paragraph counts as another language than the rest of its document from this confidence on.
SWITCH = 0.5
#: Characters scored at once.
CHUNK = 1 << 20


def identify(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Language and confidence of each document and paragraph.

    Returns ``keep`` and ``segment`` (-1: the document), ``lang``,
    ``confidence``, ``n_chars`` and ``n_languages`` (of the document).  The
    document's language is that of most of its characters.  Paragraphs without
    a letter, or below ``SWITCH``, take the document's language.  A null text,
    or one without a letter, has one row with null language and confidence 0.
    """
    src = docs.select(*keep, F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "segment int", "lang string", "confidence double", "n_chars bigint", "n_languages int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column("_text").to_pylist()
            paras, owner = [], []
            for i, t in enumerate(texts):
                for p in paragraphs(t) if t else ():
                    paras.append(p)
                    owner.append(i)
            probs = np.zeros((len(paras), len(LANGUAGES)), np.float32)
            a = size = 0
            for i, p in enumerate(paras):
                size += len(p)
                if size >= CHUNK or i + 1 == len(paras):
                    s = m.scores(paras[a : i + 1])
                    pr = softmax(s)
                    pr[~s.any(axis=1)] = 0
                    probs[a : i + 1] = pr
                    a, size = i + 1, 0
            at, seg, lang, conf, chars, kinds = [], [], [], [], [], []
            owner_a = np.array(owner, np.int64)
            lens = np.array([len(p) for p in paras], np.int64)
            first = np.searchsorted(owner_a, np.arange(len(texts) + 1))
            top = probs.argmax(axis=1) if len(paras) else np.zeros(0, np.int64)
            best = probs.max(axis=1) if len(paras) else np.zeros(0)
            for i in range(len(texts)):
                lo, hi = first[i], first[i + 1]
                weight = np.zeros(len(LANGUAGES))
                np.add.at(weight, top[lo:hi], lens[lo:hi] * (best[lo:hi] > 0))
                if not weight.any():
                    rows = [(-1, None, 0.0, int(lens[lo:hi].sum()))]
                    n = 0
                else:
                    main = int(weight.argmax())
                    own = np.where(best[lo:hi] >= SWITCH, top[lo:hi], main)
                    weight[:] = 0
                    np.add.at(weight, own, lens[lo:hi])
                    main = int(weight.argmax())
                    sure = (probs[lo:hi, main] * lens[lo:hi]).sum() / max(1, lens[lo:hi].sum())
                    rows = [(-1, LANGUAGES[main], float(sure), int(lens[lo:hi].sum()))]
                    rows += [(s, LANGUAGES[int(o)], float(probs[lo + s, o]), int(lens[lo + s])) for s, o in enumerate(own)]
                    n = len(set(own.tolist()))
                for s, x, c, k in rows:
                    at.append(i)
                    seg.append(s)
                    lang.append(x)
                    conf.append(c)
                    chars.append(k)
                    kinds.append(n)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in keep), pa.array(seg, pa.int32()), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), pa.array(chars, pa.int64()), pa.array(kinds, pa.int32())], names=[*keep, "segment", "lang", "confidence", "n_chars", "n_languages"])

    return src.mapInArrow(run, ddl)
