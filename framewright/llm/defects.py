"""Problem 3: responses that do not answer their question.

Responses are sorted by text; a text that is a proper prefix of its neighbour,
ending in a word or a sentence of it, is a shortened version.  With the length
limits and closing words of ``truncation`` this gives the truncated ones; rules
for empty texts, refusals, copies of the question and other languages judge the
rest.  A response has one defect: truncated, empty, refusal, copied_question,
other_language, in this order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import language, truncation, winnow
from framewright.storage import materialize

#: A language counts from this confidence on.
SURE = 0.6

#: Marks of a chat format, which are no content.
_SPECIAL = re.compile(r"<\|?[\w/ -]{1,30}\|?>")
_NAMED = (
    r"(?:\b(?i:answer|option|pick|choose|choice|letter|antwort|wähle|réponse|choisis|respuesta|elijo|opción)\b[^\w.!?]*(?:\w+[^\w.!?]+){0,3}?"
    r"|\b(?i:so|also|donc|así que)\s+)"
)
#: An option letter that is given as the answer: at the beginning, or named in a sentence.
_LETTER = re.compile(r"^[\W_]*(?i:option|answer|antwort|réponse|respuesta)?[\s:]*[A-Ea-e](?:[).:\]*—–-]|\s*[—–-]\s|[\W_]*$)" rf"|{_NAMED}(?:[B-E]\b|A\b(?!\s+[^\W\d_A-Z]))")
#: Before a lower-case word, A may be the article: it counts as an option where nothing is declined.
_ARTICLE = re.compile(_NAMED + r"A\b")
#: What a response speaks of when it says that it lacks something to answer.
_MEDIUM = r"(?:(?:frame|image|picture|video|clip|footage|excerpt|recording|material|context|information|detail|evidence)s?)"
_ACT = (
    r"(?:tell|say|answer|respond|reply|determine|decide|judge|guess|speculate|choose|pick|select|comment|conclude|identify|help|assist|verify|know|be (?:sure|certain)"
    r"|(?:make|give|offer|provide|reach) (?:an?y?|the|my|you)\b|(?:view|see|watch|access|open|play|process|load) (?:this|the|that|these|any|your)(?: \w+)? " + _MEDIUM + ")"
)
_UNABLE = r"(?:can(?:not|['’]t| not)|could(?:n['’]t| not)|won['’]t|will not|would rather not|(?:am|are|['’]m|['’]re) (?:not able|unable|not in a position)|do(?:n['’]t| not) (?:wish|want|know|feel able))"
#: Ways to decline: the speaker is unable or unwilling to answer, or what was shown does not suffice.  By language of the questions.
_REFUSAL = re.compile(
    "|".join((
        # a speaker, no ability or will, an act of answering; "The man cannot open the door" has none of the first
        rf"\b(?:I|we|this (?:assistant|model))\b[^.;!?]{{0,20}}{_UNABLE}\b[^.;!?]{{0,25}}?\b{_ACT}\b",
        r"\b(?:I|we)\b[^.;!?]{0,30}\b(?:decline|refuse|abstain|must pass)\b",
        rf"\bunable to {_ACT}\b",
        rf"(?:not|n['’]t) possible (?:for (?:me|us) )?to {_ACT}\b|\bimpossible (?:for (?:me|us) )?to {_ACT}\b",
        r"\b(?:nothing|no more) can be (?:said|told|concluded|determined|judged)\b|\b(?:this|that|it|the question) can(?:not|['’]t) be (?:answered|determined|decided|told|judged)\b|\bno (?:letter|option|answer|choice) (?:is|can be|will be) (?:given|chosen|picked|named)\b",
        rf"\bas an? (?:ai|assistant|language model)\b|\bwithout access to (?:the|this|that|any) {_MEDIUM}",
        rf"\b{_MEDIUM}\b[^.;!?]{{0,20}}(?:do(?:es)?(?: not|n['’]t)|can(?:not|['’]t)|fails? to)\s+(?:\w+\s+){{0,2}}?(?:give|allow|let|show|contain|provide|include|suffice|load|open|play|support|help|tell)\b",
        rf"\bnone of (?:the|these|those) (?:\w+ )?{_MEDIUM}[^.;!?]{{0,20}}\b(?:let|allow|show|give|help|tell|suffice)",
        rf"(?:\bnot|n['’]t) (?:have |see )?(?:enough|sufficient) {_MEDIUM}|\b(?:insufficient|too little) {_MEDIUM}",
        # German
        r"\b(?:kann|können|könnte|möchte|darf|will|vermag)\b[^.;!?]{0,70}\b(?:nicht|keine?n?)\b[^.;!?]{0,25}(?:beantworten|sagen|beurteilen|entscheiden|bestimmen|antworten|feststellen|wählen|aussage|antwort|angabe|treffen|machen)",
        r"\b(?:frage|antwort|das|dies|es)\b[^.;!?,]{0,15}\b(?:lässt|lassen) sich\b[^.;!?]{0,40}\bnicht\b[^.;!?]{0,20}(?:sagen|beantworten|bestimmen|entscheiden|beurteilen)",
        r"\b(?:bild\w*|video\w*|aufnahme\w*|ausschnitt\w*|einzelbild\w*|information\w*)\b[^.;!?]{0,30}\b(?:reich\w+|genüg\w+|erlaub\w+|zeig\w+)\b[^.;!?]{0,25}\b(?:nicht|zu wenig)\b",
        r"\bist (?:es )?(?:mir )?nicht möglich\b|\bich (?:verweigere|lehne)\b",
        # French
        r"\b(?:je|nous) (?:ne |n['’])[^.;!?]{0,10}(?:peux|pouvons|saurais|sais|suis|veux|souhaite)\b[^.;!?]{0,60}(?:répondre|dire|déterminer|juger|choisir|savoir|prononcer|trancher|deviner|voir)",
        r"\b(?:image|vidéo|extrait|information|élément|séquence)s?\b[^.;!?]{0,30}\b(?:ne |n['’])(?:me |nous )?(?:suffi\w+|permet\w*|montre\w*)",
        r"\bimpossible (?:pour moi )?de (?:\w+ )?(?:répondre|dire|déterminer|juger|choisir|savoir|trancher|prononcer)|\bje refuse\b",
        # Spanish
        r"\bno (?:me )?(?:puedo|podemos|sé|sabría|quiero|es posible)\b[^.;!?]{0,40}(?:responder|contestar|decir|determinar|elegir|saber|juzgar|decidir|ver)",
        r"\b(?:imágenes|imagen|v[ií]deo|fragmento|información|fotogramas?)\b[^.;!?]{0,30}\bno (?:me )?(?:bastan?|permiten?|muestran?|alcanzan?|dejan?|son suficientes|es suficiente)\b|\bme niego\b",
    )),
    re.IGNORECASE,
)
_PROMPT = {"question", "you", "asked", "the", "was", "is", "your", "options", "option", "a", "b", "c", "d", "e", "frage", "pregunta", "q"}


def judge(text: str | None) -> tuple[str, str | None]:
    """What the text alone tells: ``empty``, ``refusal``, ``letter`` or ``other``, and the prose whose language counts.

    Prose is the text without an option letter; a bare letter has none.
    """
    bare = _SPECIAL.sub(" ", text or "")
    if not any(c.isalnum() for c in bare):
        return "empty", None
    if _LETTER.search(bare):
        return "letter", _LETTER.sub(" ", bare, count=1)
    asks = bare.rstrip(" \"'”").endswith("?") and not re.search(r"[.;!]\s", bare)
    if not asks and _REFUSAL.search(bare):
        return "refusal", None
    if _ARTICLE.search(bare):
        return "letter", _ARTICLE.sub(" ", bare, count=1)
    return "other", bare


def languages(texts: Sequence[str | None], model: language.Model) -> list[str | None]:
    """The language of each text; null where it has less than ``SURE`` confidence or no letters."""
    at = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    out: list[str | None] = [None] * len(texts)
    for x in range(0, len(at), 4096):
        part = at[x : x + 4096]
        p = language.softmax(model.scores([texts[i] for i in part]))
        for i, k, c in zip(part, p.argmax(axis=1), p.max(axis=1)):
            out[i] = language.LANGUAGES[k] if c >= SURE else None
    return out


def copies_question(text: str, question: str, options: Sequence[str]) -> bool:
    """Whether a text repeats the question and, its options and a lead aside, says nothing else."""
    ws, qw = winnow.words(text), winnow.words(question)
    if len(ws) < 4 or len(qw) < 4:
        return False
    asked = set(qw)
    if len(asked.intersection(ws)) < 0.75 * len(asked):
        return False
    extra = _PROMPT | {w for o in options for w in winnow.words(o)}
    new = [w for w in ws if w not in asked and w not in extra]
    return len(new) <= max(1, 0.12 * len(ws))


def shortened(a: str, b: str) -> bool:
    """Whether ``a`` is ``b`` cut in a word or a sentence."""
    if not a or len(b) <= len(a) or not b.startswith(a):
        return False
    rest = b[len(a) :]
    if a[-1].isalnum() and rest[0].isalnum():
        return True
    rest = rest.lstrip()
    return a.rstrip()[-1:].isalnum() and bool(rest) and (rest[0].islower() or rest[0].isdigit() or rest[0] in ",;")


def neighbour_copies(texts: DataFrame) -> DataFrame:
    """Texts (distinct ``t``, ``open``) that are shortened versions of a text that follows in text order.

    The texts that begin with ``t`` follow it without a gap, so open texts wait on
    a stack while what follows begins with them.  Texts are sorted by range; what
    waits at the end of a range meets the first text of each later range that
    begins with it, in a table of one row per range and one per waiting text.
    """
    src = texts.select("t", "open", truncation.text_of("t").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list[str]]] = []  # each key begins the next one; open texts of a key
        first = None
        cut: list[str] = []
        for b in batches:
            for t, o, s in zip(b.column("t").to_pylist(), b.column("open").to_pylist(), b.column("s").to_pylist()):
                first = s if first is None else first
                while stack and not s.startswith(stack[-1][0]):
                    stack.pop()
                if stack and s == stack[-1][0]:
                    if o:
                        stack[-1][1].append(t)
                    continue
                left = []
                for key, waiting in stack:
                    if shortened(key, s):
                        cut += waiting
                    else:
                        left.append((key, waiting))
                stack = left
                if o:
                    stack.append((s, [t]))
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(["cut"] * len(cut)), pa.array(cut, pa.string()), pa.nulls(len(cut), pa.string())], names=["kind", "t", "s"])
                cut = []
        rows = ([("first", None, first)] if first is not None else []) + [("last", t, key) for key, waiting in stack for t in waiting]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "t", "s"])

    parts = max(1, int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    got = materialize(src.repartitionByRange(parts, "s").sortWithinPartitions("s", "t").mapInArrow(run, "kind string, t string, s string"))
    last, firsts = got.filter("kind = 'last'").select("t", "s"), got.filter("kind = 'first'").select(F.col("s").alias("f"))
    nxt = last.join(F.broadcast(firsts), F.startswith("f", "s") & (F.col("f") > F.col("s"))).select("t", "s", "f")

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [t for t, s, f in zip(*(b.column(c).to_pylist() for c in ("t", "s", "f"))) if shortened(s, f)]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], names=["t"])

    return got.filter("kind = 'cut'").select("t").unionByName(nxt.mapInArrow(border, "t string")).distinct()


#: Parts into which the results of one item are dealt for the join; its question goes to each.
SALTS = 8


def find_defects(results: DataFrame, items: DataFrame, model: language.Model) -> DataFrame:
    """``result_id, defect``, distinct, of results without a proper answer.

    ``results``: ``result_id, source, item_id, text, generation_tokens``;
    ``items``: ``item_id, question, candidates``, any number of rows per item;
    ``model`` tells languages; the item's language is that of most of its wordings (ties: the last in order).
    A result of an unknown or null item has no question: only truncation,
    emptiness and refusal are judged.  Rows with a null ``result_id`` are judged
    and reported with null.  Empty tables give no rows.
    """
    r = results.select("result_id", "source", "item_id", "text", "generation_tokens")
    cut = materialize(truncation.cut_texts(r, copies=neighbour_copies).select("result_id", "text").distinct())

    shared = results.sparkSession.sparkContext.broadcast(model)  # one table of fixed size

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            kinds, prose = zip(*map(judge, texts)) if texts else ((), ())
            langs = languages(prose, shared.value)
            keep = [t if k == "other" else None for k, t in zip(kinds, texts)]
            yield pa.RecordBatch.from_arrays([b.column("result_id"), b.column("item_id"), pa.array(kinds, pa.string()), pa.array(langs, pa.string()), pa.array(keep, pa.string())], names=["result_id", "item_id", "kind", "lang", "text"])

    id_type = r.schema["result_id"].dataType.simpleString()
    seen = r.select("result_id", "item_id", "text").mapInArrow(look, f"result_id {id_type}, item_id string, kind string, lang string, text string")
    # a bare letter is sound; the rest is narrow, but for texts without an answer
    seen = materialize(seen.filter("kind <> 'letter' OR lang IS NOT NULL"))

    salt = F.pmod(F.xxhash64("result_id", F.lit(5)), F.lit(SALTS)).cast("int")
    # every wording of an item stays a row: an item of any number of records is never gathered
    wordings = items.filter("item_id IS NOT NULL").select("item_id", "question", "candidates").distinct()

    def of_wording(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = languages(b.column("question").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("question"), b.column("candidates"), pa.array(lang, pa.string())], names=["item_id", "question", "candidates", "q_lang"])

    known = materialize(wordings.mapInArrow(of_wording, "item_id string, question string, candidates array<string>, q_lang string"))
    votes = known.filter("q_lang IS NOT NULL").groupBy("item_id", "q_lang").agg(F.count("*").alias("n"))
    voted = votes.groupBy("item_id").agg(F.max(F.struct("n", "q_lang"))["q_lang"].alias("q_lang"))
    spread = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    lang_of = voted.select("item_id", "q_lang", spread)
    other = seen.filter("lang IS NOT NULL").select("result_id", "item_id", "lang", salt.alias("salt")).join(lang_of, ["item_id", "salt"]).filter("lang <> q_lang").select("result_id", F.lit(5).alias("rank"))
    asked = known.filter("question IS NOT NULL").select("item_id", "question", "candidates", spread)
    unanswered = seen.filter("kind = 'other'").select("result_id", "item_id", "text", salt.alias("salt")).join(asked, ["item_id", "salt"])

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("text", "question", "candidates")]
            at = [i for i, (t, q, o) in enumerate(zip(*cols)) if copies_question(t, q, [x for x in o or () if x])]
            yield pa.RecordBatch.from_arrays([b.column("result_id").take(pa.array(at, pa.int32()))], names=["result_id"])

    copies = unanswered.select("result_id", "text", "question", "candidates").mapInArrow(copied, f"result_id {id_type}").select("result_id", F.lit(4).alias("rank"))
    alone = seen.filter("kind IN ('empty', 'refusal')").select("result_id", F.when(F.col("kind") == "empty", 2).otherwise(3).alias("rank"))
    ranks = cut.select("result_id", F.lit(1).alias("rank")).unionByName(alone).unionByName(copies).unionByName(other)
    names = F.array(*[F.lit(n) for n in ("truncated", "empty", "refusal", "copied_question", "other_language")])
    return ranks.groupBy("result_id").agg(F.min("rank").alias("rank")).select("result_id", F.element_at(names, F.col("rank")).alias("defect"))
