"""Answer texts: option letters, buckets, prompts, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: chat marks that show a degenerate response.
DEGENERATE = ("<|im_end|>", "<end_of_turn>")


def clean(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def prefix_letter(text: Column, options: Column | int) -> Column:
    """The first option letter, from A on, that begins the upper-cased text."""
    n = F.lit(options) if isinstance(options, int) else options
    first = F.upper(F.substring(clean(text), 1, 1))
    i = F.ascii(first) - 65
    return F.when((i >= 0) & (i < n), first)


def extract_choice(text: Column, candidates: Column) -> Column:
    """The option a response gives, as a letter; null if none can be told.

    In turn: a letter that begins the text (no word border: "Because" is B); the
    only option letter standing alone in the first clause; the only option whose
    words the text contains.
    """
    n = F.size(candidates)
    clause = F.element_at(F.split(text, r"[.!?\n]"), 1)
    alone = F.filter(F.array_distinct(F.regexp_extract_all(clause, F.lit(r"(?:^|[^A-Za-z0-9_])([A-Z])(?![A-Za-z0-9_])"), F.lit(1))), lambda x: F.ascii(x) - 65 < n)
    low = F.lower(text)
    named = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce((n > 0) & (F.length(F.try_element_at(candidates, i + 1)) > 0) & F.contains(low, F.lower(F.try_element_at(candidates, i + 1))), F.lit(False)))
    letter = F.when(F.size(named) == 1, F.char(F.element_at(named, 1) + 65))
    return F.coalesce(prefix_letter(text, n), F.when(F.size(alone) == 1, F.try_element_at(alone, F.lit(1))), letter)


def permissive_choice(text: Column) -> Column:
    """The only letter A to D, upper case, that stands alone anywhere in the text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])([ABCD])(?![A-Za-z])"), F.lit(1)))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))


def single_letter(choice: Column) -> Column:
    """One letter, trimmed and upper-cased, else null."""
    c = F.upper(clean(choice))
    return F.when(c.rlike("^[A-Z]$"), c)


def yes_no(text: Column) -> Column:
    t = F.upper(clean(text))
    return F.when(t.startswith("YES"), "yes").when(t.startswith("NO"), "no")


def degenerate(text: Column, parse_failure: Column) -> Column:
    """A parse failure, or a chat mark in the text."""
    m = F.lit(False)
    for s in DEGENERATE:
        m = m | F.coalesce(F.contains(text, F.lit(s)), F.lit(False))
    return m | F.coalesce(parse_failure, F.lit(False))


def pair_bucket(bad_a: Column, bad_b: Column, choice_a: Column, choice_b: Column) -> Column:
    """degenerate before clean (same choice, nulls alike) before mixed."""
    return F.when(bad_a | bad_b, "degenerate").when(choice_a.eqNullSafe(choice_b), "clean").otherwise("mixed")


def overlap_bucket(a: Column, b: Column, names: tuple[str, str]) -> Column:
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return F.when(a & b, "both").when(a, f"{names[0]}_only").when(b, f"{names[1]}_only").otherwise("both_wrong")


def drift(a: Column, b: Column, rule: str) -> Column:
    """Whether two choices differ.

    ``strict``: null never matches; ``nullsafe``: null equals null;
    ``bothpresent``: only where both are given.
    """
    if rule == "strict":
        return ~F.coalesce(a == b, F.lit(False))
    if rule == "nullsafe":
        return ~a.eqNullSafe(b)
    if rule == "bothpresent":
        return F.coalesce(a != b, F.lit(False))
    raise ValueError(rule)


def prompt(question: Column, candidates: Column) -> Column:
    """The question and one lettered line per option."""
    lines = F.transform(candidates, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x))
    return F.concat_ws("\n", F.concat(F.array(question), lines))


def strip_letter(option: Column) -> Column:
    return F.regexp_replace(option, r"^[A-Za-z]\. ", "")


def id_parts(item_id: Column) -> list[Column]:
    """Benchmark, group and rest of a composite id, and the video of the rest."""
    p = F.split(item_id, ":", 3)
    rest = F.try_element_at(p, F.lit(3))
    return [F.try_element_at(p, F.lit(1)).alias("benchmark"), F.try_element_at(p, F.lit(2)).alias("item_group"), F.element_at(F.split(rest, "-"), 1).alias("video"), F.element_at(F.split(rest, "-"), -1).try_cast("int").alias("question_no")]


def snippet(text: Column, length: int = 280) -> Column:
    """White space collapsed, cut to a length for display."""
    return F.substring(clean(F.regexp_replace(text, r"\s+", " ")), 1, length)


def digest(*parts: Column, length: int = 24) -> Column:
    """Leading hex digits of the SHA-256 of parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


#: Marks of a basin attractor.
PATHOLOGICAL = ("addCriterion", "自动")


def pathological(text: Column) -> Column:
    """Whether a text holds one of the ``PATHOLOGICAL`` marks; false for null."""
    t = F.coalesce(text, F.lit(""))
    m = F.lit(False)
    for s in PATHOLOGICAL:
        m = m | F.contains(t, F.lit(s))
    return m


def normalised_letter(v: Column) -> Column:
    """The letter of a raw choice (a variant): 0 to 25 and their digits by place, a letter in upper case; null for booleans and the rest."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "bigint")
    text = F.trim(F.try_variant_get(v, "$", "string"))
    digits = text.try_cast("int")
    at = lambda i: F.when(i.between(0, 25), F.char(i + 65))
    return F.when(kind == "BIGINT", at(number)).when(kind == "STRING", F.when(text.rlike("^[A-Za-z]$"), F.upper(text)).when(text.rlike("^[0-9]{1,2}$"), at(digits)))


def drift_class(reuse: Column, invalidated: Column) -> Column:
    """Which of two drift flags is set; null counts as not."""
    a, b = F.coalesce(reuse, F.lit(False)), F.coalesce(invalidated, F.lit(False))
    return F.when(a & b, "shared_drift").when(a, "reuse_only_drift").when(b, "invalidated_only_drift").otherwise("stable")


def outcome(delta: Column, format_ok: Column) -> Column:
    """A label by the bands of an accuracy delta, the format first."""
    return F.when(~format_ok, "format_invalid").when(delta >= -0.05, "low_fps_competitive").when(delta <= -0.10, "low_fps_rejected").otherwise("ambiguous")
