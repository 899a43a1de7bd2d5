"""Queries of the general training-data problems (p1, p2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import copydiff, drift
from framewright.storage import materialize, read_table, scratch

KEYS = ("item_id", "q_index")
KEY_TYPES = {"item_id": "string", "q_index": "integer"}
PAIR_VALUES = ("frame_count", "baseline_choice", "candidate_choice", "baseline_correct", "candidate_correct", "choice_drift", "correctness_drift")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line once, however often it was delivered."""
    return read_table(spark, sf_dir, "raw_records").select("path", "line_no", "payload").dropDuplicates()


def _leaves(lines: DataFrame) -> DataFrame:
    return materialize(drift.rescued_leaves(lines, KEY_TYPES, keep=("path",)).filter(~F.col("field").isin(*KEYS)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a field from one file of a label to the next."""
    return drift.drift_report(_leaves(_lines(spark, sf_dir)), drift.file_sequence(read_table(spark, sf_dir, "source_specs")), KEYS)


def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as one table: the fields that any file has, renamed ones under one name.

    Within a label, the names that renames connect are one field; it goes by the
    one of them that most files of all labels use, dots written as ``__``, and its
    type is that of most values.  Labels are as many as the files ask for, so
    their renames stay a table and are joined to the lines; only what is known of
    a field over all labels (the column list) comes to the driver.  Every line is then ingested,
    and the approved fields are replayed from its rescued leaves; a line of a file
    that is not listed keeps all of them there.
    """
    with scratch() as keep:
        lines = _lines(spark, sf_dir)
        leaves = _leaves(lines)
        seq = drift.file_sequence(read_table(spark, sf_dir, "source_specs"))
        label = seq.select("path", "label")
        report = drift.drift_report(leaves, seq, KEYS).filter("change = 'renamed'")
        renames = report.join(label, "path").select("label", "field", "new_field").distinct()
        use = leaves.groupBy("path", "field", "type").agg(F.count("*").alias("n")).join(label, "path")
        use = materialize(use.groupBy("label", "field", "type").agg(F.sum("n").alias("n"), F.count("*").alias("files")))
        files, kinds = {}, {}
        for r in use.groupBy("field", "type").agg(F.sum("n").alias("n"), F.sum("files").alias("files")).collect():
            files[r.field] = files.get(r.field, 0) + r.files
            kinds.setdefault(r.field, {})[r.type] = r.n
        to = F.udf(lambda pairs: drift.united(pairs, files), "map<string,string>")
        named = materialize(renames.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("field", "new_field"))).alias("pairs")).select("label", to("pairs").alias("to")))
        goes = named.select(F.col("label").alias("of"), F.explode("to").alias("name", "goes_by"))
        held = use.select("label", "field").distinct()
        held = held.join(goes, held["label"].eqNullSafe(goes["of"]) & (held["field"] == goes["name"]), "left")
        order = lambda f: (-files[f], f)
        names: dict[str, set[str]] = {}
        for r in held.select("field", F.coalesce("goes_by", "field").alias("goes_by")).distinct().collect():
            names.setdefault(r.goes_by, set()).add(r.field)
        approved = {}
        for c in sorted(names):
            total: dict[str, int] = {}
            for f in names[c]:
                for t, n in kinds[f].items():
                    if t != "null":
                        total[t] = total.get(t, 0) + n
            # a dot would be read as a path into a struct
            name = c.replace(".", "__")
            name = c if name in approved else name
            approved[name] = (max(sorted(total, key=drift.TYPES.index), key=total.get) if total else "string", {c: sorted(names[c], key=order)})
        maps = named.select(F.col("label").alias("of"), "to")
        maps = label.join(maps, label["label"].eqNullSafe(maps["of"]), "left").select("path", F.coalesce("to", F.create_map().cast("map<string,string>")).alias("_to"))
        ingested = keep(materialize(drift.rescue_ingest(lines.join(maps, "path", "left"), KEY_TYPES, keep=("path", "line_no", "_to"))))
    return drift.promote(ingested, approved, renamed="_to")


def _letter(c: str) -> Column:
    t = F.upper(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    return F.when(t.rlike("^[A-Z]$"), t)


def _pairs(df: DataFrame) -> DataFrame:
    keys = {"source": F.col("source"), "item_id": F.lower(F.regexp_replace("item_id", r"^\s+|\s+$", "")), "q_index": F.col("q_index")}
    values = {v: _letter(v) if v.endswith("choice") else F.col(v) for v in PAIR_VALUES}
    values["frame_count"] = F.col("frame_count").cast("bigint")
    return copydiff.latest(df, keys, values, "written_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that either copy lacks and fields that differ, by key."""
    d = copydiff.copy_differences(_pairs(read_table(spark, sf_dir, "pair_rows")), _pairs(read_table(spark, sf_dir, "pair_rows_mirror")), ("source", *KEYS), PAIR_VALUES, ("primary", "mirror"))
    return d.select(F.col("k_source").alias("source"), F.col("k_item_id").alias("item_id"), F.col("k_q_index").alias("q_index"), "difference")


_CURRENT = """SELECT source, lower(regexp_replace(item_id, '^\\s+|\\s+$', '', 'g')) AS item_id, q_index, frame_count,
  CASE WHEN regexp_full_match(upper(regexp_replace(baseline_choice, '^\\s+|\\s+$', '', 'g')), '[A-Z]') THEN upper(regexp_replace(baseline_choice, '^\\s+|\\s+$', '', 'g')) END AS baseline_choice,
  CASE WHEN regexp_full_match(upper(regexp_replace(candidate_choice, '^\\s+|\\s+$', '', 'g')), '[A-Z]') THEN upper(regexp_replace(candidate_choice, '^\\s+|\\s+$', '', 'g')) END AS candidate_choice,
  baseline_correct, candidate_correct, choice_drift, correctness_drift, written_at FROM {t}"""
_HELD = "SELECT * FROM ({c}) QUALIFY row_number() OVER (PARTITION BY source, item_id, q_index ORDER BY written_at DESC) = 1"


def _p2_sql() -> str:
    a, b = (_HELD.format(c=_CURRENT.format(t=t)) for t in ("pair_rows", "pair_rows_mirror"))
    same = "a.source IS NOT DISTINCT FROM b.source AND a.item_id IS NOT DISTINCT FROM b.item_id AND a.q_index IS NOT DISTINCT FROM b.q_index"
    parts = [f"SELECT a.source, a.item_id, a.q_index, '{v}' AS difference FROM a JOIN b ON {same} WHERE a.{v} IS DISTINCT FROM b.{v}" for v in PAIR_VALUES]
    parts.append(f"SELECT a.source, a.item_id, a.q_index, 'missing_in_mirror' AS difference FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {same})")
    parts.append(f"SELECT b.source, b.item_id, b.q_index, 'missing_in_primary' AS difference FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {same})")
    return f"WITH a AS ({a}), b AS ({b}) " + " UNION ALL ".join(parts)


QUERIES = {"p1_found": p1_found, "p1_table": p1_table, "p2_found": p2_found}
ORACLES = {"p2_found": _p2_sql()}
