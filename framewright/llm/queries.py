"""Queries of the training-data problems tagged llm, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import defects, language, leakage, overlap, packing, percentiles, truncation
from framewright.storage import materialize, read_table

GROUPS = ("benchmark", "item_group", "arm")
PERMILLE = (10, 50, 250, 500, 750, 900, 950, 990, 999)


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``end_to_end_ms`` and ``generate_ms`` of each result once, as delivered last; long format."""
    r = read_table(spark, sf_dir, "item_results")
    apart = F.when(F.col("result_id").isNull(), F.monotonically_increasing_id())  # no id: no redelivery known
    last = F.max(F.struct("ingested_at", *GROUPS, F.to_date("finished_at").alias("day"), "end_to_end_ms", "generate_ms"))
    once = r.groupBy("result_id", apart.alias("_apart")).agg(last.alias("r")).select("r.*")
    return percentiles.to_long(once, GROUPS, ["end_to_end_ms", "generate_ms"], extra=["day"], finite_only=False)


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles per benchmark, item_group and arm."""
    return percentiles.bisect_percentiles(materialize(_timings(spark, sf_dir)), GROUPS, PERMILLE)


def p5_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from summaries made per day and added up; relative error at most ``error_bound()``."""
    daily = percentiles.summarize(_timings(spark, sf_dir), [*GROUPS, "day"])
    return percentiles.estimate(percentiles.merge(daily, GROUPS), GROUPS, PERMILLE)


_P5 = f"""WITH once AS (SELECT * FROM item_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) = 1),
v AS (SELECT benchmark, item_group, arm, 'end_to_end_ms' AS metric, end_to_end_ms AS value FROM once WHERE end_to_end_ms IS NOT NULL
 UNION ALL SELECT benchmark, item_group, arm, 'generate_ms', generate_ms FROM once WHERE generate_ms IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY benchmark, item_group, arm, metric ORDER BY value) AS rn, count(*) OVER (PARTITION BY benchmark, item_group, arm, metric) AS n_values FROM v)
SELECT benchmark, item_group, arm, metric, CAST(q.permille AS INTEGER) AS permille, n_values, value FROM r, (SELECT unnest([{", ".join(map(str, PERMILLE))}]) AS permille) q
WHERE rn = greatest(1, (n_values * q.permille + 999) // 1000)"""


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every text for every container size."""
    return packing.pack(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pack_specs"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each size and the share of their space that is used."""
    used = p7_pack(spark, sf_dir).groupBy("spec_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
    spec = read_table(spark, sf_dir, "pack_specs").select("spec_id", "capacity_tokens")
    return used.join(spec, "spec_id").select("spec_id", "capacity_tokens", "n_containers", "n_pieces", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document (segment -1) and paragraph."""
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit_on(docs))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label names no language or a wrong one; paragraphs of mixed documents."""
    docs = read_table(spark, sf_dir, "documents")
    found = language.identify(docs.withColumn("label", F.col("lang")), language.fit_on(docs), keep=("doc_id", "label"))
    wrong = (F.col("segment") == -1) & ~language.named_language(F.col("label")).eqNullSafe(F.col("lang"))
    mixed = (F.col("segment") >= 0) & (F.col("n_languages") > 1)
    return found.filter(F.col("lang").isNotNull() & (wrong | mixed)).select("doc_id", "segment", "lang").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with the words of the passage that it covers."""
    return leakage.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "holdout_passages"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the passages that leaked into them."""
    return p8_leaks(spark, sf_dir).select("doc_id", "passage_id").distinct()


def p6_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cut result with the evidence."""
    r = read_table(spark, sf_dir, "item_results").select("result_id", "source", "text", "generation_tokens")
    return truncation.cut_texts(r).select("result_id", "source", "cut_by").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose text was cut off."""
    return p6_cuts(spark, sf_dir).select("result_id").distinct()


def p6_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut results in each source."""
    cut = p6_cuts(spark, sf_dir).groupBy("source").agg(F.countDistinct("result_id").alias("n_cut"))
    total = read_table(spark, sf_dir, "item_results").groupBy("source").agg(F.countDistinct("result_id").alias("n_results"))
    n = F.coalesce("n_cut", F.lit(0))
    return total.join(cut, "source", "left").select("source", "n_results", n.alias("n_cut"), (n / F.col("n_results")).alias("cut_share"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results without a proper answer and their defect; languages are learned from the labelled documents."""
    model = language.fit_on(read_table(spark, sf_dir, "documents"))
    return defects.find_defects(read_table(spark, sf_dir, "item_results"), read_table(spark, sf_dir, "bench_items"), model)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item and session pairs that stand in train and in another split."""
    items = overlap.same_items(read_table(spark, sf_dir, "bench_items")).select(F.lit("item").alias("level"), "key_a", "key_b")
    sessions = overlap.same_videos(read_table(spark, sf_dir, "session_arms")).select(F.lit("session").alias("level"), "key_a", "key_b")
    return items.unionByName(sessions)


def p4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session pairs alone."""
    return overlap.same_videos(read_table(spark, sf_dir, "session_arms"))


_P4 = r"""WITH s AS (SELECT DISTINCT session_key, nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(video_id)), '^.*[/\\]', ''), '\.[a-z0-9]{2,4}$', ''), '[^\p{L}\p{N}]', '', 'g'), '') AS video, split = 'train' AS train FROM session_arms)
SELECT DISTINCT least(a.session_key, b.session_key) AS key_a, greatest(a.session_key, b.session_key) AS key_b FROM s a JOIN s b ON a.video = b.video AND a.session_key <> b.session_key WHERE a.train AND NOT b.train"""


def p4_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each split and manifest that also stand in train, and how well they are covered."""
    b = read_table(spark, sf_dir, "bench_items")
    pairs = materialize(overlap.same_items(b))
    hit = pairs.select(F.explode(F.array("key_a", "key_b")).alias("record_id"), "question_coverage").groupBy("record_id").agg(F.max("question_coverage").alias("coverage"))
    held = b.filter("split <> 'train'").groupBy("record_id", "split", "manifest").agg(F.count("*").alias("_n"))
    return held.join(hit, "record_id", "left").groupBy("split", "manifest").agg(F.count("*").alias("n_records"), F.count("coverage").alias("n_in_train"), F.avg("coverage").alias("mean_coverage"))


QUERIES = {
    "p4_found": p4_found,
    "p4_sessions": p4_sessions,
    "p4_by_split": p4_by_split,
    "p3_found": p3_found,
    "p6_found": p6_found,
    "p6_cuts": p6_cuts,
    "p6_by_source": p6_by_source,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_segments": p9_segments,
    "p5_percentiles": p5_percentiles,
    "p5_merged": p5_merged,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
}
ORACLES = {"p4_sessions": _P4, "p5_percentiles": _P5}
