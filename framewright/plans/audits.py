"""Queries that audit runs: gates, answer classes, path rules, layouts, rankings, bootstraps of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import answers as A
from framewright.functions import statistics as S
from framewright.operators import quality
from framewright.operators import sequence as SQ
from framewright.plans import runs as RP
from framewright.plans import streams as SP
from framewright.sources import files
from framewright.storage import materialize, read_table

Q: dict = {}
O: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


# ---- bootstraps of pairs and of an area under the curve

def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pair_rows").filter("baseline_correct IS NOT NULL AND candidate_correct IS NOT NULL")
    delta = F.col("candidate_correct").cast("double") - F.col("baseline_correct").cast("double")
    return p.select("source", "item_id", F.concat_ws("|", "item_id", "q_index").alias("row"), delta.alias("delta"))


@query()
def bootstrap_paired_delta(spark, sf):
    """Interval of a paired difference of accuracy, items resampled as wholes."""
    return S.bootstrap(_deltas(spark, sf), ["source"], "item_id", "delta", 5_000, rule="A")


@query()
def bootstrap_row_delta(spark, sf):
    """The same with paired rows resampled one by one."""
    return S.bootstrap(_deltas(spark, sf), ["source"], "row", "delta", 5_000, rule="A")


@query()
def bootstrap_metric(spark, sf):
    """Interval of the mean of any metric: logarithms of generation times per arm, items resampled."""
    r = RP._results(spark, sf).filter("generate_ms > 0").select("arm", "item_id", F.ln("generate_ms").alias("v"))
    return S.bootstrap(r, ["arm"], "item_id", "v", 10_000)


@query()
def bootstrap_auc(spark, sf):
    """Interval of the AUC of the generation time for correctness, items resampled."""
    r = RP._results(spark, sf).filter("arm = 'dense' AND generate_ms IS NOT NULL AND correct IS NOT NULL")
    return S.bootstrap_auc(r.select("benchmark", "item_id", "generate_ms", F.col("correct").cast("int").alias("y")), ["benchmark"], "item_id", "generate_ms", "y", 2_000)


# ---- gates

_REQUIRED = ("dense", "pruned", "cached")


@query("""WITH g AS (SELECT source, count(*) AS n, count(DISTINCT item_id) AS items, count(DISTINCT frame_count) AS budgets, count(*) FILTER (coalesce(choice_drift, true)) AS drifts, count(*) FILTER (coalesce(correctness_drift, true)) AS flips, count(*) FILTER (baseline_choice IS NULL OR candidate_choice IS NULL) AS unparsed, count(*) FILTER (q_index > 0) AS follow_ups, count(*) FILTER (source_path IS NULL OR written_at IS NULL) AS loose FROM pair_rows GROUP BY source)
SELECT source, v.gate, coalesce(v.passed, false) AS passed FROM g, LATERAL (VALUES ('min_rows', n >= 100), ('expected_rows', n = 300), ('min_pair_keys', items >= 20), ('one_budget', budgets = 1), ('zero_choice_diffs', drifts = 0), ('zero_correctness_diffs', flips = 0), ('zero_parse_failures', unparsed = 0), ('follow_ups', follow_ups > 0), ('provenance', loose = 0)) v(gate, passed)""")
def artifact_gates(spark, sf):
    """Whole-artifact switches on paired rows: counts, budgets, differences, parse failures, follow-ups, provenance."""
    null_as = lambda c: F.coalesce(F.col(c), F.lit(True))
    m = [
        F.count("*").alias("n"), F.count_distinct("item_id").alias("items"), F.count_distinct("frame_count").alias("budgets"), F.count_if(null_as("choice_drift")).alias("drifts"), F.count_if(null_as("correctness_drift")).alias("flips"),
        F.count_if(F.col("baseline_choice").isNull() | F.col("candidate_choice").isNull()).alias("unparsed"), F.count_if(F.col("q_index") > 0).alias("follow_ups"), F.count_if(F.col("source_path").isNull() | F.col("written_at").isNull()).alias("loose"),
    ]
    rules = {"min_rows": F.col("n") >= 100, "expected_rows": F.col("n") == 300, "min_pair_keys": F.col("items") >= 20, "one_budget": F.col("budgets") == 1, "zero_choice_diffs": F.col("drifts") == 0, "zero_correctness_diffs": F.col("flips") == 0, "zero_parse_failures": F.col("unparsed") == 0, "follow_ups": F.col("follow_ups") > 0, "provenance": F.col("loose") == 0}
    return quality.gates(read_table(spark, sf, "pair_rows"), m, rules, ["source"])


@query("""WITH g AS (SELECT duration, list_sort(list(DISTINCT arm_name)) AS arms, count(DISTINCT session_key) AS keys, sum(cold_total_ms) / nullif(sum(stream_total_ms), 0) AS ratio, sum(parse_failures) + sum(degenerates) AS bad, count(*) FILTER (stream_correct IS DISTINCT FROM cold_correct) AS drift FROM session_arms GROUP BY duration)
SELECT duration, v.gate, coalesce(v.passed, false) AS passed FROM g, LATERAL (VALUES ('exact_arms', arms = ['dense_q0', 'pruned_q0']), ('enough_keys', keys >= 6), ('call_ratio', ratio >= 2), ('no_failures', bad = 0), ('no_drift', drift = 0)) v(gate, passed)""")
def stage_gates(spark, sf):
    """Stage gates on session arms: exactly the arms asked for, keys, ratio of cold to streamed time, failures, drift."""
    m = [
        F.array_sort(F.collect_set("arm_name")).alias("arms"), F.count_distinct("session_key").alias("keys"), (F.sum("cold_total_ms") / F.nullif(F.sum("stream_total_ms"), F.lit(0.0))).alias("ratio"),
        (F.sum("parse_failures") + F.sum("degenerates")).alias("bad"), F.count_if(~F.col("stream_correct").eqNullSafe(F.col("cold_correct"))).alias("drift"),
    ]
    rules = {"exact_arms": F.col("arms") == F.array(F.lit("dense_q0"), F.lit("pruned_q0")), "enough_keys": F.col("keys") >= 6, "call_ratio": F.col("ratio") >= 2, "no_failures": F.col("bad") == 0, "no_drift": F.col("drift") == 0}
    return quality.gates(read_table(spark, sf, "session_arms"), m, rules, ["duration"])


@query("""WITH s AS (SELECT label, list_sort(list(DISTINCT frame_count) FILTER (frame_count IS NOT NULL)) AS budgets, list_sort(list(DISTINCT schema) FILTER (schema IS NOT NULL)) AS schemas, bool_and(declared_rows > 0) AS counted, bool_and(written_at IS NOT NULL) AS dated, max(file_no) - min(file_no) + 1 = count(DISTINCT file_no) AS gapless FROM source_specs GROUP BY label)
SELECT label, array_to_string(list_filter([CASE WHEN NOT coalesce(budgets = [8, 16, 32], false) THEN 'budgets' END, CASE WHEN NOT coalesce(len(schemas) = 1, false) THEN 'schemas' END, CASE WHEN NOT coalesce(counted, false) THEN 'counted' END, CASE WHEN NOT coalesce(dated, false) THEN 'dated' END, CASE WHEN NOT coalesce(gapless, false) THEN 'gapless' END], lambda x: x IS NOT NULL), ',') AS failed FROM s""")
def summary_compatibility(spark, sf):
    """Names of the checks that the files of a label fail: requested lists equal those recorded, completeness flags true."""
    g = read_table(spark, sf, "source_specs").groupBy("label").agg(F.array_sort(F.collect_set("frame_count")).alias("budgets"), F.collect_set("schema").alias("schemas"), F.bool_and(F.col("declared_rows") > 0).alias("counted"), F.bool_and(F.col("written_at").isNotNull()).alias("dated"), (F.max("file_no") - F.min("file_no") + 1 == F.count_distinct("file_no")).alias("gapless"))
    ok = {"budgets": F.col("budgets") == F.array(*[F.lit(i) for i in (8, 16, 32)]), "schemas": F.size("schemas") == 1, "counted": F.col("counted"), "dated": F.col("dated"), "gapless": F.col("gapless")}
    return g.select("label", F.concat_ws(",", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in ok.items()]))).alias("failed"))


# ---- classes of answers and pairs

@query("SELECT source, item_id, q_index, CASE WHEN coalesce(choice_drift, false) AND coalesce(correctness_drift, false) THEN 'shared_drift' WHEN coalesce(choice_drift, false) THEN 'reuse_only_drift' WHEN coalesce(correctness_drift, false) THEN 'invalidated_only_drift' ELSE 'stable' END AS drift_class FROM pair_rows")
def drift_classes(spark, sf):
    """Which of two drift flags a pair shows; null counts as no drift."""
    return read_table(spark, sf, "pair_rows").select("source", "item_id", "q_index", A.drift_class(F.col("choice_drift"), F.col("correctness_drift")).alias("drift_class"))


@query("WITH g AS (SELECT source, avg(CAST(candidate_correct AS INTEGER)) - avg(CAST(baseline_correct AS INTEGER)) AS delta, bool_and(candidate_choice IS NOT NULL) AS format FROM pair_rows GROUP BY source) SELECT source, round(delta, 6) AS delta, CASE WHEN NOT format THEN 'format_invalid' WHEN delta >= -0.05 THEN 'low_fps_competitive' WHEN delta <= -0.10 THEN 'low_fps_rejected' ELSE 'ambiguous' END AS outcome FROM g")
def outcome_bands(spark, sf):
    """Outcome of a run by the bands of its accuracy delta."""
    g = read_table(spark, sf, "pair_rows").groupBy("source").agg((F.avg(F.col("candidate_correct").cast("int")) - F.avg(F.col("baseline_correct").cast("int"))).alias("delta"), F.bool_and(F.col("candidate_choice").isNotNull()).alias("format"))
    return g.select("source", F.round("delta", 6).alias("delta"), A.outcome(F.col("delta"), F.col("format")).alias("outcome"))


@query("""WITH o AS (SELECT path, line_no, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM raw_records WHERE payload IS NOT NULL AND length(trim(payload)) > 0), f AS (SELECT path, line_no, name, json_type(j, '$.' || name) AS t, json_extract_string(j, '$.' || name) AS s FROM o, (VALUES ('baseline_choice'), ('cold_choice'), ('q_index'), ('baseline_correct')) v(name) WHERE json_type(j) = 'OBJECT')
SELECT path, line_no, name AS field, CASE WHEN t IN ('BIGINT', 'UBIGINT') AND CAST(s AS BIGINT) BETWEEN 0 AND 25 THEN chr(CAST(65 + CAST(s AS BIGINT) AS INTEGER)) WHEN t = 'VARCHAR' AND regexp_full_match(trim(s), '[A-Za-z]') THEN upper(trim(s)) WHEN t = 'VARCHAR' AND regexp_full_match(trim(s), '[0-9]|1[0-9]|2[0-5]') THEN chr(65 + CAST(trim(s) AS INTEGER)) END AS letter FROM f""")
def normalised_letters(spark, sf):
    """Letters of raw choice fields: whole numbers and letters count, booleans and the rest do not."""
    v = F.try_parse_json("payload")
    lines = read_table(spark, sf, "raw_records").select("path", "line_no", v.alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    names = ("baseline_choice", "cold_choice", "q_index", "baseline_correct")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), A.normalised_letter(F.try_variant_get("v", f"$.{n}", "variant")).alias("letter")) for n in names]))
    return lines.select("path", "line_no", each.alias("x")).select("path", "line_no", "x.*")


@query("SELECT result_id, contains(coalesce(text, ''), 'addCriterion') OR contains(coalesce(text, ''), '自动') AS pathological FROM item_results")
def pathological_texts(spark, sf):
    """Texts with the short marker of a basin attractor."""
    return read_table(spark, sf, "item_results").select("result_id", A.pathological(F.col("text")).alias("pathological"))


# ---- paths and layouts

@query(r"SELECT path, TRY_CAST(nullif(regexp_extract(path, '_seed(\d+)', 1), '') AS INTEGER) AS seed, TRY_CAST(nullif(regexp_extract(path, '(?:^|[^0-9a-z])(\d+)f(?:[^0-9a-z]|$)', 1), '') AS INTEGER) AS frames, nullif(regexp_extract(path, '(phase[0-9]+)', 1), '') AS phase, CASE WHEN path IS NULL THEN 'missing' WHEN starts_with(path, '/') THEN 'absolute' WHEN starts_with(path, '~') THEN 'home' WHEN starts_with(path, 'results/') THEN 'generated' WHEN NOT regexp_matches(path, '^(research|data|exports|raw)/') THEN 'unknown root' END AS problem FROM source_specs")
def path_facts(spark, sf):
    """Seed, frames and phase in a file name, and what is wrong with its folder."""
    p = F.col("path")
    number = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")).try_cast("int")
    return read_table(spark, sf, "source_specs").select("path", number(r"_seed(\d+)").alias("seed"), number(r"(?:^|[^0-9a-z])(\d+)f(?:[^0-9a-z]|$)").alias("frames"), F.nullif(F.regexp_extract(p, "(phase[0-9]+)", 1), F.lit("")).alias("phase"), quality.path_problem(p, ("research", "data", "exports", "raw")).alias("problem"))


_SIDE = {"phase155": ("baseline_choice", "session_choice", "baseline_correct", "session_correct"), "phase130": ("cold_choice", "streaming_choice", "cold_correct", "streaming_correct")}
_LAYOUT = lambda i: "CASE WHEN s.schema = 'phase155' THEN json_extract_string(j, '$.{}') ELSE json_extract_string(j, '$.{}') END".format(_SIDE["phase155"][i], _SIDE["phase130"][i])
_ONE = "CASE WHEN regexp_full_match(upper(trim({c})), '[A-Z]') THEN upper(trim({c})) END"


@query(f"""WITH o AS (SELECT path, line_no, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM raw_records WHERE payload IS NOT NULL AND length(trim(payload)) > 0), r AS (SELECT s.label AS source, o.path AS source_path, line_no, json_extract_string(j, '$.item_id') AS item_id, {_ONE.format(c=_LAYOUT(0))} AS a, {_ONE.format(c=_LAYOUT(1))} AS b, coalesce({_LAYOUT(2)} = 'true', false) AS ac, coalesce({_LAYOUT(3)} = 'true', false) AS bc FROM o JOIN source_specs s ON o.path = s.path WHERE json_type(j) = 'OBJECT')
SELECT source, source_path, line_no, item_id, a AS baseline_choice, b AS candidate_choice, ac AS baseline_correct, bc AS candidate_correct, coalesce(a <> b, false) AS choice_drift, ac <> bc AS correctness_drift FROM r""")
def pair_layouts(spark, sf):
    """Paired rows from two layouts of raw lines, by the layout that the file declares."""
    s = read_table(spark, sf, "source_specs").select("path", "label", "schema")
    lines = read_table(spark, sf, "raw_records").select("path", "line_no", F.try_parse_json("payload").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    get = lambda i: F.when(F.col("schema") == "phase155", F.try_variant_get("v", f"$.{_SIDE['phase155'][i]}", "string")).otherwise(F.try_variant_get("v", f"$.{_SIDE['phase130'][i]}", "string"))
    a, b, ac, bc = A.single_letter(get(0)), A.single_letter(get(1)), F.coalesce(get(2) == "true", F.lit(False)), F.coalesce(get(3) == "true", F.lit(False))
    return lines.join(s, "path").select(F.col("label").alias("source"), F.col("path").alias("source_path"), "line_no", F.try_variant_get("v", "$.item_id", "string").alias("item_id"), a.alias("baseline_choice"), b.alias("candidate_choice"), ac.alias("baseline_correct"), bc.alias("candidate_correct"), A.drift(a, b, "bothpresent").alias("choice_drift"), (ac != bc).alias("correctness_drift"))


_CURVES = (
    '{"runs": [{"frame_count": 8, "dense_accuracy": 0.5, "dense_accuracy_ci95": [0.4, 0.6], "count": 60}, {"frame_count": 16, "accuracy": 0.55, "n": 58}]}',
    '{"dev": {"dense_curve": [{"frame_count": 4, "accuracy": 0.3, "ci95_low": 0.2, "ci95_high": 0.4, "n": 30}]}}',
    '{"dense_curve": [{"frame_count": 32, "dense_accuracy": 0.6, "count": 20}]}',
)


@query("SELECT * FROM (VALUES ('a', 8, 0.5::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 60), ('a', 16, 0.55, 0.0, 1.0, 58), ('b', 4, 0.3, 0.2, 0.4, 30), ('c', 32, 0.6, 0.0, 1.0, 20)) v(name, frame_count, dense_accuracy, ci95_low, ci95_high, n)")
def curve_layouts(spark, sf):
    """Points of a dense curve from the three layouts that summaries have."""
    d = spark.createDataFrame(list(zip("abc", _CURVES)), "name string, payload string")
    return files.curve_points(d, "payload", ["name"])


# ---- scores and rankings

@query("""WITH m AS (SELECT p_partkey, p_size / 100.0 AS novelty, p_retailprice / 2000.0 AS reuse, length(p_name) / 50.0 AS region FROM part)
SELECT p_partkey, round(3.0 * reuse + CASE WHEN novelty BETWEEN 0.03 AND 0.2 THEN 1.2 WHEN novelty < 0.01 THEN -3.8 WHEN novelty < 0.03 THEN -1.4 ELSE -4.0 * greatest(0.0, novelty - 0.2) END - 5.5 * greatest(0.0, region - 0.18) - 2.0 * greatest(0.0, region - 0.3), 6) AS score FROM m""")
def window_scores(spark, sf):
    """A linear score with penalties piece by piece."""
    p = read_table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 100.0).alias("novelty"), (F.col("p_retailprice") / 2000.0).alias("reuse"), (F.length("p_name") / 50.0).alias("region"))
    n = F.col("novelty")
    novelty = S.piecewise(n, [(n.between(0.03, 0.2), F.lit(1.2)), (n < 0.01, F.lit(-3.8)), (n < 0.03, F.lit(-1.4))], -4.0 * S.excess(n, 0.2))
    score = S.linear([(3.0, F.col("reuse")), (1.0, novelty), (-5.5, S.excess(F.col("region"), 0.18)), (-2.0, S.excess(F.col("region"), 0.3))])
    return p.select("p_partkey", F.round(score, 6).alias("score"))


@query(f"WITH {RP._ONCE}, g AS (SELECT arm, benchmark, round(avg(CAST(correct AS INTEGER)), 6) AS accuracy, round(avg(prompt_tokens), 4) AS cost, round(avg(CAST(choice_index = answer_index AS INTEGER)), 6) AS agreement FROM once GROUP BY arm, benchmark) SELECT arm, benchmark, accuracy, cost, agreement, row_number() OVER (ORDER BY accuracy DESC, cost, agreement DESC, arm, benchmark) AS place FROM g")
def arm_ranking(spark, sf):
    """Arms by accuracy, then cost, then agreement."""
    g = RP._results(spark, sf).groupBy("arm", "benchmark").agg(F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.round(F.avg("prompt_tokens"), 4).alias("cost"), F.round(F.avg((F.col("choice_index") == F.col("answer_index")).cast("int")), 6).alias("agreement"))
    order = Window.orderBy(F.desc("accuracy"), "cost", F.desc("agreement"), "arm", "benchmark")  # a row per arm and benchmark
    return g.withColumn("place", F.row_number().over(order).cast("bigint"))


@query(f"WITH {RP._ONCE} SELECT result_id, end_to_end_ms FROM once WHERE end_to_end_ms IS NOT NULL ORDER BY end_to_end_ms DESC, result_id LIMIT 10")
def top_latencies(spark, sf):
    """The ten greatest latencies."""
    return RP._results(spark, sf).filter("end_to_end_ms IS NOT NULL").select("result_id", "end_to_end_ms").orderBy(F.desc("end_to_end_ms"), "result_id").limit(10)


@query("WITH r AS (SELECT vec_id, vec_id // 16 AS f, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY md5('7|' || vec_id), vec_id) AS i, count(*) OVER (PARTITION BY vec_id // 16) AS n FROM embeddings) SELECT CAST(f AS BIGINT) AS f, vec_id FROM r WHERE i <= greatest(1, CAST(ceil(n * 0.5) AS BIGINT))")
def keep_random(spark, sf):
    """Half of the tokens of a frame in a seeded random order."""
    e = read_table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 16).cast("bigint").alias("f"), "vec_id")
    w = Window.partitionBy("f")  # 16 tokens
    r = e.withColumn("i", F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("7|"), F.col("vec_id").cast("string"))), "vec_id"))).withColumn("n", F.count("*").over(w))
    return r.filter(F.col("i") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.5))).select("f", "vec_id")


@query("""WITH lst AS (SELECT * FROM session_arms QUALIFY row_number() OVER (PARTITION BY session_key, arm_name ORDER BY ingested_at DESC) = 1), x AS (SELECT arm_name, duration, stream_total_ms AS v, row_number() OVER (PARTITION BY arm_name, duration ORDER BY stream_total_ms) - 1 AS i, count(*) OVER (PARTITION BY arm_name, duration) AS n FROM lst WHERE stream_total_ms IS NOT NULL), p AS (SELECT arm_name, duration, max(v) FILTER (i = CAST(floor(0.5 * (n - 1)) AS BIGINT)) AS p50, max(v) FILTER (i = CAST(floor(0.9 * (n - 1)) AS BIGINT)) AS p90, max(v) FILTER (i = CAST(floor(0.95 * (n - 1)) AS BIGINT)) AS p95 FROM x GROUP BY ALL),
g AS (SELECT arm_name, duration, count(*) AS n_sessions, round(avg(stream_total_ms), 4) AS mean_ms, round(sum(cold_total_ms) / sum(stream_total_ms), 6) AS speedup, CAST(sum(follow_up_stream_correct) AS BIGINT) AS follow_up_correct, CAST(sum(parse_failures) AS BIGINT) AS parse_failures FROM lst GROUP BY ALL) SELECT g.*, p50, p90, p95 FROM g LEFT JOIN p ON g.arm_name IS NOT DISTINCT FROM p.arm_name AND g.duration IS NOT DISTINCT FROM p.duration""")
def session_summary(spark, sf):
    """Latency, reuse and failures of sessions per arm and duration, with index percentiles."""
    cols = ("duration", "stream_total_ms", "cold_total_ms", "follow_up_stream_correct", "parse_failures")
    s = read_table(spark, sf, "session_arms").groupBy("session_key", "arm_name").agg(F.max_by(F.struct(*cols), "ingested_at").alias("r")).select("session_key", "arm_name", "r.*")
    s = materialize(s)
    keys = ["arm_name", "duration"]
    g = s.groupBy(*keys).agg(F.count("*").alias("n_sessions"), F.round(F.avg("stream_total_ms"), 4).alias("mean_ms"), F.round(F.sum("cold_total_ms") / F.sum("stream_total_ms"), 6).alias("speedup"), F.sum("follow_up_stream_correct").alias("follow_up_correct"), F.sum("parse_failures").alias("parse_failures"))
    p = S.index_percentile(s, keys, "stream_total_ms", {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    return g.alias("g").join(p.alias("p"), S._same(keys, "g", "p"), "left").select("g.*", "p.p50", "p.p90", "p.p95")


@query(f"WITH {SP._EV} SELECT event_id, array_to_string([CAST(x AS VARCHAR) FOR x IN range(CAST(floor(s / 300) AS BIGINT) * 300 - 900, CAST(floor(s / 300) AS BIGINT) * 300 + 1, 300)], ',') AS low_fps, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ',') AS last_k FROM ev")
def evidence_policies(spark, sf):
    """What two policies show at an event: four times of a slow clock, and the last three events of the user."""
    e = SP._events(spark, sf)
    grid = (F.floor(F.col("s") / 300) * 300).cast("bigint")
    times = F.transform(F.sequence(grid - 900, grid, F.lit(300).cast("bigint")), lambda x: x.cast("string"))
    w = Window.partitionBy("user_id").orderBy("s", "event_id").rowsBetween(-3, -1)
    before = F.transform(F.collect_list("event_id").over(w), lambda x: x.cast("string"))
    return e.select("event_id", F.array_join(times, ",").alias("low_fps"), F.when(F.size(before) > 0, F.array_join(before, ",")).alias("last_k"))


QUERIES, ORACLES = Q, O
