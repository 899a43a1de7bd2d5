"""Queries on runs, pairs and sessions: ``item_results``, ``pair_rows``, ``session_arms``, ``bench_items``, ``orders``/``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import answers as A
from framewright.functions import statistics as S
from framewright.operators import frontier as FR
from framewright.operators import pairing as P
from framewright.operators import selection as L
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


def _r6(*cols):
    return [F.round(c, 6).alias(n) for n, c in cols]


# ---- results of items by arm

RES = ["item_id", "benchmark", "item_group", "source", "keep_rate", "answer_index", "choice_index", "correct", "parse_failure", "text", "prompt_tokens", "generation_tokens", "vision_ms", "generate_ms", "end_to_end_ms", "result_id"]


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Each result once, as delivered last."""
    r = read_table(spark, sf, "item_results").select("run_id", "arm", "ingested_at", "finished_at", *RES)
    return P.last_wins(r, ["result_id"], ["ingested_at"])


_ONCE = "once AS (SELECT * FROM item_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) = 1)"


def _arm(spark, sf, arm: str) -> DataFrame:
    """The newest result of each item under an arm."""
    r = _results(spark, sf).filter(F.col("arm") == arm).select("item_id", "finished_at", "result_id", "benchmark", "item_group", "choice_index", "correct", "parse_failure", "generate_ms", "end_to_end_ms", "vision_ms")
    return P.last_wins(r, ["item_id"], ["finished_at", "result_id"]).drop("finished_at")


def _arm_sql(arm: str) -> str:
    return f"{arm} AS (SELECT * FROM once WHERE arm = '{arm}' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY finished_at DESC NULLS LAST, result_id DESC) = 1)"


_PAIR = f"{_ONCE}, {_arm_sql('dense')}, {_arm_sql('pruned')}, pr AS (SELECT d.item_id, d.benchmark, d.item_group, d.correct AS a, p.correct AS b, d.choice_index AS ca, p.choice_index AS cb, d.parse_failure AS fa, p.parse_failure AS fb, d.end_to_end_ms AS ta, p.end_to_end_ms AS tb, d.vision_ms AS va, p.vision_ms AS vb, d.generate_ms AS ga, p.generate_ms AS gb FROM dense d JOIN pruned p ON d.item_id IS NOT DISTINCT FROM p.item_id)"


def _paired(spark, sf) -> DataFrame:
    j = P.inner_pairs(_arm(spark, sf, "dense"), _arm(spark, sf, "pruned"), ["item_id"], ("d", "p"))
    return j.select("item_id", F.col("d_benchmark").alias("benchmark"), F.col("d_item_group").alias("item_group"), F.col("d_correct").alias("a"), F.col("p_correct").alias("b"), F.col("d_choice_index").alias("ca"), F.col("p_choice_index").alias("cb"), F.col("d_parse_failure").alias("fa"), F.col("p_parse_failure").alias("fb"), F.col("d_end_to_end_ms").alias("ta"), F.col("p_end_to_end_ms").alias("tb"), F.col("d_vision_ms").alias("va"), F.col("p_vision_ms").alias("vb"), F.col("d_generate_ms").alias("ga"), F.col("p_generate_ms").alias("gb"))


@query(f"WITH {_ONCE} SELECT arm, benchmark, item_group, count(*) AS n, round(coalesce(avg(CAST(correct AS INTEGER)), 0), 6) AS accuracy, round(coalesce(avg(CAST(parse_failure AS INTEGER)), 0), 6) AS parse_failure_rate, round(avg(end_to_end_ms), 4) AS mean_ms, count(*) FILTER (generation_tokens > 0 AND generate_ms > 0) AS n_rate, round(sum(generate_ms) FILTER (generation_tokens > 0 AND generate_ms > 0) / sum(generation_tokens) FILTER (generation_tokens > 0 AND generate_ms > 0), 6) AS ms_per_token FROM once GROUP BY arm, benchmark, item_group")
def group_accuracy(spark, sf):
    """Accuracy, failures and timing per arm and group; ratio of sums per token."""
    ok = (F.col("generation_tokens") > 0) & (F.col("generate_ms") > 0)
    return _results(spark, sf).groupBy("arm", "benchmark", "item_group").agg(F.count("*").alias("n"), *_r6(("accuracy", S.mean_or_zero(F.col("correct"))), ("parse_failure_rate", S.mean_or_zero(F.col("parse_failure")))), F.round(F.avg("end_to_end_ms"), 4).alias("mean_ms"), F.count_if(ok).alias("n_rate"), F.round(F.sum(F.when(ok, F.col("generate_ms"))) / F.sum(F.when(ok, F.col("generation_tokens"))), 6).alias("ms_per_token"))


@query(f"WITH {_ONCE} SELECT result_id, count(*) AS n FROM item_results GROUP BY result_id HAVING count(*) > 1")
def duplicate_results(spark, sf):
    """Keys that the unique-index guard refuses."""
    return P.duplicate_keys(read_table(spark, sf, "item_results"), ["result_id"])


@query(f"WITH {_ONCE}, {_arm_sql('dense')}, {_arm_sql('cached')} SELECT coalesce(d.item_id, c.item_id) AS item_id, CASE WHEN d.item_id IS NULL THEN 'missing_left' ELSE 'missing_right' END AS error FROM dense d FULL JOIN cached c ON d.item_id = c.item_id WHERE d.item_id IS NULL OR c.item_id IS NULL")
def pairing_errors(spark, sf):
    """What keeps dense and cached runs from strict 1:1 pairing."""
    return P.pairing_errors(_arm(spark, sf, "dense"), _arm(spark, sf, "cached"), ["item_id"])


@query(f"WITH {_PAIR} SELECT item_id, benchmark, CASE WHEN coalesce(fa, false) OR coalesce(fb, false) THEN 'degenerate' WHEN ca IS NOT DISTINCT FROM cb THEN 'clean' ELSE 'mixed' END AS bucket, CASE WHEN coalesce(a, false) AND coalesce(b, false) THEN 'both' WHEN coalesce(a, false) THEN 'dense_only' WHEN coalesce(b, false) THEN 'pruned_only' ELSE 'both_wrong' END AS overlap, NOT coalesce(ca = cb, false) AS drift_strict, ca IS DISTINCT FROM cb AS drift_nullsafe, coalesce(ca <> cb, false) AS drift_bothpresent FROM pr")
def pair_buckets(spark, sf):
    """Buckets, overlap and the three definitions of drift per pair."""
    no = F.lit(False)
    ca, cb = F.col("ca"), F.col("cb")
    return _paired(spark, sf).select("item_id", "benchmark", A.pair_bucket(F.coalesce("fa", no), F.coalesce("fb", no), ca, cb).alias("bucket"), A.overlap_bucket(F.col("a"), F.col("b"), ("dense", "pruned")).alias("overlap"), *[A.drift(ca, cb, r).alias(f"drift_{r}") for r in ("strict", "nullsafe", "bothpresent")])


@query(f"WITH {_PAIR} SELECT benchmark, item_group, count(*) AS n, count(*) FILTER (coalesce(a, false) AND coalesce(b, false)) AS both_right, count(*) FILTER (coalesce(a, false) AND NOT coalesce(b, false)) AS a_only, count(*) FILTER (NOT coalesce(a, false) AND coalesce(b, false)) AS b_only, count(*) FILTER (NOT coalesce(a, false) AND NOT coalesce(b, false)) AS both_wrong FROM pr GROUP BY benchmark, item_group")
def per_group_confusion(spark, sf):
    """Both right, one right, both wrong per group."""
    return P.confusion(_paired(spark, sf), ["benchmark", "item_group"], "a", "b")


def _ratio(num: str, den: str):
    return F.sum(num) / F.nullif(F.sum(den), F.lit(0.0))


@query(f"""WITH {_PAIR}, x AS (SELECT benchmark, count(*) AS n, avg(CAST(a AS INTEGER)) AS acc_a, avg(CAST(b AS INTEGER)) AS acc_b, avg(CAST(ca IS NOT DISTINCT FROM cb AS INTEGER)) AS agreement, sum(ta) FILTER (tb IS NOT NULL) / sum(tb) FILTER (ta IS NOT NULL) AS speedup, sum(va) FILTER (va IS NOT NULL AND ta IS NOT NULL) / sum(ta) FILTER (va IS NOT NULL AND ta IS NOT NULL) AS share, 1 - sum(vb) FILTER (va IS NOT NULL AND vb IS NOT NULL) / sum(va) FILTER (va IS NOT NULL AND vb IS NOT NULL) AS reduction, median(ta / tb) FILTER (tb > 0) AS median_ratio FROM pr GROUP BY benchmark)
SELECT benchmark, n, round(acc_a, 6) AS acc_a, round(acc_b, 6) AS acc_b, round(acc_b - acc_a, 6) AS delta, round(agreement, 6) AS agreement, round(speedup, 6) AS speedup, round(share, 6) AS share, round(reduction, 6) AS reduction, round(1 / (1 - share * reduction), 6) AS ceiling, round(speedup - 1 / (1 - share * reduction), 5) AS residual, round(median_ratio, 6) AS median_ratio FROM x""")
def arm_comparison(spark, sf):
    """Accuracy delta, agreement, ratio-of-sums speed-up and the ceiling that the vision share allows."""
    both = lambda x, *on: F.sum(F.when(F.greatest(*[F.col(c).isNull() for c in on]) == False, F.col(x)))  # noqa: E712,E731
    pairs = materialize(_paired(spark, sf))
    g = pairs.groupBy("benchmark").agg(
        F.count("*").alias("n"), F.avg(F.col("a").cast("int")).alias("acc_a"), F.avg(F.col("b").cast("int")).alias("acc_b"), F.avg(F.col("ca").eqNullSafe(F.col("cb")).cast("int")).alias("agreement"),
        (both("ta", "ta", "tb") / both("tb", "ta", "tb")).alias("speedup"), (both("va", "va", "ta") / both("ta", "va", "ta")).alias("share"), (1 - both("vb", "va", "vb") / both("va", "va", "vb")).alias("reduction"),
    )
    g = S.with_percentiles(g, pairs.filter("tb > 0").select("benchmark", (F.col("ta") / F.col("tb")).alias("r")), ["benchmark"], "r", {"median_ratio": 0.5})
    c = FR.ceiling(F.col("share"), F.col("reduction"))
    return g.select("benchmark", "n", *_r6(("acc_a", F.col("acc_a")), ("acc_b", F.col("acc_b")), ("delta", F.col("acc_b") - F.col("acc_a")), ("agreement", F.col("agreement")), ("speedup", F.col("speedup")), ("share", F.col("share")), ("reduction", F.col("reduction")), ("ceiling", c)), F.round(F.col("speedup") - c, 5).alias("residual"), F.round("median_ratio", 6).alias("median_ratio"))


@query(f"WITH {_ONCE}, {_arm_sql('dense')}, {_arm_sql('cached')}, l AS (SELECT DISTINCT item_id FROM dense WHERE NOT correct), r AS (SELECT DISTINCT item_id FROM cached WHERE NOT correct), j AS (SELECT l.item_id AS x, r.item_id AS y FROM l FULL JOIN r ON l.item_id = r.item_id) SELECT count(x) AS n_left, count(y) AS n_right, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_both, count(*) AS n_union, count(x) - count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS left_only, count(y) - count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS right_only, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*) AS jaccard FROM j")
def failure_overlap(spark, sf):
    """Overlap of the failure sets of two arms."""
    return P.overlap_stats(_arm(spark, sf, "dense").filter("NOT correct"), _arm(spark, sf, "cached").filter("NOT correct"), ["item_id"])


@query(f"WITH {_ONCE}, {_arm_sql('dense')}, {_arm_sql('pruned')} SELECT item_id, 'left_only' AS side FROM (SELECT item_id FROM dense EXCEPT SELECT item_id FROM pruned) UNION ALL SELECT item_id, 'right_only' FROM (SELECT item_id FROM pruned EXCEPT SELECT item_id FROM dense) UNION ALL SELECT item_id, 'both' FROM (SELECT item_id FROM dense INTERSECT SELECT item_id FROM pruned)")
def key_sets(spark, sf):
    """Items of either and of both arms."""
    a, b = _arm(spark, sf, "dense").select("item_id"), _arm(spark, sf, "pruned").select("item_id")
    side = lambda d, n: d.withColumn("side", F.lit(n))
    return side(a.subtract(b), "left_only").unionByName(side(b.subtract(a), "right_only")).unionByName(side(a.intersect(b), "both"))


@query(f"""WITH {_PAIR}, g AS (SELECT benchmark, item_group, a, count(*) AS n, avg(CAST(ca IS DISTINCT FROM cb AS INTEGER)) AS drift, grouping(benchmark, item_group, a) AS gid FROM pr GROUP BY GROUPING SETS ((benchmark), (item_group), (a), (benchmark, a)))
SELECT benchmark, item_group, a AS dense_correct, n, round(drift, 6) AS drift, CAST(gid AS BIGINT) AS gid FROM g WHERE n >= 5""")
def grouping_sets_drift(spark, sf):
    """Drift by several independent features and one cross feature in one pass."""
    p = _paired(spark, sf).withColumn("d", (~F.col("ca").eqNullSafe(F.col("cb"))).cast("int"))
    b, i, a = F.col("benchmark"), F.col("item_group"), F.col("a")
    g = p.groupingSets([[b], [i], [a], [b, a]], b, i, a).agg(F.count("*").alias("n"), F.avg("d").alias("drift"), F.grouping_id().alias("gid"))
    return g.filter("n >= 5").select("benchmark", "item_group", F.col("a").alias("dense_correct"), "n", F.round("drift", 6).alias("drift"), F.col("gid").cast("bigint").alias("gid"))


_Z = S.Z95


def _wil(k: str, n: str) -> tuple[str, str]:
    c = f"({k} / {n} + {_Z * _Z} / (2 * {n})) / (1 + {_Z * _Z} / {n})"
    h = f"{_Z} * sqrt(greatest({k} / {n} * (1 - {k} / {n}) / {n} + {_Z * _Z} / (4.0 * {n} * {n}), 0)) / (1 + {_Z * _Z} / {n})"
    return f"{c} - {h}", f"{c} + {h}"


@query(f"WITH {_ONCE}, g AS (SELECT arm, benchmark, CAST(count(*) FILTER (correct) AS DOUBLE) AS k, CAST(count(correct) AS DOUBLE) AS n FROM once GROUP BY arm, benchmark) SELECT arm, benchmark, CAST(n AS BIGINT) AS n, round({_wil('k', 'n')[0]}, 6) AS low, round({_wil('k', 'n')[1]}, 6) AS high, round(greatest(0, {_wil('k', 'n')[0]}), 6) AS low_clamped, round(least(1, {_wil('k', 'n')[1]}), 6) AS high_clamped, round(sqrt(greatest(k / n * (1 - k / n), 0) / n), 6) AS se FROM g")
def wilson_by_group(spark, sf):
    """Wilson intervals, plain and clamped, and the binomial error."""
    g = _results(spark, sf).groupBy("arm", "benchmark").agg(F.count_if("correct").alias("k"), F.count("correct").alias("n"))
    k, n = F.col("k"), F.col("n")
    (a, b), (c, d) = S.wilson(k, n), S.wilson(k, n, clamp=True)
    return g.select("arm", "benchmark", "n", *_r6(("low", a), ("high", b), ("low_clamped", c), ("high_clamped", d), ("se", S.binomial_se(k / n, n))))


@query()
def bootstrap_accuracy(spark, sf):
    """Clustered bootstrap interval of accuracy per arm and benchmark."""
    return S.bootstrap(_results(spark, sf), ["arm", "benchmark"], "item_id", "correct", 10_000)


@query(f"WITH {_ONCE} SELECT source, count(DISTINCT item_id) AS items, count(*) AS n, round(sum(end_to_end_ms) / sum(generation_tokens), 4) AS x FROM once WHERE end_to_end_ms IS NOT NULL AND generation_tokens > 0 GROUP BY source")
def per_token_time(spark, sf):
    """Milliseconds per generated token and distinct items per source."""
    r = _results(spark, sf).filter("end_to_end_ms IS NOT NULL AND generation_tokens > 0")
    return r.groupBy("source").agg(F.countDistinct("item_id").alias("items"), F.count("*").alias("n"), F.round(F.sum("end_to_end_ms") / F.sum("generation_tokens"), 4).alias("x"))


_LAB = f"{_ONCE}, l AS (SELECT benchmark, generate_ms AS s, CAST(correct AS INTEGER) AS y, choice_index, answer_index FROM once WHERE arm = 'dense' AND generate_ms IS NOT NULL AND correct IS NOT NULL)"


def _labelled(spark, sf) -> DataFrame:
    return _results(spark, sf).filter("arm = 'dense' AND generate_ms IS NOT NULL AND correct IS NOT NULL").select("benchmark", F.col("generate_ms").alias("s"), F.col("correct").cast("int").alias("y"), "choice_index", "answer_index", "result_id")


@query(f"WITH {_LAB}, r AS (SELECT *, rank() OVER (PARTITION BY benchmark ORDER BY s) + (count(*) OVER (PARTITION BY benchmark, s) - 1) / 2.0 AS rk FROM l) SELECT benchmark, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)), 6) AS auc FROM r GROUP BY benchmark")
def auc_latency_correct(spark, sf):
    """AUC of the generation time for correctness."""
    return S.auc(_labelled(spark, sf), ["benchmark"], "s", "y").withColumn("auc", F.round("auc", 6))


@query(f"WITH {_LAB}, c AS (SELECT benchmark, s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM l GROUP BY benchmark, s), w AS (SELECT *, sum(pos + neg) OVER d AS n, sum(neg) OVER d AS k, sum(pos + neg) OVER (PARTITION BY benchmark) AS total FROM c WINDOW d AS (PARTITION BY benchmark ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT benchmark, s AS threshold, round(n / total, 6) AS coverage, round(k / n, 6) AS precision FROM w WHERE k / n >= 0.4 QUALIFY row_number() OVER (PARTITION BY benchmark ORDER BY n / total DESC, s) = 1")
def safe_filter(spark, sf):
    """The threshold of greatest coverage at a floor of precision."""
    d = S.safe_filter(_labelled(spark, sf), ["benchmark"], "s", "y", 0.4)
    return d.select("benchmark", "threshold", F.round("coverage", 6).alias("coverage"), F.round("precision", 6).alias("precision"))


@query(f"WITH {_LAB} SELECT benchmark, count(*) AS n, count(*) FILTER (s >= 2000) AS flagged, round(avg(CASE WHEN s >= 2000 THEN 1 - y END), 6) AS precision, round(avg(CAST(s >= 2000 AS INTEGER)), 6) AS coverage, round(avg((CAST(s >= 2000 AS INTEGER) - (1 - y)) ** 2), 6) AS brier FROM l GROUP BY benchmark")
def threshold_evaluation(spark, sf):
    """Precision, coverage and Brier score of a fixed threshold."""
    hit = (F.col("s") >= 2000).cast("int")
    return _labelled(spark, sf).groupBy("benchmark").agg(F.count("*").alias("n"), F.count_if(F.col("s") >= 2000).alias("flagged"), *_r6(("precision", F.avg(F.when(F.col("s") >= 2000, 1 - F.col("y")))), ("coverage", F.avg(hit)), ("brier", F.avg((hit - (1 - F.col("y"))) ** 2))))


@query(f"WITH {_ONCE}, l AS (SELECT benchmark, generate_ms AS s, CAST(correct AS INTEGER) AS y, result_id FROM once WHERE arm = 'dense' AND generate_ms IS NOT NULL AND correct IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY s, result_id) - 1 AS i, count(*) OVER (PARTITION BY benchmark) AS n FROM l), b AS (SELECT *, (SELECT count(*) FROM range(1, 5) e(k) WHERE i >= round_even(k * n / 5.0, 0)) AS bin FROM r) SELECT benchmark, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(s), 4) AS mean_s, round(avg(y), 6) AS rate FROM b GROUP BY benchmark, bin")
def calibration_bins(spark, sf):
    """Equal-count bins with edges rounded half to even."""
    d = S.equal_count_bins(_labelled(spark, sf), ["benchmark"], "s", [F.col("result_id")], 5)
    return d.groupBy("benchmark", "bin").agg(F.count("*").alias("n"), F.round(F.avg("s"), 4).alias("mean_s"), F.round(F.avg("y"), 6).alias("rate"))


_KAP = f"{_PAIR}, c AS (SELECT benchmark, ca, cb, count(*) AS n FROM pr GROUP BY ALL), t AS (SELECT benchmark, sum(n) AS t, sum(n) FILTER (ca IS NOT DISTINCT FROM cb) AS o FROM c GROUP BY benchmark), ma AS (SELECT benchmark, ca AS k, sum(n) AS m FROM c GROUP BY ALL), mb AS (SELECT benchmark, cb AS k, sum(n) AS m FROM c GROUP BY ALL), e AS (SELECT ma.benchmark, sum(ma.m * mb.m) AS e FROM ma JOIN mb ON ma.benchmark = mb.benchmark AND ma.k IS NOT DISTINCT FROM mb.k GROUP BY ma.benchmark)"


@query(f"WITH {_KAP} SELECT t.benchmark, round((o / t - e / (t * t)) / (1 - e / (t * t)), 6) AS kappa FROM t JOIN e ON t.benchmark = e.benchmark")
def kappa_choices(spark, sf):
    """Agreement of the choices of two arms beyond chance, null being a choice."""
    return S.kappa(_paired(spark, sf), ["benchmark"], "ca", "cb").withColumn("kappa", F.round("kappa", 6))


@query(f"WITH {_ONCE}, m AS (SELECT arm, avg(generate_ms) AS m, stddev_pop(generate_ms) AS s, median(generate_ms) AS med FROM once GROUP BY arm), d AS (SELECT o.arm, result_id, generate_ms, m, s, med, median(abs(generate_ms - med)) OVER (PARTITION BY o.arm) AS mad FROM once o JOIN m ON o.arm = m.arm WHERE generate_ms IS NOT NULL) SELECT result_id, round((generate_ms - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 5) AS z, round((generate_ms - med) / (mad + 1e-6), 4) AS robust_z, (generate_ms - med) / (mad + 1e-6) > 1.5 AS event FROM d")
def standardised_timings(spark, sf):
    """Standard and median-based scores of a timing per arm; the statistics are joined, not windowed."""
    r = _results(spark, sf).filter("generate_ms IS NOT NULL").select("arm", "result_id", "generate_ms")
    r = materialize(r)
    m = r.groupBy("arm").agg(F.avg("generate_ms").alias("m"), F.stddev_pop("generate_ms").alias("s"))
    m = materialize(S.with_percentiles(m, r, ["arm"], "generate_ms", {"med": 0.5}))
    j = r.join(m, "arm").withColumn("dev", F.abs(F.col("generate_ms") - F.col("med")))
    j = j.join(S.percentile(j, ["arm"], "dev", {"mad": 0.5}), "arm")
    s = F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s"))
    rz = (F.col("generate_ms") - F.col("med")) / (F.col("mad") + 1e-6)
    return j.select("result_id", F.round((F.col("generate_ms") - F.col("m")) / s, 5).alias("z"), F.round(rz, 4).alias("robust_z"), (rz > 1.5).alias("event"))


@query()
def logistic_drift(spark, sf):
    """Probability of a correct answer by a regression on two standardised features."""
    r = _results(spark, sf).filter("correct IS NOT NULL AND generate_ms IS NOT NULL AND prompt_tokens IS NOT NULL").select("result_id", "correct", F.ln(F.col("generate_ms") + 1).alias("u"), F.col("prompt_tokens").cast("double").alias("v"))
    m = r.agg(F.avg("u").alias("mu"), F.stddev_pop("u").alias("su"), F.avg("v").alias("mv"), F.stddev_pop("v").alias("sv"))
    x = r.crossJoin(F.broadcast(m)).select("result_id", "correct", ((F.col("u") - F.col("mu")) / F.greatest("su", F.lit(1e-8))).alias("x1"), ((F.col("v") - F.col("mv")) / F.greatest("sv", F.lit(1e-8))).alias("x2"))  # one row
    x = materialize(x)  # read by every pass
    w = S.logistic_optimum(x, ["x1", "x2"], "correct")
    return x.select("result_id", F.round(S.logistic_score(["x1", "x2"], w), 6).alias("p"))


@query(f"WITH {_ONCE}, v AS (SELECT benchmark, arm, end_to_end_ms AS v, row_number() OVER (PARTITION BY benchmark, arm ORDER BY end_to_end_ms) AS i, count(*) OVER (PARTITION BY benchmark, arm) AS n FROM once WHERE end_to_end_ms IS NOT NULL) SELECT benchmark, arm, max(v) FILTER (i = CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1) AS p50, max(v) FILTER (i = CAST(floor(0.9 * (n - 1)) AS BIGINT) + 1) AS p90, max(v) FILTER (i = CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1) AS p99 FROM v GROUP BY benchmark, arm")
def index_percentiles(spark, sf):
    """The index percentile rule per group."""
    return S.index_percentile(_results(spark, sf), ["benchmark", "arm"], "end_to_end_ms", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query(f"WITH {_ONCE} SELECT arm, round(1000.0 * sum(n_frames) / sum(vision_ms), 6) AS fps, round(median(1000.0 * n_frames / vision_ms), 6) AS median_fps, round(min(1000.0 * n_frames / vision_ms), 6) AS least, round(max(1000.0 * n_frames / vision_ms), 6) AS most, count(*) FILTER (1000.0 * n_frames / vision_ms >= 30) AS n_30 FROM once WHERE vision_ms > 0 AND n_frames IS NOT NULL GROUP BY arm")
def fps_summary(spark, sf):
    """Frames per second of the vision stage."""
    r = P.last_wins(read_table(spark, sf, "item_results").select("result_id", "ingested_at", "arm", "n_frames", "vision_ms"), ["result_id"], ["ingested_at"]).filter("vision_ms > 0 AND n_frames IS NOT NULL")
    f = 1000.0 * F.col("n_frames") / F.col("vision_ms")
    r = materialize(r.select("arm", "n_frames", "vision_ms", f.alias("f")))
    g = r.groupBy("arm").agg(*_r6(("fps", 1000.0 * F.sum("n_frames") / F.sum("vision_ms")), ("least", F.min("f")), ("most", F.max("f"))), F.count_if(F.col("f") >= 30).alias("n_30"))
    return S.with_percentiles(g, r, ["arm"], "f", {"median_fps": 0.5}).withColumn("median_fps", F.round("median_fps", 6))


@query(f"WITH {_ONCE} SELECT coalesce(CAST(keep_rate AS VARCHAR), 'all') AS keep_rate, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 6) AS accuracy, avg(CAST(correct AS INTEGER)) >= 0.3 AND avg(CAST(parse_failure AS INTEGER)) <= 0.2 AS passes FROM once GROUP BY keep_rate")
def keep_rate_bracket(spark, sf):
    """Gates per keep rate."""
    acc, pf = F.avg(F.col("correct").cast("int")), F.avg(F.col("parse_failure").cast("int"))
    return _results(spark, sf).groupBy("keep_rate").agg(F.count("*").alias("n"), F.round(acc, 6).alias("accuracy"), ((acc >= 0.3) & (pf <= 0.2)).alias("passes")).withColumn("keep_rate", F.coalesce(F.col("keep_rate").cast("string"), F.lit("all")))


# ---- answers and text

@query(r"""WITH b AS (SELECT item_id, min_by(candidates, record_id) AS candidates FROM bench_items GROUP BY item_id), t AS (SELECT DISTINCT r.item_id, r.text, candidates, upper(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS u, list_distinct(regexp_extract_all(regexp_split_to_array(text, '[.!?\n]')[1], '(?:^|[^A-Za-z0-9_])([A-Z])(?:$|[^A-Za-z0-9_])', 1)) AS raw FROM item_results r JOIN b ON r.item_id = b.item_id WHERE text IS NOT NULL)
SELECT item_id, text, CASE WHEN length(u) > 0 AND ascii(u) - 65 BETWEEN 0 AND len(candidates) - 1 THEN chr(ascii(u)) END AS prefix FROM t""")
def prefix_letters(spark, sf):
    """The option letter that begins a response."""
    b = read_table(spark, sf, "bench_items").groupBy("item_id").agg(F.min_by("candidates", "record_id").alias("candidates"))
    r = read_table(spark, sf, "item_results").filter("text IS NOT NULL").select("item_id", "text").distinct()
    return r.join(b, "item_id").select("item_id", "text", A.prefix_letter(F.col("text"), F.size("candidates")).alias("prefix"))


@query(r"""WITH b AS (SELECT item_id, min_by(candidates, record_id) AS c FROM bench_items GROUP BY item_id), t AS (SELECT DISTINCT r.item_id, r.text, c, upper(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS u FROM item_results r JOIN b ON r.item_id = b.item_id WHERE text IS NOT NULL),
x AS (SELECT item_id, text, CASE WHEN length(u) > 0 AND ascii(u) - 65 BETWEEN 0 AND len(c) - 1 THEN chr(ascii(u)) END AS prefix, list_filter(list_distinct(regexp_extract_all(regexp_replace(regexp_split_to_array(text, '[.!?\n]')[1], '[^A-Za-z0-9_]', '  ', 'g'), '(?:^| )([A-Z])(?: |$)', 1)), lambda l: ascii(l) - 65 < len(c)) AS alone, list_filter(range(0, coalesce(len(c), 0)), lambda i: coalesce(length(c[i + 1]) > 0 AND contains(lower(text), lower(c[i + 1])), false)) AS named, list_distinct(regexp_extract_all(regexp_replace(text, '[^A-Za-z]', '  ', 'g'), '(?:^| )([ABCD])(?: |$)', 1)) AS any_ FROM t)
SELECT item_id, text, coalesce(prefix, CASE WHEN len(alone) = 1 THEN alone[1] END, CASE WHEN len(named) = 1 THEN chr(CAST(65 + named[1] AS INTEGER)) END) AS choice, CASE WHEN len(any_) = 1 THEN any_[1] END AS permissive FROM x""")
def extract_choice(spark, sf):
    """The option that a response gives, by prefix, lone letter or words."""
    b = read_table(spark, sf, "bench_items").groupBy("item_id").agg(F.min_by("candidates", "record_id").alias("candidates"))
    r = read_table(spark, sf, "item_results").filter("text IS NOT NULL").select("item_id", "text").distinct()
    return r.join(b, "item_id").select("item_id", "text", A.extract_choice(F.col("text"), F.col("candidates")).alias("choice"), A.permissive_choice(F.col("text")).alias("permissive"))


@query(r"""WITH t AS (SELECT result_id, text, parse_failure, upper(regexp_replace(text, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')) AS u FROM item_results)
SELECT result_id, contains(coalesce(text, ''), '<|im_end|>') OR contains(coalesce(text, ''), '<end_of_turn>') OR coalesce(parse_failure, false) AS degenerate, CASE WHEN starts_with(u, 'YES') THEN 'yes' WHEN starts_with(u, 'NO') THEN 'no' END AS yes_no, CASE WHEN regexp_full_match(u, '[A-Z]') THEN u END AS letter FROM t""")
def degenerate_markers(spark, sf):
    """Degenerate responses, yes/no prefixes and bare letters."""
    t = F.col("text")
    return read_table(spark, sf, "item_results").select("result_id", A.degenerate(t, F.col("parse_failure")).alias("degenerate"), A.yes_no(t).alias("yes_no"), A.single_letter(t).alias("letter"))


@query("SELECT record_id, question || chr(10) || array_to_string(list_transform(range(1, len(candidates) + 1), lambda i: chr(CAST(64 + i AS INTEGER)) || '. ' || candidates[i]), chr(10)) AS prompt, substr(sha256(concat_ws('|', 'v2', item_id, benchmark, split)), 1, 24) AS digest, split_part(item_id, ':', 1) AS bench, split_part(item_id, ':', 2) AS grp, TRY_CAST(regexp_extract(item_id, '-([^-]*)$', 1) AS INTEGER) AS question_no FROM bench_items")
def prompt_build(spark, sf):
    """Prompts, content keys and parts of composite ids."""
    b = read_table(spark, sf, "bench_items")
    bench, grp, _, no = A.id_parts(F.col("item_id"))
    return b.select("record_id", A.prompt(F.col("question"), F.col("candidates")).alias("prompt"), A.digest(F.lit("v2"), F.col("item_id"), F.col("benchmark"), F.col("split")).alias("digest"), bench.alias("bench"), grp.alias("grp"), no.alias("question_no"))


@query("SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 280) AS snippet, CASE WHEN contains(source, 'log') THEN 'log' WHEN contains(source, 'note') THEN 'note' ELSE 'other' END AS family FROM documents")
def snippets(spark, sf):
    """Display snippets and families by name."""
    s = F.col("source")
    fam = F.when(F.contains(s, F.lit("log")), "log").when(F.contains(s, F.lit("note")), "note").otherwise("other")
    return read_table(spark, sf, "documents").select("doc_id", A.snippet(F.col("text")).alias("snippet"), fam.alias("family"))


# ---- registries, sampling, quotas

@query("SELECT item_id, min(record_id) AS record_id, count(*) AS n, arg_min(manifest, record_id) AS manifest FROM bench_items GROUP BY item_id")
def manifest_union(spark, sf):
    """Union of manifests, the first sighting of an item wins."""
    b = read_table(spark, sf, "bench_items")
    return b.groupBy("item_id").agg(F.min("record_id").alias("record_id"), F.count("*").alias("n"), F.min_by("manifest", "record_id").alias("manifest"))


@query("SELECT b.record_id FROM bench_items b WHERE split <> 'train' AND NOT EXISTS (SELECT 1 FROM item_results r WHERE r.item_id = b.item_id)")
def pending_items(spark, sf):
    """Requested minus completed."""
    b = read_table(spark, sf, "bench_items").filter("split <> 'train'")
    return b.join(read_table(spark, sf, "item_results").select("item_id"), "item_id", "left_anti").select("record_id")


@query("WITH s AS (SELECT record_id, benchmark, item_group, row_number() OVER (PARTITION BY benchmark, item_group ORDER BY md5(CAST(record_id AS VARCHAR)), record_id) - 1 AS i FROM bench_items), r AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY i, item_group) - 1 AS k FROM s) SELECT record_id, CASE WHEN k % 2 = 0 THEN 'dev' ELSE 'holdout' END AS part FROM r WHERE k < 60")
def balanced_split(spark, sf):
    """Disjoint dev and holdout samples, dealt round robin over the groups of a benchmark."""
    b = read_table(spark, sf, "bench_items").select("record_id", "benchmark", "item_group")
    i = F.row_number().over(Window.partitionBy("benchmark", "item_group").orderBy(F.md5(F.col("record_id").cast("string")), "record_id")) - 1
    s = b.withColumn("i", i)
    k = F.row_number().over(Window.partitionBy("benchmark").orderBy("i", "item_group")) - 1
    return s.withColumn("k", k).filter("k < 60").select("record_id", F.when(F.col("k") % 2 == 0, "dev").otherwise("holdout").alias("part"))


@query("WITH v AS (SELECT item_id, max(CAST(choice_drift AS INTEGER)) AS drift FROM pair_rows GROUP BY item_id), r AS (SELECT *, row_number() OVER (PARTITION BY drift ORDER BY md5(item_id), item_id) AS i, count(*) OVER (PARTITION BY drift) AS n FROM v) SELECT item_id, drift, CASE WHEN i <= round_even(n * 0.7, 0) THEN 'train' ELSE 'test' END AS part FROM r")
def group_safe_split(spark, sf):
    """Train/test split by item, stratified by whether any row drifts."""
    v = read_table(spark, sf, "pair_rows").groupBy("item_id").agg(F.max(F.col("choice_drift").cast("int")).alias("drift"))
    w = Window.partitionBy("drift")
    r = v.withColumn("i", F.row_number().over(w.orderBy(F.md5("item_id"), "item_id"))).withColumn("n", F.count("*").over(w))
    return r.select("item_id", "drift", F.when(F.col("i") <= F.bround(F.col("n") * 0.7), "train").otherwise("test").alias("part"))


@query("WITH r AS (SELECT record_id, benchmark, split, row_number() OVER (PARTITION BY benchmark, split = 'dev' ORDER BY record_id DESC) AS i FROM bench_items), t AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY (split = 'dev' AND i <= 5) DESC, record_id DESC) AS k FROM r) SELECT record_id, benchmark, (split = 'dev' AND i <= 5) AS tier FROM t WHERE k <= 20")
def two_tier_quota(spark, sf):
    """A quota of preferred rows, then the rest in order."""
    r = L.top_k(read_table(spark, sf, "bench_items").select("record_id", "benchmark", (F.col("split") == "dev").alias("dev")), ["benchmark", "dev"], [F.desc("record_id")], 5, "in_quota")
    t = r.withColumn("tier", F.col("dev") & F.col("in_quota"))
    return L.top_k(t, ["benchmark"], [F.desc("tier"), F.desc("record_id")], 20).filter("keep").select("record_id", "benchmark", "tier")


@query("WITH v AS (SELECT record_id, benchmark, video_id, row_number() OVER (PARTITION BY benchmark, video_id ORDER BY record_id) AS i FROM bench_items) SELECT record_id, benchmark FROM (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY record_id) AS k FROM v WHERE i <= 2) WHERE k <= 40")
def diverse_selection(spark, sf):
    """At most two records per video, then a cap per benchmark."""
    b = read_table(spark, sf, "bench_items").select("record_id", "benchmark", "video_id")
    v = L.top_k(b, ["benchmark", "video_id"], [F.col("record_id")], 2).filter("keep").drop("keep")
    return L.top_k(v, ["benchmark"], [F.col("record_id")], 40).filter("keep").select("record_id", "benchmark")


@query("SELECT item_id, len(list_distinct(list(video_id))) AS n_videos, CASE WHEN bool_and(contains(manifest, 'dev')) THEN 'all_dev' WHEN bool_and(contains(manifest, 'holdout')) THEN 'all_holdout' ELSE 'mixed' END AS label FROM bench_items GROUP BY item_id")
def split_labels(spark, sf):
    """Split label of an item over all its manifests."""
    dev, hold = F.bool_and(F.contains("manifest", F.lit("dev"))), F.bool_and(F.contains("manifest", F.lit("holdout")))
    return read_table(spark, sf, "bench_items").groupBy("item_id").agg(F.countDistinct("video_id").alias("n_videos"), F.when(dev, "all_dev").when(hold, "all_holdout").otherwise("mixed").alias("label"))


# ---- sessions and policies

_SES = "lst AS (SELECT * FROM session_arms QUALIFY row_number() OVER (PARTITION BY session_key, arm_name ORDER BY ingested_at DESC) = 1), sp AS (SELECT p.session_key, coalesce(p.duration, d.duration) AS duration, coalesce(p.split, d.split) AS split, p, d FROM lst p JOIN lst d ON p.session_key = d.session_key WHERE p.arm_name = 'pruned_q0' AND d.arm_name = 'dense_q0')"


def _sessions(spark, sf) -> DataFrame:
    return FR.session_pairs(read_table(spark, sf, "session_arms").drop("video_id", "session_id", "recorded_at"))


@query(f"WITH {_SES} SELECT session_key, duration, split, p.stream_correct - d.stream_correct AS gain, p.q0_stream_correct AS q0_pruned, d.q0_stream_correct AS q0_dense, round(p.cold_total_ms / p.stream_total_ms, 6) AS speedup_pruned, round(d.cold_total_ms / d.stream_total_ms, 6) AS speedup_dense FROM sp")
def session_metrics(spark, sf):
    """Both arms of a session side by side."""
    s = _sessions(spark, sf)
    x = lambda a: F.round(F.col(f"{a}.cold_total_ms") / F.col(f"{a}.stream_total_ms"), 6)
    return s.select("session_key", "duration", "split", (F.col("pruned.stream_correct") - F.col("dense.stream_correct")).alias("gain"), F.col("pruned.q0_stream_correct").alias("q0_pruned"), F.col("dense.q0_stream_correct").alias("q0_dense"), x("pruned").alias("speedup_pruned"), x("dense").alias("speedup_dense"))


_POLS = {"all_pruned": "false", "all_dense": "true", "dense_on_short": "duration = 'short'", "dense_on_medium": "duration = 'medium'", "dense_on_long": "duration = 'long'", "dense_on_short_medium": "duration IN ('short', 'medium')", "dense_on_short_long": "duration IN ('short', 'long')", "dense_on_medium_long": "duration IN ('medium', 'long')", "dense_if_q0_gains": "d.q0_stream_correct > p.q0_stream_correct", "dense_if_session_gains": "d.stream_correct > p.stream_correct"}
_POLSQL = " UNION ALL ".join(f"SELECT '{n}' AS policy, coalesce({c}, false) AS is_dense, CASE WHEN coalesce({c}, false) THEN d ELSE p END AS arm FROM sp" for n, c in _POLS.items())


@query(f"WITH {_SES}, x AS ({_POLSQL}), g AS (SELECT policy, count(*) AS n_sessions, count(*) FILTER (is_dense) AS n_dense, CAST(sum(arm.stream_correct) AS BIGINT) AS stream_correct, CAST(sum(arm.cold_correct) AS BIGINT) AS cold_correct, sum(arm.stream_total_ms) AS sm, sum(arm.cold_total_ms) AS cm FROM x GROUP BY policy), h AS (SELECT *, (stream_correct - cold_correct) / (n_sessions * 3) AS delta, cm / sm AS speedup FROM g) SELECT policy, n_sessions, n_dense, stream_correct, cold_correct, round(delta, 6) AS delta, round(speedup, 6) AS speedup, abs(delta) <= 0.05 AND speedup >= 3 AS passes, delta >= -0.1 AND speedup >= 3 AS rescues FROM h")
def policy_suite(spark, sf):
    """Totals and flags of ten admission policies."""
    e = FR.evaluate_policies(_sessions(spark, sf), FR.policy_suite())
    return e.select("policy", "n_sessions", "n_dense", "stream_correct", "cold_correct", F.round("delta", 6).alias("delta"), F.round("speedup", 6).alias("speedup"), "passes", "rescues")


@query()
def admission_frontier(spark, sf):
    """Exact frontier of time slack over the change of correct answers, with the totals of the chosen arms."""
    return FR.admission_frontier(_sessions(spark, sf))


@query()
def frontier_picks(spark, sf):
    """Best points of the frontier under six constraints; null where none qualifies."""
    s = materialize(_sessions(spark, sf))
    return FR.best_points(FR.frontier_points(FR.admission_frontier(s), s.groupBy("split").agg(F.count("*").alias("n_sessions"))))


_DUR = "(SELECT duration, avg(cold_total_ms / 3) AS cold, avg(stream_total_ms / 3) AS follow, avg(cold_total_ms) AS setup FROM session_arms WHERE cold_total_ms IS NOT NULL AND stream_total_ms IS NOT NULL GROUP BY duration)"


@query(f"SELECT duration, CAST(q AS INTEGER) AS q, round(q * cold / (setup + q * follow), 6) AS speedup FROM {_DUR}, (VALUES (1), (2), (5), (10), (50)) v(q)")
def setup_inclusive_speedup(spark, sf):
    """Speed-up with the setup paid once over 1 to 50 queries."""
    g = read_table(spark, sf, "session_arms").filter("cold_total_ms IS NOT NULL AND stream_total_ms IS NOT NULL").groupBy("duration").agg(F.avg(F.col("cold_total_ms") / 3).alias("cold"), F.avg(F.col("stream_total_ms") / 3).alias("follow"), F.avg("cold_total_ms").alias("setup"))
    g = g.withColumn("q", F.explode(F.array(*[F.lit(i) for i in (1, 2, 5, 10, 50)])))
    return g.select("duration", "q", F.round(FR.setup_inclusive_speedup(F.col("setup"), F.col("follow"), F.col("cold"), F.col("q")), 6).alias("speedup"))


# ---- paired rows

@query("SELECT source, CAST(q_index AS INTEGER) AS q_index, count(*) AS n, round(avg(CAST(baseline_correct AS INTEGER)), 6) AS baseline, round(avg(CAST(candidate_correct AS INTEGER)), 6) AS candidate, round(avg(CAST(choice_drift AS INTEGER)), 6) AS drift FROM pair_rows GROUP BY source, q_index")
def drift_by_position(spark, sf):
    """Accuracy and drift by query position."""
    m = {"baseline": "baseline_correct", "candidate": "candidate_correct", "drift": "choice_drift"}
    return read_table(spark, sf, "pair_rows").groupBy("source", "q_index").agg(F.count("*").alias("n"), *_r6(*[(n, F.avg(F.col(c).cast("int"))) for n, c in m.items()]))


@query("SELECT source, " + ", ".join(f"round(avg(CAST({c} AS INTEGER)) FILTER ({p}), 6) AS {s}_{n}" for s, p in (("all", "true"), ("q0", "q_index = 0"), ("follow_up", "q_index > 0"), ("q2", "q_index = 2")) for n, c in (("baseline", "baseline_correct"), ("candidate", "candidate_correct"))) + " FROM pair_rows GROUP BY source")
def slice_summary(spark, sf):
    """All slices in one pass."""
    q = F.col("q_index")
    s = P.slices({"baseline": F.col("baseline_correct"), "candidate": F.col("candidate_correct")}, {"all": F.lit(True), "q0": q == 0, "follow_up": q > 0, "q2": q == 2})
    d = read_table(spark, sf, "pair_rows").groupBy("source").agg(*s)
    return d.select("source", *[F.round(c, 6).alias(c) for c in d.columns if c != "source"])


_LET = "CASE WHEN regexp_full_match(upper(regexp_replace({c}, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g')), '[A-Z]') THEN upper(regexp_replace({c}, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g')) END"


@query(f"SELECT source, item_id, q_index FROM pair_rows WHERE choice_drift IS DISTINCT FROM (({_LET.format(c='baseline_choice')}) IS DISTINCT FROM ({_LET.format(c='candidate_choice')}))")
def derived_flag_errors(spark, sf):
    """Rows whose stored drift flag contradicts the choices."""
    d = A.drift(A.single_letter(F.col("baseline_choice")), A.single_letter(F.col("candidate_choice")), "nullsafe")
    return read_table(spark, sf, "pair_rows").filter(~F.col("choice_drift").eqNullSafe(d)).select("source", "item_id", "q_index")


# ---- orders against aggregated line items

_OL = "li AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {_OL} SELECT o_orderpriority, count(*) AS n, round(sum(revenue) / sum(o_totalprice), 6) AS ratio_of_sums, round(avg(revenue / o_totalprice), 6) AS mean_of_ratios, count(*) FILTER (revenue > o_totalprice) AS n_above FROM orders JOIN li ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def order_pairs(spark, sf):
    """Baseline orders against the aggregate of their lines."""
    li = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("lines"))
    j = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), *_r6(("ratio_of_sums", F.sum("revenue") / F.sum("o_totalprice")), ("mean_of_ratios", F.avg(F.col("revenue") / F.col("o_totalprice")))), F.count_if(F.col("revenue") > F.col("o_totalprice")).alias("n_above"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def wide_aggregate(spark, sf):
    """A wide aggregate with the filter pushed to the scan."""
    li = read_table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


# ---- skylines and budgets on parts

@query("SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size <= p.p_size AND o.p_retailprice >= p.p_retailprice AND (o.p_size < p.p_size OR o.p_retailprice > p.p_retailprice))")
def skyline_2d(spark, sf):
    """Parts that none of less size beats in price."""
    return FR.skyline(read_table(spark, sf, "part"), "p_size", "p_retailprice").select("p_partkey")


@query("SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size <= p.p_size AND o.p_retailprice >= p.p_retailprice AND length(o.p_name) >= length(p.p_name) AND (o.p_size < p.p_size OR o.p_retailprice > p.p_retailprice OR length(o.p_name) > length(p.p_name)))")
def skyline_3d(spark, sf):
    """The same with a second score."""
    p = read_table(spark, sf, "part").withColumn("len", F.length("p_name").cast("double"))
    return FR.skyline_3d(p, "p_size", "p_retailprice", "len").select("p_partkey")


_CURVE = "cv AS (SELECT p_brand AS brand, p_size // 5 * 5 + 2 AS size, max(p_retailprice) AS price FROM part GROUP BY ALL)"


def _curve(spark, sf) -> DataFrame:
    """The best price of a brand per budget."""
    return read_table(spark, sf, "part").groupBy("p_brand", (F.floor(F.col("p_size") / 5) * 5 + 2).cast("int").alias("p_size")).agg(F.max("p_retailprice").alias("p_retailprice"))


@query(f"WITH {_CURVE} SELECT p_partkey, coalesce((SELECT arg_max(price, size) FROM cv WHERE brand = p_brand AND size <= p_size), (SELECT arg_min(price, size) FROM cv WHERE brand = p_brand)) AS dense_price FROM part")
def dense_at_budget(spark, sf):
    """The curve point at or below a budget, else the lowest one."""
    p = read_table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    curve = _curve(spark, sf).select("p_brand", F.col("p_size").alias("size"), F.col("p_retailprice").alias("dense_price"))
    return P.as_of_floor(p, curve, "p_size", "size", "dense_price", ["p_brand"]).select("p_partkey", "dense_price")


@query(f"WITH {_CURVE}, d AS (SELECT p_partkey, min(size) AS winner FROM part LEFT JOIN cv ON brand = p_brand AND p_retailprice >= price AND p_size <= size AND (p_retailprice > price OR p_size < size) GROUP BY p_partkey) SELECT p_partkey, winner FROM d")
def pareto_vs_dense(spark, sf):
    """The first curve point that a part dominates."""
    p = read_table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return FR.dominated_by(p, _curve(spark, sf), ["p_brand"], "p_retailprice", "p_size", "p_size").select("p_partkey", "winner")


@query("WITH h AS (SELECT p_brand, p_partkey, p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand) AS headroom FROM part) SELECT p_brand, p_partkey, round(headroom, 4) AS headroom FROM h QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round(headroom, 6) DESC, p_partkey) <= 3")
def headroom_ranking(spark, sf):
    """Top three parts per brand above the brand's mean; the mean is joined, so a hot brand is no hot window."""
    p = read_table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    j = p.join(p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m")), "p_brand").withColumn("headroom", F.col("p_retailprice") - F.col("m"))
    return L.top_k(j, ["p_brand"], [F.round("headroom", 6).desc(), F.col("p_partkey")], 3).filter("keep").select("p_brand", "p_partkey", F.round("headroom", 4).alias("headroom"))


QUERIES, ORACLES = Q, O
