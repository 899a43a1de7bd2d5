"""Codec, geometry, memory and report queries.

Without video the driver tables stand in: line items are sub-block vectors of
an order's macroblocks, orders are packets of a customer's clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import statistics as ST
from framewright.operators import codec as C
from framewright.operators import pairing as P
from framewright.operators import reuse as R
from framewright.operators import sequence as SQ
from framewright.plans import frames as FP
from framewright.plans import runs as RP
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


_MB = "mb AS (SELECT l_orderkey AS mb, l_quantity - 25 AS dx, l_discount * 100 - 5 AS dy, CASE WHEN l_linenumber % 3 = 0 THEN 16 WHEN l_linenumber % 3 = 1 THEN 8 ELSE 4 END AS w, CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 8 END AS h, l_tax AS r, l_returnflag FROM lineitem), m AS (SELECT mb, sum(dx * w * h) / sum(w * h) AS mv_x, sum(dy * w * h) / sum(w * h) AS mv_y, max(w) AS mw, max(h) AS mh, avg(r) AS res, min(r) AS res_back, bool_or(l_returnflag = 'R') AS intra FROM mb GROUP BY mb)"


def _vectors(spark, sf) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    return li.select(F.col("l_orderkey").alias("mb"), (F.col("l_quantity") - 25).alias("dx"), (F.col("l_discount") * 100 - 5).alias("dy"), F.when(n % 3 == 0, 16).when(n % 3 == 1, 8).otherwise(4).alias("w"), F.when(n % 2 == 0, 16).otherwise(8).alias("h"), F.col("l_tax").alias("r"), (F.col("l_returnflag") == "R").alias("intra"))


_PART = "CASE WHEN mw >= 16 AND mh >= 16 THEN 0 WHEN mw >= 16 AND mh >= 8 THEN 1 WHEN mw >= 8 AND mh >= 16 THEN 2 WHEN mw >= 8 AND mh >= 8 THEN 3 ELSE 4 END"


@query(f"WITH {_MB} SELECT mb, round(mv_x, 6) AS mv_x, round(mv_y, 6) AS mv_y, round(sqrt(mv_x * mv_x + mv_y * mv_y), 6) AS mv_magnitude, CAST({_PART} AS INTEGER) AS partition_type FROM m")
def macroblock_vectors(spark, sf):
    """Area-weighted motion and partition of macroblocks."""
    d = C.macroblocks(_vectors(spark, sf), ["mb"])
    return d.select("mb", *[F.round(c, 6).alias(c) for c in ("mv_x", "mv_y", "mv_magnitude")], "partition_type")


@query(f"WITH {_MB}, f AS (SELECT mb, round(least(res, res_back), 9) > 0.02 AS cbf, round(sqrt(mv_x * mv_x + mv_y * mv_y), 9) <= 4 AS still, intra FROM m) SELECT mb, cbf, NOT cbf AND still AS skip, CAST(CASE WHEN NOT cbf AND still THEN 0 WHEN cbf OR intra THEN 2 ELSE 1 END AS INTEGER) AS cls FROM f")
def macroblock_classes(spark, sf):
    """Flags and classes of macroblocks by residual and motion."""
    v = _vectors(spark, sf)
    r = v.groupBy("mb").agg(F.avg("r").alias("res"), F.min("r").alias("back"), F.bool_or("intra").alias("intra"))
    d = C.macroblocks(v, ["mb"]).join(r, "mb")
    cbf, skip = C.macroblock_flags(F.round(C.best_direction(F.col("res"), F.col("back")), 9), F.round("mv_magnitude", 9), 0.02, 4.0)
    d = d.withColumns({"cbf": cbf, "skip": skip})
    return d.select("mb", "cbf", "skip", C.classify_macroblock(F.col("skip"), F.col("cbf"), F.col("intra")).alias("cls"))


_PK = "pk AS (SELECT o_custkey AS clip, o_orderkey AS idx, CASE o_orderstatus WHEN 'F' THEN 'I' WHEN 'O' THEN 'P' ELSE 'B' END AS kind, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS keyf, o_totalprice AS size FROM orders), mk AS (SELECT clip, coalesce(avg(size) FILTER (size > 0 AND (keyf OR kind = 'I')), 0) AS mean_key FROM pk GROUP BY clip)"


@query(f"WITH {_PK} SELECT pk.clip, idx, kind, round(mean_key, 4) AS mean_key, CASE WHEN NOT keyf AND kind <> 'I' AND mean_key > 0 AND size / mean_key < 0.4 THEN 'ALL_STATIC' END AS exit FROM pk JOIN mk ON pk.clip = mk.clip")
def frame_early_exit(spark, sf):
    """Tiny inter frames beside the mean intra frame of their clip."""
    o = read_table(spark, sf, "orders")
    s = F.col("o_orderstatus")
    pk = o.select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("idx"), F.when(s == "F", "I").when(s == "O", "P").otherwise("B").alias("kind"), ((s == "F") & (F.col("o_orderkey") % 2 == 0)).alias("keyf"), F.col("o_totalprice").alias("size"))
    mk = pk.groupBy("clip").agg(C.mean_key_size(F.col("size"), F.col("kind"), F.col("keyf")).alias("mean_key"))
    j = pk.join(mk, "clip")
    return j.select("clip", "idx", "kind", F.round("mean_key", 4).alias("mean_key"), C.early_exit(F.col("size"), F.col("keyf"), F.col("kind"), F.col("mean_key"), 0.4).alias("exit"))


_WH = "wh AS (SELECT p_partkey, 320 + p_size * 32 AS w, 240 + CAST(floor(p_retailprice) AS INTEGER) % 800 AS h FROM part)"


def _sizes(spark, sf) -> DataFrame:
    return read_table(spark, sf, "part").select("p_partkey", (320 + F.col("p_size") * 32).alias("w"), (240 + F.floor("p_retailprice").cast("int") % 800).alias("h"))


@query(f"WITH {_WH}, s AS (SELECT *, least(448.0 / w, 448.0 / h) AS sc FROM wh), b AS (SELECT *, CAST(round_even(w * sc, 0) AS INTEGER) AS bw, CAST(round_even(h * sc, 0) AS INTEGER) AS bh FROM s) SELECT p_partkey, CAST(greatest(1, round_even(w * (448.0 / greatest(w, h)) / 28, 0)) * 28 AS INTEGER) AS rw, CAST(greatest(1, round_even(h * (448.0 / greatest(w, h)) / 28, 0)) * 28 AS INTEGER) AS rh, (448 - bw) // 2 AS \"left\", (448 - bh) // 2 AS top, (448 - bw) // 2 + bw AS \"right\", (448 - bh) // 2 + bh AS bottom FROM b")
def geometry(spark, sf):
    """Resized dimensions and letterbox of images."""
    d = _sizes(spark, sf)
    rw, rh = C.resized(F.col("w"), F.col("h"), 448, 28)
    return d.select("p_partkey", rw.alias("rw"), rh.alias("rh"), *C.letterbox(F.col("w"), F.col("h"), 448))


@query(f"WITH {_WH}, s AS (SELECT *, least(448.0 / w, 448.0 / h) AS sc FROM wh), b AS (SELECT p_partkey, CAST(round_even(w * sc, 0) AS INTEGER) AS bw, CAST(round_even(h * sc, 0) AS INTEGER) AS bh FROM s), x AS (SELECT *, (448 - bw) // 2 AS l, (448 - bh) // 2 AS t FROM b) SELECT p_partkey, count(*) FILTER (c * 112 >= l AND r * 112 >= t AND (c + 1) * 112 <= l + bw AND (r + 1) * 112 <= t + bh) AS active FROM x, range(4) rr(r), range(4) cc(c) GROUP BY p_partkey")
def active_blocks(spark, sf):
    """Blocks that lie fully inside the letterbox."""
    d = _sizes(spark, sf).select("p_partkey", *C.letterbox(F.col("w"), F.col("h"), 448))
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(15))))
    inside = C.block_inside(F.floor(F.col("b") / 4), F.col("b") % 4, 112, F.col("left"), F.col("top"), F.col("right"), F.col("bottom"))
    return d.groupBy("p_partkey").agg(F.count_if(inside).alias("active"))


@query("SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(x // 2 + 4 * (y // 2) AS INTEGER) AS token FROM range(8) a(x), range(8) b(y)")
def token_index(spark, sf):
    """Token of every patch of an 8x8 plane, 2x2 patches to a token."""
    p = spark.range(64).select((F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    return p.withColumn("token", C.token_index(F.col("x"), F.col("y"), 2, 8))


@query("SELECT source, item_id, q_index, frame_count, CASE WHEN q_index = 0 THEN 1.0 WHEN frame_count = 8 THEN 0.9 WHEN frame_count = 32 THEN 0.5 ELSE 0.7 END AS keep_rate, CAST(CASE WHEN q_index = 0 THEN 0 WHEN q_index = 1 THEN 1 ELSE 2 END AS INTEGER) AS reprefill FROM pair_rows")
def query_policy(spark, sf):
    """Keep rate and re-made frames of a query by position and size."""
    d = read_table(spark, sf, "pair_rows")
    rate = C.keep_rate(F.col("q_index"), F.col("frame_count").cast("string"), 1.0, 0.7, {"8": 0.9, "32": 0.5})
    return d.select("source", "item_id", "q_index", "frame_count", rate.alias("keep_rate"), F.when(F.col("q_index") == 0, 0).when(F.col("q_index") == 1, 1).otherwise(2).alias("reprefill"))


@query()
def novelty_components(spark, sf):
    """Connected components of novel blocks per frame."""
    d = FP._scored(spark, sf).withColumn("mask", F.transform("classes", lambda c: c == 2))
    return C.components(d, "mask", FP.COLS)


@query(f"WITH {FP._states_sql(4, 6, 2)}, st2 AS (SELECT clip, t, b, cls < 2 AND t % 5 <> 0 AS allowed2 FROM cl) SELECT a.clip, CASE WHEN count(*) FILTER (allowed OR allowed2) = 0 THEN 1.0 ELSE count(*) FILTER (allowed AND allowed2) / count(*) FILTER (allowed OR allowed2) END AS jaccard FROM sr a JOIN st2 b ON a.clip IS NOT DISTINCT FROM b.clip AND a.t = b.t AND a.b = b.b GROUP BY a.clip")
def mask_agreement(spark, sf):
    """Jaccard of the reuse masks of two policies."""
    s = R.reuse_states(FP._blocks(spark, sf), **FP.POLICY).withColumn("other", F.col("r") & (F.col("t") % 5 != 0))
    return s.groupBy("clip").agg(C.masked_jaccard(F.col("allowed"), F.col("other")).alias("jaccard"))


@query(f"WITH {RP._ONCE}, g AS (SELECT benchmark, item_group, avg(generate_ms) AS m, count(generate_ms) AS n FROM once GROUP BY benchmark, item_group) SELECT benchmark, round(sum(m * n) FILTER (m IS NOT NULL) / nullif(sum(n) FILTER (m IS NOT NULL), 0), 6) AS mean FROM g GROUP BY benchmark")
def mean_of_means(spark, sf):
    """Group means weighted by their counts."""
    g = RP._results(spark, sf).groupBy("benchmark", "item_group").agg(F.avg("generate_ms").alias("m"), F.count("generate_ms").alias("n"))
    return g.groupBy("benchmark").agg(F.round(C.weighted_mean(F.col("m"), F.col("n")), 6).alias("mean"))


@query(f"WITH {RP._ONCE} SELECT run_id, count(*) AS n, max(prompt_tokens) AS peak, round(avg(prompt_tokens), 4) AS mean, CASE WHEN count(DISTINCT arm) = 1 THEN min(arm) END AS arm, CASE WHEN count(DISTINCT n_frames) = 1 THEN min(n_frames) END AS n_frames, greatest(max(decode_ms), max(processor_ms), max(vision_ms)) AS worst_stage FROM once GROUP BY run_id")
def run_envelopes(spark, sf):
    """Peaks of a run, and its arm and size where it has one only."""
    r = P.last_wins(read_table(spark, sf, "item_results").select("result_id", "ingested_at", "run_id", "arm", "n_frames", "prompt_tokens", "decode_ms", "processor_ms", "vision_ms"), ["result_id"], ["ingested_at"])
    return r.groupBy("run_id").agg(F.count("*").alias("n"), F.max("prompt_tokens").alias("peak"), F.round(F.avg("prompt_tokens"), 4).alias("mean"), C.one_value(F.col("arm")).alias("arm"), C.one_value(F.col("n_frames")).alias("n_frames"), F.greatest(F.max("decode_ms"), F.max("processor_ms"), F.max("vision_ms")).alias("worst_stage"))


@query(f"WITH {RP._ONCE}, f AS (SELECT CASE WHEN contains(run_id, 'r00') THEN 'first' ELSE 'later' END AS family, max(vision_ms) AS v FROM once GROUP BY run_id) SELECT family, count(*) AS n_runs, max(v) AS peak, count(*) FILTER (v > 4000) AS over FROM f GROUP BY family")
def family_envelopes(spark, sf):
    """Peaks by family of runs, families by a part of the name."""
    r = P.last_wins(read_table(spark, sf, "item_results").select("result_id", "ingested_at", "run_id", "vision_ms"), ["result_id"], ["ingested_at"]).groupBy("run_id").agg(F.max("vision_ms").alias("v"))
    fam = F.when(F.contains("run_id", F.lit("r00")), "first").otherwise("later")
    return r.groupBy(fam.alias("family")).agg(F.count("*").alias("n_runs"), F.max("v").alias("peak"), F.count_if(F.col("v") > 4000).alias("over"))


@query(f"WITH {RP._ONCE}, v AS (SELECT arm, source, avg(CAST(correct AS INTEGER)) AS a FROM once GROUP BY arm, source) SELECT arm, count(*) AS n, round(avg(a), 6) AS mean, round(min(a), 6) AS least, round(max(a), 6) AS most, bool_and(a > 0.1) AS all_pass FROM v GROUP BY arm")
def sweep_summary(spark, sf):
    """Mean, least and greatest accuracy over the cells of a sweep."""
    v = RP._results(spark, sf).groupBy("arm", "source").agg(F.avg(F.col("correct").cast("int")).alias("a"))
    return v.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean"), F.round(F.min("a"), 6).alias("least"), F.round(F.max("a"), 6).alias("most"), F.bool_and(F.col("a") > 0.1).alias("all_pass"))


@query(f"WITH {RP._ONCE} SELECT e.arm, e.keep_rate FROM (SELECT a.arm, k.keep_rate FROM (SELECT DISTINCT arm FROM once) a, (SELECT DISTINCT keep_rate FROM once WHERE keep_rate IS NOT NULL) k) e WHERE NOT EXISTS (SELECT 1 FROM once o WHERE o.arm = e.arm AND o.keep_rate = e.keep_rate)")
def missing_cells(spark, sf):
    """Cells that the full grid of arms and keep rates lacks; both lists are settings of a sweep."""
    r = RP._results(spark, sf).select("arm", "keep_rate").distinct()
    grid = r.select("arm").distinct().crossJoin(r.filter("keep_rate IS NOT NULL").select("keep_rate").distinct())
    return grid.join(r, ["arm", "keep_rate"], "left_anti")


@query(f"WITH {RP._ONCE} SELECT source, arm, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS total FROM once GROUP BY source, arm")
def histogram(spark, sf):
    """Counts by source and arm beside the source's total."""
    n = RP._results(spark, sf).groupBy("source", "arm").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("source").agg(F.sum("n").alias("total")), "source").select("source", "arm", "n", "total")


@query(f"WITH {RP._PAIR}, g AS (SELECT benchmark, ca IS DISTINCT FROM cb AS drift, ta - tb AS m FROM pr) SELECT benchmark, round(avg(m) FILTER (drift), 4) AS mean_drift, round(avg(m) FILTER (NOT drift), 4) AS mean_stable, round(median(m) FILTER (drift), 4) AS median_drift, round(median(m), 4) AS median_all FROM g GROUP BY benchmark")
def margins_by_drift(spark, sf):
    """Margins of drifting, stable and all pairs."""
    p = RP._paired(spark, sf).select("benchmark", (~F.col("ca").eqNullSafe(F.col("cb"))).alias("drift"), (F.col("ta") - F.col("tb")).alias("m"))
    p = materialize(p)
    d, s = F.when(F.col("drift"), F.col("m")), F.when(~F.col("drift"), F.col("m"))
    g = p.groupBy("benchmark").agg(F.avg(d).alias("mean_drift"), F.avg(s).alias("mean_stable"))
    g = ST.with_percentiles(g, p.filter("drift"), ["benchmark"], "m", {"median_drift": 0.5})
    g = ST.with_percentiles(g, p, ["benchmark"], "m", {"median_all": 0.5})
    return g.select("benchmark", *[F.round(n, 4).alias(n) for n in ("mean_drift", "mean_stable", "median_drift", "median_all")])


@query("WITH f AS (SELECT label AS clip, vec_id AS pos FROM embeddings) SELECT clip, pos, coalesce(lag(pos) OVER w + 1, pos) AS span_from, pos AS span_to FROM f WINDOW w AS (PARTITION BY clip ORDER BY pos)")
def sample_spans(spark, sf):
    """Spans between the samples of a clip, whose numbers have gaps."""
    f = read_table(spark, sf, "embeddings").select(F.col("label").alias("clip"), F.col("vec_id").alias("pos"))
    return SQ.spans(f, ["clip"], "pos").select("clip", "pos", "span_from", "span_to")


@query("WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity, CAST(floor(l_quantity / 10) AS BIGINT) AS len, l_partkey FROM lineitem), o AS (SELECT l_orderkey, len, sum(len) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS e FROM f WHERE len > 0) SELECT l_orderkey, count(*) AS segments, CAST(max(e) AS BIGINT) AS total, CAST(min(e - len) AS BIGINT) AS first FROM o GROUP BY l_orderkey")
def segment_offsets(spark, sf):
    """Offsets of consecutive segments, empty ones dropped."""
    f = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.floor(F.col("l_quantity") / 10).alias("len"))
    o = SQ.offsets(f, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], "len")
    return o.groupBy("l_orderkey").agg(F.count("*").alias("segments"), F.max("end").alias("total"), F.min("start").alias("first"))


@query("SELECT vec_id, list_max(list_transform(embedding, lambda z: abs(CAST(z AS DOUBLE)))) AS max_abs, len(list_filter(embedding, lambda z: isnan(z) OR isinf(z))) AS not_finite FROM embeddings")
def array_audit(spark, sf):
    """Greatest magnitude and values that are not finite, per array."""
    bad = F.size(F.filter("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    return read_table(spark, sf, "embeddings").select("vec_id", F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("max_abs"), bad.cast("bigint").alias("not_finite"))


@query(f"WITH {RP._PAIR} SELECT item_id, round(ta / tb, 6) AS ratio, CASE WHEN b AND NOT a THEN 'gain' WHEN a AND NOT b THEN 'loss' WHEN a AND b THEN 'shared' ELSE 'none' END AS outcome, round(abs(ta - tb) / greatest(abs(ta), 1e-12), 6) AS relative_gap FROM pr WHERE ta IS NOT NULL AND tb > 0 AND a IS NOT NULL AND b IS NOT NULL")
def pair_report(spark, sf):
    """Ratio, outcome and relative gap of every pair."""
    p = RP._paired(spark, sf).filter("ta IS NOT NULL AND tb > 0 AND a IS NOT NULL AND b IS NOT NULL")
    out = F.when(F.col("b") & ~F.col("a"), "gain").when(F.col("a") & ~F.col("b"), "loss").when(F.col("a") & F.col("b"), "shared").otherwise("none")
    gap = F.abs(F.col("ta") - F.col("tb")) / F.greatest(F.abs("ta"), F.lit(1e-12))
    return p.select("item_id", F.round(F.col("ta") / F.col("tb"), 6).alias("ratio"), out.alias("outcome"), F.round(gap, 6).alias("relative_gap"))


@query(f"WITH {RP._ONCE}, x AS (SELECT source, benchmark, avg(CAST(correct AS INTEGER)) AS a FROM once GROUP BY source, benchmark) SELECT source, round(max(a) FILTER (benchmark = 'videomme'), 6) AS videomme, round(max(a) FILTER (benchmark = 'tomato'), 6) AS tomato, round(max(a) FILTER (benchmark = 'mvbench'), 6) AS mvbench FROM x GROUP BY source")
def accuracy_pivot(spark, sf):
    """Accuracy by source, a column per benchmark."""
    g = RP._results(spark, sf).groupBy("source").pivot("benchmark", ["videomme", "tomato", "mvbench"]).agg(F.avg(F.col("correct").cast("int")))
    return g.select("source", *[F.round(c, 6).alias(c) for c in ("videomme", "tomato", "mvbench")])


QUERIES, ORACLES = Q, O
