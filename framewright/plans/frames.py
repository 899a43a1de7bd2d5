"""Frame and block queries on the ``embeddings`` table, read as 8x8 planes.

A clip is a label, its frames are ordered by ``vec_id``; for token features a
frame is 16 consecutive vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import statistics as S
from framewright.operators import frames as B
from framewright.operators import reuse as R
from framewright.operators import selection as L
from framewright.operators import sequence as SQ
from framewright.storage import materialize, read_table

W = H = 8
BLOCK, COLS = 2, 4
STATIC_T, SHIFTED_T = 0.11, 0.16


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings").select(F.col("label").alias("clip"), "vec_id", F.col("embedding").alias("plane"))
    return SQ.numbered(e, ["clip"], "vec_id", "t").select("clip", "t", "plane")


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_previous(_frames(spark, sf)).withColumn("diff", B.abs_diff())


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = _diffs(spark, sf).filter("t > 0").withColumn("scores", B.block_scores(F.col("diff"), B.mean, W, H, BLOCK))
    return d.withColumn("classes", B.classify(F.col("scores"), STATIC_T, SHIFTED_T)).select("clip", "t", "scores", "classes")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """``clip, t, b, s, cls, r``; r: static or shifted."""
    z = F.posexplode(F.arrays_zip("scores", "classes")).alias("b", "z")
    return _scored(spark, sf).select("clip", "t", z).select("clip", "t", "b", F.col("z.scores").alias("s"), F.col("z.classes").alias("cls"), (F.col("z.classes") < B.NOVEL).alias("r"))


_FR = "fr AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding FROM embeddings)"
_PX = _FR + ", px AS (SELECT clip, t, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(v AS DOUBLE) AS v FROM (SELECT clip, t, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM fr))"
_DF = _PX + ", df AS (SELECT * FROM (SELECT clip, t, y, x, abs(v - lag(v) OVER (PARTITION BY clip, y, x ORDER BY t)) AS d FROM px) WHERE t > 0)"
_BK = _DF + ", bk AS (SELECT clip, t, (y // 2) * 4 + x // 2 AS b, avg(d) AS s FROM df GROUP BY ALL)"
_CL = _BK + f", cl AS (SELECT *, CASE WHEN s < {STATIC_T} THEN 0 WHEN s < {SHIFTED_T} THEN 1 ELSE 2 END AS cls FROM bk)"
Q: dict = {}
O: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


@query(f"""WITH {_DF}, r AS (SELECT *, row_number() OVER (PARTITION BY clip, t, y // 2, x // 2 ORDER BY d DESC) AS rn FROM df)
SELECT clip, t, CAST((y // 2) * 4 + x // 2 AS INTEGER) AS b, round(avg(d), 6) AS mean, round(max(d), 6) AS max_abs, avg(CASE WHEN d > 0.15 THEN 1.0 ELSE 0.0 END) AS changed, round(avg(d) FILTER (rn <= 2), 6) AS top2_mean FROM r GROUP BY clip, t, (y // 2) * 4 + x // 2""")
def block_stats(spark, sf):
    """Four statistics of the difference of adjacent frames, per block."""
    stats = {"mean": B.mean, "max_abs": B.max_abs, "changed": B.changed_fraction(0.15), "top2_mean": B.top_k_mean(2)}
    v = _diffs(spark, sf).filter("t > 0").withColumn("v", B.block_values(F.col("diff"), W, H, BLOCK))
    one = v.select("clip", "t", F.posexplode("v").alias("b", "x"))
    return one.select("clip", "t", "b", *[(F.round(f(F.col("x")), 6) if n != "changed" else f(F.col("x"))).alias(n) for n, f in stats.items()])


@query(f"WITH {_CL} SELECT clip, t, CAST(b AS INTEGER) AS b, CAST(cls AS INTEGER) AS cls FROM cl")
def block_classes(spark, sf):
    """Static, shifted or novel by the mean difference."""
    return _blocks(spark, sf).select("clip", "t", "b", "cls")


@query(f"""WITH {_CL} SELECT clip, t, CAST(count(*) FILTER (cls = 0) AS INTEGER) AS n_static, CAST(count(*) FILTER (cls = 1) AS INTEGER) AS n_shifted, CAST(count(*) FILTER (cls = 2) AS INTEGER) AS n_novel,
count(*) FILTER (cls < 2) / count(*) AS reused_ratio, count(*) FILTER (cls = 2) / count(*) AS novel_ratio FROM cl GROUP BY clip, t""")
def class_summary(spark, sf):
    """Class counts and reused and novel ratios per frame."""
    return _scored(spark, sf).select("clip", "t", *B.class_summary(F.col("classes")))


@query(f"WITH {_CL} SELECT CAST(cls AS INTEGER) AS cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM cl GROUP BY cls")
def class_shares(spark, sf):
    """Share of every class over all grids."""
    n = _blocks(spark, sf).groupBy("cls").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("cls", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))  # one row


_NB = "SELECT a.clip, a.t, a.b, max(o.s) AS near FROM bk a JOIN bk o ON a.clip IS NOT DISTINCT FROM o.clip AND a.t = o.t AND a.b <> o.b AND abs(a.b // 4 - o.b // 4) <= 1 AND abs(a.b % 4 - o.b % 4) <= 1 GROUP BY a.clip, a.t, a.b"


@query(f"WITH {_BK} SELECT clip, t, CAST(b AS INTEGER) AS b, round(near, 6) AS near FROM ({_NB})")
def neighbor_max(spark, sf):
    """Greatest score among the neighbours of a block."""
    d = _scored(spark, sf).withColumn("near", B.neighbour_max(F.col("scores"), COLS, COLS))
    return d.select("clip", "t", F.posexplode("near").alias("b", "near")).withColumn("near", F.round("near", 6))


@query(f"""WITH {_CL}, nb AS ({_NB}), q AS (SELECT clip, t, quantile_cont(s, 0.75) AS lim FROM bk GROUP BY clip, t)
SELECT c.clip, c.t, CAST(c.b AS INTEGER) AS b, CAST(CASE WHEN cls = 0 AND near > lim THEN 2 ELSE cls END AS INTEGER) AS cls FROM cl c JOIN nb ON c.clip IS NOT DISTINCT FROM nb.clip AND c.t = nb.t AND c.b = nb.b JOIN q ON c.clip IS NOT DISTINCT FROM q.clip AND c.t = q.t""")
def halo_veto(spark, sf):
    """Static blocks next to a high score become novel."""
    d = _scored(spark, sf).withColumn("v", B.halo_veto(F.col("classes"), F.col("scores"), COLS, COLS, 0.75))
    return d.select("clip", "t", F.posexplode("v").alias("b", "cls"))


@query(f"""WITH {_FR}, n AS (SELECT clip, t, list_avg(list_transform(range(1, 65), lambda i: abs(CAST(embedding[i] AS DOUBLE) - CAST(prev[i] AS DOUBLE)))) AS d FROM (SELECT *, lag(embedding) OVER (PARTITION BY clip ORDER BY t) AS prev FROM fr))
SELECT clip, t, round(coalesce(d, lead(d) OVER w, 0), 6) AS mirror, round(coalesce(d, 0), 6) AS zero, round(coalesce(d, max(d) OVER (PARTITION BY clip), 0), 6) AS greatest, round(coalesce(greatest(d, lead(d) OVER w), lead(d) OVER w, d, 0), 6) AS novelty FROM n WINDOW w AS (PARTITION BY clip ORDER BY t)""")
def novelty_first_frame(spark, sf):
    """Frame novelty: three fills of the first frame, and the greater of both neighbours."""
    d = _diffs(spark, sf).select("clip", "t", B.mean(F.col("diff")).alias("d"))
    w = Window.partitionBy("clip").orderBy("t")
    nxt = F.lead("d").over(w)
    top = F.max("d").over(Window.partitionBy("clip"))
    fill = {"mirror": F.coalesce("d", nxt, F.lit(0.0)), "zero": F.coalesce("d", F.lit(0.0)), "greatest": F.coalesce("d", top, F.lit(0.0)), "novelty": F.coalesce(F.greatest("d", nxt), F.lit(0.0))}
    return d.select("clip", "t", *[F.round(c, 6).alias(n) for n, c in fill.items()])


def _states_sql(sticky: int | None, refresh: int | None, max_age: int | None) -> str:
    e = f"t // {refresh}" if refresh else "0"
    fresh = f"t % {refresh} = 0" if refresh else "false"
    latch = f"coalesce(max(CASE WHEN cls = 2 AND NOT ({fresh}) THEN 1 ELSE 0 END) OVER (PARTITION BY clip, b, {e}, t // {sticky} ORDER BY t), 0) = 0" if sticky else "true"
    gate = f"p % {max_age + 1} <> 0" if max_age is not None else "true"
    return (
        f"{_CL}, ef AS (SELECT *, cls < 2 AND NOT ({fresh}) AND {latch} AS eff FROM cl), isl AS (SELECT *, sum(CASE WHEN eff THEN 0 ELSE 1 END) OVER (PARTITION BY clip, b ORDER BY t) AS g FROM ef), "
        f"pos AS (SELECT *, count(*) FILTER (eff) OVER (PARTITION BY clip, b, g ORDER BY t) AS p FROM isl), st AS (SELECT *, eff AND {gate} AS allowed FROM pos), "
        "sr AS (SELECT *, coalesce(last_value(CASE WHEN NOT allowed THEN t END IGNORE NULLS) OVER (PARTITION BY clip, b ORDER BY t), 0) AS src FROM st)"
    )


POLICY = {"sticky": 4, "refresh": 6, "max_age": 2}


@query(f"""WITH {_states_sql(4, 6, 2)}, a AS (SELECT clip, max(t) + 1 AS n_frames, avg(CASE WHEN allowed THEN 1.0 ELSE 0.0 END) AS reuse, avg(t - src) AS staleness FROM sr GROUP BY clip)
SELECT clip, n_frames, round(reuse, 6) AS reuse, round(staleness, 6) AS staleness, round(1 + (n_frames - 1) * (1 - reuse), 6) AS fresh_frames FROM a""")
def reuse_summary(spark, sf):
    """Reuse, staleness and effective fresh frames of a clip under a policy."""
    s = R.reuse_states(_blocks(spark, sf), **POLICY)
    g = s.groupBy("clip").agg((F.max("t") + 1).alias("n_frames"), F.avg(F.col("allowed").cast("double")).alias("reuse"), F.avg(F.col("t") - F.col("src")).alias("staleness"))
    return g.select("clip", "n_frames", F.round("reuse", 6).alias("reuse"), F.round("staleness", 6).alias("staleness"), F.round(R.effective_fresh(F.col("n_frames"), F.col("reuse")), 6).alias("fresh_frames"))


def _reuse_by_frame(**policy):
    def run(spark, sf):
        s = R.reuse_states(_blocks(spark, sf), **policy)
        inner = F.col("b").isin(5, 6, 9, 10)
        return s.groupBy("clip", "t").agg(F.count_if("allowed").alias("n_reused"), F.avg(F.col("allowed").cast("double")).alias("reuse_raw"), F.avg(F.when(inner, F.col("allowed").cast("double"))).alias("reuse_active"))

    sql = f"WITH {_states_sql(policy.get('sticky'), policy.get('refresh'), policy.get('max_age'))} SELECT clip, t, count(*) FILTER (allowed) AS n_reused, avg(CASE WHEN allowed THEN 1.0 ELSE 0.0 END) AS reuse_raw, avg(CASE WHEN allowed THEN 1.0 ELSE 0.0 END) FILTER (b IN (5, 6, 9, 10)) AS reuse_active FROM sr GROUP BY clip, t"
    return run, sql


for _name, _policy in {"reuse_by_frame": POLICY, "sticky_reuse": {"sticky": 3}, "refresh_reuse": {"refresh": 5}, "age_gate": {"max_age": 1}}.items():
    Q[_name], O[_name] = _reuse_by_frame(**_policy)


@query(f"WITH {_states_sql(4, 6, 2)} SELECT clip, t, CAST(b AS INTEGER) AS b, CAST(src AS BIGINT) AS src, CAST(t - src AS BIGINT) AS staleness FROM sr")
def source_frame(spark, sf):
    """The frame that the content of a block really comes from."""
    return R.reuse_states(_blocks(spark, sf), **POLICY).select("clip", "t", "b", "src", (F.col("t") - F.col("src")).alias("staleness"))


@query(f"WITH {_states_sql(4, 6, 2)}, ru AS (SELECT clip, b, sum(CASE WHEN allowed THEN 0 ELSE 1 END) OVER (PARTITION BY clip, b ORDER BY t) AS i, allowed FROM sr), n AS (SELECT clip, b, i, count(*) FILTER (allowed) AS n FROM ru GROUP BY ALL) SELECT clip, CAST(b AS INTEGER) AS b, max(n) AS longest FROM n GROUP BY clip, b")
def longest_stale(spark, sf):
    """Longest run of reused frames per block."""
    return R.longest_run(R.reuse_states(_blocks(spark, sf), **POLICY))


@query(f"WITH {_states_sql(4, 6, 2)}, n AS (SELECT clip, t, count(*) FILTER (NOT allowed) AS fresh FROM sr GROUP BY clip, t), p AS (SELECT clip, fresh / sum(fresh) OVER (PARTITION BY clip) AS p FROM n) SELECT clip, round(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END), 6) AS entropy FROM p GROUP BY clip")
def coverage_entropy(spark, sf):
    """Entropy of fresh blocks over the frames of a clip."""
    n = R.reuse_states(_blocks(spark, sf), **POLICY).groupBy("clip", "t").agg(F.count_if(~F.col("allowed")).alias("fresh"))
    _, term = R.entropy("fresh", ["clip"])
    return n.select("clip", term.alias("e")).groupBy("clip").agg(F.round(F.sum("e"), 6).alias("entropy"))


@query(f"""WITH {_CL}, ac AS (SELECT *, cls < 2 AND b IN (5, 6, 9, 10) AS eff FROM cl), isl AS (SELECT *, sum(CASE WHEN eff THEN 0 ELSE 1 END) OVER (PARTITION BY clip, b ORDER BY t) AS g FROM ac),
pos AS (SELECT *, count(*) FILTER (eff) OVER (PARTITION BY clip, b, g ORDER BY t) AS p FROM isl) SELECT clip, t, count(*) FILTER (NOT (eff AND p % 3 <> 0)) AS fresh, count(*) FILTER (eff AND p % 3 = 0) AS stale FROM pos GROUP BY clip, t""")
def window_metrics(spark, sf):
    """Fresh and stale blocks where age grows only on reused, active blocks."""
    b = _blocks(spark, sf).withColumn("r", F.col("r") & F.col("b").isin(5, 6, 9, 10))
    s = R.reuse_states(b, max_age=2)
    return s.groupBy("clip", "t").agg(F.count_if(~F.col("allowed")).alias("fresh"), F.count_if(F.col("eff") & ~F.col("allowed")).alias("stale"))


# ---- policy grids

THRESHOLDS = ((0.08, 0.12), (0.11, 0.16), (0.14, 0.2))
AGES = (None, 1, 2, 4)
REUSE_SETS = (("static", 0), ("static_shifted", 1))


def policies(spark: SparkSession) -> DataFrame:
    """Thresholds x reuse sets x ages with a composed label."""
    grid = [F.struct(F.lit(a).alias("static_t"), F.lit(b).alias("shifted_t"), F.lit(r).alias("reuse"), F.lit(top).alias("top_class"), F.lit(age).cast("int").alias("max_age")) for a, b in THRESHOLDS for r, top in REUSE_SETS for age in AGES]
    g = spark.range(0, 1, 1, 1).select(F.inline(F.array(*grid)))
    label = F.concat_ws("_", F.lit("mean"), F.format_number("static_t", 2), F.format_number("shifted_t", 2), "reuse", F.concat(F.lit("age"), F.coalesce(F.col("max_age").cast("string"), F.lit("none"))))
    return g.withColumn("label", label)


_POL = "pol AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in THRESHOLDS) + ") AS t(static_t, shifted_t), (VALUES " + ", ".join(f"('{a}', {b})" for a, b in REUSE_SETS) + ") AS r(reuse, top_class), (VALUES " + ", ".join(f"({'NULL' if a is None else a})" for a in AGES) + ") AS g(max_age))"
_POLL = _POL.replace("pol AS", "pol0 AS") + ", pol AS (SELECT *, 'mean_' || printf('%.2f', CAST(static_t AS DOUBLE)) || '_' || printf('%.2f', CAST(shifted_t AS DOUBLE)) || '_' || reuse || '_age' || coalesce(CAST(max_age AS VARCHAR), 'none') AS label FROM pol0)"


@query(f"WITH {_POLL} SELECT label, CAST(static_t AS DOUBLE) AS static_t, CAST(shifted_t AS DOUBLE) AS shifted_t, reuse, CAST(top_class AS INTEGER) AS top_class, CAST(max_age AS INTEGER) AS max_age FROM pol")
def policy_grid(spark, sf):
    """All candidate policies."""
    return policies(spark).select("label", "static_t", "shifted_t", "reuse", "top_class", "max_age")


_CALR = f"""{_BK}, {_POLL}, x AS (SELECT label, max_age, clip, t, b, CASE WHEN top_class = 0 THEN s < static_t ELSE s < shifted_t END AS r FROM bk, pol),
isl AS (SELECT *, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER (PARTITION BY label, clip, b ORDER BY t) AS g FROM x), pos AS (SELECT *, count(*) FILTER (r) OVER (PARTITION BY label, clip, b, g ORDER BY t) AS p FROM isl),
pf AS (SELECT label, clip, t, avg(CASE WHEN r AND (max_age IS NULL OR p % (max_age + 1) <> 0) THEN 1.0 ELSE 0.0 END) AS v FROM pos GROUP BY ALL), pc AS (SELECT label, clip, avg(v) AS v FROM pf GROUP BY ALL), cal AS (SELECT label, avg(v) AS v FROM pc GROUP BY label)"""


def _calibrated(spark, sf) -> DataFrame:
    """Mean reuse per policy: over frames, then clips.

    Blocks meet the literal list of policies as an array inside the row; runs
    are windows by (policy, clip, block), one shuffle for all policies.
    """
    pol = [r.asDict() for r in policies(spark).collect()]  # literals
    flag = [F.struct(F.lit(p["label"]).alias("label"), F.lit(p["max_age"]).cast("int").alias("max_age"), (F.col("s") < (p["shifted_t"] if p["top_class"] else p["static_t"])).alias("r")) for p in pol]
    x = _blocks(spark, sf).select("clip", "t", "b", F.explode(F.array(*flag)).alias("z")).select("clip", "t", "b", "z.*")
    key = ["label", "clip", "b"]
    x = x.withColumn("g", F.sum((~F.col("r")).cast("int")).over(Window.partitionBy(*key).orderBy("t")))
    x = x.withColumn("p", F.count_if("r").over(Window.partitionBy(*key, "g").orderBy("t")))
    ok = F.col("r") & (F.col("max_age").isNull() | (F.col("p") % (F.col("max_age") + 1) != 0))
    per = x.groupBy("label", "clip", "t").agg(F.avg(ok.cast("double")).alias("v")).groupBy("label", "clip").agg(F.avg("v").alias("v"))
    return per.groupBy("label").agg(F.avg("v").alias("v"))


@query(f"WITH {_CALR} SELECT label, round(v, 6) AS reuse FROM cal")
def policy_calibration(spark, sf):
    """Mean reuse of every policy."""
    return _calibrated(spark, sf).select("label", F.round("v", 6).alias("reuse"))


_BIN = "CASE WHEN v < 0.25 THEN 0 WHEN v < 0.5 THEN 1 WHEN v < 0.75 THEN 2 ELSE 3 END"


@query(f"WITH {_CALR} SELECT CAST({_BIN} AS INTEGER) AS bin, count(*) AS n, round(min(v), 6) AS least, round(max(v), 6) AS most FROM cal GROUP BY 1")
def policy_bins(spark, sf):
    """Policies in half-open ranges of their reuse."""
    return _calibrated(spark, sf).groupBy(F.expr(_BIN).alias("bin")).agg(F.count("*").alias("n"), F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("most"))


@query(f"WITH {_CALR}, k AS (SELECT label, round(v, 9) AS v, split_part(label, '_age', 1) AS family, {_BIN} AS bin FROM cal) SELECT label, CAST(bin AS INTEGER) AS bin FROM (SELECT *, row_number() OVER (PARTITION BY bin, family ORDER BY v, label) AS rn FROM k) WHERE rn = 1")
def policy_representatives(spark, sf):
    """Per bin and family the policy of least reuse."""
    k = _calibrated(spark, sf).select("label", F.round("v", 9).alias("v"), F.split("label", "_age")[0].alias("family"), F.expr(_BIN).alias("bin"))
    return L.top_k(k, ["bin", "family"], [F.col("v"), F.col("label")], 1).filter("keep").select("label", "bin")


@query(f"WITH {_POLL}, o AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS n FROM pol) SELECT label FROM o WHERE EXISTS (SELECT 1 FROM range(0, 7) r(j) WHERE i = (j * n) // 7)")
def stride_cap(spark, sf):
    """Seven policies at even strides of the label order."""
    w = Window.orderBy("label")  # 24 literals
    o = policies(spark).select("label", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"))
    return o.filter(F.exists(F.sequence(F.lit(0), F.lit(6)), lambda j: F.col("i") == F.floor(j * F.col("n") / 7))).select("label")


@query(f"WITH {_POLL} SELECT label FROM (SELECT *, row_number() OVER (PARTITION BY static_t, shifted_t, reuse, CASE WHEN max_age >= 3 THEN NULL ELSE max_age END ORDER BY max_age NULLS FIRST, label) AS rn FROM pol) WHERE rn = 1")
def policy_dedup(spark, sf):
    """Policies whose age limit cannot bind within four frames count as unlimited."""
    eff = F.when(F.col("max_age") < 3, F.col("max_age"))
    p = policies(spark).withColumn("_eff", eff)
    return L.top_k(p, ["static_t", "shifted_t", "reuse", "_eff"], [F.col("max_age").asc_nulls_first(), F.col("label")], 1).filter("keep").select("label")


# ---- token selection: a frame is 16 vectors

_TK = "tk AS (SELECT *, count(*) OVER (PARTITION BY f) AS n FROM (SELECT vec_id // 16 AS f, vec_id % 16 AS k, vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))) AS norm, list_sum(list_transform(embedding, lambda z: abs(CAST(z AS DOUBLE)))) AS l1 FROM embeddings))"


def _tokens(spark, sf) -> DataFrame:
    """``f, k, norm, l1, n, embedding``: token k of frame f of n tokens."""
    e = read_table(spark, sf, "embeddings")
    l1 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    t = e.select(F.floor(F.col("vec_id") / 16).alias("f"), (F.col("vec_id") % 16).alias("k"), "vec_id", "embedding", B.norm(F.col("embedding")).alias("norm"), l1.alias("l1"))
    return t.withColumn("n", F.count("*").over(Window.partitionBy("f")))


@query(f"WITH {_TK} SELECT f, k FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY round(norm, 9) DESC, k) AS rn FROM tk) WHERE rn <= greatest(1, least(n, floor(n * 0.3)))")
def keep_topk(spark, sf):
    """Top tokens by norm, the lower index wins."""
    t = _tokens(spark, sf)
    return L.top_k(t, ["f"], [F.round("norm", 9).desc(), F.col("k")], L.keep_count(0.3, F.col("n"))).filter("keep").select("f", "k")


_CORNER = "k IN (0, 3, 12, 15, 10)"


@query(f"WITH {_TK} SELECT f, k, ({_CORNER}) AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY ({_CORNER}) DESC, round(norm, 9) DESC, k) AS rn FROM tk) WHERE rn <= greatest(5, least(n, floor(n * 0.5)))")
def keep_structural(spark, sf):
    """Corners and centre first, the rest of the budget by norm."""
    t = _tokens(spark, sf).withColumn("anchor", F.col("k").isin(0, 3, 12, 15, 10))
    k = F.greatest(F.lit(5), L.keep_count(0.5, F.col("n")))
    return L.top_k(t, ["f"], [F.desc("anchor"), F.round("norm", 9).desc(), F.col("k")], k).filter("keep").select("f", "k", "anchor")


_PIL = f"WITH {_TK}, p AS (SELECT *, row_number() OVER (PARTITION BY f, (k // 4) // 2 * 2 + (k % 4) // 2 ORDER BY round(norm, 9) DESC, k) <= 1 AS anchor FROM tk)"


@query(f"{_PIL} SELECT f, k, anchor FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY anchor DESC, round(l1, 9) DESC, k) AS rn FROM p) WHERE rn <= greatest(4, least(n, floor(n * 0.5)))")
def keep_pillar(spark, sf):
    """The best quarter of every 2x2 cell first, the rest by the L1 norm."""
    cell = F.floor(F.floor(F.col("k") / 4) / 2) * 2 + F.floor((F.col("k") % 4) / 2)
    t = L.top_k(_tokens(spark, sf).withColumn("cell", cell), ["f", "cell"], [F.round("norm", 9).desc(), F.col("k")], 1, "anchor")
    k = F.greatest(F.lit(4), L.keep_count(0.5, F.col("n")))
    return L.top_k(t, ["f"], [F.desc("anchor"), F.round("l1", 9).desc(), F.col("k")], k).filter("keep").select("f", "k", "anchor")


@query()
def keep_diversity(spark, sf):
    """Farthest-first selection of four tokens per frame."""
    return L.farthest_first(_tokens(spark, sf), ["f"], "k", "embedding", 4)


@query(f"WITH {_TK} SELECT f, k FROM (SELECT *, row_number() OVER (PARTITION BY f, k // 4 ORDER BY round(norm, 6) DESC, k DESC) AS rn, count(*) OVER (PARTITION BY f, k // 4) AS m FROM tk) WHERE rn <= greatest(1, round_even(m * 0.5, 0))")
def window_quota(spark, sf):
    """Quota per window of four tokens, the higher index wins."""
    t = _tokens(spark, sf).withColumn("w", F.floor(F.col("k") / 4)).withColumn("m", F.count("*").over(Window.partitionBy("f", "w")))
    return L.top_k(t, ["f", "w"], [F.round("norm", 6).desc(), F.desc("k")], F.greatest(F.lit(1), F.bround(F.col("m") * 0.5))).filter("keep").select("f", "k")


@query(f"WITH {_TK}, kp AS (SELECT vec_id FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY round(norm, 9) DESC, k) AS rn FROM tk) WHERE rn <= 4) SELECT e.vec_id, CASE WHEN kp.vec_id IS NULL THEN 0 ELSE round(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE))), 6) END AS total FROM embeddings e LEFT JOIN kp ON e.vec_id = kp.vec_id")
def compact_and_scatter(spark, sf):
    """Kept features compacted and put back, zeros at the pruned slots."""
    t = _tokens(spark, sf)
    kept = L.top_k(t, ["f"], [F.round("norm", 9).desc(), F.col("k")], 4).filter("keep").select("vec_id", F.col("embedding").alias("feature"))
    back = F.coalesce("feature", F.array_repeat(F.lit(0.0).cast("float"), 64))
    return t.select("vec_id").join(kept, "vec_id", "left").select("vec_id", F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query(f"""WITH {_FR}, n AS (SELECT clip, t, coalesce(round(list_avg(list_transform(range(1, 65), lambda i: abs(CAST(embedding[i] AS DOUBLE) - CAST(prev[i] AS DOUBLE)))), 9), 0) AS d FROM (SELECT *, lag(embedding) OVER (PARTITION BY clip ORDER BY t) AS prev FROM fr))
SELECT clip, t FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t = 0 DESC, d DESC, t) AS rn FROM n) WHERE rn <= 8""")
def top_novel_frames(spark, sf):
    """The eight most novel frames of a clip, the first one always among them."""
    d = _diffs(spark, sf).select("clip", "t", F.coalesce(F.round(B.mean(F.col("diff")), 9), F.lit(0.0)).alias("d"))
    return L.top_k(d, ["clip"], [F.desc(F.col("t") == 0), F.desc("d"), F.col("t")], 8).filter("keep").select("clip", "t")


@query("WITH n AS (SELECT label AS clip, count(*) AS n FROM embeddings GROUP BY label) SELECT clip, CAST(i AS INTEGER) AS i, CAST(CASE WHEN n <= 6 THEN i ELSE (i * (n - 1)) // 5 END AS INTEGER) AS frame FROM n, range(0, 6) r(i) WHERE i < least(n, 6)")
def uniform_indices(spark, sf):
    """Six frame indices spread evenly over a clip."""
    n = read_table(spark, sf, "embeddings").groupBy(F.col("label").alias("clip")).agg(F.count("*").alias("n"))
    return n.select("clip", F.posexplode(L.uniform_indices(F.col("n"), 6)).alias("i", "frame"))


# ---- resampling and pooling

_OV = "ov AS (SELECT c.i * 4 + c.j AS cell, d.i * 3 + d.j AS token, greatest(0, least((c.i + 1) / 4.0, (d.i + 1) / 3.0) - greatest(c.i / 4.0, d.i / 3.0)) * greatest(0, least((c.j + 1) / 4.0, (d.j + 1) / 3.0) - greatest(c.j / 4.0, d.j / 3.0)) AS area FROM (SELECT a.range AS i, b.range AS j FROM range(4) a, range(4) b) c, (SELECT a.range AS i, b.range AS j FROM range(3) a, range(3) b) d), o2 AS (SELECT * FROM ov WHERE area > 1e-9)"


@query(f"WITH {_BK}, {_OV} SELECT clip, t, CAST(token AS INTEGER) AS token, round(sum(s * area) / sum(area), 6) AS value, round(avg(s), 6) AS touched FROM bk JOIN o2 ON b = cell GROUP BY clip, t, token")
def grid_resample_area(spark, sf):
    """4x4 scores on a 3x3 grid, weighted by area and not."""
    ov = B.overlap_table(spark, (4, 4), (3, 3))
    s = _scored(spark, sf)
    a, b = B.area_mean(s, "scores", ov), B.touched_mean(s, "scores", ov).withColumnRenamed("value", "touched")
    return a.join(b, ["clip", "t", "token"]).select("clip", "t", "token", F.round("value", 6).alias("value"), F.round("touched", 6).alias("touched"))


@query(f"WITH {_CL}, {_OV}, a AS (SELECT clip, t, token, cls, round(sum(area), 9) AS area FROM cl JOIN o2 ON b = cell GROUP BY ALL) SELECT clip, t, CAST(token AS INTEGER) AS token, CAST(cls AS INTEGER) AS cls FROM (SELECT *, row_number() OVER (PARTITION BY clip, t, token ORDER BY area DESC, cls DESC) AS rn FROM a) WHERE rn = 1")
def grid_resample_majority(spark, sf):
    """4x4 classes on a 3x3 grid by area, ties to the higher class."""
    return B.area_majority(_scored(spark, sf), "classes", B.overlap_table(spark, (4, 4), (3, 3)))


@query(f"WITH {_PX} SELECT clip, t, CAST((y // 4) * 2 + x // 4 AS INTEGER) AS cell, round(avg(v), 6) AS value FROM px GROUP BY clip, t, (y // 4) * 2 + x // 4")
def pool_to_grid(spark, sf):
    """Planes mean-pooled to a 2x2 grid."""
    d = _frames(spark, sf).withColumn("p", B.pool(F.col("plane"), W, H, 2, 2))
    return d.select("clip", "t", F.posexplode("p").alias("cell", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {_CL} SELECT clip, t, CAST((b // 4) // 2 * 2 + (b % 4) // 2 AS INTEGER) AS token, round(avg(s), 6) AS mean, bool_and(cls < 2) AS all_reusable FROM cl GROUP BY clip, t, (b // 4) // 2 * 2 + (b % 4) // 2")
def token_pool(spark, sf):
    """Patches grouped to tokens: mean score, and whether all are reusable."""
    tok = (F.floor(F.floor(F.col("b") / 4) / 2) * 2 + F.floor(F.col("b") % 4 / 2)).cast("int")
    return _blocks(spark, sf).groupBy("clip", "t", tok.alias("token")).agg(F.round(F.avg("s"), 6).alias("mean"), F.bool_and("r").alias("all_reusable"))


@query(f"WITH {_BK} SELECT clip, t, CAST(abs(b // 4 - 1) + abs(b % 4 - 2) AS INTEGER) AS ring, count(*) AS n, round(avg(s), 6) AS mean, round(min(s), 6) AS least FROM bk GROUP BY clip, t, abs(b // 4 - 1) + abs(b % 4 - 2)")
def distance_rings(spark, sf):
    """Scores by the Manhattan distance from block (1, 2)."""
    ring = (F.abs(F.floor(F.col("b") / 4) - 1) + F.abs(F.col("b") % 4 - 2)).cast("int")
    return _blocks(spark, sf).groupBy("clip", "t", ring.alias("ring")).agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.min("s"), 6).alias("least"))


# ---- features

_COS = f"{_FR}, pr AS (SELECT clip, t, embedding AS a, lag(embedding) OVER (PARTITION BY clip ORDER BY t) AS p FROM fr), fc AS (SELECT clip, t, 1 - list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(p AS DOUBLE[])) AS dist, list_avg(list_transform(range(1, 65), lambda i: abs(CAST(a[i] AS DOUBLE) - CAST(p[i] AS DOUBLE)))) AS mad, sqrt(list_avg(list_transform(range(1, 65), lambda i: (CAST(a[i] AS DOUBLE) - CAST(p[i] AS DOUBLE)) ** 2))) AS rms, list_max(list_transform(range(1, 65), lambda i: abs(CAST(a[i] AS DOUBLE) - CAST(p[i] AS DOUBLE)))) AS top FROM pr WHERE t > 0)"


def _features(spark, sf) -> DataFrame:
    d = _diffs(spark, sf).filter("t > 0")
    sq = F.sqrt(B.mean(F.transform("diff", lambda x: x * x)))
    return d.select("clip", "t", (1 - B.cosine(F.col("plane"), F.col("prev"))).alias("dist"), B.mean(F.col("diff")).alias("mad"), sq.alias("rms"), F.array_max("diff").alias("top"))


@query(f"WITH {_COS} SELECT clip, t, round(dist, 6) AS dist, round(mad, 6) AS mad, round(rms, 6) AS rms, round(top, 6) AS top FROM fc")
def feature_distance(spark, sf):
    """Cosine distance, mean and root mean square difference, greatest difference of adjacent frames."""
    return _features(spark, sf).select("clip", "t", *[F.round(c, 6).alias(c) for c in ("dist", "mad", "rms", "top")])


@query(f"WITH {_COS} SELECT clip, count(*) AS n, round(avg(dist), 6) AS mean, round(stddev_pop(dist), 6) AS std, round(median(dist), 6) AS median, round(quantile_cont(dist, 0.05), 6) AS p05, round(quantile_cont(dist, 0.95), 6) AS p95 FROM fc GROUP BY clip")
def drift_distribution(spark, sf):
    """Distribution of the feature distance per clip, linear quantiles."""
    d = materialize(_features(spark, sf).select("clip", "dist"))
    g = d.groupBy("clip").agg(F.count("*").alias("n"), F.round(F.avg("dist"), 6).alias("mean"), F.round(F.stddev_pop("dist"), 6).alias("std"))
    shares = {"median": 0.5, "p05": 0.05, "p95": 0.95}
    return S.with_percentiles(g, d, ["clip"], "dist", shares).select("clip", "n", "mean", "std", *[F.round(n, 6).alias(n) for n in shares])


_RK = "rk AS (SELECT *, rank() OVER (PARTITION BY clip ORDER BY round(mad, 9)) + (count(*) OVER (PARTITION BY clip, round(mad, 9)) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY clip ORDER BY round(dist, 9)) + (count(*) OVER (PARTITION BY clip, round(dist, 9)) - 1) / 2.0 AS rd FROM fc)"


@query(f"WITH {_COS}, {_RK} SELECT clip, round(corr(mad, dist), 6) AS pearson, round(corr(rm, rd), 6) AS spearman FROM rk GROUP BY clip")
def corr_pixel_feature(spark, sf):
    """Pearson and Spearman correlation of pixel and feature change."""
    d = _features(spark, sf).withColumns({"m9": F.round("mad", 9), "d9": F.round("dist", 9)})
    d = S.average_rank(S.average_rank(d, ["clip"], "m9", "rm"), ["clip"], "d9", "rd")
    return d.groupBy("clip").agg(F.round(F.corr("mad", "dist"), 6).alias("pearson"), F.round(F.corr("rm", "rd"), 6).alias("spearman"))


@query(f"WITH {_BK} SELECT clip, round(quantile_cont(s, 0.4), 6) AS static_t, round(quantile_cont(s, 0.8), 6) AS shifted_t FROM bk GROUP BY clip UNION ALL SELECT NULL, round(quantile_cont(s, 0.4), 6), round(quantile_cont(s, 0.8), 6) FROM bk")
def threshold_calibration(spark, sf):
    """Thresholds that give target shares, per clip and pooled (null clip)."""
    b = materialize(_blocks(spark, sf).select("clip", "s"))
    shares = {"static_t": 0.4, "shifted_t": 0.8}
    pooled = S.percentile(b, [], "s", shares).select(F.lit(None).cast(b.schema["clip"].dataType).alias("clip"), *shares)
    return S.percentile(b, ["clip"], "s", shares).unionByName(pooled).select("clip", *[F.round(n, 6).alias(n) for n in shares])


@query(f"WITH {_PX}, n AS (SELECT clip, CAST(floor(v * 8) AS INTEGER) AS q, count(*) AS n FROM px GROUP BY ALL), p AS (SELECT clip, n / sum(n) OVER (PARTITION BY clip) AS p FROM n) SELECT clip, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY clip")
def color_entropy(spark, sf):
    """Entropy in bits of quantised values."""
    n = _frames(spark, sf).select("clip", F.explode("plane").alias("v")).groupBy("clip", F.floor(F.col("v").cast("double") * 8).alias("q")).agg(F.count("*").alias("n"))
    p = n.select("clip", (F.col("n") / F.sum("n").over(Window.partitionBy("clip"))).alias("p"))
    return p.groupBy("clip").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


@query("WITH l AS (SELECT vec_id, list_transform(embedding[1:4], lambda z: CAST(z AS DOUBLE)) AS v FROM embeddings), m AS (SELECT *, list_max(v) AS mx, list_sum(list_transform(v, lambda z: exp(z - list_max(v)))) AS zz FROM l), g AS (SELECT vec_id, -list_sum(list_transform(v, lambda z: exp(z - mx) / zz * ln(greatest(exp(z - mx) / zz, 1e-12)))) AS entropy, list_reverse_sort(v)[1] - list_reverse_sort(v)[2] AS gap FROM m) SELECT vec_id, round(entropy, 6) AS entropy, round(gap, 6) AS gap, CASE WHEN gap < 0.05 THEN 'tie' WHEN gap < 0.1 THEN 'weak' WHEN gap < 0.2 THEN 'fair' ELSE 'strong' END AS stratum FROM g")
def logprob_strata(spark, sf):
    """Entropy, top gap and confidence stratum of four option scores."""
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    d = read_table(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", S.softmax_entropy(F.col("v")).alias("entropy"), S.top_gap(F.col("v")).alias("gap"))
    stratum = F.when(F.col("gap").isNull(), "missing").when(F.col("gap") < 0.05, "tie").when(F.col("gap") < 0.1, "weak").when(F.col("gap") < 0.2, "fair").otherwise("strong")
    return d.select("vec_id", F.round("entropy", 6).alias("entropy"), F.round("gap", 6).alias("gap"), stratum.alias("stratum"))


QUERIES, ORACLES = Q, O
