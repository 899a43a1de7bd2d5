"""Queries on registries, prompts, digests, segments and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions import answers as A
from framewright.operators import drift
from framewright.operators import frames as B
from framewright.operators import selection as L
from framewright.operators import sequence as SQ
from framewright.plans import frames as FP
from framewright.plans import runs as RP
from framewright.plans import streams as SP
from framewright.storage import read_table

Q: dict = {}
O: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


@query("SELECT record_id, benchmark, item_group FROM bench_items QUALIFY row_number() OVER (PARTITION BY benchmark, item_group ORDER BY record_id) <= 5")
def first_per_group(spark, sf):
    """The first five items of each group."""
    b = read_table(spark, sf, "bench_items").select("record_id", "benchmark", "item_group")
    return L.top_k(b, ["benchmark", "item_group"], [F.col("record_id")], 5).filter("keep").drop("keep")


@query("SELECT DISTINCT b.item_id, b.video_id FROM bench_items b WHERE EXISTS (SELECT 1 FROM item_results r WHERE r.item_id = b.item_id AND r.arm = 'cached')")
def wanted_items(spark, sf):
    """Items of the registry that some run asks for."""
    r = read_table(spark, sf, "item_results").filter("arm = 'cached'").select("item_id")
    return read_table(spark, sf, "bench_items").join(r, "item_id", "left_semi").select("item_id", "video_id").distinct()


@query(r"WITH p AS (SELECT DISTINCT item_id, regexp_replace(item_id, '-[^-]*$', '') AS session, TRY_CAST(regexp_extract(item_id, '-([^-]*)$', 1) AS INTEGER) AS no FROM bench_items) SELECT session, count(*) AS n, string_agg(item_id, ',' ORDER BY no, item_id) AS items FROM p GROUP BY session HAVING count(*) >= 3")
def session_questions(spark, sf):
    """Sessions of at least three questions, in the order of their numbers; a session is one video's short list."""
    p = read_table(spark, sf, "bench_items").select("item_id").distinct()
    p = p.select("item_id", F.regexp_replace("item_id", "-[^-]*$", "").alias("session"), F.regexp_extract("item_id", "-([^-]*)$", 1).try_cast("int").alias("no"))
    g = p.groupBy("session").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce("no", F.lit(2**31 - 1)).alias("no"), "item_id"))).alias("s")).filter("n >= 3")
    return g.select("session", "n", F.array_join(F.col("s.item_id"), ",").alias("items"))


@query(r"SELECT record_id, coalesce(nullif(video_id, ''), regexp_replace(item_id, '-[^-]*$', '')) AS session, regexp_replace(coalesce(candidates[1], ''), '^[A-Za-z]\. ', '') AS first_option FROM bench_items")
def session_ids(spark, sf):
    """Session of an item: its video, else its id without the number."""
    b = read_table(spark, sf, "bench_items")
    return b.select("record_id", F.coalesce(F.nullif("video_id", F.lit("")), F.regexp_replace("item_id", "-[^-]*$", "")).alias("session"), A.strip_letter(F.coalesce(F.try_element_at("candidates", F.lit(1)), F.lit(""))).alias("first_option"))


_DIG = "p AS (SELECT clip, t, t // 16 AS c, CAST(list_sum(list_transform(embedding, lambda z: CAST(floor(CAST(z AS DOUBLE) * 1000) AS BIGINT))) AS BIGINT) AS v FROM fr), h AS (SELECT clip, c, count(*) AS n, sha256(string_agg(CAST(v AS VARCHAR), '|' ORDER BY t)) AS h FROM p GROUP BY clip, c)"


@query(f"WITH {FP._FR}, {_DIG} SELECT clip, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '|' ORDER BY c)) AS digest FROM h GROUP BY clip")
def clip_digests(spark, sf):
    """Order-dependent content hash of a clip's frames."""
    v = F.aggregate("plane", F.lit(0).cast("bigint"), lambda a, x: a + F.floor(x.cast("double") * 1000)).cast("string")
    return SQ.sequence_digest(FP._frames(spark, sf), ["clip"], "t", v, chunk=16)


@query(f"WITH {FP._PX}, d AS (SELECT a.clip, a.t, (a.y // 2) * 4 + a.x // 2 AS b, abs(a.v - p.v) AS d FROM px a JOIN px p ON a.clip IS NOT DISTINCT FROM p.clip AND p.t = a.t - 1 AND p.x = least(a.x + 1, 7) AND p.y = a.y) SELECT clip, t, CAST(b AS INTEGER) AS b, round(avg(d), 6) AS residual FROM d GROUP BY clip, t, b")
def motion_residual(spark, sf):
    """Residual of blocks against the plane before, moved by one column."""
    d = B.with_previous(FP._frames(spark, sf)).filter("t > 0")
    r = d.withColumn("r", B.shifted_residual(F.col("plane"), F.col("prev"), 8, 8, 2, 1, 0))
    return r.select("clip", "t", F.posexplode("r").alias("b", "residual")).withColumn("residual", F.round("residual", 6))


@query()
def bicubic_resize(spark, sf):
    """4x4 scores on a 6x6 grid by the cubic kernel."""
    return B.bicubic(FP._scored(spark, sf), "scores", (4, 4), (6, 6))


@query("WITH g AS (SELECT p_partkey, p_size % 4 + 1 AS t, (p_size % 6 + 1) * 2 AS h, (p_size % 5 + 1) * 2 AS w FROM part) SELECT p_partkey, CAST(t * (h // 2) * (w // 2) AS INTEGER) AS tokens, CAST((h // 2) * (w // 2) AS INTEGER) AS per_frame, floor(sqrt((h // 2) * (w // 2))) ** 2 = (h // 2) * (w // 2) AS square FROM g")
def grid_shapes(spark, sf):
    """Tokens of merged grids, per frame and in all, and whether they form a square."""
    p = read_table(spark, sf, "part")
    t, h, w = F.col("p_size") % 4 + 1, (F.col("p_size") % 6 + 1) * 2, (F.col("p_size") % 5 + 1) * 2
    n = (F.floor(h / 2) * F.floor(w / 2)).cast("int")
    return p.select("p_partkey", (t * n).cast("int").alias("tokens"), n.alias("per_frame"), (F.pow(F.floor(F.sqrt(n)), F.lit(2)) == n).alias("square"))


@query(f"WITH {SP._TURN}, n AS (SELECT user_id, count(*) AS n FROM tn GROUP BY user_id), p AS (SELECT * FROM (VALUES ('fixed'), ('refresh5'), ('refresh10')) v(policy)) SELECT user_id, policy, CASE WHEN regexp_matches(policy, '^refresh') THEN (n + CAST(regexp_extract(policy, '([0-9]+)$', 1) AS BIGINT) - 1) // CAST(regexp_extract(policy, '([0-9]+)$', 1) AS BIGINT) ELSE 1 END AS expected FROM n, p")
def expected_refreshes(spark, sf):
    """Rows that a policy named ``refreshN`` makes anew."""
    n = SP._events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    d = n.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in ("fixed", "refresh5", "refresh10")])))
    k = F.regexp_extract("policy", "([0-9]+)$", 1).try_cast("bigint")
    return d.select("user_id", "policy", F.when(k.isNotNull(), F.floor((F.col("n") + k - 1) / k)).otherwise(1).cast("bigint").alias("expected"))


@query(f"WITH {SP._TURN} SELECT user_id, CAST(turn AS INTEGER) AS turn, replace(replace(CASE turn % 3 WHEN 0 THEN 'What is new in turn {{n}}?' WHEN 1 THEN 'After {{previous}}, what comes next?' ELSE 'Is {{previous}} still true in turn {{n}}?' END, '{{n}}', CAST(turn AS VARCHAR)), '{{previous}}', coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY turn), 'nothing')) AS prompt FROM tn")
def turn_prompts(spark, sf):
    """A cycle of templates filled with the turn and the answer before."""
    t = SP._turns(spark, sf)
    form = F.element_at(F.array(F.lit("What is new in turn {n}?"), F.lit("After {previous}, what comes next?"), F.lit("Is {previous} still true in turn {n}?")), (F.col("turn") % 3 + 1).cast("int"))
    before = F.coalesce(F.lag("event_type").over(Window.partitionBy("user_id").orderBy("turn")), F.lit("nothing"))
    return t.select("user_id", "turn", F.replace(F.replace(form, F.lit("{n}"), F.col("turn").cast("string")), F.lit("{previous}"), before).alias("prompt"))


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS s, array_to_string(list_transform(range(0, 300, 60), lambda i: CAST(CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) - 240 + i AS VARCHAR)), ',') AS polling, CAST(round_even((epoch_us(ts) % 10000000) / 1000000.0 * 2.5, 0) AS BIGINT) AS frame FROM events")
def policy_frames(spark, sf):
    """Time stamps that a polling policy looks at before an event, and a stamp as a frame number."""
    e = read_table(spark, sf, "events")
    us = SP.micros("ts")
    s = F.floor(us / 1e6).cast("bigint")
    return e.select("event_id", s.alias("s"), F.array_join(F.transform(F.sequence(s - 240, s, F.lit(60).cast("bigint")), lambda x: x.cast("string")), ",").alias("polling"), F.bround((us % 10000000) / 1000000.0 * 2.5).cast("bigint").alias("frame"))


@query("SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"type\":\"' || event_type || '\"}' AS canonical FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND event_type IS NOT NULL")
def canonical_json(spark, sf):
    """JSON with its keys in order and no spaces."""
    e = read_table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).filter("k IS NOT NULL AND event_type IS NOT NULL")
    return e.select("event_id", F.to_json(F.struct("k", F.col("event_type").alias("type"))).alias("canonical"))


@query("""WITH o AS (SELECT path, line_no, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM raw_records WHERE payload IS NOT NULL AND length(trim(payload)) > 0), k AS (SELECT o.path, line_no, t.fullkey, t.type FROM o, json_tree(o.j) t WHERE json_type(o.j) = 'OBJECT')
SELECT path, line_no, replace(substr(fullkey, 3), '"', '') AS field, CASE WHEN type IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'integer' WHEN type = 'NULL' THEN 'null' WHEN type = 'VARCHAR' THEN 'string' ELSE lower(type) END AS type FROM k WHERE type <> 'OBJECT' AND NOT contains(fullkey, '[')""")
def json_leaves(spark, sf):
    """Every leaf of the JSON lines by dotted name and type, any depth."""
    return drift.rescued_leaves(read_table(spark, sf, "raw_records"), {}, keep=("path", "line_no")).drop("value")


@query("SELECT session_key, arm_name, CASE WHEN duration = 'short' THEN 1 ELSE 0 END AS is_short, CASE WHEN duration = 'medium' THEN 1 ELSE 0 END AS is_medium, CASE WHEN duration = 'long' THEN 1 ELSE 0 END AS is_long, round(ln(stream_total_ms + 1), 6) AS log_ms, ingested_at FROM session_arms")
def feature_matrix(spark, sf):
    """Features of sessions with one column per duration."""
    d = read_table(spark, sf, "session_arms")
    hot = [F.when(F.col("duration") == x, 1).otherwise(0).alias(f"is_{x}") for x in ("short", "medium", "long")]
    return d.select("session_key", "arm_name", *hot, F.round(F.ln(F.col("stream_total_ms") + 1), 6).alias("log_ms"), "ingested_at")


_SEG = "o AS (SELECT *, sum(len) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS e FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(floor(l_quantity / 10) AS BIGINT) AS len FROM lineitem) WHERE len > 0)"


@query(f"WITH {_SEG}, p AS (SELECT o_orderkey AS l_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 12 AS pos FROM orders) SELECT p.l_orderkey, pos, (SELECT CAST(max(e - len) AS BIGINT) FROM o WHERE o.l_orderkey = p.l_orderkey AND pos >= e - len AND pos < e) AS start FROM p")
def segment_of_position(spark, sf):
    """The segment that holds a position, none beyond the end."""
    f = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.floor(F.col("l_quantity") / 10).alias("len"))
    seg = SQ.offsets(f, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], "len")
    p = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.floor("o_totalprice") % 12).alias("pos"))
    return SQ.assign_segments(p, seg, ["l_orderkey"], "pos")


@query(f"WITH {FP._BK}, i AS (SELECT * FROM (VALUES (1), (3), (5)) v(t)) SELECT clip, count(DISTINCT bk.t) AS n, round(avg(s), 6) AS mean FROM bk JOIN i ON bk.t = i.t GROUP BY clip")
def critical_mean(spark, sf):
    """Mean score over listed frames."""
    b = FP._blocks(spark, sf).filter(F.col("t").isin(1, 3, 5))
    return b.groupBy("clip").agg(F.count_distinct("t").alias("n"), F.round(F.avg("s"), 6).alias("mean"))


@query(f"WITH {RP._PAIR} SELECT benchmark, count(*) AS n, round(avg(CAST(abs(ga - gb) <= 1e-9 AS INTEGER)), 6) AS equal_share, max(abs(ga - gb)) AS max_abs FROM pr WHERE ga IS NOT NULL AND gb IS NOT NULL GROUP BY benchmark")
def equivalence_audit(spark, sf):
    """Share of equal values of two arms and their greatest difference."""
    d = F.abs(F.col("ga") - F.col("gb"))
    return RP._paired(spark, sf).filter("ga IS NOT NULL AND gb IS NOT NULL").groupBy("benchmark").agg(F.count("*").alias("n"), F.round(F.avg((d <= 1e-9).cast("int")), 6).alias("equal_share"), F.max(d).alias("max_abs"))


@query(f"WITH {RP._ONCE}, g AS (SELECT arm, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 3) AS acc FROM once GROUP BY arm) SELECT arm, '| ' || arm || ' | ' || CAST(n AS VARCHAR) || ' | ' || printf('%.3f', acc) || ' |' AS line FROM g")
def report_lines(spark, sf):
    """Lines of a Markdown table."""
    g = RP._results(spark, sf).groupBy("arm").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("acc"))
    return g.select("arm", F.concat(F.lit("| "), F.concat_ws(" | ", "arm", F.col("n").cast("string"), F.format_string("%.3f", F.round("acc", 3))), F.lit(" |")).alias("line"))


QUERIES, ORACLES = Q, O
