"""Queries on event sequences, streaming twins, sources and validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators import quality, selection
from framewright.operators import sequence as SQ
from framewright.plans import frames as FP
from framewright.storage import read_table, shared_path
from framewright.streaming import stateful

Q: dict = {}
O: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros(ts: str) -> Column:
    """Microseconds of a zone-less time stamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {ts})")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """``user_id, event_id, event_type, value, s``: seconds of the time stamp."""
    return read_table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "props", (micros("ts") / 1e6).alias("s"))


_EV = "ev AS (SELECT user_id, event_id, event_type, value, props, epoch_us(ts) / 1000000.0 AS s FROM events)"


@query(f"WITH {_EV}, g AS (SELECT user_id, event_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS gap FROM ev) SELECT user_id, event_id, round(gap, 3) AS gap, CASE WHEN gap IS NULL THEN 'first' WHEN gap > 0 AND gap <= 3600 THEN 'stale' ELSE 'fresh' END AS kind FROM g")
def stale_cache(spark, sf):
    """Whether the event before is recent enough to have left a stale cache."""
    d = _events(spark, sf).withColumn("gap", SQ.gaps(F.col("s"), ["user_id"], ["s", "event_id"]))
    kind = F.when(F.col("gap").isNull(), "first").when((F.col("gap") > 0) & (F.col("gap") <= 3600), "stale").otherwise("fresh")
    return d.select("user_id", "event_id", F.round("gap", 3).alias("gap"), kind.alias("kind"))


@query(f"WITH {_EV}, n AS (SELECT *, CASE WHEN s - lag(s) OVER w > 21600 THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS session FROM n) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 4) AS total, round(max(s) - min(s), 3) AS seconds FROM k GROUP BY user_id, session")
def event_sessions(spark, sf):
    """Sessions by pauses of more than six hours."""
    d = SQ.sessions(_events(spark, sf), ["user_id"], "s", 21600.0, ["s", "event_id"])
    return d.groupBy("user_id", F.col("session").cast("bigint").alias("session")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("s") - F.min("s"), 3).alias("seconds"))


_TURN = f"{_EV}, tn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS turn FROM ev)"


def _turns(spark, sf) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    return _events(spark, sf).withColumn("turn", F.row_number().over(w) - 1)


@query(f"WITH {_TURN} SELECT user_id, CAST(turn // 10 AS BIGINT) AS bucket, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM tn GROUP BY user_id, turn // 10")
def turn_buckets(spark, sf):
    """Tumbling buckets of ten turns."""
    return SQ.turn_buckets(_turns(spark, sf), ["user_id"], "turn", 10, [F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median")])


@query(f"WITH {_TURN}, s AS (SELECT user_id, turn // 3 AS session, max(value) FILTER (turn % 3 = 0) AS setup, avg(value) FILTER (turn % 3 > 0) AS follow, count(*) FILTER (turn % 3 > 0) AS k FROM tn GROUP BY user_id, turn // 3) SELECT user_id, count(*) AS sessions, round(median(setup / k + follow), 6) AS amortised FROM s WHERE k > 0 GROUP BY user_id")
def setup_amortised(spark, sf):
    """Setup of a session's first query spread over its follow-ups, the median session."""
    t = _turns(spark, sf)
    q = F.col("turn") % 3
    s = t.groupBy("user_id", F.floor(F.col("turn") / 3).alias("session")).agg(F.max(F.when(q == 0, F.col("value"))).alias("setup"), F.avg(F.when(q > 0, F.col("value"))).alias("follow"), F.count_if(q > 0).alias("k"))
    return s.filter("k > 0").groupBy("user_id").agg(F.count("*").alias("sessions"), F.round(F.median(F.col("setup") / F.col("k") + F.col("follow")), 6).alias("amortised"))


@query(f"""WITH RECURSIVE {_EV}, c AS (SELECT user_id, min(s) AS s FROM ev GROUP BY user_id UNION ALL SELECT user_id, ns FROM (SELECT c.user_id, min(e.s) AS ns FROM c JOIN ev e ON e.user_id = c.user_id AND e.s - c.s >= 21600 GROUP BY c.user_id, c.s) WHERE ns IS NOT NULL), sp AS (SELECT user_id, min(s) AS a, max(s) AS b FROM ev GROUP BY user_id), an AS (SELECT user_id, a + CAST(q AS DOUBLE) * (b - a) AS s FROM sp, (VALUES (0.25), (0.5), (0.75)) v(q))
SELECT user_id, s, false AS anchor FROM c UNION ALL SELECT user_id, s, true FROM an WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = an.user_id AND abs(an.s - c.s) <= 1)""")
def greedy_spacing(spark, sf):
    """Events at least six hours after the last chosen one, and three anchors."""
    return selection.greedy_spacing(_events(spark, sf), ["user_id"], "s", 21600.0, anchors=(0.25, 0.5, 0.75), anchor_gap=1.0)


@query(f"WITH {_TURN}, p AS (SELECT user_id, event_id AS point, s AS at FROM tn) SELECT p.user_id, p.point, count(*) AS n, round(avg(value), 6) AS mean FROM p JOIN ev e ON p.user_id = e.user_id AND e.s <= p.at AND e.s > p.at - 86400 GROUP BY p.user_id, p.point")
def event_windows(spark, sf):
    """Events of the day up to each event of a user."""
    p = _events(spark, sf).select("user_id", F.col("event_id").alias("point"), F.col("s").alias("at"))
    j = SQ.window_join(_events(spark, sf).select("user_id", "value", "s"), p, ["user_id"], "s", "at", 86400.0)
    return j.groupBy("user_id", "point").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {_TURN}, n AS (SELECT user_id, count(*) AS n FROM tn GROUP BY user_id), w AS (SELECT user_id, n, len, st FROM n, (VALUES (4), (8)) l(len), range(0, 100000, 2) r(st) WHERE st + len <= n) SELECT w.user_id, CAST(len AS INTEGER) AS len, CAST(st AS BIGINT) AS start, round(avg(value), 6) AS mean FROM w JOIN tn ON w.user_id = tn.user_id AND turn >= st AND turn < st + len GROUP BY w.user_id, len, st")
def sliding_windows(spark, sf):
    """Windows of four and eight turns at even starts that fit the sequence.

    A turn lists the windows it is in, so there is no range join.
    """
    t = _turns(spark, sf)
    n = t.groupBy("user_id").agg(F.count("*").alias("n"))
    parts = []
    for length in (4, 8):
        first = F.greatest(F.lit(0), F.ceil((F.col("turn") - (length - 1)) / 2) * 2).cast("bigint")
        last = (F.floor(F.col("turn") / 2) * 2).cast("bigint")
        parts.append(t.filter(first <= last).select("user_id", "value", F.lit(length).alias("len"), F.explode(F.sequence(first, last, F.lit(2).cast("bigint"))).alias("start")))
    j = parts[0].unionByName(parts[1]).join(n, "user_id").filter(F.col("start") + F.col("len") <= F.col("n"))
    return j.groupBy("user_id", "len", "start").agg(F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {_TURN}, c AS (SELECT user_id, turn, event_type, CASE WHEN turn > 0 AND event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM tn WINDOW w AS (PARTITION BY user_id ORDER BY turn)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY turn) AS run FROM c) SELECT user_id, any_value(event_type) AS event_type, CAST(min(turn) AS INTEGER) AS start, count(*) AS length FROM r GROUP BY user_id, run")
def run_lengths(spark, sf):
    """Runs of equal event types."""
    return SQ.run_lengths(_turns(spark, sf), ["user_id"], ["turn"], "event_type")


@query(f"WITH {_TURN}, g AS (SELECT user_id, turn, CAST(floor(value / 10) AS BIGINT) AS len FROM tn), o AS (SELECT *, sum(len) OVER (PARTITION BY user_id ORDER BY turn) AS e FROM g WHERE len > 0), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e DESC) AS i FROM o) SELECT user_id, CAST(coalesce(max(e - len) FILTER (i = 3), 0) AS BIGINT) AS cut, CAST(max(e) AS BIGINT) AS total FROM k GROUP BY user_id")
def cut_plan(spark, sf):
    """Prefix kept if the last three segments are made anew."""
    t = _turns(spark, sf).select("user_id", "turn", F.floor(F.col("value") / 10).alias("len"))
    return SQ.cut_plan(SQ.offsets(t, ["user_id"], ["turn"], "len"), ["user_id"], 3)


@query(f"WITH {_TURN}, h AS (SELECT user_id, turn, list(CAST(floor(value / 20) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS tok FROM tn), l AS (SELECT *, lag(tok) OVER (PARTITION BY user_id ORDER BY turn) AS prev FROM h) SELECT user_id, CAST(turn AS INTEGER) AS turn, CAST(CASE WHEN prev IS NULL THEN 0 ELSE coalesce((SELECT min(k) FROM range(1, least(len(tok), len(prev)) + 1) r(k) WHERE tok[k] <> prev[k]) - 1, least(len(tok), len(prev))) END AS INTEGER) AS hit FROM l")
def prefix_reuse(spark, sf):
    """Tokens that a query shares with the one before."""
    t = _turns(spark, sf)
    w = Window.partitionBy("user_id").orderBy("turn")
    h = t.select("user_id", "turn", F.collect_list(F.floor(F.col("value") / 20)).over(w.rowsBetween(-3, 0)).alias("tok")).withColumn("prev", F.lag("tok").over(w))
    return h.select("user_id", "turn", F.coalesce(SQ.common_prefix(F.col("tok"), F.col("prev")), F.lit(0)).cast("int").alias("hit"))


@query("SELECT event_type, count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean_k, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS missing FROM events GROUP BY event_type")
def dotted_mean(spark, sf):
    """Mean of a field inside JSON; missing ones do not count."""
    k = F.get_json_object("props", "$.k").cast("double")
    return read_table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(k), 6).alias("mean_k"), F.count_if(k.isNull()).alias("missing"))


@query("SELECT event_type, count(*) AS n, round(sum(CASE WHEN value IS NOT NULL AND value <> 0 THEN value ELSE 1 END), 4) AS total FROM events GROUP BY event_type")
def falsy_coalesce(spark, sf):
    """A fallback chain that skips zeros as well as nulls."""
    v = F.when(F.col("value").isNotNull() & (F.col("value") != 0), F.col("value")).otherwise(1.0)
    return read_table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(v), 4).alias("total"))


@query(f"WITH {_TURN}, h AS (SELECT user_id, turn, list(CAST(floor(value / 20) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS tok FROM tn), l AS (SELECT *, lag(tok) OVER (PARTITION BY user_id ORDER BY turn) AS prev FROM h), p AS (SELECT user_id, CAST(turn AS BIGINT) AS q, len(tok) AS n, CAST(CASE WHEN prev IS NULL OR turn % 10 = 0 THEN 0 ELSE coalesce((SELECT min(k) FROM range(1, least(len(tok), len(prev)) + 1) r(k) WHERE tok[k] <> prev[k]) - 1, least(len(tok), len(prev))) END AS BIGINT) AS hit FROM l) SELECT user_id AS session, q, hit, n - hit AS recomputed FROM p")
def stream_prefix(spark, sf):
    """Prefix reuse kept by a stateful stream that resets at every tenth query."""
    t = _turns(spark, sf)
    w = Window.partitionBy("user_id").orderBy("turn").rowsBetween(-3, 0)
    prompts = t.select(F.col("user_id").alias("session"), F.col("turn").cast("bigint").alias("q"), F.collect_list(F.floor(F.col("value") / 20)).over(w).alias("tokens"))
    at = shared_path(spark, "prompts")
    prompts.write.parquet(at)
    return stateful.drain(stateful.prefix_stream(spark.readStream.schema(prompts.schema).parquet(at), reset_every=10))


# ---- streaming twins

def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a file stream."""
    return spark.readStream.schema(read_table(spark, sf, name).schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf):
    """Event-time windows of a stream, drained to the end."""
    s = _stream(spark, sf, "events").withColumn("ts", F.timestamp_micros(micros("ts")))
    out = stateful.drain(stateful.windowed_counts(s, "ts", "event_type", "value", "1 day"), "complete")
    start = F.expr(f"timestampadd(MICROSECOND, unix_micros(start), {_EPOCH})")
    return out.select(start.alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {FP._states_sql(4, 6, 2)} SELECT clip, CAST(t AS BIGINT) AS t, CAST(b AS INTEGER) AS b, eff, allowed, CAST(src AS BIGINT) AS src FROM sr")
def stream_reuse(spark, sf):
    """Reuse states kept by a stateful stream; equal to the window form."""
    at = shared_path(spark, "blocks")
    blocks = FP._blocks(spark, sf).select("clip", "t", "b", "r")
    blocks.write.parquet(at)
    s = spark.readStream.schema(blocks.schema).parquet(at)
    return stateful.drain(stateful.reuse_stream(s, **FP.POLICY))


# ---- sources, sinks, validators

@query("SELECT path, line_no, NOT json_valid(payload) OR json_type(TRY_CAST(CASE WHEN json_valid(payload) THEN payload END AS JSON)) <> 'OBJECT' AS broken FROM raw_records WHERE length(trim(payload)) > 0")
def line_scan(spark, sf):
    """Lines of the result files, blank ones skipped; whether each holds an object."""
    r = read_table(spark, sf, "raw_records").filter(F.length(F.trim("payload")) > 0)
    v = F.schema_of_variant(F.try_parse_json("payload"))
    return r.select("path", "line_no", (~F.coalesce(v.startswith("OBJECT"), F.lit(False))).alias("broken"))


@query("SELECT s.label, s.path, s.declared_rows, count(DISTINCT r.line_no) AS lines, count(DISTINCT r.line_no) >= s.declared_rows AS finished FROM source_specs s LEFT JOIN raw_records r ON s.path = r.path GROUP BY s.label, s.path, s.declared_rows")
def finished_files(spark, sf):
    """Files with as many lines as they declare."""
    n = read_table(spark, sf, "raw_records").groupBy("path").agg(F.count_distinct("line_no").alias("lines"))
    s = read_table(spark, sf, "source_specs").select("label", "path", "declared_rows").join(n, "path", "left")
    lines = F.coalesce("lines", F.lit(0).cast("bigint"))
    return s.select("label", "path", "declared_rows", lines.alias("lines"), (lines >= F.col("declared_rows")).alias("finished"))


@query("WITH o AS (SELECT path, line_no, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM raw_records) SELECT path, line_no, '' AS field, 'no object' AS error FROM o WHERE j IS NULL OR json_type(j) <> 'OBJECT' UNION ALL SELECT path, line_no, f, CASE WHEN json_type(j, '$.' || f) IS NULL THEN 'missing' ELSE 'type' END FROM o, (VALUES ('item_id', 'VARCHAR'), ('q_index', 'NUM'), ('video_id', 'VARCHAR')) r(f, t) WHERE json_type(j) = 'OBJECT' AND (json_type(j, '$.' || f) IS NULL OR (t = 'VARCHAR' AND json_type(j, '$.' || f) <> 'VARCHAR') OR (t = 'NUM' AND json_type(j, '$.' || f) NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE')))")
def json_schema_errors(spark, sf):
    """Required fields of the JSON lines that are missing or mistyped."""
    return quality.json_schema_errors(read_table(spark, sf, "raw_records"), "payload", ["path", "line_no"], {"item_id": "string", "q_index": "number", "video_id": "string"})


@query("SELECT benchmark, 'rows' AS gate, count(*) >= 21 AS passed FROM item_results GROUP BY benchmark UNION ALL SELECT benchmark, 'items', count(DISTINCT item_id) >= 7 FROM item_results GROUP BY benchmark UNION ALL SELECT benchmark, 'parse', avg(CAST(parse_failure AS INTEGER)) <= 0.1 FROM item_results GROUP BY benchmark")
def protocol_gates(spark, sf):
    """Coverage and quality gates per benchmark."""
    m = [F.count("*").alias("n"), F.count_distinct("item_id").alias("items"), F.avg(F.col("parse_failure").cast("int")).alias("pf")]
    return quality.gates(read_table(spark, sf, "item_results"), m, {"rows": F.col("n") >= 21, "items": F.col("items") >= 7, "parse": F.col("pf") <= 0.1}, ["benchmark"])


@query("SELECT item_id, f AS field, n FROM (SELECT item_id, count(DISTINCT {'a': benchmark}) AS b, count(DISTINCT {'a': item_group}) AS g, count(DISTINCT {'a': answer_index}) AS a FROM item_results GROUP BY item_id) UNPIVOT (n FOR f IN (b, g, a)) WHERE n > 1".replace("f AS field", "CASE f WHEN 'b' THEN 'benchmark' WHEN 'g' THEN 'item_group' ELSE 'answer_index' END AS field"))
def matched_invariants(spark, sf):
    """Fields that must be one per item but vary."""
    return quality.varying_fields(read_table(spark, sf, "item_results"), "item_id", ["benchmark", "item_group", "answer_index"])


@query("SELECT s.session_key, m.a AS missing FROM (SELECT DISTINCT session_key FROM session_arms) s, (VALUES ('pruned_q0'), ('dense_q0')) m(a) WHERE NOT EXISTS (SELECT 1 FROM session_arms x WHERE x.session_key = s.session_key AND x.arm_name = m.a)")
def missing_arms(spark, sf):
    """Arms that a session lacks."""
    return quality.missing_members(read_table(spark, sf, "session_arms"), "session_key", "arm_name", ["pruned_q0", "dense_q0"])


@query("SELECT path, 'frame_count' AS rule FROM source_specs WHERE NOT coalesce(frame_count IN (8, 16, 32), false) UNION ALL SELECT path, 'schema' FROM source_specs WHERE NOT coalesce(schema IN ('phase155', 'phase130'), false) UNION ALL SELECT path, 'declared' FROM source_specs WHERE NOT coalesce(declared_rows > 0, false) UNION ALL SELECT path, 'relative' FROM source_specs WHERE NOT coalesce(NOT starts_with(path, '/') AND NOT starts_with(path, '~') AND NOT starts_with(path, 'results/'), false)")
def spec_rules(spark, sf):
    """Rules that rows of the specs break, null counting as broken."""
    p = F.col("path")
    return quality.failing_rows(read_table(spark, sf, "source_specs"), ["path"], {"frame_count": F.col("frame_count").isin(8, 16, 32), "schema": F.col("schema").isin("phase155", "phase130"), "declared": F.col("declared_rows") > 0, "relative": ~p.startswith("/") & ~p.startswith("~") & ~p.startswith("results/")})


@query("SELECT DISTINCT r.item_id FROM item_results r WHERE NOT EXISTS (SELECT 1 FROM bench_items b WHERE b.item_id = r.item_id)")
def unreferenced_items(spark, sf):
    """Items of results that no manifest lists."""
    return quality.unreferenced(read_table(spark, sf, "item_results").select("item_id"), read_table(spark, sf, "bench_items"), ["item_id"]).distinct()


@query("WITH a AS (SELECT source, 'primary' AS copy, avg(CAST(choice_drift AS INTEGER)) AS d FROM pair_rows GROUP BY source UNION ALL SELECT source, 'mirror', avg(CAST(choice_drift AS INTEGER)) FROM pair_rows_mirror GROUP BY source) SELECT source, round(max(d) FILTER (copy = 'primary'), 6) AS primary_rate, round(max(d) FILTER (copy = 'mirror'), 6) AS mirror_rate, round(max(d) - min(d), 6) AS span FROM a GROUP BY source")
def run_comparison(spark, sf):
    """A metric by run, pivoted, with its span."""
    part = lambda t, n: read_table(spark, sf, t).groupBy("source").agg(F.avg(F.col("choice_drift").cast("int")).alias("d")).withColumn("copy", F.lit(n))
    u = part("pair_rows", "primary").unionByName(part("pair_rows_mirror", "mirror"))
    g = u.groupBy("source").pivot("copy", ["primary", "mirror"]).agg(F.max("d"))
    return g.select("source", F.round("primary", 6).alias("primary_rate"), F.round("mirror", 6).alias("mirror_rate"), F.round(F.greatest("primary", "mirror") - F.least("primary", "mirror"), 6).alias("span"))


@query("SELECT n_name, count(*) AS suppliers, round(avg(s_acctbal), 4) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def dimension_join(spark, sf):
    """A star of dimensions; Catalyst broadcasts by the scans' sizes."""
    j = read_table(spark, sf, "supplier").join(read_table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("suppliers"), F.round(F.avg("s_acctbal"), 4).alias("balance"))


QUERIES, ORACLES = Q, O
