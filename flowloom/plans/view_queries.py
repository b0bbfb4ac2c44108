"""Queries of what users ask of stored sessions: customers stand for recordings, orders for epochs and sessions, line items
for operations, documents for stored content."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowloom.operators import views as v
from flowloom.plans.catalog import query, table
from flowloom.plans.log_queries import events

STATUSES = ("in_progress", "recoverable", "failed", "published", "inconsistent")
_STATUS = "['in_progress', 'recoverable', 'failed', 'published', 'inconsistent'][c_custkey % 5 + 1]"
_CREATED = "(631152000000000 + c_custkey % 40 * 86400000000)"
_ENDED = "CASE WHEN {k} % 50 = 0 THEN NULL ELSE {a} + ({k} % 977 - 100) * 1000 END"


def pick(names, index):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def sessions(spark, sf_dir):
    """Every order as a session's summary; some have not ended, some end before they began."""
    start, k = F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")
    end = F.when(k % 50 != 0, F.timestamp_micros(start + (k % 977 - 100) * 1000))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recording_id"), k, F.timestamp_micros(start).alias("started_at"), end.alias("ended_at"), k.alias("operation_count"))


def listed(spark, sf_dir):
    k = F.col("c_custkey")
    entries = table(spark, sf_dir, "customer").select(k.alias("recording_id"), F.col("c_name").alias("name"), F.timestamp_micros(F.expr("631152000000000 + c_custkey % 40 * 86400000000")).alias("created_at"), pick(STATUSES, k % 5).alias("status"), F.when(k % 3 != 0, k).alias("session_id"))
    first = sessions(spark, sf_dir).groupBy("recording_id").agg(*[F.min_by(c, "o_orderkey").alias(c) for c in ("started_at", "ended_at", "operation_count")])
    return v.list_recordings(entries, first)


LISTED = f"""WITH s AS (SELECT o_custkey AS id, epoch_us(o_orderdate) AS a, {_ENDED.format(k="o_orderkey", a="epoch_us(o_orderdate)")} AS b, o_orderkey AS n FROM orders),
    f AS (SELECT id, a, b, n FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1),
    l AS (SELECT c_custkey AS id, c_name AS name, {_CREATED} AS created_us, {_STATUS} AS status, f.id IS NOT NULL AND c_custkey % 3 <> 0 AS known, a, b, n FROM customer LEFT JOIN f ON f.id = c_custkey),
    r AS (SELECT id, name, created_us, CASE WHEN known THEN CASE WHEN b IS NOT NULL THEN greatest(0, (b - a) // 1000) END END AS duration_ms, known::INT AS sessions, CASE WHEN known THEN n ELSE 0 END AS operations, status FROM l)"""


@query(LISTED + " SELECT id AS recording_id, name, created_us, duration_ms, sessions, operations, status, row_number() OVER (ORDER BY created_us DESC, id DESC) AS place FROM r")
def recordings_newest_first(spark, sf_dir):
    rows = listed(spark, sf_dir).withColumn("created_us", F.unix_micros("created_at")).drop("created_at")
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc("created_us"), F.desc("recording_id"))))


@query(LISTED + """, e AS (SELECT o_custkey AS id, row_number() OVER w - 1 AS ordinal, lead(o_orderkey) OVER w IS NULL AND o_orderstatus = 'O' AS active, o_orderstatus = 'F' AS published FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    g AS (SELECT id, count(*) AS n, min(ordinal) FILTER (active) AS a, count(*) FILTER (published) AS p FROM e GROUP BY 1), t AS (SELECT id, count(*) AS n, sum(n)::BIGINT AS o, CASE WHEN count(*) = count(b) THEN sum(greatest(0, (b - a) // 1000))::BIGINT END AS d FROM s GROUP BY 1),
    x AS (SELECT r.*, CASE status WHEN 'in_progress' THEN 'running' WHEN 'published' THEN 'completed' WHEN 'inconsistent' THEN 'inconsistent' ELSE 'failed' END AS state FROM r WHERE id % 2 = 1)
    SELECT c_custkey AS parent_id, c_name AS name, c_custkey * 1000 AS created_ms, 'completed' AS state, 'user' AS stop_reason, coalesce(g.n, 0) AS epoch_count, g.a AS active_epoch, coalesce(g.p, 0) AS published_epoch_count, coalesce(t.n, 0) AS sessions, coalesce(t.o, 0) AS operations, t.d AS duration_ms, c_mktsegment AS warnings
        FROM customer LEFT JOIN g ON g.id = c_custkey LEFT JOIN t ON t.id = c_custkey WHERE c_custkey % 2 = 0
    UNION ALL SELECT id, name, created_us // 1000, state, NULL, 1, CASE WHEN state = 'running' THEN 0 END, sessions, sessions, operations, duration_ms, '' FROM x""")
def parent_recordings(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    runs = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("parent_id"), F.col("c_name").alias("name"), (F.col("c_custkey") * 1000).alias("created_ms"), F.lit("completed").alias("state"), F.lit("user").alias("stop_reason"), F.array("c_mktsegment").alias("warnings"))
    epochs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent_id"), (F.row_number().over(w) - 1).alias("ordinal"), (F.lead("o_orderkey").over(w).isNull() & (F.col("o_orderstatus") == "O")).alias("active"), (F.col("o_orderstatus") == "F").alias("published"))
    return v.parent_views(listed(spark, sf_dir), runs, epochs, sessions(spark, sf_dir)).withColumn("warnings", F.array_join("warnings", ","))


@query("""WITH x AS (SELECT l_orderkey AS k, 'incomplete_capture' AS r FROM lineitem WHERE l_linenumber = 7 UNION SELECT l_orderkey, 'incomplete_operation' FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2 UNION SELECT l_orderkey, 'missing_recorded_response' FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber = 3
        UNION SELECT l_orderkey, 'warning:late_body' FROM lineitem WHERE l_quantity > 49 UNION SELECT o_orderkey, 'etl_issues' FROM orders WHERE o_orderkey % 40 = 0), g AS (SELECT k, string_agg(r, ',' ORDER BY r) AS b FROM x GROUP BY 1)
    SELECT o_orderkey AS session, coalesce(b, '') AS blockers, b IS NULL AS replayable FROM orders LEFT JOIN g ON k = o_orderkey""")
def inspect_blockers(spark, sf_dir):
    lines, orders, n = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), F.col("l_linenumber")
    state = lambda bad: F.when(bad, "incomplete").otherwise("complete").alias("completeness")
    connections = lines.select(F.col("l_orderkey").alias("session"), state(n == 7))
    warnings = F.array_compact(F.array(F.when(F.col("l_quantity") > 49, "late_body"), F.when(F.col("l_quantity") < 3, "missing_timestamp")))
    operations = lines.select(F.col("l_orderkey").alias("session"), state((F.col("l_returnflag") == "R") & (n == 2)), ((F.col("l_linestatus") != "O") | (n != 3)).alias("has_response"), warnings.alias("warnings"))
    named = orders.select(F.col("o_orderkey").alias("session"))
    return v.replay_blockers(named, connections, operations, named.where("session % 40 = 0"))


#: Sessions that go wrong in each of the fifteen ways, here and there.
STRUCTURE = """WITH s AS (SELECT o_orderkey AS s, CASE WHEN o_orderkey % 97 = 0 THEN 2 ELSE 1 END AS version FROM orders),
    c0 AS (SELECT DISTINCT l_orderkey AS s, l_linenumber % 3 AS c FROM lineitem), c AS (SELECT * FROM c0 UNION ALL SELECT * FROM c0 WHERE s % 89 = 0),
    o AS (SELECT l_orderkey AS s, l_linenumber % 3 AS c, l_partkey * 10 + l_linenumber AS o, CASE WHEN l_partkey % 101 = 0 THEN 2 ELSE 1 END AS v, CASE WHEN l_partkey % 59 = 0 THEN 2 ELSE 1 END AS w, CASE WHEN l_partkey % 103 = 0 THEN -1 ELSE l_orderkey END AS p, l_partkey AS k FROM lineitem),
    sc AS (SELECT s, c FROM c0 WHERE s % 83 <> 0 UNION ALL SELECT s, 9 FROM s WHERE s % 79 = 0), so AS (SELECT DISTINCT s, o FROM o WHERE k % 107 <> 0 UNION ALL SELECT s, -1 FROM s WHERE s % 73 = 0),
    t AS (SELECT s, CASE WHEN k % 53 = 0 THEN (c + 1) % 3 ELSE c END AS c, o FROM o WHERE k % 109 <> 0 UNION ALL SELECT s, c, o FROM o WHERE k % 113 = 0 AND k % 109 <> 0 AND k % 53 <> 0 UNION ALL SELECT s, 0, -2 FROM s WHERE s % 71 = 0 UNION ALL SELECT s, 8, -3 FROM s WHERE s % 67 = 0)"""


@query(STRUCTURE + """, own AS (SELECT s, o, min(c) AS c FROM o GROUP BY 1, 2)
    SELECT s AS session, 'unsupported_schema_version' AS error, version::VARCHAR AS id FROM s WHERE version <> 1
    UNION SELECT s, 'duplicate_connection', c::VARCHAR FROM c GROUP BY s, c HAVING count(*) > 1
    UNION SELECT s, 'missing_connection_completeness', c::VARCHAR FROM c WHERE (s, c) NOT IN (SELECT s, c FROM sc)
    UNION SELECT s, 'unsupported_protocol_data_version', o::VARCHAR FROM o WHERE v <> 1
    UNION SELECT s, 'duplicate_operation', o::VARCHAR FROM o GROUP BY s, o HAVING count(*) > 1
    UNION SELECT s, 'missing_operation_completeness', o::VARCHAR FROM o WHERE (s, o) NOT IN (SELECT s, o FROM so)
    UNION SELECT s, 'completion_owner_missing_range', o::VARCHAR FROM o WHERE w <> 1
    UNION SELECT s, 'operation_range_parent_mismatch', o::VARCHAR FROM o WHERE p <> s
    UNION SELECT s, 'unknown_connection_completeness', c::VARCHAR FROM sc WHERE (s, c) NOT IN (SELECT s, c FROM c)
    UNION SELECT s, 'unknown_operation_completeness', o::VARCHAR FROM so WHERE (s, o) NOT IN (SELECT s, o FROM o)
    UNION SELECT s, 'timeline_unknown_connection', c::VARCHAR FROM t WHERE (s, c) NOT IN (SELECT s, c FROM c)
    UNION SELECT s, 'timeline_unknown_operation', o::VARCHAR FROM t WHERE (s, o) NOT IN (SELECT s, o FROM o)
    UNION SELECT t.s, 'timeline_connection_mismatch', t.o::VARCHAR FROM t JOIN own USING (s, o) WHERE t.c <> own.c
    UNION SELECT s, 'duplicate_timeline_operation', o::VARCHAR FROM t GROUP BY s, o HAVING count(*) > 1
    UNION SELECT s, 'missing_timeline_operation', o::VARCHAR FROM o WHERE (s, o) NOT IN (SELECT s, o FROM t)""")
def session_structure(spark, sf_dir):
    session, k = F.col("l_orderkey").alias("session"), F.col("l_partkey")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    named = orders.select(F.col("o_orderkey").alias("session"), F.expr("if(o_orderkey % 97 = 0, 2, 1)").alias("version"), F.col("o_orderkey").alias("recording"))
    one = lines.select(session, F.expr("l_linenumber % 3").alias("connection")).distinct()
    # the first connection of an operation that stands in several counts as its own
    raw = lines.select(session, F.expr("l_linenumber % 3").alias("connection"), (k * 10 + F.col("l_linenumber")).alias("operation"), F.expr("if(l_partkey % 101 = 0, 2, 1)").alias("data_version"), F.expr("if(l_partkey % 59 = 0, 2, 1)").alias("owner"), F.array(F.struct(F.lit(1).alias("epoch"), F.expr("if(l_partkey % 103 = 0, -1, l_orderkey)").alias("parent"))).alias("ranges"), k.alias("k"))
    states = one.where("session % 83 <> 0").select("session", F.lit("connection").alias("kind"), F.col("connection").cast("long").alias("id"))
    states = states.union(named.where("session % 79 = 0").select("session", F.lit("connection"), F.lit(9).cast("long"))).union(raw.where("k % 107 <> 0").select("session", F.lit("operation"), "operation").distinct()).union(named.where("session % 73 = 0").select("session", F.lit("operation"), F.lit(-1).cast("long")))
    times = raw.where("k % 109 <> 0").select("session", F.expr("if(k % 53 = 0, (connection + 1) % 3, connection)").alias("connection"), "operation")
    times = times.union(raw.where("k % 113 = 0 and k % 109 <> 0 and k % 53 <> 0").select("session", "connection", "operation"))
    for m, c, o in ((71, 0, -2), (67, 8, -3)):
        times = times.union(named.where(f"session % {m} = 0").select("session", F.lit(c), F.lit(o).cast("long")))
    return v.structure_errors(named, one.union(one.where("session % 89 = 0")), raw.drop("k"), states, times)


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS k, l_linenumber AS n FROM lineitem), r AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'unsupported' WHEN k % 7 = 0 THEN 'incomplete' ELSE 'complete' END AS completion,
        CASE WHEN k % 3 = 0 THEN '{"parent":' || s || ',"epoch":4,"ordinal":2,"first":10,"last":90}' WHEN k % 3 = 1 THEN '{"parent":' || s || ',"epoch":3,"ordinal":1,"first":1,"last":9},{"parent":' || s || ',"epoch":4,"ordinal":2,"first":10,"last":90}' ELSE '{"parent":' || s || ',"epoch":4,"ordinal":2,"first":10,"last":90}' END AS j FROM o)
    SELECT s AS session, n::BIGINT AS position, sha256(concat_ws('|', k::VARCHAR, n::VARCHAR, '[' || j || ']', '4', completion)) AS operation FROM r""")
def provenance_stamps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("connection"), F.col("l_linenumber").cast("long").alias("position")).distinct().withColumn("operation", F.concat_ws("/", F.col("connection").cast("string"), F.col("position").cast("string")))
    one = lambda epoch, ordinal, a, b: F.struct(F.col("session").alias("parent"), F.lit(epoch).alias("epoch"), F.lit(ordinal).alias("ordinal"), F.lit(a).alias("first"), F.lit(b).alias("last"))
    none = F.array().cast("array<struct<parent:bigint,epoch:int,ordinal:int,first:int,last:int>>")
    rows = rows.withColumn("ranges", F.when(F.col("connection") % 3 == 0, F.array(one(4, 2, 10, 90))).when(F.col("connection") % 3 == 1, F.array(one(3, 1, 1, 9))).otherwise(none))
    rows = rows.withColumn("completeness", F.when(F.col("connection") % 5 == 0, "unsupported").when(F.col("connection") % 7 == 0, "orphan").otherwise("complete"))
    return v.stamp_provenance(rows, rows.select("session", "position", "operation"), F.col("session"), F.lit(4), F.lit(2), F.lit(10), F.lit(90))[1]


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_custkey % 6 = 0 THEN 'unsupported' WHEN o_orderstatus <> 'P' AND o_custkey % 10 = 1 THEN 'execution_not_authorized'
    WHEN o_orderkey % 5 = 0 AND o_custkey % 2 = 0 THEN 'effect_not_allowed:authentication' WHEN o_custkey % 9 = 0 THEN 'missing_target' WHEN o_custkey % 9 = 1 THEN 'recorded_destination' WHEN o_orderpriority = '1-URGENT' THEN 'allowed' ELSE 'effect_not_allowed:' || o_orderpriority END AS decision FROM orders""")
def replay_decisions(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    state = lambda bad: F.when(bad, "incomplete").otherwise("complete")
    attributes = F.create_map(F.lit("replayable"), F.when(k % 13 == 0, "false").otherwise("true"), F.lit("requires_runtime_authorization"), F.when(k % 5 == 0, "true").otherwise("false"))
    target = F.when(c % 9 != 0, F.when(c % 9 == 1, "10.0.0.1:80").otherwise("10.0.0.2:80"))
    policy = F.create_map(F.lit("1-URGENT"), F.lit(True), F.lit("2-HIGH"), F.lit(False))
    decision = v.replay_decision(k % 23 == 0, state(k % 7 == 0), state(k % 11 == 0), F.lit("complete"), c % 6 != 0, attributes, F.when(F.col("o_orderstatus") == "P", "raw").otherwise("http/1.1"), target, F.lit("10.0.0.1:80"), policy, F.col("o_orderpriority"), c % 10 != 1, c % 2 != 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", decision.alias("decision"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey % 3 = 0 AS d, o_orderkey % 4 <> 0 AS a, o_orderkey % 5 AS s, CASE WHEN o_orderkey % 7 < 5 THEN ['passed', 'failed', 'skipped', 'inconclusive', 'unsupported'][o_orderkey % 7 + 1] WHEN o_orderkey % 7 = 5 THEN 'not_run' END AS v FROM orders)
    SELECT o_custkey, count(*) FILTER (d) AS executable, count(*) FILTER (NOT d) AS non_executable, count(*) FILTER (a) AS attempted, count(*) FILTER (s = 0) AS completed, count(*) FILTER (s = 1) AS failed, count(*) FILTER (s > 1) AS unattempted,
    """ + ", ".join(f"count(*) FILTER (v = '{n}') AS verification_{n}" for n in v.VERIFICATIONS) + ", count(*) FILTER (v IS NULL OR v = 'not_run') AS verification_not_run FROM x GROUP BY 1")
def replay_counters(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("decision", F.when(k % 3 == 0, "allowed").otherwise("unsupported")).withColumn("attempted", k % 4 != 0)
    rows = rows.withColumn("state", F.when(k % 5 == 0, "completed").when(k % 5 == 1, "failed").otherwise("not_attempted")).withColumn("verification", F.when(k % 7 < 5, pick(v.VERIFICATIONS, F.least(k % 7, F.lit(4)))).when(k % 7 == 5, "not_run"))
    return v.replay_counters(rows, ["o_custkey"], "decision", "attempted", "state", "verification")


MESSAGES = ("bad transfer encoding in upgrade", "close-delimited body", "informational reply", "request target is absolute", "CONNECT refused", "upgrade of version", "version 9", "no header end")


@query("""SELECT event_id, ['unsupported_transfer_encoding', 'unsupported_close_delimited_body', 'unsupported_informational_response', 'unsupported_target', 'unsupported_target', 'unsupported_upgrade', 'unsupported_version', 'malformed'][event_id % 8 + 1] AS warning,
    ['recovery_failure', 'recovery_failure', 'quota_pressure', 'appendable_failure', 'capture_attach_failure', 'etl_resume_failure', 'storage_failure', 'storage_failure', NULL][event_id % 9 + 1] AS code FROM events""")
def error_codes(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select("event_id", v.warning_code(pick(MESSAGES, F.col("event_id") % 8)).alias("warning"), v.failure_code(pick((*v.FAILURE_CODES, "other"), F.col("event_id") % 9)).alias("code"))


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 4 <> 0 AND event_id % 5 <> 0 THEN (json_extract(props, '$.k'))::BIGINT END AS k, CASE WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN 'unsupported_version' WHEN event_id % 5 = 0 THEN 'malformed' END AS error FROM events""")
def protocol_versions(spark, sf_dir):
    n = F.col("event_id")
    text = F.when(n % 5 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    data, error = v.protocol_data(F.when(n % 3 == 0, 2).otherwise(1), F.when(n % 4 != 0, "application/json"), text, "application/json", "k bigint")
    return events(spark, sf_dir).select("event_id", data["k"].alias("k"), error.alias("error"))


@query("""WITH e AS (SELECT o_custkey AS parent, o_orderkey AS epoch, row_number() OVER w AS ordinal, lead(o_orderkey) OVER w IS NULL AS active FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT parent, epoch, ordinal, CASE WHEN epoch % 7 <> 0 THEN -epoch END AS session, CASE WHEN epoch % 7 <> 0 THEN 'selected' WHEN active THEN 'active_tail_omitted' ELSE 'missing_session' END AS verdict FROM e""")
def parent_replay_plan(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    epochs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("epoch"), F.row_number().over(w).alias("ordinal"), F.lead("o_orderkey").over(w).isNull().alias("active"))
    return v.replay_plan(epochs, epochs.where("epoch % 7 <> 0").withColumn("session", -F.col("epoch")))


@query("""SELECT user_id, event_id AS sequence, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 9 = 0 THEN '' ELSE 'b' || (event_id % 2)::VARCHAR END, CASE WHEN event_id % 9 = 0 THEN 9223372036854775807 ELSE -epoch_us(ts) END, event_id) AS place FROM events""")
def frame_order(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.col("event_id").alias("sequence"), "us")
    seen = rows.where("sequence % 9 <> 0").withColumn("boot", F.concat(F.lit("b"), (F.col("sequence") % 2).cast("string"))).withColumn("ns", -F.col("us"))
    return v.frames_by_time(rows.drop("us"), seen, ["user_id"])


@query("""WITH c AS (SELECT l_suppkey, l_orderkey, min(l_linenumber) AS first_sequence, bool_or(l_linestatus = 'O') AS active FROM lineitem GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY active DESC, first_sequence, l_orderkey) AS place FROM c""")
def stream_order(spark, sf_dir):
    return v.streams_by_first(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", "l_linenumber", F.col("l_linestatus") == "O")


@query("""SELECT doc_id AS session, CASE WHEN doc_id % 4 = 0 OR text IS NULL THEN 'missing_manifest' WHEN doc_id % 5 = 0 THEN 'checksum_mismatch' WHEN doc_id % 9 = 0 THEN 'unsupported_version' ELSE 'ok' END AS verdict FROM documents""")
def manifest_check(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session"), F.col("text").alias("content"), F.expr("if(doc_id % 9 = 0, 2, 1)").alias("version"))
    right = F.sha2(F.col("content").cast("binary"), 256)
    manifests = stored.where("session % 4 <> 0").select("session", F.when(F.col("session") % 5 == 0, F.concat(right, F.lit("0"))).otherwise(right).alias("checksum"))
    return v.session_check(stored, manifests)


@query("""WITH f AS (SELECT o_orderkey AS session FROM orders ORDER BY 1 LIMIT 50), n AS (SELECT l_orderkey AS session, count(*) AS o, count(*) FILTER (l_returnflag = 'R') AS p FROM lineitem GROUP BY 1)
    SELECT session, coalesce(o, 0) AS operation_count, coalesce(p, 0) AS payload_count FROM f LEFT JOIN n USING (session)""")
def session_summaries(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "session")
    return v.session_summaries(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "session"), lines, lines.where("l_returnflag = 'R'"), 50)


@query("""SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 6 = 0 OR text IS NULL THEN 'missing' WHEN doc_id % 7 = 0 THEN 'size_mismatch' ELSE 'present' END AS verdict FROM documents""")
def artifact_presence(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.octet_length("text").alias("bytes"), "doc_id")
    return v.artifact_presence(named.drop("doc_id"), named.where("doc_id % 6 <> 0").select("key", F.expr("if(doc_id % 7 = 0, bytes + 1, bytes)").alias("bytes")))


@query("SELECT count(*) AS entries, sum(octet_length(encode(c_name)))::BIGINT AS bytes, count(*) <= 100 AND sum(octet_length(encode(c_name))) <= 16777216 AS fits FROM customer")
def catalog_bounds(spark, sf_dir):
    return v.catalog_bounds(table(spark, sf_dir, "customer"), F.col("c_name"), 100, 16 << 20)
