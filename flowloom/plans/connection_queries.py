"""Queries of the connection operators, over events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import connections as c
from flowloom.plans.catalog import query, table
from flowloom.plans.log_queries import SQL_SIZE, events

HOUR = 3_600_000_000


@query("""SELECT user_id, event_type, count(*) AS events, min(event_id) AS first_sequence, max(event_id) AS last_sequence, min(epoch_us(ts)) AS first_ns, max(epoch_us(ts)) AS last_ns FROM events GROUP BY 1, 2""")
def conn_span(spark, sf_dir):
    return c.connection_spans(events(spark, sf_dir), ["user_id"], "event_id", ["event_type"], "us")


@query("""WITH e AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
    s AS (SELECT *, (sum(CASE WHEN p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS session FROM e)
    SELECT user_id, session, count(*) AS events, min(event_id) AS first_sequence, max(event_id) AS last_sequence, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration_us FROM s GROUP BY 1, 2""")
def idle_sessions(spark, sf_dir):
    s = c.idle_sessions(events(spark, sf_dir), ["user_id"], [], "event_id", F.col("us"), 6 * HOUR)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_sequence"), F.max("event_id").alias("last_sequence"), (F.max("us") - F.min("us")).alias("duration_us"))


@query(f"""SELECT event_id, count(*) OVER w AS chunks, (sum({SQL_SIZE}) OVER w)::BIGINT AS bytes, (sum({SQL_SIZE}) OVER w > 100000 OR count(*) OVER w > 30) AS "over"
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def running_limits(spark, sf_dir):
    return c.running_limits(events(spark, sf_dir), ["user_id"], "event_id", "size", 100_000, 30).select("event_id", "chunks", "bytes", "over")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {SQL_SIZE} AS z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    r AS (SELECT user_id, event_id, i, CASE WHEN z > 60000 THEN 0 ELSE z END AS b, CASE WHEN z > 60000 THEN 0 ELSE 1 END AS c, 0::BIGINT AS incarnation, z <= 60000 AS kept, CASE WHEN z > 60000 THEN 1 ELSE 0 END::BIGINT AS nxt FROM e WHERE i = 1
        UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN r.b + e.z > 60000 OR r.c + 1 > 12 THEN 0 ELSE r.b + e.z END, CASE WHEN r.b + e.z > 60000 OR r.c + 1 > 12 THEN 0 ELSE r.c + 1 END, r.nxt,
            NOT (r.b + e.z > 60000 OR r.c + 1 > 12), r.nxt + CASE WHEN r.b + e.z > 60000 OR r.c + 1 > 12 THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, event_id, incarnation, kept FROM r""")
def split_at_limits(spark, sf_dir):
    return c.split_at_limits(events(spark, sf_dir), ["user_id"], "event_id", "size", 60_000, 12)


@query(f"""WITH e AS (SELECT user_id, event_id, {SQL_SIZE} // 10000 AS t, event_id // 5000 AS g, lag({SQL_SIZE} // 10000) OVER w AS lt, lag(event_id // 5000) OVER w AS lg, lag(event_id) OVER w AS le
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, le AS window_start, event_id AS window_end, CASE WHEN le IS NULL THEN t WHEN lg <> g OR t < lt THEN NULL ELSE t - lt END AS drop_delta,
    CASE WHEN le IS NULL THEN 'first' WHEN lg <> g OR t < lt THEN 'unknown' ELSE 'grown' END AS kind FROM e WHERE CASE WHEN le IS NULL THEN t > 0 ELSE lg <> g OR t <> lt END""")
def counter_deltas(spark, sf_dir):
    samples = events(spark, sf_dir).withColumn("total", F.expr("size div 10000")).withColumn("generation", F.expr("event_id div 5000")).withColumn("clock", F.lit("boot"))
    return c.counter_windows(samples, ["user_id"], "event_id", "total", "generation", "clock")


@query("""WITH s AS (SELECT DISTINCT user_id, (event_id * 2654435761) % 4294967296 AS s FROM events),
    g AS (SELECT user_id, s, coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY s), last_value(s) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b, count(*) OVER (PARTITION BY user_id) AS n FROM s),
    x AS (SELECT user_id, s, b, CASE WHEN n = 1 THEN 4294967296 ELSE (s - b + 4294967296) % 4294967296 END AS gap FROM g)
    SELECT user_id, CASE WHEN gap <> 2147483648 THEN s END AS start, gap::BIGINT AS largest_gap, gap = 2147483648 AS ambiguous FROM x QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, b) = 1""")
def tcp_circular_start(spark, sf_dir):
    return c.circular_start(events(spark, sf_dir).withColumn("s", F.expr("(event_id * 2654435761) % 4294967296")), ["user_id"], "s")


@query("""WITH s AS (SELECT user_id, event_id, (event_id * 2654435761) % 4294967296 AS s FROM events), d AS (SELECT DISTINCT user_id, s FROM s),
    g AS (SELECT user_id, s, coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY s), last_value(s) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b, count(*) OVER (PARTITION BY user_id) AS n FROM d),
    x AS (SELECT user_id, s AS start FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN n = 1 THEN 4294967296 ELSE (s - b + 4294967296) % 4294967296 END DESC, b) = 1)
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY (s - start + 4294967296) % 4294967296, event_id) AS position FROM s JOIN x USING (user_id)""")
def tcp_order(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("s", F.expr("(event_id * 2654435761) % 4294967296"))
    return c.tcp_order(rows, ["user_id"], c.circular_start(rows, ["user_id"], "s"), "s", ["event_id"]).select("event_id", "position")


@query("""SELECT l_partkey, l_quantity, min(l_orderkey * 10 + l_linenumber) AS kept FROM lineitem GROUP BY 1, 2""")
def retransmit_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("kept", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return c.drop_retransmissions(rows, ["l_partkey", "l_quantity"], ["kept"]).select("l_partkey", "l_quantity", "kept")


@query("""SELECT l_orderkey, bool_or(b) AS ambiguous FROM (SELECT l_orderkey, l_linenumber, count(*) > 1 AND bool_or(l_returnflag = 'R') AS b FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def ambiguous_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("wal", F.when(F.col("l_returnflag") != "R", F.col("l_partkey")))
    return c.ambiguous_positions(rows, ["l_orderkey"], ["l_linenumber"], "wal")


@query("""WITH r AS (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM lineitem)
    SELECT l_suppkey, l_orderkey, l_linenumber, coalesce(l_orderkey > lag(l_orderkey + l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber), false) AS gap_before FROM r""")
def frame_gap_before(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber").distinct()
    return c.gap_before(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber"], "l_orderkey", F.col("l_linenumber"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS p, (l_linenumber::BIGINT * 1000000000 + l_partkey) % 4294967296 AS s, l_quantity::BIGINT // 10 * 200000000 AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3))
    SELECT a.l_orderkey, a.p AS first, b.p AS second, CASE WHEN a.s = b.s THEN 'conflicting' ELSE 'partial' END AS kind FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.p < b.p
    WHERE a.n > 0 AND b.n > 0 AND ((b.s - a.s + 4294967296) % 4294967296 < a.n OR (a.s - b.s + 4294967296) % 4294967296 < b.n)""")
def range_overlaps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    rows = rows.select("l_orderkey", F.expr("l_partkey * 10 + l_linenumber").alias("p"), F.expr("(l_linenumber * 1000000000L + l_partkey) % 4294967296").alias("s"), F.expr("cast(q as long) div 10 * 200000000").alias("n"))
    return c.overlaps(rows, ["l_orderkey"], "p", "s", "n")


#: A loss window from every event; some end on another clock, some are of unknown size.
LOSSES = """SELECT event_type AS clock, CASE WHEN event_id % 11 = 0 THEN 'other' ELSE event_type END AS clock2, epoch_us(ts) AS s, epoch_us(ts) + event_id % 50 * 3600000000 AS t,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS d, CASE event_id % 4 WHEN 0 THEN 'counter regressed' WHEN 1 THEN 'new generation' WHEN 2 THEN 'unreadable' END AS reason FROM events"""


def losses(spark, sf_dir):
    reason = F.when(F.col("event_id") % 4 == 0, "counter regressed").when(F.col("event_id") % 4 == 1, "new generation").when(F.col("event_id") % 4 == 2, "unreadable")
    end_clock = F.when(F.col("event_id") % 11 == 0, "other").otherwise(F.col("event_type"))
    return events(spark, sf_dir).select(F.col("event_type").alias("clock"), end_clock.alias("end_clock"), F.col("us").alias("start_ns"), F.expr(f"us + event_id % 50 * {HOUR}").alias("end_ns"), F.expr("if(event_id % 3 = 0, null, event_id)").alias("drop_delta"), reason.alias("reason"))


@query(f"""WITH w AS ({LOSSES}), p AS (SELECT user_id, event_type AS clock, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM events),
    x AS (SELECT u.user_id, CASE WHEN w.clock <> clock2 THEN 'clock_mismatch' WHEN d IS NULL AND (contains(reason, 'generation') OR contains(reason, 'regressed')) THEN 'reset' WHEN d IS NULL THEN 'unknown'
        WHEN p.clock IS NULL THEN 'clock_mismatch' WHEN t < a OR s > b THEN 'outside' ELSE 'overlaps' END AS k, count(*) AS n FROM u CROSS JOIN w LEFT JOIN p ON p.user_id = u.user_id AND p.clock = w.clock GROUP BY 1, 2)
    SELECT user_id, """ + ", ".join(f"coalesce(sum(n) FILTER (k = '{k}'), 0)::BIGINT AS {k}" for k in ("overlaps", "outside", "unknown", "reset", "clock_mismatch")) + " FROM x GROUP BY 1")
def interval_loss_join(spark, sf_dir):
    spans = c.connection_spans(events(spark, sf_dir).withColumnRenamed("event_type", "clock"), ["user_id"], "event_id", ["clock"], "us")
    return c.classify_losses(spans, losses(spark, sf_dir), ["user_id"], 240 * HOUR)


@query(f"""WITH w AS (SELECT * FROM ({LOSSES}) WHERE clock = 'click') SELECT DISTINCT user_id FROM events e WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM w WHERE epoch_us(e.ts) BETWEEN s AND t)""")
def point_in_interval_semi(spark, sf_dir):
    clicks = events(spark, sf_dir).where("event_type = 'click'")
    return c.affected_by_terminal_loss(clicks, losses(spark, sf_dir).where("clock = 'click'"), ["user_id"], "event_type", "us", 24 * HOUR)


@query("""WITH f AS (SELECT user_id, min(event_id) AS f, min_by(props, event_id) AS p FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT event_id, CASE WHEN f < event_id THEN p END AS evidence_props FROM events LEFT JOIN f USING (user_id) WHERE event_type <> 'signup'""")
def asof_first_evidence(spark, sf_dir):
    rows = events(spark, sf_dir)
    return c.first_evidence(rows.where("event_type <> 'signup'"), rows.where("event_type = 'signup'"), ["user_id"], "event_id", ["props"]).select("event_id", "evidence_props")


@query("""SELECT e.event_id, p.props AS intent_props FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.event_id >= p.event_id""")
def asof_latest_intent(spark, sf_dir):
    rows = events(spark, sf_dir)
    return c.latest_before(rows.where("event_type = 'purchase'"), rows.where("event_type = 'view'"), ["user_id"], "event_id", ["props"]).select("event_id", "intent_props")


@query("""SELECT user_id, count(DISTINCT (event_type, event_id % 2)) AS versions FROM events GROUP BY 1 HAVING count(DISTINCT (event_type, event_id % 2)) > 1""")
def evidence_conflicts(spark, sf_dir):
    return c.evidence_conflicts(events(spark, sf_dir).withColumn("half", F.col("event_id") % 2), ["user_id"], ["event_type", "half"])


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey)""")
def missing_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id")
    return c.missing_evidence(rows, events(spark, sf_dir), ["user_id"]).select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_custkey ELSE o_orderkey END AS client, CASE WHEN o_orderstatus = 'O' THEN o_orderkey ELSE o_custkey END AS server,
    CASE WHEN (o_orderstatus = 'O') = (o_orderkey % 2 = 0) THEN 'client_to_server' ELSE 'server_to_client' END AS direction FROM orders""")
def orientation(spark, sf_dir):
    role, flow = F.when(F.col("o_orderstatus") == "O", "active").otherwise("passive"), F.when(F.col("o_orderkey") % 2 == 0, "egress").otherwise("ingress")
    client, server = c.endpoints(role, F.col("o_custkey"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", client.alias("client"), server.alias("server"), c.direction(role, flow).alias("direction"))


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'unknown' WHEN bool_or(l_returnflag = 'A') THEN 'reset' WHEN bool_or(l_linestatus = 'F') THEN 'clean_close' ELSE 'unknown' END AS termination FROM lineitem GROUP BY 1""")
def termination(spark, sf_dir):
    return c.termination(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", F.col("l_linestatus") == "F")


@query(f"""WITH e AS (SELECT event_type AS clock, CASE WHEN event_id % 11 <> 0 THEN epoch_us(ts) END AS n, {SQL_SIZE} AS z FROM events),
    t AS (SELECT clock, min(n) AS start_ns, max(n) AS end_ns, count(*) AS records, sum(z)::BIGINT AS bytes FROM e WHERE n IS NOT NULL GROUP BY 1)
    SELECT * FROM t UNION ALL SELECT NULL, NULL, (SELECT CASE WHEN count(*) = 1 THEN max(end_ns) END FROM t), count(*), sum(z)::BIGINT FROM e WHERE n IS NULL HAVING count(*) > 0""")
def terminal_loss_by_clock(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_type").alias("clock"), F.expr("if(event_id % 11 <> 0, us, null)").alias("ns"), "size")
    return c.terminal_loss_summary(rows, "clock", "ns", F.col("size"))
