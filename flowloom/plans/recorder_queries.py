"""Queries of a recorder's decisions: events stand for polls, records and evidence, orders for runs and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import text
from flowloom.operators import recorder as r
from flowloom.operators.recordings import stop_reason
from flowloom.plans.catalog import query, table
from flowloom.plans.log_queries import SQL_SIZE, events

POLICIES = ("source_completion", "explicit_stop", "deadline", "any_terminal_condition")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'fatal' WHEN o_custkey % 6 = 0 THEN 'user' WHEN o_orderstatus = 'F' AND o_custkey % 5 <> 0 AND o_orderkey % 4 IN (0, 3) THEN 'source_completed'
    WHEN o_orderstatus <> 'O' AND o_orderkey % 4 IN (2, 3) THEN 'deadline' END AS stop FROM orders""")
def stop_policies(spark, sf_dir):
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    policy = F.element_at(F.array(*map(F.lit, POLICIES)), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k, stop_reason(k % 9 == 0, c % 6 == 0, s == "F", s != "O", c % 5 == 0, policy).alias("stop"))


@query(f"""WITH p AS (SELECT event_id, event_id % 1000 AS now, CASE WHEN user_id % 9 <> 0 THEN user_id % 500 END AS started, 64 + {SQL_SIZE} % 5 AS bytes, event_id % 3 AS pending, event_id % 1000 - event_id % 25 AS sync FROM events),
    o AS (SELECT *, coalesce(bytes > 64 AND now - started >= 300, false) AS rotate FROM p) SELECT event_id, pending > 0 AND (rotate OR now - sync >= 10) AS commit, rotate FROM o""")
def segment_polls(spark, sf_dir):
    n, u = F.col("event_id"), F.col("user_id")
    poll = r.segment_poll(n % 1000, F.when(u % 9 != 0, u % 500), 64 + F.col("size") % 5, n % 3, n % 1000 - n % 25, 300)
    return events(spark, sf_dir).select("event_id", poll.alias("p")).select("event_id", "p.commit", "p.rotate")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events), s AS (SELECT user_id, min(us) AS us, 0 AS n FROM e GROUP BY 1
    UNION ALL SELECT s.user_id, min(e.us), s.n + 1 FROM s JOIN e ON e.user_id = s.user_id AND e.us >= s.us + 86400000000 GROUP BY s.user_id, s.n) SELECT user_id, us FROM s WHERE n > 0""")
def loss_samples(spark, sf_dir):
    polls = events(spark, sf_dir)
    began = polls.groupBy("user_id").agg(F.min("us").alias("attached"))
    return r.due_samples(polls.join(began, "user_id"), "user_id", "us", "attached", 86_400_000_000)


@query(f"""SELECT user_id, (sum({SQL_SIZE} + 48) + 64 + 48 + 76)::BIGINT AS bytes, CASE WHEN user_id % 7 = 0 THEN 'destination_exists' WHEN sum({SQL_SIZE} + 48) + 188 > 10000 * (user_id % 40) THEN 'too_large' ELSE 'fits' END AS verdict FROM events GROUP BY 1""")
def capture_preflight(spark, sf_dir):
    return r.capture_fits(events(spark, sf_dir), ["user_id"], "size", 10000 * (F.col("user_id") % 40), F.col("user_id") % 7 == 0)


@query("""SELECT event_id, CASE WHEN event_id = min(event_id) OVER w THEN 'cached' WHEN event_type IS NOT DISTINCT FROM arg_min(event_type, event_id) OVER w THEN 'refreshed' ELSE 'conflict' END AS verdict FROM events WINDOW w AS (PARTITION BY user_id)""")
def evidence_cache(spark, sf_dir):
    return r.evidence_cache(events(spark, sf_dir), ["user_id"], "event_id", ["event_type"]).select("event_id", "verdict")


@query("""WITH i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 19 <> 0 THEN CASE WHEN o_orderkey % 17 = 0 THEN 'short' ELSE sha256(o_custkey::VARCHAR) END END AS d, CASE WHEN o_orderkey % 13 = 0 THEN '../x' ELSE 'run-' || o_orderkey END AS t FROM orders),
    p AS (SELECT *, CASE WHEN k % 4 IN (0, 3) THEN CASE WHEN k % 5 = 0 THEN 'other' ELSE d END END AS s, CASE WHEN k % 4 = 1 OR k % 12 = 3 THEN CASE WHEN k % 5 = 0 THEN 'other' ELSE d END END AS x, CASE WHEN k % 3 = 0 THEN d WHEN k % 3 = 1 THEN 'other' END AS b FROM i)
    SELECT k AS o_orderkey, CASE WHEN k % 23 = 0 THEN 'production_disabled' WHEN d IS NULL THEN 'missing_intent' WHEN d = 'short' OR k % 13 = 0 THEN 'invalid_intent' WHEN k % 11 = 0 THEN 'unsafe_path' WHEN s IS NOT NULL AND x IS NOT NULL THEN 'invalid_intent'
        WHEN s IS NULL AND x IS NULL THEN CASE WHEN b IS NULL THEN 'missing_artifact' WHEN b = d THEN 'forget_intent' ELSE 'invalid_intent' END WHEN coalesce(s, x) <> d THEN 'digest_mismatch' WHEN s IS NOT NULL THEN 'move_and_delete' ELSE 'delete' END AS step FROM p""")
def cleanup_recovery(spark, sf_dir):
    k = F.col("o_orderkey")
    digest = F.when(k % 19 != 0, F.when(k % 17 == 0, "short").otherwise(F.sha2(F.col("o_custkey").cast("string"), 256)))
    found = F.when(k % 5 == 0, "other").otherwise(digest)
    transaction = F.when(k % 13 == 0, "../x").otherwise(F.concat(F.lit("run-"), k))
    tombstone = F.when(k % 3 == 0, digest).when(k % 3 == 1, "other")
    step = r.cleanup_recovery(k % 23 != 0, transaction, digest, k % 11 != 0, F.when((k % 4).isin(0, 3), found), F.when((k % 4 == 1) | (k % 12 == 3), found), tombstone)
    return table(spark, sf_dir, "orders").select(k, step.alias("step"))


#: IPv6 addresses as a socket table and as a reader has them.
SIX = (
    ("00000000000000000000000001000000", "::1"),
    ("00000000000000000000000000000000", "::"),
    ("B80D0120000000000000000001000000", "2001:db8::1"),
    ("0000000000000000FFFF00000100007F", "::ffff:127.0.0.1"),
    ("000080FE00000000FF005450A1B2C3D4", "fe80::5054:ff:d4c3:b2a1"),
    ("0000010000000200030000000400FF0A", "1:0:2::3:aff:4"),
)


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 256) || '.' || (o_custkey // 256 % 256) || '.0.10' ELSE {[a for _, a in SIX]}[o_custkey % 6 + 1] END AS address, (o_custkey % 65536)::INTEGER AS port, o_orderkey + 7 AS inode FROM orders WHERE o_orderkey % 3 <> 0""")
def listener_tables(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    six = F.element_at(F.array(*[F.lit(raw) for raw, _ in SIX]), (c % 6 + 1).cast("int"))
    local = F.when(k % 2 == 0, F.format_string("0A00%02X%02X", F.expr("o_custkey div 256 % 256"), c % 256)).otherwise(six)
    line = F.format_string("%4d: %s:%04X 00000000:0000 %s 00000000:00000000 00:00000000 00000000 0 0 %d 1", k, local, c % 65536, F.when(k % 3 == 0, "01").otherwise("0A"), k + 7)
    return table(spark, sf_dir, "orders").select(k, text.listener(line).alias("l")).where("l is not null").select("o_orderkey", "l.*")
