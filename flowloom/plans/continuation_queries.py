"""Queries of state that epochs hand on: users stand for snapshots, their events for connections and journal entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import continuation as c
from flowloom.plans.catalog import query, table
from flowloom.plans.log_queries import events, mark


@query("""WITH k AS (SELECT user_id, event_id // (user_id % 3 * 2 + 1) AS i, count(*) FILTER (event_type <> 'signup') AS a, count(*) FILTER (event_type = 'signup') AS d FROM events GROUP BY 1, 2),
    s AS (SELECT user_id, sum(a)::BIGINT AS a, sum(d)::BIGINT AS d, bool_or(a > 1) AS t, bool_or(a + d > 1) AS g FROM k GROUP BY 1)
    SELECT user_id, a + d AS connections, CASE WHEN user_id % 7 = 0 THEN 'unsupported_version' WHEN user_id % 5 = 0 THEN 'limit_mismatch' WHEN a > 60 THEN 'bounds' WHEN t THEN 'duplicate_connection' WHEN d > 60 THEN 'bounds' WHEN g THEN 'duplicate_connection' ELSE 'restored' END AS verdict FROM s""")
def restore_snapshots(spark, sf_dir):
    limits = {"max_active": 60, "max_bytes": 1 << 20, "max_chunks": 64, "idle_ns": 10**9}
    u = F.col("user_id")
    rows = events(spark, sf_dir).select(u, F.expr("event_id div (user_id % 3 * 2 + 1)").alias("identity"), mark().alias("finalized"))
    stated = [F.lit(v).alias(k) for k, v in limits.items() if k != "idle_ns"]
    snapshots = rows.select("user_id").distinct().select(u, F.when(u % 7 == 0, 2).otherwise(1).alias("version"), *stated, F.when(u % 5 != 0, F.lit(limits["idle_ns"])).alias("idle_ns"))
    return c.restore_verdict(snapshots, rows, limits, "user_id", "identity", "finalized")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_custkey <> o_custkey - o_orderkey % 3 THEN 'catch_up' WHEN o_orderkey % 5 = 0 THEN 'digest_mismatch' ELSE 'export' END AS step, o_orderkey % 6 AS connections,
    0 AS generations, 0 AS partial_frame_bytes, 0 AS correlations, 0 AS loss_windows, 0 AS issues, 0 AS segments FROM orders""")
def continuation_exports(spark, sf_dir):
    k, marker = F.col("o_orderkey"), F.col("o_custkey")
    step = c.export_step(F.when(k % 4 != 0, marker - k % 3), F.when(k % 5 == 0, "old").otherwise("new"), marker, F.lit("new"))
    return table(spark, sf_dir, "orders").select(k, step.alias("step"), *c.exported_counts(k % 6))


@query("""WITH RECURSIVE j AS (SELECT user_id AS u, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type IN ('click', 'purchase') THEN 'consumed' WHEN event_type = 'view' THEN 'ready' WHEN event_type = 'signup' THEN 'pending' WHEN event_id % 2 = 0 THEN 'failed' ELSE 'unavailable' END AS s, event_id % 4 AS d FROM events),
    f AS (SELECT DISTINCT u, 0::BIGINT AS n, NULL::BIGINT AS id, 'pending' AS st, NULL::BIGINT AS dg, NULL::VARCHAR AS verdict FROM j
        UNION ALL SELECT j.u, j.n, j.id, CASE WHEN st = 'pending' AND s IN ('ready', 'failed', 'unavailable') OR st = 'ready' AND s = 'consumed' AND dg = d THEN s ELSE st END, CASE WHEN st = 'pending' AND s = 'ready' THEN d ELSE dg END,
            CASE WHEN st = 'pending' AND s IN ('ready', 'failed', 'unavailable') OR st = 'ready' AND s = 'consumed' AND dg = d THEN 'accepted' WHEN s = 'consumed' THEN 'checksum_mismatch' ELSE 'invalid_transition' END FROM f JOIN j ON j.u = f.u AND j.n = f.n + 1)
    SELECT id AS event_id, verdict FROM f WHERE id IS NOT NULL""")
def continuation_journal(spark, sf_dir):
    e, n = F.col("event_type"), F.col("event_id")
    state = F.when(e.isin("click", "purchase"), "consumed").when(e == "view", "ready").when(e == "signup", "pending").when(n % 2 == 0, "failed").otherwise("unavailable")
    journal = events(spark, sf_dir).select("user_id", n, state.alias("state"), (n % 4).alias("digest"))
    return c.hand_over(journal, ["user_id"], "event_id", "state", "digest").select("event_id", "verdict")
