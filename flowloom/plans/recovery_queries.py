"""Queries of the recovery operators: events stand for a log of each user, orders for epochs and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowloom.operators import recovery as r
from flowloom.plans.catalog import query, table
from flowloom.plans.log_queries import SQL_SIZE, events, mark


@query("""WITH k AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'capture_event' WHEN 'view' THEN 'loss_window' WHEN 'purchase' THEN 'terminal_loss' WHEN 'signup' THEN 'commit_marker' ELSE 'noise' END AS kind FROM events),
    g AS (SELECT *, CASE kind WHEN 'capture_event' THEN event_id % 10 <> 0 WHEN 'loss_window' THEN event_id % 7 <> 0 WHEN 'terminal_loss' THEN event_id % 13 <> 0 AND event_id % 3 <> 0 WHEN 'commit_marker' THEN event_id % 13 <> 0 AND event_id % 4 <> 0 ELSE false END AS good FROM k)
    SELECT event_id, CASE WHEN good THEN CASE kind WHEN 'capture_event' THEN CASE WHEN event_id % 10 = 9 THEN 'loss_window' ELSE 'event' END WHEN 'loss_window' THEN 'loss_window' WHEN 'terminal_loss' THEN 'terminal_loss' ELSE 'marker' END END AS evidence,
        CASE WHEN NOT good THEN 'malformed_' || kind END AS issue FROM g""")
def record_dispatch(spark, sf_dir):
    n, e = F.col("event_id"), F.col("event_type")
    kind = F.when(e == "click", "capture_event").when(e == "view", "loss_window").when(e == "purchase", "terminal_loss").when(e == "signup", "commit_marker").otherwise("noise")
    click = F.when(n % 10 == 0, "{broken").when(n % 10 == 9, '{"kind":"loss_window_observed"}').otherwise('{"kind":"payload_fragment"}')
    view = F.when(n % 7 == 0, '{"kind":"payload_fragment"}').otherwise('{"kind":"loss_window_observed"}')
    other = F.format_string('{"first":%d,"last":%d,"records":%d}', n, n + F.when(n % 3 == 0, -1).otherwise(5), F.when(n % 4 == 0, -1).otherwise(3))
    payload = F.when(e == "click", click).when(e == "view", view).otherwise(other)
    return r.dispatch(events(spark, sf_dir).withColumn("payload", payload), kind, F.when(n % 13 == 0, 2).otherwise(1), F.col("payload")).select("event_id", "evidence", "issue")


@query(f"""WITH m AS (SELECT user_id, max(event_id) AS marker FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT user_id, marker, count(*) FILTER (event_type <> 'signup') AS records, coalesce(sum({SQL_SIZE}) FILTER (event_type <> 'signup'), 0)::BIGINT AS bytes, min(event_id // 1000) AS first_segment, max(event_id // 1000) AS last_segment FROM events JOIN m USING (user_id) WHERE event_id <= marker GROUP BY 1, 2""")
def committed_snapshot(spark, sf_dir):
    log = events(spark, sf_dir).withColumn("segment", F.expr("event_id div 1000"))
    return r.committed_snapshot(log, ["user_id"], "event_id", "size", mark(), "segment", ["event_type", "props"]).drop("marker_digest", "input_digest")


SCANNED = f"""WITH m AS (SELECT user_id, max(event_id) AS marker FROM events WHERE event_type = 'signup' GROUP BY 1), e AS (SELECT user_id, event_id, event_type = 'signup' AS k, marker, coalesce(event_id <= marker, false) AS i, {SQL_SIZE} AS z FROM events LEFT JOIN m USING (user_id)),
    s AS (SELECT user_id, max(marker) AS marker, count(*) FILTER (i AND NOT k) AS committed_records, coalesce(sum(z) FILTER (i AND NOT k), 0)::BIGINT AS committed_bytes, count(*) FILTER (NOT i) AS uncommitted_records, coalesce(sum(z) FILTER (NOT i), 0)::BIGINT AS uncommitted_bytes,
        min(event_id) FILTER (NOT i) AS first_uncommitted, max(event_id) FILTER (NOT i) AS last_uncommitted FROM e GROUP BY 1)"""


@query(SCANNED + """, d AS (SELECT *, ['starting', 'recording', 'completed', 'failed'][user_id % 4 + 1] AS st, user_id % 6 <> 0 AS here FROM s)
    SELECT user_id, marker, committed_records, committed_bytes, uncommitted_records, uncommitted_bytes, first_uncommitted, last_uncommitted, CASE WHEN NOT here OR st IN ('starting', 'recording') THEN 'aborted' ELSE st END AS status,
        CASE WHEN NOT here OR st IN ('starting', 'recording') THEN 'process_crash_recovered' ELSE 'user' END AS shutdown_reason, CASE WHEN here AND user_id % 7 = 0 AND user_id % 14 <> 0 THEN 'selector_mismatch' END AS error, NOT (here AND st IN ('completed', 'failed') AND user_id % 5 = 0) AS updated,
        CASE WHEN user_id % 8 = 0 THEN user_id END AS partial_tail_offset, user_id % 9 AS repaired_bytes, CASE WHEN user_id % 11 = 0 THEN 2 ELSE 0 END AS limit_loss_records,
        array_to_string(list_filter([CASE WHEN user_id % 10 = 0 THEN 'identity' END, CASE WHEN user_id % 8 = 0 THEN 'partial_tail' END, CASE WHEN user_id % 9 > 0 THEN 'tail_repaired' END, CASE WHEN user_id % 11 = 0 THEN 'wal_limit_loss' END], lambda x: x IS NOT NULL), ',') AS issues FROM d""")
def recovery_report(spark, sf_dir):
    u = F.col("user_id")
    scanned = r.post_marker(events(spark, sf_dir), ["user_id"], "event_id", "size", mark())
    status = F.element_at(F.array(*[F.lit(x) for x in ("starting", "recording", "completed", "failed")]), (u % 4 + 1).cast("int"))
    off = F.when(u % 5 == 0, 0).otherwise(1)
    said = scanned.where("user_id % 6 <> 0").select(u, F.when(u % 7 == 0, "a").alias("selector"), F.when(u % 7 == 0, F.when(u % 14 == 0, "a").otherwise("b")).alias("wanted_selector"), status.alias("status"), F.lit("user").alias("shutdown_reason"), "marker", "committed_records", "committed_bytes", (F.col("uncommitted_records") + off).alias("uncommitted_records"), "uncommitted_bytes")
    users = scanned.select("user_id")
    tails = users.select(u, F.when(u % 8 == 0, u).alias("partial_tail_offset"), (u % 9).alias("repaired_bytes"), F.when(u % 11 == 0, 2).otherwise(0).alias("limit_loss_records"))
    more = users.where("user_id % 10 = 0").withColumn("code", F.lit("identity")).union(users.where("user_id % 8 = 0").withColumn("code", F.lit("partial_tail")))
    return r.recovery_report(r.reconcile_metadata(scanned, said, "user_id"), "user_id", tails, more)


@query("SELECT o_orderkey AS epoch, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS parent, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 END AS ordinal, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown_epoch' ELSE 'found' END AS verdict FROM orders")
def epoch_parents(spark, sf_dir):
    epochs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("epoch"), F.col("o_custkey").alias("parent"), (F.col("o_orderkey") % 4).alias("ordinal"))
    return r.parent_context(epochs, epochs.where("epoch % 5 <> 0"))


@query(f"""WITH e AS (SELECT user_id, event_id, {SQL_SIZE} AS z, event_id // 1000 AS segment, max(event_id) OVER (PARTITION BY user_id) AS last FROM events), f AS (SELECT *, CASE WHEN user_id % 3 <> 0 THEN last - 50 END AS tail FROM e)
    SELECT user_id, max(tail) AS truncated_to, coalesce(sum(z) FILTER (segment = last // 1000 AND event_id >= tail), 0)::BIGINT AS repaired_bytes, count(*) - count(*) FILTER (segment = last // 1000 AND event_id >= tail) AS rows FROM f GROUP BY 1""")
def repair_tail(spark, sf_dir):
    log = events(spark, sf_dir).withColumn("segment", F.expr("event_id div 1000"))
    tails = log.groupBy("user_id").agg(F.max("event_id").alias("_last")).select("user_id", F.expr("if(user_id % 3 <> 0, _last - 50, null)").alias("tail_offset"))
    kept, report = r.repair_tail(log, tails, ["user_id"], "segment", "event_id", "size")
    return report.join(kept.groupBy("user_id").agg(F.count("*").alias("rows")), "user_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


@query("""WITH e AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), c AS (SELECT u, count(*) AS m FROM e GROUP BY 1),
    k AS (SELECT u, m, CASE WHEN u % 5 = 0 THEN NULL WHEN u % 7 = 0 THEN m + 1 WHEN u % 17 = 0 THEN m ELSE 3 END AS l FROM c), f AS (SELECT u, n, l, m FROM e JOIN k USING (u) WHERE NOT (u % 11 = 0 AND n = 5) AND (l IS NULL OR n > l)),
    x AS (SELECT *, n <> coalesce(lag(n) OVER (PARTITION BY u ORDER BY n), l, 0) + 1 AS g FROM f), s AS (SELECT u, bool_or(g) AS g, min(n) AS a, max(n) AS b, count(*) AS t FROM x GROUP BY 1)
    SELECT u AS user_id, CASE WHEN m < l THEN 'regression' WHEN m = l AND u % 17 = 0 THEN 'lineage_mismatch' WHEN t IS NULL AND m <> coalesce(l, 0) THEN 'gap' WHEN g OR b <> m THEN 'gap' WHEN l IS NOT NULL AND u % 13 = 0 THEN 'lineage_mismatch' ELSE 'ok' END AS verdict, a AS first_new, coalesce(t, 0) AS new_rows FROM k LEFT JOIN s USING (u)""")
def incremental_batches(spark, sf_dir):
    u = F.col("user_id")
    rows = events(spark, sf_dir).select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("n"))
    checks = rows.groupBy("user_id").agg(F.max("n").alias("marker"))
    last = F.when(u % 5 == 0, None).when(u % 7 == 0, F.col("marker") + 1).when(u % 17 == 0, F.col("marker")).otherwise(3)
    checks = checks.select("user_id", last.alias("last_marker"), F.when(u % 17 == 0, "old").otherwise("d").alias("last_digest"), "marker", F.lit("d").alias("digest"), F.lit(1).alias("first_sequence"))
    lineage = checks.select("user_id", F.lit(0).alias("ordinal"), F.lit(1).alias("old_first"), F.lit(3).alias("old_last"), F.lit("a").alias("old_digest"), F.lit(1).alias("new_first"), F.when(u % 13 == 0, 2).otherwise(4).alias("new_last"), F.lit("a").alias("new_digest"))
    return r.plan_batches(checks, rows.where("not (user_id % 11 = 0 and n = 5)"), "user_id", "n", lineage)


@query("""WITH e AS (SELECT o_custkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS k FROM orders), x AS (SELECT *, n <= 2 AND p % 5 <> 0 AS old, p % 7 = 0 AND n = 1 AS fork, k % 41 = 0 AS gone, k % 43 = 0 AS differs FROM e WHERE p % 3 <> 0),
    g AS (SELECT p, bool_or(old AND fork) AS f, bool_or(differs AND NOT gone) AS d, bool_or(old AND gone) AS l, bool_or(gone) AS a, bool_or(old) AS had, bool_or(NOT old) AS more FROM x GROUP BY 1)
    SELECT p AS parent, CASE WHEN f THEN 'output_lineage' WHEN d THEN 'verification' WHEN l THEN 'output_lineage' WHEN a THEN 'discarded' WHEN NOT had THEN 'repaired_checkpoint' WHEN more THEN 'adopted_output' ELSE 'already_consistent' END AS outcome FROM g""")
def interrupted_publications(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), n.alias("ordinal"), F.col("o_orderkey").alias("key"), F.lit("d").alias("digest"))
    durable = rows.where("ordinal <= 2 and parent % 5 <> 0").withColumn("digest", F.expr("if(parent % 7 = 0 and ordinal = 1, 'x', digest)"))
    store = rows.where("key % 41 <> 0").select("key", F.expr("if(key % 43 = 0, 'y', digest)").alias("digest"))
    return r.recover_publication(rows.where("parent % 3 <> 0"), durable, store, "parent")


@query("""WITH e AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 10 <> 0 AS c FROM orders)
    SELECT o_custkey, count(*) FILTER (n >= 4 OR NOT c) AS kept, count(*) FILTER (n < 4 AND c) AS dropped, min(n) FILTER (n >= 4 OR NOT c) AS first_retained, CASE WHEN bool_or(n < 4 AND NOT c) THEN 'metadata_limit' END AS error FROM e GROUP BY 1""")
def lifecycle_compaction(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return r.compact_lifecycle(table(spark, sf_dir, "orders").withColumn("n", n), ["o_custkey"], "n", F.col("o_orderkey") % 10 != 0, F.lit(4))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 4 ELSE (row_number() OVER (PARTITION BY user_id, event_id // 2000 ORDER BY event_id) - 1) % 6 END AS k, event_id // 2000 AS j FROM events), x AS (SELECT *, lag(k) OVER (PARTITION BY user_id, j ORDER BY event_id) AS b, lag(event_id) OVER (PARTITION BY user_id, j ORDER BY event_id) IS NULL AS first FROM e)
    SELECT user_id, j, event_id, ['prepared', 'successor_created', 'boundary_committed', 'topology_activated', 'complete', 'other'][k + 1] AS phase, k < 5 AND k = CASE WHEN first THEN 0 WHEN b = 5 THEN 0 ELSE b + 1 END AS legal FROM x""")
def rollover_journal(spark, sf_dir):
    w = W.partitionBy("user_id", "j").orderBy("event_id")
    rows = events(spark, sf_dir).withColumn("j", F.expr("event_id div 2000"))
    k = F.when(F.col("event_id") % 7 == 0, 4).otherwise((F.row_number().over(w) - 1) % 6)
    rows = rows.withColumn("phase", F.element_at(F.array(*[F.lit(p) for p in (*r.PHASES, "other")]), (k + 1).cast("int")))
    return r.rollover_steps(rows, ["user_id", "j"], "event_id", "phase")


@query("""WITH x AS (SELECT o_custkey, o_orderkey AS a, o_orderkey + o_orderkey % 400 - 20 AS b FROM orders)
    SELECT o_custkey, a, b, CASE WHEN a > b THEN 'backward' WHEN b >= o_custkey * 10 THEN 'beyond' WHEN a <= max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'overlaps' ELSE 'ok' END AS verdict FROM x""")
def outcome_ranges(spark, sf_dir):
    ranges = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("a"), F.expr("o_orderkey + o_orderkey % 400 - 20").alias("b"))
    return r.outcome_ranges(ranges, ranges.select("o_custkey").distinct().withColumn("admitted", F.col("o_custkey") * 10), ["o_custkey"], "a", "b")


@query(f"""WITH e AS (SELECT user_id, event_id, {SQL_SIZE} AS z, count(*) OVER (PARTITION BY user_id, event_id // 500 ORDER BY event_id) AS n FROM events), x AS (SELECT *, sum(CASE WHEN n <= 3 THEN z ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM e)
    SELECT event_id, CASE WHEN t > 60000 THEN 'terminal_loss' WHEN n > 3 THEN 'rejected' ELSE 'accepted' END AS outcome FROM x""")
def ingest_admission(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("drain", F.expr("event_id div 500"))
    return r.admit(rows, ["user_id", "drain"], "event_id", "size", 3, 60000).select("event_id", "outcome")
