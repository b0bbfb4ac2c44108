"""Queries of the log operators, over events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowloom.operators import logs
from flowloom.plans.catalog import query, table

SQL_SIZE = "round(value * 100)::BIGINT"


def mark():
    """Which rows are commit markers."""
    return F.col("event_type") == "signup"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("size", F.round(F.col("value") * 100).cast("long")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("""SELECT user_id, a AS "after", event_id AS "before", event_id - a - 1 AS missing FROM (
    SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events WHERE event_type <> 'error') WHERE event_id <> a + 1""")
def sequence_gaps(spark, sf_dir):
    return logs.sequence_gaps(events(spark, sf_dir).where("event_type <> 'error'"), ["user_id"], "event_id")


@query("""WITH m AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT event_id, coalesce(event_id <= m, false) AS committed FROM events LEFT JOIN m USING (user_id)""")
def committed_prefix(spark, sf_dir):
    return logs.committed_prefix(events(spark, sf_dir), ["user_id"], "event_id", mark()).select("event_id", "committed")


@query("""WITH m AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT user_id, count(*) FILTER (coalesce(event_id <= m, false)) AS committed_records, count(*) FILTER (NOT coalesce(event_id <= m, false)) AS ignored_post_commit_records
    FROM events LEFT JOIN m USING (user_id) WHERE event_type <> 'signup' GROUP BY 1""")
def post_commit_counts(spark, sf_dir):
    return logs.post_commit_counts(events(spark, sf_dir), ["user_id"], "event_id", mark())


BATCHES = f"""WITH b AS (SELECT *, event_type <> 'signup' AS d, {SQL_SIZE} AS z,
        coalesce(sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS batch FROM events),
    g AS (SELECT user_id, batch, min(event_id) FILTER (d) AS batch_first, max(event_id) FILTER (d) AS batch_last, count(*) FILTER (d) AS records,
        coalesce(sum(z) FILTER (d), 0)::BIGINT AS bytes, max(event_id) FILTER (NOT d) AS marker FROM b GROUP BY 1, 2 HAVING max(event_id) FILTER (NOT d) IS NOT NULL)
    SELECT *, (sum(records) OVER w)::BIGINT AS durable_records, (sum(bytes) OVER w)::BIGINT AS durable_bytes FROM g WINDOW w AS (PARTITION BY user_id ORDER BY batch)"""


@query(BATCHES)
def commit_batches(spark, sf_dir):
    return logs.commit_batches(events(spark, sf_dir), ["user_id"], "event_id", F.col("size"), mark())


#: What markers say of their batches, each in one of six ways: as it is, or with one count wrong or a place missing.
SAID = f"""SELECT user_id, marker, durable_records + (marker % 6 = 1)::INT AS r, durable_bytes - (marker % 6 = 2)::INT AS b,
    CASE WHEN marker % 6 <> 3 THEN batch_first END AS f, batch_last + (marker % 6 = 4)::INT AS l FROM ({BATCHES})"""


@query(f"""SELECT user_id, marker FROM ({BATCHES}) JOIN ({SAID}) USING (user_id, marker)
    WHERE durable_records <> r OR durable_bytes <> b OR batch_first IS DISTINCT FROM f OR batch_last IS DISTINCT FROM l""")
def marker_disagreements(spark, sf_dir):
    batches = logs.commit_batches(events(spark, sf_dir), ["user_id"], "event_id", F.col("size"), mark())
    wrong = lambda k: F.expr(f"if(marker % 6 = {k}, 1, 0)")
    said = batches.withColumn("durable_records", F.col("durable_records") + wrong(1)).withColumn("durable_bytes", F.col("durable_bytes") - wrong(2))
    said = said.withColumn("batch_first", F.expr("if(marker % 6 <> 3, batch_first, null)")).withColumn("batch_last", F.col("batch_last") + wrong(4))
    return logs.check_markers(batches, said, ["user_id"])


@query("""SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1""")
def ordered_digest(spark, sf_dir):
    return logs.ordered_digest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus"))


@query("""WITH f AS (SELECT user_id, event_id, event_type = 'signup' AS m, (sum((event_type <> 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS n FROM events WHERE event_id > 100),
    c AS (SELECT user_id, min(event_id) FILTER (n >= 20) AS f, max(event_id) AS l FROM f WHERE m AND n > 0 GROUP BY 1)
    SELECT c.user_id, coalesce(f, l) AS cut, n AS new_records FROM c JOIN f ON c.user_id = f.user_id AND f.event_id = coalesce(c.f, c.l)""")
def batch_cut(spark, sf_dir):
    return logs.batch_cut(events(spark, sf_dir), ["user_id"], "event_id", mark(), F.lit(100), 20)


@query(f"""WITH m AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_type = 'signup' GROUP BY 1),
    e AS (SELECT user_id, event_id, event_type <> 'signup' AND event_id <= m AND event_id > 500 AS late, {SQL_SIZE} AS z, min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id, event_id // 1000) AS created FROM events LEFT JOIN m USING (user_id))
    SELECT user_id, count(*) FILTER (late) AS records, coalesce(sum(z) FILTER (late), 0)::BIGINT AS bytes, coalesce(greatest(1710000000000 - min_by(created, event_id) FILTER (late), 0) // 1000, 0)::BIGINT AS age_seconds FROM e GROUP BY 1""")
def lag_report(spark, sf_dir):
    log = logs.committed_prefix(events(spark, sf_dir), ["user_id"], "event_id", mark())
    log = log.withColumn("created", F.min(F.expr("us div 1000")).over(W.partitionBy("user_id", F.expr("event_id div 1000"))))
    return logs.lag_report(log, ["user_id"], "event_id", F.col("size"), mark(), F.col("committed"), F.col("created"), F.lit(500), F.lit(1710000000000))


@query("""SELECT user_id, event_type, event_id, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def keep_last_dedup(spark, sf_dir):
    return logs.keep_last(events(spark, sf_dir), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", "props")


@query(f"""WITH m AS (SELECT max(event_id) AS m FROM events WHERE event_type = 'signup'),
    c AS (SELECT event_id // 100 AS segment, event_id, event_id <= m AS committed, event_type = 'signup' AS k, {SQL_SIZE} AS z FROM events, m)
    SELECT segment, min(event_id) FILTER (committed) AS first_sequence, max(event_id) FILTER (committed) AS last_committed, min(event_id) FILTER (k) AS first_marker,
    max(event_id) FILTER (k) AS last_marker, count(*) AS records, sum(z)::BIGINT AS bytes, bool_or(committed) AS has_committed FROM c GROUP BY 1""")
def segment_rollup(spark, sf_dir):
    log = logs.committed_prefix(events(spark, sf_dir).withColumn("log", F.lit(1)), ["log"], "event_id", mark())
    return logs.segment_rollup(log.withColumn("segment", F.expr("event_id div 100")), ["segment"], "event_id", F.col("size"), mark())


@query(f"""WITH m AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_type = 'signup' GROUP BY 1),
    c AS (SELECT user_id, event_id // 1000 AS segment, event_id, coalesce(event_id <= m, false) AS k, {SQL_SIZE} AS z FROM events LEFT JOIN m USING (user_id)),
    s AS (SELECT user_id, count(*) FILTER (NOT k) AS removed_segments FROM (SELECT user_id, segment, bool_or(k) AS k FROM c GROUP BY 1, 2) GROUP BY 1)
    SELECT user_id, count(*) FILTER (NOT k) AS discarded_records, coalesce(sum(z) FILTER (NOT k), 0)::BIGINT AS discarded_bytes, coalesce(max(event_id) FILTER (k), -1) + 1 AS next_sequence,
    coalesce(sum(z) FILTER (k), 0)::BIGINT AS projected_bytes, any_value(removed_segments) AS removed_segments FROM c JOIN s USING (user_id) GROUP BY 1""")
def reopen_preview(spark, sf_dir):
    return logs.reopen_preview(events(spark, sf_dir).withColumn("segment", F.expr("event_id div 1000")), ["user_id"], "event_id", F.col("size"), "segment", mark())


@query("""WITH o AS (SELECT o_orderpriority, epoch_us(date_trunc('month', o_orderdate)) // 1000000 AS month, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2),
    r AS (SELECT *, (sum(n) OVER (PARTITION BY o_orderpriority) - coalesce(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS remaining FROM o)
    SELECT * FROM r WHERE remaining > 200""")
def retention_candidates(spark, sf_dir):
    month = F.unix_seconds(F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))).alias("month")
    sized = table(spark, sf_dir, "orders").groupBy("o_orderpriority", month).agg(F.count("*").alias("n"))
    return logs.retention_candidates(sized, ["o_orderpriority"], ["month"], "n", 200, F.col("month") < 852076800)


@query("""WITH s AS (SELECT event_id // 100 AS segment, min(event_id) AS f, max(event_id) AS l FROM events GROUP BY 1)
    SELECT segment FROM s WHERE segment % 7 = 0 UNION SELECT max(segment) + 1 FROM s""")
def manifest_ahead(spark, sf_dir):
    log = events(spark, sf_dir).groupBy(F.expr("event_id div 100").alias("segment")).agg(F.min("event_id").alias("first_sequence"), F.max("event_id").alias("last_sequence"), F.lit("d").alias("digest"))
    listed = log.withColumn("last_sequence", F.when(F.col("segment") % 7 == 0, F.col("last_sequence") + 1).otherwise(F.col("last_sequence")))
    extra = log.agg((F.max("segment") + 1).alias("segment"), F.lit(0).cast("long").alias("first_sequence"), F.lit(1).cast("long").alias("last_sequence"), F.lit("d").alias("digest"))
    return logs.ahead_of_log(listed.unionByName(extra), log, ["segment"])


@query("""WITH r AS (SELECT l_suppkey, l_orderkey AS f, l_orderkey + l_linenumber * 100 AS l, lag(l_orderkey + l_linenumber * 100) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey) AS p, l_partkey FROM (SELECT l_suppkey, l_orderkey, min(l_partkey) AS l_partkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2))
    SELECT l_suppkey, count(*) FILTER (coalesce(f <= p, false)) AS violations FROM r GROUP BY 1""")
def segment_overlaps(spark, sf_dir):
    ranges = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max("l_linenumber").alias("n"))
    return logs.overlapping_ranges(ranges.withColumn("last", F.col("l_orderkey") + F.col("n") * 100), ["l_suppkey"], "l_orderkey", "last")


@query("""WITH n AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey AS k FROM orders),
    j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.k AS a, b.k AS b FROM (SELECT o_custkey, i, CASE WHEN o_custkey % 5 = 0 AND i = 2 THEN -1 ELSE k END AS k FROM n WHERE i <= 5) a FULL JOIN n b ON a.o_custkey = b.o_custkey AND a.i = b.i)
    SELECT o_custkey, CASE WHEN count(*) FILTER (a IS NOT NULL AND a IS DISTINCT FROM b) > 0 THEN 'fork' WHEN count(*) FILTER (a IS NULL) > 0 THEN 'prefix' ELSE 'equal' END AS relation FROM j GROUP BY 1""")
def lineage_relation(spark, sf_dir):
    from pyspark.sql.window import Window as W

    now = table(spark, sf_dir, "orders").withColumn("i", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).select("o_custkey", "i", F.col("o_orderkey").cast("string").alias("digest"))
    known = now.where("i <= 5").withColumn("digest", F.when((F.col("o_custkey") % 5 == 0) & (F.col("i") == 2), F.lit("-1")).otherwise(F.col("digest")))
    return logs.lineage(known, now, ["o_custkey"], "i", "digest")


@query("""SELECT o_orderkey AS sequence, CASE WHEN event_id IS NULL THEN 'missing' WHEN event_type <> 'click' THEN 'conflict' ELSE 'agrees' END AS verdict FROM orders LEFT JOIN events ON event_id = o_orderkey""")
def checkpoint_verdicts(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.lit(1).alias("log"), F.col("o_orderkey").alias("sequence"), F.lit("click").alias("digest"))
    log = events(spark, sf_dir).select(F.lit(1).alias("log"), F.col("event_id").alias("sequence"), F.col("event_type").alias("digest"))
    return logs.checkpoint_agrees(points, log, ["log"], "sequence", "digest").select("sequence", "verdict")
