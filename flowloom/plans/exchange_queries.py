"""Queries of the exchange operators, over events, orders, lineitem and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import exchanges as x
from flowloom.plans.catalog import query, table
from flowloom.plans.log_queries import events

METHODS = ("GET", "HEAD", "POST", "DELETE", "PROPFIND")
METHOD = "CASE o_orderkey % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'HEAD' WHEN 2 THEN 'POST' WHEN 3 THEN 'DELETE' ELSE 'PROPFIND' END"
EFFECT = "CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'read' WHEN o_orderkey % 5 IN (2, 3) THEN 'write' ELSE 'unknown' END"
DECISION = """CASE WHEN o_orderkey % 11 = 0 THEN 'unsupported' WHEN o_orderstatus = 'F' THEN 'not_authorized' WHEN o_orderkey % 7 = 0 THEN 'authorization_header' WHEN o_custkey % 13 = 0 THEN 'missing_target'
    WHEN o_custkey % 17 = 0 THEN 'recorded_destination' WHEN o_orderkey % 5 IN (0, 1) OR (o_orderkey % 5 IN (2, 3) AND o_orderpriority = '1-URGENT') THEN 'execute' ELSE 'effect_not_allowed' END"""


def operations(spark, sf_dir):
    """Orders as operations: a method, its effect, a policy, and what is decided."""
    method = F.element_at(F.array(*[F.lit(m) for m in METHODS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").withColumn("method", method).withColumn("effect", x.effect(F.col("method")))
    policy = F.create_map(F.lit("read"), F.lit(True), F.lit("write"), F.col("o_orderpriority") == "1-URGENT")
    rows = rows.withColumn("allowed", x.allowed_by(policy, F.col("effect")))
    return rows.withColumn("decision", x.replay_decision(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus") != "F", F.col("o_orderkey") % 7 == 0, F.col("o_custkey") % 13 != 0, F.col("o_custkey") % 17 == 0, F.col("allowed")))


@query(f"SELECT o_orderkey, {METHOD} AS method, {EFFECT} AS effect FROM orders")
def effects(spark, sf_dir):
    return operations(spark, sf_dir).select("o_orderkey", "method", "effect")


@query("""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, event_id AS request FROM events WHERE event_type = 'purchase'),
    s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, event_id AS response FROM events WHERE event_type = 'error')
    SELECT coalesce(r.user_id, s.user_id) AS user_id, coalesce(r.rank, s.rank) AS rank, request, response FROM r FULL JOIN s ON r.user_id = s.user_id AND r.rank = s.rank""")
def rank_pairing(spark, sf_dir):
    return x.pair_by_rank(events(spark, sf_dir), ["user_id"], "event_id", F.col("event_type") == "purchase", F.col("event_type") == "error")


QUEUE = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type IN ('purchase', 'error')),
    r AS (SELECT user_id, event_id, i, (event_type = 'purchase')::INT AS waiting, event_type = 'error' AS orphan, event_type FROM e WHERE i = 1
        UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.event_type = 'purchase' THEN r.waiting + 1 ELSE greatest(r.waiting - 1, 0) END, e.event_type = 'error' AND r.waiting = 0, e.event_type
        FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)"""


@query(QUEUE + """, q AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM r WHERE event_type = 'purchase'),
    a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM r WHERE event_type = 'error' AND NOT orphan)
    SELECT q.user_id, q.event_id AS request, a.event_id AS response, CASE WHEN a.event_id IS NULL THEN 'unmatched_request' ELSE 'paired' END AS state FROM q LEFT JOIN a ON q.user_id = a.user_id AND q.k = a.k
    UNION ALL SELECT user_id, NULL, event_id, 'orphan_response' FROM r WHERE orphan""")
def fifo_pairing(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("kind", F.when(F.col("event_type") == "purchase", "request").when(F.col("event_type") == "error", "response"))
    return x.pair_fifo(rows, "user_id", "event_id", "kind")


@query(QUEUE + " SELECT event_id, waiting, orphan FROM r")
def pipeline_depth(spark, sf_dir):
    return x.fifo_states(events(spark, sf_dir), ["user_id"], "event_id", F.col("event_type") == "purchase", F.col("event_type") == "error").select("event_id", F.col("waiting").cast("int").alias("waiting"), "orphan")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'malformed' WHEN o_orderkey % 17 = 0 OR o_orderkey % 13 = 0 THEN 'unsupported' WHEN o_orderkey % 11 = 0 THEN 'truncated'
    WHEN o_orderstatus = 'P' THEN 'unmatched' WHEN o_orderkey % 7 = 0 OR o_custkey % 9 = 0 THEN 'incomplete' ELSE 'complete' END AS completeness FROM orders""")
def completeness_cascade(spark, sf_dir):
    code = lambda n, c: F.when(F.col("o_orderkey") % n == 0, c)
    codes = F.array_compact(F.array(code(13, "unsupported_upgrade"), code(17, "pipelined"), code(19, "malformed"), F.lit("missing_timestamp")))
    state = x.completeness(codes, F.col("o_orderkey") % 11 == 0, F.col("o_orderstatus") != "P", F.col("o_orderkey") % 7 == 0, F.col("o_custkey") % 9 != 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("completeness"))


@query(f"SELECT o_orderkey, {DECISION} AS decision FROM orders")
def decision_cascade(spark, sf_dir):
    return operations(spark, sf_dir).select("o_orderkey", "decision")


@query("""WITH r(ordinal, c_nationkey, c_mktsegment, target) AS (VALUES (1, 3, 'BUILDING', 'a'), (2, 3, NULL, 'b'), (3, NULL, 'MACHINERY', 'c'), (4, 7, NULL, 'd'), (5, NULL, NULL, 'e'), (6, 9, 'BUILDING', 'f'))
    SELECT c_custkey, r.ordinal AS rule, target FROM customer c JOIN r ON (r.c_nationkey IS NULL OR r.c_nationkey = c.c_nationkey) AND (r.c_mktsegment IS NULL OR r.c_mktsegment = c.c_mktsegment)
    QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY r.ordinal) = 1""")
def target_rules_first_match(spark, sf_dir):
    rules = spark.createDataFrame([(1, 3, "BUILDING", "a"), (2, 3, None, "b"), (3, None, "MACHINERY", "c"), (4, 7, None, "d"), (5, None, None, "e"), (6, 9, "BUILDING", "f")], "ordinal int, c_nationkey int, c_mktsegment string, target string")
    return x.first_rule(table(spark, sf_dir, "customer"), rules, "c_custkey", ["c_nationkey", "c_mktsegment"]).select("c_custkey", "rule", "target")


@query("""SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'no_response' WHEN a.doc_id % 4 <> b.doc_id % 8 % 4 + (b.doc_id % 40 = 3)::INT THEN 'status' WHEN a.lang <> b.lang THEN 'headers' WHEN sha256(a.text) <> sha256(b.text) THEN 'body' ELSE 'passed' END AS verdict
    FROM documents a LEFT JOIN (SELECT doc_id, lang, CASE WHEN doc_id % 6 = 0 THEN text || '!' ELSE text END AS text FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN 'xx' ELSE lang END AS lang, text FROM documents) WHERE doc_id % 15 <> 0) b ON a.doc_id = b.doc_id""")
def verify_bodies(spark, sf_dir):
    header = lambda c: F.array(F.struct(F.lit("Date").alias("name"), F.col("doc_id").cast("string").cast("binary").alias("value")), F.struct(F.lit("X-Lang").alias("name"), c.cast("binary").alias("value")))
    docs = table(spark, sf_dir, "documents")
    recorded = docs.select("doc_id", (F.col("doc_id") % 4).cast("int").alias("status"), header(F.col("lang")).alias("headers"), F.col("text").cast("binary").alias("body"))
    lang = F.when(F.col("doc_id") % 10 == 4, "xx").otherwise(F.col("lang"))
    text = F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    status = F.col("doc_id") % 8 % 4 + (F.col("doc_id") % 40 == 3).cast("int")
    observed = docs.where("doc_id % 15 <> 0").select("doc_id", status.cast("int").alias("status"), header(lang).alias("headers"), text.cast("binary").alias("body"))
    return x.verify(recorded, observed, "doc_id")


@query(f"""WITH d AS (SELECT o_custkey, {DECISION} AS decision FROM orders) SELECT o_custkey, count(*) AS total, count(*) FILTER (decision = 'execute') AS execute, count(*) FILTER (decision = 'unsupported') AS unsupported,
    count(*) FILTER (decision = 'not_authorized') AS not_authorized, count(*) FILTER (decision = 'authorization_header') AS authorization_header, count(*) FILTER (decision = 'missing_target') AS missing_target,
    count(*) FILTER (decision = 'recorded_destination') AS recorded_destination, count(*) FILTER (decision = 'effect_not_allowed') AS effect_not_allowed FROM d GROUP BY 1""")
def replay_counts(spark, sf_dir):
    states = ("execute", "unsupported", "not_authorized", "authorization_header", "missing_target", "recorded_destination", "effect_not_allowed")
    return x.replay_counts(operations(spark, sf_dir), ["o_custkey"], "decision", states)


@query(f"""WITH d AS (SELECT o_custkey, {DECISION} = 'execute' AS e FROM orders) SELECT o_custkey, count(*) FILTER (e) AS executable, count(*) FILTER (NOT e) AS blocked,
    CASE WHEN count(*) FILTER (e) = 0 THEN 'not_replayable' WHEN count(*) FILTER (NOT e) > 0 THEN 'partially_replayable' ELSE 'fully_replayable' END AS replayability FROM d GROUP BY 1""")
def replayability(spark, sf_dir):
    return x.replayability(operations(spark, sf_dir), ["o_custkey"], F.col("decision") == "execute")


@query("""WITH f AS (SELECT l_orderkey, unnest([CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_discount > 0.08 THEN 'discounted' END, CASE WHEN l_quantity > 45 THEN 'large' END]) AS r FROM lineitem)
    SELECT l_orderkey, coalesce(string_agg(DISTINCT r, ',' ORDER BY r), '') AS blockers FROM f GROUP BY 1""")
def blocker_sets(spark, sf_dir):
    reasons = [F.when(F.col("l_returnflag") == "R", "returned"), F.when(F.col("l_discount") > 0.08, "discounted"), F.when(F.col("l_quantity") > 45, "large")]
    return x.blocker_sets(table(spark, sf_dir, "lineitem"), ["l_orderkey"], reasons)


@query(f"""WITH d AS (SELECT o_custkey, o_orderkey, {DECISION} = 'execute' AS e, o_totalprice < 400000 AS p FROM orders),
    s AS (SELECT *, coalesce(max((e AND NOT p)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM d)
    SELECT o_orderkey, CASE WHEN NOT e THEN 'skipped' WHEN stopped THEN 'not_attempted' WHEN p THEN 'passed' ELSE 'failed' END AS outcome FROM s""")
def replay_outcome(spark, sf_dir):
    return x.stop_at_failure(operations(spark, sf_dir), ["o_custkey"], ["o_orderkey"], F.col("decision") == "execute", F.col("o_totalprice") < 400000).select("o_orderkey", "outcome")


@query("""WITH m AS (SELECT o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate) AS ordinal, max(o_custkey) AS largest FROM orders GROUP BY 1, 2)
    SELECT *, coalesce(sum(largest + 1) OVER (PARTITION BY o_orderpriority ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM m""")
def epoch_offsets(spark, sf_dir):
    months = table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("ordinal")).agg(F.max("o_custkey").alias("largest"))
    return x.epoch_offsets(months, ["o_orderpriority"], ["ordinal"], "largest")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate), o_orderkey) AS position FROM orders")
def replay_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("offset", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return x.scheduled(rows, ["o_custkey"], "offset", "o_orderkey").select("o_orderkey", "position")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS o, max(l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT l_orderkey, o, (sum(n) OVER w - n)::BIGINT AS s, (sum(n) OVER w)::BIGINT AS e FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY o)),
    m AS (SELECT l_orderkey, unnest([1, 2, 3]) AS message FROM (SELECT DISTINCT l_orderkey FROM lineitem)), b AS (SELECT *, (message - 1) * 17 AS f, message * 17 AS t FROM m)
    SELECT l_orderkey, message, o, greatest(s, f) - s AS taken_from, least(e, t) - s AS taken_to FROM a JOIN b USING (l_orderkey) WHERE s < t AND f < e""")
def provenance_slices(spark, sf_dir):
    ranges = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.expr("l_linenumber * 1000000L + l_partkey").alias("o")).agg(F.max("l_quantity").cast("long").alias("n"))
    messages = ranges.select("l_orderkey").distinct().withColumn("message", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))).withColumn("consumed", F.lit(17))
    return x.slice_provenance(ranges, messages, ["l_orderkey"], "o", "n")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN octet_length(encode(html)) WHEN 1 THEN page_id WHEN 2 THEN page_id * 2 END AS size FROM pages""")
def payload_sizes(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("inline", "artifact", "redacted", "missing")]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", x.payload_size(kind, F.col("html"), F.col("page_id"), F.col("page_id") * 2).cast("long").alias("size"))
