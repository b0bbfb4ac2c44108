"""Queries of the catalog operators, over orders, customer, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowloom.operators import recordings as r
from flowloom.plans.catalog import query, table
from flowloom.plans.log_queries import SQL_SIZE, events


def cents(c):
    return F.round(F.col(c) * 100).cast("long")


@query("""WITH o AS (SELECT o_custkey + 500 AS k, max(o_orderstatus) AS s, max(o_orderkey) AS l FROM orders GROUP BY 1)
    SELECT coalesce(c_custkey, k) AS recording_id, c_name AS name, coalesce(s, c_mktsegment) AS status, l AS session_id, array_to_string(CASE WHEN k IS NULL THEN [1] WHEN c_custkey IS NULL THEN [0] ELSE [0, 1] END, ',') AS found_in FROM customer FULL JOIN o ON c_custkey = k""")
def catalog_full_outer(spark, sf_dir):
    logs = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 500).alias("recording_id")).agg(F.max("o_orderstatus").alias("status"), F.max("o_orderkey").alias("session_id"))
    listed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recording_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))
    return r.merge_catalog([logs, listed], ["recording_id"], ["name", "status", "session_id"]).withColumn("found_in", F.array_join(F.transform("found_in", lambda i: i.cast("string")), ","))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def known_sessions_semi(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(known, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unseen_anti(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_recording(spark, sf_dir):
    return r.latest(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT 'id' AS reference, c_custkey FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'name', c_custkey FROM customer WHERE c_name = 'Customer#000000009'
    UNION ALL SELECT 'latest', max(c_custkey) FROM customer""")
def resolve_reference(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    out = None
    for kind, reference in (("id", "7"), ("name", "Customer#000000009"), ("latest", "latest"), ("name", "BUILDING")):
        one = r.resolve(customers, reference, "c_custkey", "c_name", ["c_custkey"]).select(F.lit(kind).alias("reference"), "c_custkey")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT o_custkey, count(*) AS sessions, sum(o_orderkey)::BIGINT AS operations, count(*) FILTER (o_orderstatus = 'F') AS published FROM orders GROUP BY 1""")
def list_report(spark, sf_dir):
    return r.parent_rollup(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F").orderBy("o_custkey")


@query("""SELECT o_custkey, CASE WHEN count(CASE WHEN o_orderkey % 50 <> 0 THEN 1 END) = count(*) THEN sum(o_orderkey)::BIGINT END AS total FROM orders GROUP BY 1""")
def null_poison_sum(spark, sf_dir):
    return r.null_poison_sum(table(spark, sf_dir, "orders").withColumn("v", F.expr("if(o_orderkey % 50 <> 0, o_orderkey, null)")), ["o_custkey"], "v")


@query("""SELECT o_custkey, min(epoch_us(o_orderdate)) AS started_at, max(epoch_us(o_orderdate)) AS ended_at, coalesce(max_by(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'F'), 'F') AS status, count(*) AS sessions FROM orders GROUP BY 1""")
def merge_sessions(spark, sf_dir):
    return r.merge_sessions(table(spark, sf_dir, "orders").withColumn("at", F.unix_micros(F.col("o_orderdate").cast("timestamp"))), ["o_custkey"], ["o_orderkey"], "at", "at", "o_orderstatus", "F")


@query("""WITH i AS (SELECT o_custkey, o_orderkey, unnest(range(0, o_orderkey % 3)) AS k, o_orderstatus, o_orderpriority FROM orders)
    SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, k) - 1 AS ordinal, CASE k WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS item FROM i""")
def merged_evidence(spark, sf_dir):
    found = F.when(F.col("o_orderkey") % 6 != 0, F.slice(F.array("o_orderstatus", "o_orderpriority"), F.lit(1), (F.col("o_orderkey") % 3).cast("int")))
    return r.merged_evidence(table(spark, sf_dir, "orders").withColumn("found", found), ["o_custkey"], "o_orderkey", "found")


@query("""WITH a AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS published, o_orderstatus = 'P' AS incomplete, o_orderkey % 5 <> 0 AS present, CASE o_orderpriority WHEN '1-URGENT' THEN 'published' WHEN '2-HIGH' THEN 'in_progress' WHEN '3-MEDIUM' THEN 'recoverable' END AS advisory FROM orders)
    SELECT o_orderkey, CASE WHEN published AND incomplete THEN 'inconsistent' WHEN published THEN 'published' WHEN present AND advisory = 'published' THEN 'inconsistent' WHEN present THEN 'recoverable'
        WHEN advisory IS NOT NULL THEN advisory ELSE 'in_progress' END AS status FROM a""")
def status_truth_table(spark, sf_dir):
    priority = F.col("o_orderpriority")
    advisory = F.when(priority == "1-URGENT", "published").when(priority == "2-HIGH", "in_progress").when(priority == "3-MEDIUM", "recoverable")
    status = r.reconcile_status(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus") == "P", F.col("o_orderkey") % 5 != 0, advisory)
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@query("""WITH b AS (SELECT k, o_orderkey, o_custkey FROM (SELECT DISTINCT o_custkey AS k, o_orderkey, o_custkey FROM orders) UNION ALL SELECT o_orderkey + 1000000, o_orderkey, o_custkey FROM orders)
    SELECT k AS index_key, o_orderkey FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey) = 1""")
def index_by_two_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("epoch", F.col("o_orderkey") + 1000000)
    return r.index_by_two_keys(rows, "o_custkey", "epoch", ["o_orderkey"]).select("index_key", "o_orderkey")


@query("""WITH e AS (SELECT o_custkey, o_orderkey, row_number() OVER w - (o_orderkey % 97 = 0)::INT AS ordinal, lag(o_orderkey) OVER w AS p, CASE WHEN o_orderkey % 101 <> 0 THEN lead(o_orderkey) OVER w END AS f, lead(o_orderkey) OVER w IS NULL AS a
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    x AS (SELECT o_custkey, a, coalesce(ordinal <> lag(ordinal) OVER w + 1, false)::INT + (p IS DISTINCT FROM lag(o_orderkey) OVER w)::INT + (f IS DISTINCT FROM lead(o_orderkey) OVER w)::INT AS bad FROM e WINDOW w AS (PARTITION BY o_custkey ORDER BY ordinal, o_orderkey))
    SELECT o_custkey, (sum(bad) + (count(*) FILTER (a) <> 1)::INT)::BIGINT AS violations FROM x GROUP BY 1 HAVING count(*) FILTER (a) > 0""")
def epoch_chain_check(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("ordinal", F.row_number().over(w) - (F.col("o_orderkey") % 97 == 0).cast("int")).withColumn("previous", F.lag("o_orderkey").over(w)).withColumn("_lead", F.lead("o_orderkey").over(w))
    rows = rows.withColumn("following", F.expr("if(o_orderkey % 101 <> 0, _lead, null)")).withColumn("active", F.col("_lead").isNull())
    return r.epoch_chain(rows, ["o_custkey"], "ordinal", "o_orderkey", "previous", "following", "active")


#: Evidence of orders as epochs of customers: of every seventh another parent, ordinal, path or digest is told.
EVIDENCE = """WITH e AS (SELECT o_custkey AS parent, o_orderkey AS epoch, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS ordinal, 'p' || o_orderkey AS path FROM orders),
    v AS (SELECT epoch AS place, CASE WHEN epoch % 1009 = 0 THEN 'filesystem_mtime' WHEN epoch % 3 = 0 THEN 'run_summary' WHEN epoch % 3 = 1 THEN 'checkpoint' ELSE 'catalog' END AS authority, e.parent AS catalog_parent,
        CASE WHEN epoch % 101 = 0 THEN -1 ELSE e.parent END AS parent, CASE WHEN epoch % 103 = 0 THEN -epoch ELSE epoch END AS epoch, CASE WHEN epoch % 107 = 0 THEN 0 ELSE ordinal END AS ordinal,
        CASE WHEN epoch % 109 = 0 THEN 'q' ELSE path END AS path, CASE WHEN epoch % 41 = 0 THEN 'other' ELSE c_name END AS digest, c_name, e.ordinal AS o, e.path AS p FROM e JOIN customer ON c_custkey = e.parent)"""


@query(EVIDENCE + """, x AS (SELECT *, CASE WHEN authority = 'filesystem_mtime' THEN 'mtime_selection_forbidden' WHEN parent <> catalog_parent THEN 'parent_identity_conflict' WHEN epoch < 0 OR ordinal <> o OR path <> p THEN 'lineage_fork'
        WHEN digest <> c_name AND authority = 'catalog' THEN 'authority_conflict' END AS error FROM v),
    g AS (SELECT catalog_parent, min_by(error, place) FILTER (error IS NOT NULL) AS error, bool_or(digest <> c_name) AS other FROM x GROUP BY 1)
    SELECT c_custkey AS parent, coalesce(error, CASE WHEN other THEN 'rebuild_derived' END, 'authoritative') AS verdict FROM customer LEFT JOIN g ON c_custkey = catalog_parent""")
def epoch_evidence(spark, sf_dir):
    key = F.col("o_orderkey")
    ordinal = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    catalog = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parent"), F.col("c_name").alias("digest"))
    epochs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), key.alias("epoch"), ordinal.alias("ordinal"), F.concat(F.lit("p"), key.cast("string")).alias("path"))
    wrong = lambda k, other, right: F.when(F.col("place") % k == 0, other).otherwise(F.col(right))
    told = epochs.join(catalog, "parent").withColumn("place", F.col("epoch"))
    authority = F.when(F.col("place") % 1009 == 0, "filesystem_mtime").when(F.col("place") % 3 == 0, "run_summary").when(F.col("place") % 3 == 1, "checkpoint").otherwise("catalog")
    told = told.select("place", authority.alias("authority"), F.col("parent").alias("catalog_parent"), wrong(101, F.lit(-1).cast("long"), "parent").alias("parent"), wrong(103, -F.col("epoch"), "epoch").alias("epoch"), wrong(107, F.lit(0).cast("long"), "ordinal").alias("ordinal"), wrong(109, F.lit("q"), "path").alias("path"), wrong(41, F.lit("other"), "digest").alias("digest"))
    return r.reconcile_epochs(catalog, epochs, told)


@query("""WITH x AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS ordinal FROM events)
    SELECT event_type, ordinal, event_id, 0::BIGINT AS left_out FROM x WHERE ordinal <= 64 UNION ALL SELECT event_type, 65, NULL, count(*) FROM x WHERE ordinal > 64 GROUP BY 1""")
def issue_cap(spark, sf_dir):
    return r.cap_issues(events(spark, sf_dir), ["event_type"], ["event_id"], ["event_id"])


@query("""SELECT 'event' AS kind, event_id AS sequence FROM events WHERE event_type = 'error' UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'unknown', NULL FROM region""")
def evidence_union(spark, sf_dir):
    parts = {"event": events(spark, sf_dir).where("event_type = 'error'").select(F.col("event_id").alias("sequence")), "order": table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("sequence")), "unknown": table(spark, sf_dir, "region").select(F.lit(None).cast("long").alias("sequence"))}
    return r.union_evidence(parts, ["sequence"], "sequence")


@query("""SELECT 'left' AS side, event_id, event_type FROM (SELECT event_id, event_type FROM events EXCEPT ALL SELECT event_id, CASE WHEN event_id % 1000 = 1 THEN 'x' ELSE event_type END FROM events)
    UNION ALL SELECT 'right', event_id, 'x' FROM events WHERE event_id % 1000 = 1""")
def session_equivalence(spark, sf_dir):
    a = events(spark, sf_dir).select("event_id", "event_type")
    return r.differences(a, a.withColumn("event_type", F.when(F.col("event_id") % 1000 == 1, "x").otherwise(F.col("event_type"))))


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return r.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey FROM orders")
def bounded_rows(spark, sf_dir):
    return r.at_most(table(spark, sf_dir, "orders"), ["o_custkey"], 10_000).select("o_orderkey")


@query("""SELECT doc_id, CASE WHEN doc_id % 21 = 0 THEN 'conflict' WHEN doc_id % 2 = 1 THEN 'created' WHEN doc_id % 3 = 0 THEN 'conflict' ELSE 'already_exists_matching' END AS outcome FROM documents""")
def put_outcomes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    stored = docs.where("doc_id % 2 = 0").withColumn("digest", F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("digest")))
    return r.put_if_absent(stored, docs, "doc_id", "digest", docs.where("doc_id % 21 = 0")).select("doc_id", "outcome")


@query("SELECT doc_id FROM documents WHERE NOT (doc_id % 5 = 0)")
def tombstoned(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    wanted = docs.where("doc_id % 5 = 0").unionByName(docs.where("doc_id % 5 = 1").withColumn("digest", F.lit("stale")))
    return r.tombstone(docs, wanted, "doc_id", "digest")[0].select("doc_id")


@query("SELECT url FROM pages WHERE starts_with(url, 'https://') ORDER BY url LIMIT 20")
def artifact_page(spark, sf_dir):
    return r.list_prefix(table(spark, sf_dir, "pages").select("url"), "url", "https://", 20)


@query("""WITH d AS (SELECT source, sha256(text) AS s, octet_length(encode(text))::BIGINT AS b FROM documents WHERE octet_length(encode(text)) > 0), g AS (SELECT source, s, count(*) AS n, max(b) AS b FROM d GROUP BY 1, 2)
    SELECT source, sum(n)::BIGINT AS payloads, sum(n * b)::BIGINT AS payload_bytes, count(*) AS distinct_payloads, sum(b)::BIGINT AS distinct_bytes FROM g GROUP BY 1""")
def content_addressed(spark, sf_dir):
    return r.content_addressed(table(spark, sf_dir, "documents"), ["source"], F.col("text"))


@query("""WITH q AS (SELECT c_custkey, c_custkey * 10 AS free, c_custkey % 900 * 10 AS reserved, c_nationkey * 300 AS managed FROM customer)
    SELECT c_custkey, CASE WHEN NOT (free < 2000 OR reserved > greatest(free - 2000, 0)) THEN 'none' WHEN managed > 4000 THEN 'terminal' ELSE 'recoverable' END AS pressure FROM q""")
def quota_pressure(spark, sf_dir):
    pressure = r.quota_pressure(F.col("c_custkey") * 10, F.col("c_custkey") % 900 * 10, F.lit(4000), F.lit(2000), F.col("c_nationkey") * 300)
    return table(spark, sf_dir, "customer").select("c_custkey", pressure.alias("pressure"))


@query(f"""SELECT event_id, (sum(CASE WHEN event_type = 'error' THEN -{SQL_SIZE} ELSE {SQL_SIZE} END) OVER w)::BIGINT AS reserved, sum(CASE WHEN event_type = 'error' THEN -{SQL_SIZE} ELSE {SQL_SIZE} END) OVER w <= 150000 AS fits FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def reservation_ledger(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("delta", F.when(F.col("event_type") == "error", -F.col("size")).otherwise(F.col("size")))
    return r.reservation_ledger(rows, ["user_id"], "event_id", "delta", F.lit(150000)).select("event_id", "reserved", "fits")


@query("""WITH s AS (SELECT *, ['starting', 'recovering', 'running', 'draining', 'stopped', 'failed', 'running'][o_orderkey % 7 + 1] AS life, o_orderkey % 5 <> 0 AS live FROM orders)
    SELECT o_orderkey, CASE WHEN NOT live AND life IN ('running', 'recovering', 'draining') OR life = 'failed' OR o_custkey % 11 = 0 THEN 'failed' WHEN life = 'running' AND o_orderstatus = 'O' THEN 'ready'
        WHEN life IN ('starting', 'recovering') THEN life WHEN life = 'running' THEN 'loading_ebpf' ELSE 'degraded' END AS status,
    CASE WHEN o_orderkey % 7 = 0 THEN 'fatal' WHEN o_custkey % 5 = 0 THEN 'user' WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN 'source_completed' WHEN o_orderstatus = 'O' THEN 'deadline' END AS stop FROM s""")
def recorder_states(spark, sf_dir):
    a, b, f, d, o = F.col("o_orderkey") % 7 == 0, F.col("o_custkey") % 5 == 0, F.col("o_orderstatus") == "F", F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus") == "O"
    life = F.element_at(F.array(*[F.lit(x) for x in ("starting", "recovering", "running", "draining", "stopped", "failed", "running")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    status = r.recorder_status(life, F.when(F.col("o_custkey") % 11 == 0, "failed").otherwise("healthy"), F.when(o, "ready").otherwise("loading"), F.col("o_orderkey") % 5 != 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), r.stop_reason(a, b, f, o, d).alias("stop"))


@query("""WITH s AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state, event_type AS to_state FROM events)
    SELECT * FROM s WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (('view', 'click'), ('click', 'purchase'), ('signup', 'view'), ('view', 'view'))""")
def illegal_transitions(spark, sf_dir):
    allowed = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "view")], "from_state string, to_state string")
    return r.illegal_transitions(events(spark, sf_dir), ["user_id"], "event_id", "event_type", allowed)


@query("""WITH p AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' AND l_linenumber % 4 = 1 THEN 'unsupported' WHEN l_returnflag = 'A' AND l_linenumber % 4 = 3 THEN 'not_checked' WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN 'supported_with_warnings' WHEN l_returnflag = 'R' AND l_linenumber % 4 = 0 THEN 'not_checked' ELSE 'supported' END AS s, l_linenumber % 2 = 1 AS must FROM lineitem),
    g AS (SELECT l_orderkey, bool_or(must AND s = 'unsupported') AS u, bool_or(must AND s = 'not_checked') AS n, bool_or(s = 'supported_with_warnings' OR (NOT must AND s IN ('unsupported', 'not_checked'))) AS w FROM p GROUP BY 1)
    SELECT l_orderkey, CASE WHEN u THEN 'unsupported' WHEN n THEN 'not_checked' WHEN w THEN 'supported_with_warnings' ELSE 'supported' END AS status, CASE WHEN u OR n THEN 4 ELSE 0 END AS exit_code FROM g""")
def doctor_report(spark, sf_dir):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    status = F.when((flag == "R") & (line % 4 == 1), "unsupported").when((flag == "A") & (line % 4 == 3), "not_checked").when((F.col("l_linestatus") == "F") & (line == 2), "supported_with_warnings").when((flag == "R") & (line % 4 == 0), "not_checked").otherwise("supported")
    return r.worst_status(table(spark, sf_dir, "lineitem").withColumn("status", status).withColumn("required", line % 2 == 1), ["l_orderkey"], "status", "required")


@query("""WITH g AS (SELECT o_custkey, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), h AS (SELECT o_custkey, min(o_orderkey) AS a, min(o_orderkey) AS b FROM orders GROUP BY 1),
    q AS (SELECT * FROM g UNION ALL SELECT * FROM h), c AS (SELECT o.o_custkey, o.o_orderkey, (SELECT count(*) FROM q WHERE q.o_custkey = o.o_custkey AND o.o_orderkey BETWEEN q.a AND q.b) AS times FROM orders o)
    SELECT * FROM c WHERE times <> 1""")
def coverage_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    span = lambda df, b: df.groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), b("o_orderkey").alias("b"))
    ranges = span(orders.where("o_orderstatus = 'F'"), F.max).unionByName(span(orders, F.min))
    return r.uncovered(ranges, orders, ["o_custkey"], "a", "b", "o_orderkey")


@query(f"""SELECT user_id, count(*) FILTER (true) AS received_records, sum({SQL_SIZE})::BIGINT AS received_bytes, count(*) FILTER (event_type = 'error') AS rejected_records, coalesce(sum({SQL_SIZE}) FILTER (event_type = 'error'), 0)::BIGINT AS rejected_bytes FROM events GROUP BY 1""")
def ingest_counters(spark, sf_dir):
    return r.ingest_counters(events(spark, sf_dir), ["user_id"], {"received": F.lit(True), "rejected": F.col("event_type") == "error"}, "size")
