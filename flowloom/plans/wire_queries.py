"""Queries of scalar functions, of HTTP over pages, and of the streaming forms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowloom.functions import text as t
from flowloom.operators import sessions
from flowloom.operators.exchanges import normalized_headers, sanitized_headers
from flowloom.plans.catalog import query, table
from flowloom.plans.log_queries import events
from flowloom.streaming import keyed


@query("""WITH d AS (SELECT event_id, (event_id % 97)::VARCHAR || CASE event_id % 7 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'm' WHEN 3 THEN 'h' WHEN 4 THEN 'd' WHEN 5 THEN '' ELSE 'w' END AS s FROM events)
    SELECT event_id, CASE WHEN event_id % 97 > 0 THEN (event_id % 97) * CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 60000 WHEN 3 THEN 3600000 WHEN 4 THEN 86400000 WHEN 5 THEN 1000 END END AS ms FROM d""")
def parse_duration(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("ms", "s", "m", "h", "d", "", "w")]), (F.col("event_id") % 7 + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", t.parse_duration(F.concat((F.col("event_id") % 97).cast("string"), unit)).alias("ms"))


@query("""SELECT doc_id, coalesce(octet_length(encode(text)) BETWEEN 1 AND 128 AND NOT regexp_matches(text, '[\\x00-\\x1f\\x7f]') AND text <> 'latest' AND NOT starts_with(text, 'rec_'), false) AS valid FROM documents""")
def name_rules(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(t.valid_name(F.col("text")), F.lit(False)).alias("valid"))


def escaped_sql(column):
    for code in (*range(1, 32), 127):
        column = f"replace({column}, chr({code}), '\\u{{{code:x}}}')"
    return column


@query(f"SELECT doc_id, {escaped_sql('text')} AS escaped FROM documents")
def escape_control(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.escape_control(F.col("text")).alias("escaped"))


@query("""WITH u AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS h FROM documents), v AS (SELECT doc_id, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS u FROM u)
    SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN u END AS id, 'rec_' || u AS shown FROM v""")
def parse_ids(spark, sf_dir):
    h = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    u = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("rec_"), u)).when(F.col("doc_id") % 3 == 1, F.upper(u)).otherwise(F.concat(F.lit("REC_"), u))
    return table(spark, sf_dir, "documents").select("doc_id", t.parse_id(raw, "rec_").alias("id"), t.format_id(u, "rec_").alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey < 59001 THEN ((o_orderkey + 999) // 1000)::VARCHAR || 's' ELSE (((o_orderkey + 999) // 1000) // 60)::VARCHAR || 'm ' || (((o_orderkey + 999) // 1000) % 60)::VARCHAR || 's' END AS shown,
    greatest((epoch_us(TIMESTAMP '1998-01-01') - epoch_us(o_orderdate)) // 1000, 0) AS age_ms FROM orders""")
def format_durations(spark, sf_dir):
    age = t.millis_between(F.col("o_orderdate").cast("timestamp"), F.lit("1998-01-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.format_millis(F.col("o_orderkey")).alias("shown"), age.alias("age_ms"))


@query("""SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, event_id % 2 = 0 AS odd_hex FROM events""")
def json_payload(spark, sf_dir):
    k = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"]
    hexed = F.hex(F.col("props").cast("binary"))
    odd = t.decode_hex(F.when(F.col("event_id") % 2 == 0, F.concat(hexed, F.lit("A"))).otherwise(hexed)).isNull()
    return events(spark, sf_dir).select("event_id", k.alias("k"), odd.alias("odd_hex"))


@query("""SELECT page_id, url LIKE '%/en/%' AS safe, 'x-page,x-page,accept' AS names, CASE WHEN page_id % 2 = 0 THEN 'host,accept,content-length' ELSE 'host,x-page,x-page,accept,content-length' END AS sent, 'h' || (page_id * 3)::VARCHAR AS ends FROM pages""")
def header_normalize(spark, sf_dir):
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("binary").alias("value"))
    headers = F.array(header("X-Page", F.col("page_id").cast("string")), header("X-page", F.col("url")), header("Accept", F.lit("*/*")))
    listed = F.when(F.col("page_id") % 2 == 0, "close, X-Page").otherwise("close")
    more = F.array(header("Connection", listed), header("Cookie", F.lit("a=b")), header("Expect", F.lit("100-continue")), header("X-Forwarded-Port", F.lit("1")))
    names = lambda hs: F.array_join(F.transform(hs, lambda h: h["name"]), ",")
    sent = sanitized_headers(F.concat(headers, more), F.lit("h"), F.col("page_id") * 3)
    key = F.concat(F.lit("a/b/c/"), F.when(F.col("url").contains("/en/"), "d").otherwise(".."))
    ends = F.concat(F.element_at(sent, 1)["value"].cast("string"), F.element_at(sent, -1)["value"].cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", t.safe_key(key).alias("safe"), names(normalized_headers(headers)).alias("names"), names(sent).alias("sent"), ends.alias("ends"))


def page_frames(spark, sf_dir):
    """Each page as a connection: a request in two fragments and a response with the page as body, lengths or chunks."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"https?://[^/]+(/[^#]*)", 1).alias("path"), F.col("html").cast("binary").alias("body"))
    size = F.octet_length("body")
    text = lambda c: F.encode(c, "UTF-8")
    path = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    pages = pages.withColumn("path", F.regexp_replace(path, r"[^!-~]", "-"))
    chunked = F.concat(text(F.concat(F.lower(F.hex(size)), F.lit(";x=1\r\n"))), F.col("body"), text(F.lit("\r\n0\r\nX-Trailer: 1\r\n\r\n")))
    head = F.when(F.col("page_id") % 2 == 0, F.lit("Transfer-Encoding: chunked")).otherwise(F.concat(F.lit("Content-Length: "), size.cast("string")))
    status = F.when(F.col("page_id") % 10 == 3, "404 Not Found").otherwise("200 OK")
    response = F.concat(text(F.concat(F.lit("HTTP/1.1 "), status, F.lit("\r\n"), head, F.lit("\r\n\r\n"))), F.when(F.col("page_id") % 2 == 0, chunked).otherwise(F.col("body")))
    request = text(F.concat(F.lit("GET "), F.col("path"), F.lit(" HTTP/1.1\r\nHost: recorded.invalid\r\n\r\n")))
    frame = lambda n, d, c: F.struct(F.lit(n).cast("long").alias("sequence"), F.lit(d).alias("direction"), c.alias("payload"))
    half = F.lit(7)
    frames = F.array(frame(1, "client_to_server", F.substr(request, F.lit(1), half)), frame(2, "client_to_server", F.substr(request, half + 1)), frame(3, "server_to_client", response))
    return pages.select("page_id", F.explode(frames).alias("f")).select("page_id", "f.*")


@query("""SELECT page_id, 'GET' AS method, regexp_replace(CASE WHEN regexp_extract(url, 'https?://[^/]+(/[^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, 'https?://[^/]+(/[^#]*)', 1) END, '[^!-~]', '-', 'g') AS target,
    CASE WHEN page_id % 10 = 3 THEN 404 ELSE 200 END AS status, octet_length(encode(html))::INTEGER AS body_bytes, sha256(html) AS body_sha256, 'read' AS effect, 'complete' AS completeness FROM pages""")
def http_roundtrip(spark, sf_dir):
    none = spark.createDataFrame([], "page_id bigint, truncated boolean, gap boolean, provenance boolean")
    ops = sessions.classify(sessions.decode(page_frames(spark, sf_dir), ["page_id"]), ["page_id"], none)
    return ops.select("page_id", "method", "target", "status", F.octet_length("response").alias("body_bytes"), F.sha2("response", 256).alias("body_sha256"), "effect", "completeness")


def streamed(spark, sf_dir, build, key: list[str], version: str):
    """A streaming query run to its end over events, and of each key the last version that it wrote."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="flowloom-")
    sink = f"{base}/flowloom-stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet")
    stream = build(source.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))))
    keyed.run_to_end(stream, sink, f"{sink}-checkpoint")
    out = StructType(stream.schema.fields + [StructField("batch", LongType())])
    found = spark.read.schema(out).option("basePath", sink).parquet(f"{sink}/batch=*")
    n = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(version), F.desc("batch")))
    return found.withColumn("_n", n).where("_n = 1").drop("_n", "batch")


@query("""WITH e AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
    s AS (SELECT *, (sum(CASE WHEN p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS session FROM e)
    SELECT user_id, session, count(*) AS events, min(event_id) AS first_sequence, max(event_id) AS last_sequence, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration_us FROM s GROUP BY 1, 2""")
def streaming_sessions(spark, sf_dir):
    return streamed(spark, sf_dir, lambda df: keyed.idle_sessions(df, 21_600_000_000), ["user_id", "session"], "events")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def streaming_dedup(spark, sf_dir):
    return streamed(spark, sf_dir, lambda df: keyed.keep_last(df, "user_id"), ["user_id", "event_type"], "event_id")
