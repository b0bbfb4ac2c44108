"""Capture fixtures: JSON documents of connections and payload events, checked and turned into capture events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ENDPOINT = "struct<host:string,port:int>"
SCHEMA = f"""schema_version int, connections array<struct<id:string,socket_cookie:bigint,first_seen_ns:bigint,network_namespace:bigint,local_endpoint:{ENDPOINT},
    remote_endpoint:{ENDPOINT},role:string,transport:string,process:struct<pid:int,tid:int,executable:string>>>,
    events array<struct<sequence:bigint,timestamp:string,connection_id:string,direction:string,payload_hex:string,truncated:boolean,flags:int>>"""


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, with its name as ``fixture``."""
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path).withColumn("fixture", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def connections(fixtures: DataFrame) -> DataFrame:
    return fixtures.select("fixture", F.posexplode("connections").alias("position", "c")).select("fixture", "position", "c.*")


def payloads(fixtures: DataFrame) -> DataFrame:
    rows = fixtures.select("fixture", F.explode("events").alias("e")).select("fixture", "e.*")
    return rows.withColumn("payload", F.when(F.col("payload_hex").rlike("^([0-9a-fA-F]{2})*$"), F.unhex("payload_hex"))).withColumn("at", F.try_to_timestamp("timestamp"))


def problems(fixtures: DataFrame) -> DataFrame:
    """fixture, problem: what keeps a fixture from being used; no rows if all are good."""
    c, e = connections(fixtures), payloads(fixtures)
    w = W.partitionBy("fixture").orderBy("sequence")
    found = [
        fixtures.where(~F.col("schema_version").eqNullSafe(1)).select("fixture", F.lit("schema_version").alias("problem")),
        c.groupBy("fixture", "id").count().where("count > 1 or id is null or id = ''").select("fixture", F.lit("connection_id")),
        c.groupBy("fixture", "socket_cookie", "first_seen_ns", "network_namespace").count().where("count > 1").select("fixture", F.lit("socket")),
        c.where("transport <> 'tcp' or role not in ('active', 'passive')").select("fixture", F.lit("transport_or_role")),
        c.where("local_endpoint.port not between 1 and 65535 or remote_endpoint.port not between 1 and 65535 or contains(local_endpoint.host, ':') <> contains(remote_endpoint.host, ':')").select("fixture", F.lit("endpoint")),
        e.withColumn("n", F.row_number().over(w)).where("sequence is null or sequence <> n").select("fixture", F.lit("sequence")),
        e.withColumn("p", F.lag("at").over(w)).where("at is null or at < p").select("fixture", F.lit("timestamp")),
        e.where("payload is null or direction not in ('client_to_server', 'server_to_client')").select("fixture", F.lit("payload")),
        e.join(c.select("fixture", F.col("id").alias("connection_id")), ["fixture", "connection_id"], "left_anti").select("fixture", F.lit("unknown_connection")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def capture_events(fixtures: DataFrame) -> DataFrame:
    """fixture, connection_id, ordinal, kind, direction, tcp_sequence, ns, payload, truncated: a socket_connected event for
    each connection first, then the payloads in order (a payload's sequence is its TCP sequence, and is added to the time)."""
    c = connections(fixtures)
    opened = c.select("fixture", F.col("id").alias("connection_id"), F.col("position").cast("long").alias("ordinal"), F.lit("socket_connected").alias("kind"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("long").alias("tcp_sequence"), F.col("first_seen_ns").alias("ns"), F.lit(None).cast("binary").alias("payload"), F.lit(False).alias("truncated"))
    many = c.groupBy("fixture").agg(F.count("*").alias("_n"))
    sent = payloads(fixtures).join(many, "fixture").join(c.select("fixture", F.col("id").alias("connection_id"), "first_seen_ns"), ["fixture", "connection_id"])
    sent = sent.select("fixture", "connection_id", (F.col("_n") + F.col("sequence") - 1).alias("ordinal"), F.lit("payload_fragment").alias("kind"), "direction", F.col("sequence").alias("tcp_sequence"), (F.col("first_seen_ns") + F.col("sequence")).alias("ns"), "payload", "truncated")
    return opened.unionByName(sent)
