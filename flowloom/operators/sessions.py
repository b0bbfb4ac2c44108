"""From a connection's ordered frames to operations, and from operations to published sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from flowloom.functions import http
from flowloom.functions.text import content_uuid
from flowloom.operators.exchanges import completeness, effect

HEADERS = "array<struct<name:string,value:binary>>"
OPERATION = f"sequence bigint, position int, protocol string, method string, target string, status int, request_headers {HEADERS}, response_headers {HEADERS}, request binary, response binary, depth int, codes array<string>"


def decode(frames: DataFrame, conn: list[str], sequence: str = "sequence", direction: str = "direction", payload: str = "payload", protocol: str = "auto") -> DataFrame:
    """conn and an operation's columns: every connection's frames in order through its decoder, one group at a time, which
    the recorder's limits bound. protocol: auto, or a name of the registry that is used without asking."""
    run_ = http.REGISTRY[protocol][1] if protocol != "auto" else http.operations
    schema = T.StructType(frames.select(*conn).schema.fields + T.StructType.fromDDL(OPERATION).fields)
    names = [f.name for f in schema.fields]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(sequence)
        found = run_([(d, int(s), bytes(p or b"")) for d, s, p in zip(ordered[direction], ordered[sequence], ordered[payload], strict=True)])
        pairs = lambda hs: None if hs is None else [{"name": n, "value": v} for n, v in hs]
        out = []
        for position, o in enumerate(found):
            row = dict(zip(conn, key, strict=True)) | {"position": position} | o
            row["request_headers"], row["response_headers"] = pairs(o.get("request_headers")), pairs(o.get("response_headers"))
            out.append([row.get(n) for n in names])
        table = pd.DataFrame(out, columns=names, dtype=object)
        for c in ("status", "depth"):
            table[c] = table[c].astype("Int32")
        return table

    return frames.select(*conn, sequence, direction, payload).groupBy(*conn).applyInPandas(run, schema)


def classify(operations: DataFrame, conn: list[str], troubled: DataFrame) -> DataFrame:
    """operations with effect, completeness and id. troubled: conn, truncated, gap, provenance of connections."""
    rows = operations.join(troubled, conn, "left")
    truncated, gap, known = F.coalesce("truncated", F.lit(False)), F.coalesce("gap", F.lit(False)), F.coalesce("provenance", F.lit(True))
    opaque = F.exists("codes", lambda c: c == "unknown_protocol")
    state = F.when(opaque, "unsupported").otherwise(completeness(F.col("codes"), F.exists("codes", lambda c: c == "truncated_message"), F.col("status").isNotNull(), gap, known))
    # a connection that lost bytes has no complete operation
    state = F.when(truncated & ~opaque, "incomplete").otherwise(state)
    ident = content_uuid("operation", *[F.col(c) for c in conn], F.col("position"), F.col("method"), F.col("target"), F.sha2(F.coalesce("request", F.lit("").cast("binary")), 256), F.sha2(F.coalesce("response", F.lit("").cast("binary")), 256))
    return rows.withColumn("effect", effect(F.col("method"))).withColumn("completeness", state).withColumn("operation_id", ident).drop("truncated", "gap", "provenance")


def timeline(operations: DataFrame, session: list[str], conn_position: str) -> DataFrame:
    """session, position, operation_id, in the order of sequence, connection and place in it."""
    w = W.partitionBy(*session).orderBy("sequence", conn_position, "position")
    return operations.select(*session, F.row_number().over(w).alias("timeline_position"), "operation_id")


def violations(connections: DataFrame, operations: DataFrame, times: DataFrame, session: list[str], conn: str) -> DataFrame:
    """session, problem of sessions that are not whole: ids that repeat, operations of no connection, operations missing
    from the timeline and entries of it without an operation."""
    twice = lambda df, c, name: df.groupBy(*session, c).count().where("count > 1").select(*session, F.lit(name).alias("problem"))
    none = lambda a, b, c, name: a.join(b.select(*session, c), [*session, c], "left_anti").select(*session, F.lit(name).alias("problem"))
    return twice(connections, conn, "duplicate_connection").union(twice(operations, "operation_id", "duplicate_operation")).union(none(operations, connections, conn, "unknown_connection")).union(none(operations, times, "operation_id", "missing_from_timeline")).union(none(times, operations, "operation_id", "unknown_operation")).distinct()


def inspect(operations: DataFrame, session: list[str], conn: str) -> DataFrame:
    """session, connections (array of conn and its operations' methods, targets, statuses and states), blockers, replayability."""
    item = F.struct("sequence", "position", "operation_id", "method", "target", "status", "effect", "completeness")
    per = operations.groupBy(*session, conn).agg(F.array_sort(F.collect_list(item)).alias("operations"), F.count_if(F.col("completeness") == "complete").alias("_yes"), F.count("*").alias("_all"), F.collect_set(F.when(F.col("completeness") != "complete", F.col("completeness"))).alias("_why"))
    out = per.groupBy(*session).agg(F.array_sort(F.collect_list(F.struct(F.col(conn).alias("connection_id"), "operations"))).alias("connections"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_why")))), ",").alias("blockers"), F.sum("_yes").alias("_yes"), F.sum("_all").alias("_all"))
    return out.withColumn("replayability", F.when(F.col("_yes") == 0, "not_replayable").when(F.col("_yes") < F.col("_all"), "partially_replayable").otherwise("fully_replayable")).drop("_yes", "_all")


def from_fixtures(fixtures: DataFrame) -> DataFrame:
    """A fixture's classified operations: events, frames in log order, decoder, completeness."""
    from flowloom.sources.fixtures import capture_events

    events = capture_events(fixtures)
    frames = events.where("kind = 'payload_fragment'").withColumnRenamed("ordinal", "sequence")
    lost = frames.groupBy("fixture", "connection_id").agg(F.max("truncated").alias("truncated"), F.lit(False).alias("gap"), F.lit(True).alias("provenance"))
    return classify(decode(frames, ["fixture", "connection_id"]), ["fixture", "connection_id"], lost)
