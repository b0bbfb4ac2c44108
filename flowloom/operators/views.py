"""What users ask of stored sessions: lists, what keeps a session from being replayed, whether it is whole, and the plan of
replaying a recording epoch by epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Versions of stored data, the warning that does not block a replay, states of runs by catalog status.
SESSION_VERSION, PROTOCOL_DATA_VERSION = 1, 1
HARMLESS_WARNING = "missing_timestamp"
RUN_STATES = {"in_progress": "running", "recoverable": "failed", "failed": "failed", "published": "completed", "inconsistent": "inconsistent"}
VERIFICATIONS = ("passed", "failed", "skipped", "inconclusive", "unsupported")
# Parts of error texts and the warnings they mean, first match first.
WARNINGS = (
    ("transfer encoding", "unsupported_transfer_encoding"),
    ("close-delimited", "unsupported_close_delimited_body"),
    ("informational", "unsupported_informational_response"),
    ("request target", "unsupported_target"),
    ("CONNECT", "unsupported_target"),
    ("upgrade", "unsupported_upgrade"),
    ("version", "unsupported_version"),
)
# What a recorder's metadata says of each error at its start.
FAILURE_CODES = {
    "recovery": "recovery_failure",
    "recovery_detail": "recovery_failure",
    "quota": "quota_pressure",
    "appendable": "appendable_failure",
    "capture_attach": "capture_attach_failure",
    "etl_resume": "etl_resume_failure",
    "lease": "storage_failure",
    "lifecycle": "storage_failure",
}


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, never under 0; null without an end."""
    return F.when(end.isNotNull(), F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000)))


def list_recordings(entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """recording_id, name, created_at, duration_ms, sessions, operations, status, newest first (ties: larger id first).

    entries: recording_id, name, created_at, status, session_id. summaries: recording_id, started_at, ended_at,
    operation_count, one for each recording; one counts only where the catalog knows the session.
    """
    known = F.col("_here") & F.col("session_id").isNotNull()
    met = entries.join(summaries.withColumn("_here", F.lit(True)), "recording_id", "left").withColumn("_known", F.coalesce(known, F.lit(False)))
    rows = met.select("recording_id", "name", "created_at", F.when(F.col("_known"), duration_ms(F.col("started_at"), F.col("ended_at"))).alias("duration_ms"), F.col("_known").cast("int").alias("sessions"), F.when(F.col("_known"), F.col("operation_count")).otherwise(0).alias("operations"), "status")
    return rows.orderBy(F.desc("created_at"), F.desc("recording_id"))


def parent_views(listed: DataFrame, runs: DataFrame, epochs: DataFrame, summaries: DataFrame) -> DataFrame:
    """parent_id, name, created_ms, state, stop_reason, epoch_count, active_epoch, published_epoch_count, sessions,
    operations, duration_ms, warnings, oldest first (ties: smaller id first).

    A recording with a run (parent_id, name, created_ms, state, stop_reason, warnings) shows it, with its epochs
    (parent_id, ordinal, active, published) and all its sessions (summaries); the duration is unknown if a session has not
    ended, or without sessions. One without a run is one epoch of its own, as listed (the result of list_recordings).
    """
    of_epochs = epochs.groupBy("parent_id").agg(F.count("*").alias("epoch_count"), F.min(F.when(F.col("active"), F.col("ordinal"))).alias("active_epoch"), F.count_if("published").alias("published_epoch_count"))
    open_ = F.count_if(F.col("ended_at").isNull()) > 0
    of_sessions = summaries.groupBy(F.col("recording_id").alias("parent_id")).agg(F.count("*").alias("sessions"), F.sum("operation_count").alias("operations"), F.when(~open_, F.sum(duration_ms(F.col("started_at"), F.col("ended_at")))).alias("duration_ms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    columns = ["parent_id", "name", "created_ms", "state", "stop_reason", "epoch_count", "active_epoch", "published_epoch_count", "sessions", "operations", "duration_ms", "warnings"]
    new = runs.join(of_epochs, "parent_id", "left").join(of_sessions, "parent_id", "left")
    new = new.select("parent_id", "name", "created_ms", "state", "stop_reason", zero("epoch_count"), "active_epoch", zero("published_epoch_count"), zero("sessions"), zero("operations"), "duration_ms", "warnings")
    state = F.element_at(F.create_map(*[F.lit(x) for kv in RUN_STATES.items() for x in kv]), F.col("status"))
    old = listed.withColumnRenamed("recording_id", "parent_id").join(runs.select("parent_id"), "parent_id", "left_anti").withColumn("state", state)
    old = old.withColumn("created_ms", F.unix_millis(F.col("created_at").cast("timestamp"))).withColumn("stop_reason", F.lit(None).cast("string")).withColumn("epoch_count", F.lit(1)).withColumn("active_epoch", F.when(F.col("state") == "running", 0))
    old = old.withColumn("published_epoch_count", (F.col("sessions") > 0).cast("int")).withColumn("warnings", F.array().cast("array<string>"))
    return new.select(columns).unionByName(old.select(columns)).orderBy("created_ms", "parent_id")


def replay_blockers(sessions: DataFrame, connections: DataFrame, operations: DataFrame, issues: DataFrame) -> DataFrame:
    """session, blockers (distinct, sorted, comma-joined; empty without any), replayable.

    connections: session, completeness. operations: session, completeness, has_response, warnings (codes). issues: session.
    Sums of reasons move, not the operations themselves.
    """
    rows = connections.where(~F.col("completeness").eqNullSafe("complete")).select("session", F.lit("incomplete_capture").alias("_why"))
    codes = F.transform(F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda c: c != HARMLESS_WARNING), lambda c: F.concat(F.lit("warning:"), c))
    own = F.array_compact(F.array(F.when(~F.col("completeness").eqNullSafe("complete"), "incomplete_operation"), F.when(~F.col("has_response"), "missing_recorded_response")))
    rows = rows.union(operations.select("session", F.explode(F.concat(own, codes)))).union(issues.select("session", F.lit("etl_issues")))
    found = rows.groupBy("session").agg(F.array_join(F.array_sort(F.collect_set("_why")), ",").alias("blockers"))
    return sessions.select("session").join(found, "session", "left").select("session", F.coalesce("blockers", F.lit("")).alias("blockers"), F.col("blockers").isNull().alias("replayable"))


def structure_errors(sessions: DataFrame, connections: DataFrame, operations: DataFrame, states: DataFrame, times: DataFrame) -> DataFrame:
    """session, error, id: all that is not whole in a session; a session may be published if it has no row here.

    sessions: session, version, recording. connections: session, connection. operations: session, connection, operation,
    data_version, owner (the epoch that completed it), ranges (array of epoch and parent). states: session, kind
    (connection or operation), id, which say what is known to be complete or not. times: session, connection, operation.
    """
    at = lambda df, error, c: df.select("session", F.lit(error).alias("error"), F.col(c).cast("string").alias("id"))
    twice = lambda df, c: df.groupBy("session", c).agg(F.count("*").alias("_n")).where("_n > 1")
    without = lambda a, b, c: a.join(b.select("session", c).distinct(), ["session", c], "left_anti")
    conn_states, op_states = (states.where(F.col("kind") == k).select("session", F.col("id").alias(k)) for k in ("connection", "operation"))
    owned = operations.where(F.col("owner").isNotNull() & ~F.exists("ranges", lambda r: r["epoch"].eqNullSafe(F.col("owner"))))
    foreign = operations.join(sessions.select("session", "recording"), "session").where(F.exists("ranges", lambda r: r["parent"].isNotNull() & ~r["parent"].eqNullSafe(F.col("recording"))))
    of = operations.select("session", "operation", F.col("connection").alias("_own")).dropDuplicates(["session", "operation"])
    parts = [
        at(sessions.where(~F.col("version").eqNullSafe(SESSION_VERSION)), "unsupported_schema_version", "version"),
        at(twice(connections, "connection"), "duplicate_connection", "connection"),
        at(without(connections, conn_states, "connection"), "missing_connection_completeness", "connection"),
        at(operations.where(~F.col("data_version").eqNullSafe(PROTOCOL_DATA_VERSION)), "unsupported_protocol_data_version", "operation"),
        at(twice(operations, "operation"), "duplicate_operation", "operation"),
        at(without(operations, op_states, "operation"), "missing_operation_completeness", "operation"),
        at(owned, "completion_owner_missing_range", "operation"),
        at(foreign, "operation_range_parent_mismatch", "operation"),
        at(without(conn_states, connections, "connection"), "unknown_connection_completeness", "connection"),
        at(without(op_states, operations, "operation"), "unknown_operation_completeness", "operation"),
        at(without(times, connections, "connection"), "timeline_unknown_connection", "connection"),
        at(without(times, operations, "operation"), "timeline_unknown_operation", "operation"),
        at(times.join(of, ["session", "operation"]).where(~F.col("connection").eqNullSafe(F.col("_own"))), "timeline_connection_mismatch", "operation"),
        at(twice(times, "operation"), "duplicate_timeline_operation", "operation"),
        at(without(operations, times, "operation"), "missing_timeline_operation", "operation"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def stamp_provenance(operations: DataFrame, times: DataFrame, parent: Column, epoch: Column, ordinal: Column, first: Column, last: Column) -> tuple[DataFrame, DataFrame]:
    """(operations, times) with the operations' epoch ranges, who completed them, how they completed, and ids that follow
    from all that; the timeline (session, position, operation) names them by the new ids.

    operations: session, operation, completeness, ranges (array of struct parent, epoch, ordinal, first, last) and what an
    id hashes: connection, position. A range that is there already is not added again.
    """
    one = F.struct(parent.alias("parent"), epoch.alias("epoch"), ordinal.alias("ordinal"), first.alias("first"), last.alias("last"))
    had = operations.withColumn("_one", one)
    ranges = F.when(F.array_contains("ranges", F.col("_one")), F.col("ranges")).otherwise(F.array_append("ranges", F.col("_one")))
    state = F.when(F.col("completeness").isin("complete", "unsupported"), F.col("completeness")).otherwise("incomplete")
    done = had.withColumn("ranges", ranges).withColumn("owner", epoch).withColumn("completion", state).drop("_one")
    name = F.sha2(F.concat_ws("|", F.col("connection").cast("string"), F.col("position").cast("string"), F.to_json("ranges"), F.col("owner").cast("string"), "completion"), 256)
    done = done.withColumn("_old", F.col("operation")).withColumn("operation", name)
    moved = times.join(done.select("session", F.col("_old").alias("operation"), F.col("operation").alias("_new")), ["session", "operation"], "left")
    return done.drop("_old"), moved.select("session", "position", F.coalesce("_new", F.col("operation").cast("string")).alias("operation"))


def replay_decision(invalid_session: Column, connection: Column, operation: Column, completion: Column, has_response: Column, attributes: Column, protocol: Column, target: Column, recorded: Column, policy: Column, effect: Column, authorized: Column, authentication: Column) -> Column:
    """allowed, or why not, the first that holds: unsupported, execution_not_authorized, an authentication that was not
    allowed, missing_target, recorded_destination, an effect that the policy (a map to booleans) does not allow."""
    says = lambda key, value: F.coalesce(F.try_element_at(attributes, F.lit(key)) == value, F.lit(False))
    whole = connection.eqNullSafe("complete") & operation.eqNullSafe("complete") & completion.eqNullSafe("complete") & has_response & ~says("replayable", "false")
    return (
        F.when(invalid_session | ~whole, "unsupported")
        .when((protocol == "http/1.1") & ~authorized, "execution_not_authorized")
        .when(says("requires_runtime_authorization", "true") & ~authentication, "effect_not_allowed:authentication")
        .when(target.isNull(), "missing_target")
        .when(target == recorded, "recorded_destination")
        .when(F.coalesce(F.try_element_at(policy, effect), F.lit(False)), "allowed")
        .otherwise(F.concat(F.lit("effect_not_allowed:"), effect))
    )


def replay_counters(df: DataFrame, group: list[str], decision: str, attempted: str, state: str, verification: str) -> DataFrame:
    """group and the twelve counts of a replay's operations."""
    some = lambda c, v, name: F.count_if(F.col(c) == v).alias(name)
    known = F.coalesce(F.col(verification).isin(*VERIFICATIONS), F.lit(False))
    out = [some(decision, "allowed", "executable"), F.count_if(~F.col(decision).eqNullSafe("allowed")).alias("non_executable"), F.count_if(attempted).alias("attempted")]
    out += [some(state, "completed", "completed"), some(state, "failed", "failed"), some(state, "not_attempted", "unattempted")]
    out += [some(verification, v, f"verification_{v}") for v in VERIFICATIONS] + [F.count_if(~known).alias("verification_not_run")]
    return df.groupBy(*group).agg(*out)


def warning_code(message: Column) -> Column:
    """The warning that an error's text means: the first part that it holds; malformed otherwise."""
    out = None
    for part, code in WARNINGS:
        out = F.when(message.contains(part), code) if out is None else out.when(message.contains(part), code)
    return out.otherwise("malformed")


def failure_code(error: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FAILURE_CODES.items() for x in kv]), error)


def protocol_data(version: Column, media_type: Column, data: Column, wanted_type: str, schema: str) -> tuple[Column, Column]:
    """(data read by schema, error): read only if version and media type are those that are known."""
    known, whole = version.eqNullSafe(PROTOCOL_DATA_VERSION) & media_type.eqNullSafe(wanted_type), F.try_parse_json(data).isNotNull()
    return F.when(known & whole, F.from_json(data, schema)), F.when(~known, "unsupported_version").when(~whole, "malformed")


def replay_plan(epochs: DataFrame, sessions: DataFrame) -> DataFrame:
    """parent, epoch, ordinal, session, verdict of every epoch of a recording: selected, active_tail_omitted (it still
    runs and has no session), or missing_session, an error."""
    met = epochs.join(sessions.select("parent", "epoch", "session"), ["parent", "epoch"], "left")
    verdict = F.when(F.col("session").isNotNull(), "selected").when(F.col("active"), "active_tail_omitted").otherwise("missing_session")
    return met.select("parent", "epoch", "ordinal", "session", verdict.alias("verdict"))


def frames_by_time(frames: DataFrame, events: DataFrame, conn: list[str]) -> DataFrame:
    """frames with place: by boot and time of the event of the same sequence, then by sequence; those without an event
    have no boot, so they come first, by sequence."""
    met = frames.join(events.select(*conn, "sequence", "boot", "ns"), [*conn, "sequence"], "left")
    order = W.partitionBy(*conn).orderBy(F.coalesce("boot", F.lit("")), F.coalesce("ns", F.lit((1 << 63) - 1)), "sequence")
    return met.withColumn("place", F.row_number().over(order)).drop("boot", "ns")


def streams_by_first(rows: DataFrame, part: list[str], conn: str, sequence: str, active: Column) -> DataFrame:
    """part, conn, first_sequence, active, place: active connections before those that are finished, each kind by its first
    sequence (ties: by connection)."""
    per = rows.groupBy(*part, conn).agg(F.min(sequence).alias("first_sequence"), F.max(active).alias("active"))
    return per.withColumn("place", F.row_number().over(W.partitionBy(*part).orderBy(F.desc("active"), "first_sequence", conn)))


def session_check(sessions: DataFrame, manifests: DataFrame) -> DataFrame:
    """session, verdict of every stored session (session, content, version): its manifest (session, checksum) has to be
    there, to name the content's SHA-256, and the version has to be the known one."""
    met = sessions.join(manifests.select("session", "checksum"), "session", "left")
    verdict = F.when(F.col("checksum").isNull(), "missing_manifest").when(F.sha2(F.col("content").cast("binary"), 256) != F.col("checksum"), "checksum_mismatch").when(~F.col("version").eqNullSafe(SESSION_VERSION), "unsupported_version").otherwise("ok")
    return met.select("session", verdict.alias("verdict"))


def session_summaries(sessions: DataFrame, operations: DataFrame, payloads: DataFrame, limit: int) -> DataFrame:
    """session, operation_count, payload_count of the first ``limit`` sessions by id; bodies are not read."""
    first = sessions.select("session").orderBy("session").limit(limit)
    ops, parts = (df.groupBy("session").agg(F.count("*").alias(c)) for df, c in ((operations, "operation_count"), (payloads, "payload_count")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return first.join(ops, "session", "left").join(parts, "session", "left").select("session", zero("operation_count"), zero("payload_count"))


def artifact_presence(references: DataFrame, store: DataFrame) -> DataFrame:
    """key, verdict of every referenced artifact (key, bytes), by the store's names and sizes (key, bytes) alone."""
    met = references.join(store.select("key", F.col("bytes").alias("_bytes")), "key", "left")
    return met.select("key", F.when(F.col("_bytes").isNull(), "missing").when(F.col("_bytes") != F.col("bytes"), "size_mismatch").otherwise("present").alias("verdict"))


def catalog_bounds(entries: DataFrame, encoded: Column, most: int, most_bytes: int) -> DataFrame:
    """entries, bytes, fits: whether a catalog may be saved."""
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length(encoded)), F.lit(0)).alias("bytes")).withColumn("fits", (F.col("entries") <= most) & (F.col("bytes") <= most_bytes))
