"""Operators that rebuild connections from socket events: groups, order, gaps, overlaps, losses, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: TCP sequence numbers wrap here.
WRAP = 1 << 32


def wrapping_minus(a: Column, b: Column) -> Column:
    """a - b modulo 2**32."""
    return F.pmod(a - b, F.lit(WRAP))


def connection_spans(df: DataFrame, conn: list[str], sequence: str, clock: list[str], ns: str) -> DataFrame:
    """Per connection and clock: its events, its range in the log and in time."""
    return df.groupBy(*conn, *clock).agg(F.count("*").alias("events"), F.min(sequence).alias("first_sequence"), F.max(sequence).alias("last_sequence"), F.min(ns).alias("first_ns"), F.max(ns).alias("last_ns"))


def running_limits(df: DataFrame, conn: list[str], sequence: str, size: str, most_bytes: int, most_chunks: int) -> DataFrame:
    """df with chunks, bytes (so far) and over: whether the row is past a limit. The first such row of a connection is
    discarded and ends it; what follows belongs to a new connection (see ``split_at_limits``)."""
    so_far = W.partitionBy(*conn).orderBy(sequence).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = df.withColumn("chunks", F.count("*").over(so_far)).withColumn("bytes", F.sum(size).over(so_far))
    return counted.withColumn("over", (F.col("bytes") > most_bytes) | (F.col("chunks") > most_chunks))


def split_at_limits(df: DataFrame, conn: list[str], sequence: str, size: str, most_bytes: int, most_chunks: int) -> DataFrame:
    """conn, sequence, incarnation, kept: each breach of a limit discards its row and starts the next incarnation empty.

    A breach depends on the one before it, so a connection's sizes are folded in order; the fold's state is three
    numbers and the list of a connection's rows, which the limits themselves bound in a recorder.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(sequence).alias("s"), F.col(size).cast("long").alias("z"))))
    start = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<s:bigint,n:bigint,k:boolean>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        breach = (acc["bytes"] + row["z"] > most_bytes) | (acc["chunks"] + 1 > most_chunks)
        told = F.array(F.struct(row["s"].cast("long").alias("s"), acc["n"].alias("n"), (~breach).alias("k")))
        return F.struct(F.when(breach, 0).otherwise(acc["bytes"] + row["z"]).cast("long").alias("bytes"), F.when(breach, 0).otherwise(acc["chunks"] + 1).cast("long").alias("chunks"), F.when(breach, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.concat(acc["out"], told).alias("out"))

    folded = df.groupBy(*conn).agg(rows.alias("_rows")).select(*conn, F.explode(F.aggregate("_rows", start, step)["out"]).alias("_o"))
    return folded.select(*conn, F.col("_o.s").alias(sequence), F.col("_o.n").alias("incarnation"), F.col("_o.k").alias("kept"))


def idle_sessions(df: DataFrame, conn: list[str], clock: list[str], order: str, ns: Column, idle: int) -> DataFrame:
    """df with session (from 0): a pause of ``idle`` or more, in the order of arrival and on one clock, closes a session."""
    arrival = W.partitionBy(*conn, *clock).orderBy(order)
    pause = ns - F.lag(ns).over(arrival)
    opened = F.when(pause >= idle, 1).otherwise(0)
    return df.withColumn("_opened", opened).withColumn("session", F.sum("_opened").over(arrival.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_opened")


def counter_windows(df: DataFrame, part: list[str], order: str, total: str, generation: str, clock: str) -> DataFrame:
    """Loss windows from samples of a cumulative counter: start, end, delta. A change of clock or generation, or a counter
    that falls, gives an unknown delta; a first sample of 0 and a sample without growth give no window."""
    w = W.partitionBy(*part).orderBy(order)
    last, start = F.lag(total).over(w), F.lag(order).over(w)
    first = start.isNull()
    broken = (F.lag(generation).over(w) != F.col(generation)) | (F.lag(clock).over(w) != F.col(clock)) | (F.col(total) < last)
    kind = F.when(first, F.when(F.col(total) > 0, "first")).when(broken, "unknown").when(F.col(total) > last, "grown")
    delta = F.when(first, F.col(total)).when(~broken, F.col(total) - last)
    return df.select(*part, start.alias("window_start"), F.col(order).alias("window_end"), delta.alias("drop_delta"), kind.alias("kind")).where("kind is not null")


def circular_start(df: DataFrame, part: list[str], sequence: str) -> DataFrame:
    """part, start, ambiguous: the sequence after the largest gap on the circle of 2**32; with a gap of half the circle
    there is no telling, and no start."""
    points = df.select(*part, F.col(sequence).alias("_s")).distinct()
    w = W.partitionBy(*part).orderBy("_s")
    ring = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.lag("_s").over(w), F.last("_s").over(ring))
    gap = F.when(F.count("*").over(ring) == 1, F.lit(WRAP)).otherwise(wrapping_minus(F.col("_s"), before))
    # of equal gaps the first, by the sequence that the gap follows
    best = points.withColumn("_gap", gap).withColumn("_before", before).groupBy(*part).agg(F.max_by("_s", F.struct("_gap", -F.col("_before"))).alias("_start"), F.max("_gap").alias("largest_gap"))
    unsure = F.col("largest_gap") == WRAP // 2
    return best.select(*part, F.when(~unsure, F.col("_start")).alias("start"), "largest_gap", unsure.alias("ambiguous"))


def tcp_order(df: DataFrame, part: list[str], starts: DataFrame, sequence: str, then: list[str]) -> DataFrame:
    """df with position: fragments by their distance from the start of the circle, then by ``then``."""
    w = W.partitionBy(*part).orderBy("_far", *then)
    far = wrapping_minus(F.col(sequence), F.coalesce("start", F.lit(0)))
    return df.join(starts.select(*part, "start"), part, "left").withColumn("_far", far).withColumn("position", F.row_number().over(w)).drop("_far", "start")


def drop_retransmissions(df: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """The first of the fragments that agree in place, length and bytes."""
    n = F.row_number().over(W.partitionBy(*same).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def ambiguous_positions(df: DataFrame, part: list[str], position: list[str], provenance: str) -> DataFrame:
    """part, ambiguous: whether two fragments share a place and one has no provenance."""
    spots = df.groupBy(*part, *position).agg(((F.count("*") > 1) & F.max(F.col(provenance).isNull())).alias("_bad"))
    return spots.groupBy(*part).agg(F.max("_bad").alias("ambiguous"))


def gap_before(df: DataFrame, part: list[str], order: list[str], start: str, length: Column) -> DataFrame:
    """df with gap_before: whether a fragment starts after the end of the row ahead of it (that row, not the furthest end)."""
    end = F.lag(F.col(start) + length).over(W.partitionBy(*part).orderBy(*order))
    return df.withColumn("gap_before", F.coalesce(F.col(start) > end, F.lit(False)))


def overlaps(df: DataFrame, part: list[str], position: str, start: str, length: str) -> DataFrame:
    """part, first, second, kind of every two fragments that overlap on the circle: conflicting (same start) or partial. Empty ones overlap with nothing.

    The join is by connection and direction, whose fragments a recorder's limits bound.
    """
    a = df.select(*part, F.col(position).alias("first"), F.col(start).alias("_s"), F.col(length).alias("_n"))
    b = df.select(*part, F.col(position).alias("second"), F.col(start).alias("_t"), F.col(length).alias("_m"))
    near = (wrapping_minus(F.col("_t"), F.col("_s")) < F.col("_n")) | (wrapping_minus(F.col("_s"), F.col("_t")) < F.col("_m"))
    touch = (F.col("_n") > 0) & (F.col("_m") > 0) & near
    met = a.join(b, part).where((F.col("first") < F.col("second")) & touch)
    return met.select(*part, "first", "second", F.when(F.col("_s") == F.col("_t"), "conflicting").otherwise("partial").alias("kind"))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Rows whose closed intervals meet, by buckets of ``width``: each side is put into the buckets it touches, buckets
    are joined by equality, and a pair counts in the first bucket that both touch."""
    (a, b), (c, d) = left_span, right_span
    low = lambda x: F.expr(f"{x} div {width} - if({x} < 0 and {x} % {width} <> 0, 1, 0)")
    l_ = left.where(F.col(a) <= F.col(b)).withColumn("_bucket", F.explode(F.sequence(low(a), low(b))))
    r_ = right.where(F.col(c) <= F.col(d)).withColumn("_bucket", F.explode(F.sequence(low(c), low(d))))
    meet = (F.col(c) <= F.col(b)) & (F.col(d) >= F.col(a))
    return l_.join(r_, [*on, "_bucket"]).where(meet & (F.col("_bucket") == F.greatest(low(a), low(c)))).drop("_bucket")


def points_inside(points: DataFrame, spans: DataFrame, on: list[str], at: str, span: tuple[str, str], width: int) -> DataFrame:
    """Rows of points whose ``at`` lies in one or more of the closed spans with the same ``on``: of all spans that start
    no later, the furthest end is at or after it. Furthest ends are carried from bucket to bucket of ``width``, and rows
    are ordered inside one bucket only, so no pairs are made and no key is one task."""
    start, end = span
    mine = points.where(F.col(at).isNotNull()).select(*on, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_row"))
    theirs = spans.where(F.col(start) <= F.col(end)).select(*on, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.col(end).alias("_end"))
    line = mine.unionByName(theirs, allowMissingColumns=True).withColumn("_bucket", F.expr(f"_at div {width}"))
    before = F.max("_furthest").over(W.partitionBy(*on).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    base = line.groupBy(*on, "_bucket").agg(F.max("_end").alias("_furthest")).select(*on, "_bucket", before.alias("_base"))
    inside = F.max("_end").over(W.partitionBy(*on, "_bucket").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow))
    told = line.withColumn("_inside", inside).where("_side = 1").join(base, [*on, "_bucket"])
    return told.where(F.greatest("_inside", "_base") >= F.col("_at")).select("_row.*")


def counts_below(points: DataFrame, values: DataFrame, on: list[str], at: str, value: str, width: int) -> DataFrame:
    """points with ``below``: how many rows of values with the same ``on`` are less than ``at``. Buckets of ``width`` are
    counted and summed up, and rows are ranked inside one bucket only, so no pairs are made and no key is one task."""
    mine = points.select(*on, F.col(at).alias("_at"), F.lit(0).alias("_n"), F.struct(*points.columns).alias("_row"))
    line = mine.unionByName(values.select(*on, F.col(value).alias("_at"), F.lit(1).alias("_n")), allowMissingColumns=True).withColumn("_bucket", F.expr(f"_at div {width}"))
    before = F.sum("_sum").over(W.partitionBy(*on).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    base = line.groupBy(*on, "_bucket").agg(F.sum("_n").alias("_sum")).select(*on, "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.sum("_n").over(W.partitionBy(*on, "_bucket").orderBy("_at", "_n").rowsBetween(W.unboundedPreceding, W.currentRow))
    return line.withColumn("_inside", inside).where("_row is not null").join(base, [*on, "_bucket"]).select("_row.*", (F.col("_inside") + F.col("_base")).alias("below"))


def classify_losses(spans: DataFrame, losses: DataFrame, conn: list[str], width: int) -> DataFrame:
    """conn, overlaps, outside, unknown, reset, clock_mismatch: how many of all loss windows are what to each connection.

    spans: conn, clock, first_ns, last_ns. losses: clock, end_clock, start_ns, end_ns, drop_delta (null: unknown), reason.
    A window between two clocks is a mismatch; one of unknown size is a reset if its reason speaks of a generation or of
    counters that regressed, else unknown, wherever it lies; a known one on a clock that the connection has no event of
    is a mismatch, else it overlaps the connection's span or lies outside.
    """
    reset = F.coalesce(F.col("reason").rlike("generation|regressed"), F.lit(False))
    kind = F.when(F.col("clock") != F.col("end_clock"), "clock_mismatch").when(F.col("drop_delta").isNull(), F.when(reset, "reset").otherwise("unknown")).otherwise("known")
    told = losses.withColumn("_kind", kind)
    totals = told.agg(*[F.count_if(F.col("_kind") == k).alias(f"_{k}") for k in ("clock_mismatch", "reset", "unknown", "known")])
    known = told.where("_kind = 'known'")
    on_clock = known.groupBy("clock").agg(F.count("*").alias("_all"))
    early = counts_below(spans, known, ["clock"], "first_ns", "end_ns", width).withColumnRenamed("below", "_early")
    late = counts_below(early.withColumn("_after", F.col("last_ns") + 1), known, ["clock"], "_after", "start_ns", width)
    mine = late.join(on_clock, "clock", "left").groupBy(*conn).agg(F.coalesce(F.sum("_all"), F.lit(0)).alias("_mine"), F.sum(F.col("below") - F.col("_early")).alias("overlaps"))
    both = mine.join(F.broadcast(totals))  # one row
    return both.select(*conn, "overlaps", (F.col("_mine") - F.col("overlaps")).alias("outside"), F.col("_unknown").alias("unknown"), F.col("_reset").alias("reset"), (F.col("_clock_mismatch") + F.col("_known") - F.col("_mine")).alias("clock_mismatch"))


def affected_by_terminal_loss(events: DataFrame, losses: DataFrame, conn: list[str], clock: str, ns: str, width: int) -> DataFrame:
    """Connections with an event inside a terminal loss of its clock, or any event while a loss of another clock exists."""
    points, spans = events.select(*conn, clock, ns), losses.withColumnRenamed("clock", clock)
    inside = points_inside(points, spans, [clock], ns, ("start_ns", "end_ns"), width).select(*conn)
    clocks = losses.select(F.col("clock").alias("_clock")).distinct().agg(F.count("*").alias("_n"), F.min("_clock").alias("_one"))
    other = events.select(*conn, clock).distinct().join(F.broadcast(clocks)).where((F.col("_n") > 1) | ((F.col("_n") == 1) & (F.col(clock) != F.col("_one")))).select(*conn)
    return inside.union(other).distinct()


def first_evidence(events: DataFrame, evidence: DataFrame, conn: list[str], sequence: str, fields: list[str]) -> DataFrame:
    """events with the fields of the first evidence at or before them (null if none came yet).

    One ordered pass over both, by connection: the first evidence is carried along, so no row is joined with another.
    """
    side = evidence.select(*conn, sequence, F.struct(*fields).alias("_e"), F.lit(0).alias("_side"))
    rows = events.withColumn("_e", F.lit(None).cast(side.schema["_e"].dataType)).withColumn("_side", F.lit(1))
    w = W.partitionBy(*conn).orderBy(sequence, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = rows.unionByName(side, allowMissingColumns=True).withColumn("_first", F.first("_e", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*events.columns, *[F.col("_first")[f].alias(f"evidence_{f}") for f in fields])


def latest_before(events: DataFrame, intents: DataFrame, conn: list[str], sequence: str, fields: list[str]) -> DataFrame:
    """events with the fields of the latest intent before them: an as-of join in one ordered pass."""
    side = intents.select(*conn, sequence, F.struct(*fields).alias("_e"), F.lit(0).alias("_side"))
    rows = events.withColumn("_e", F.lit(None).cast(side.schema["_e"].dataType)).withColumn("_side", F.lit(1))
    w = W.partitionBy(*conn).orderBy(sequence, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = rows.unionByName(side, allowMissingColumns=True).withColumn("_last", F.last("_e", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*events.columns, *[F.col("_last")[f].alias(f"intent_{f}") for f in fields])


def evidence_conflicts(df: DataFrame, socket: list[str], fields: list[str]) -> DataFrame:
    """Sockets whose evidence disagrees about family, endpoints or role."""
    return df.groupBy(*socket).agg(F.count_distinct(F.struct(*fields)).alias("versions")).where("versions > 1")


def missing_evidence(events: DataFrame, evidence: DataFrame, socket: list[str]) -> DataFrame:
    """Events of sockets that no evidence names."""
    return events.join(evidence.select(*socket).distinct(), socket, "left_anti")


def endpoints(role: Column, local: Column, remote: Column) -> tuple[Column, Column]:
    """(client, server): an active socket is the client's."""
    active = role == "active"
    return F.when(active, local).otherwise(remote), F.when(active, remote).otherwise(local)


def direction(role: Column, flow: Column) -> Column:
    """client_to_server when the active side sends or the passive side receives."""
    return F.when(((role == "active") & (flow == "egress")) | ((role == "passive") & (flow == "ingress")), "client_to_server").otherwise("server_to_client")


def termination(df: DataFrame, conn: list[str], lost: Column, reset: Column, closed: Column) -> DataFrame:
    """conn, termination: unknown with any loss window that is not outside, else reset, else clean_close; unknown again
    where the connection was not seen to end."""
    seen = F.when(F.max(lost), "unknown").when(F.max(reset), "reset").when(F.max(closed), "clean_close").otherwise("unknown")
    return df.groupBy(*conn).agg(seen.alias("termination"))


def terminal_loss_summary(df: DataFrame, clock: str, ns: str, size: Column) -> DataFrame:
    """Per clock: first and last time, records, bytes; rows without a time in one more entry, with the last time known
    only if there is one clock."""
    timed = df.where(F.col(ns).isNotNull()).groupBy(clock).agg(F.min(ns).alias("start_ns"), F.max(ns).alias("end_ns"), F.count("*").alias("records"), F.sum(size).alias("bytes"))
    rest = df.where(F.col(ns).isNull()).agg(F.count("*").alias("records"), F.sum(size).alias("bytes")).where("records > 0")
    only = timed.agg(F.count("*").alias("_n"), F.max("end_ns").alias("_end"))
    extra = rest.join(F.broadcast(only)).select(F.lit(None).cast(df.schema[clock].dataType).alias(clock), F.lit(None).cast("long").alias("start_ns"), F.when(F.col("_n") == 1, F.col("_end")).alias("end_ns"), "records", "bytes")
    return timed.unionByName(extra)
