"""From a log to what is known of a recording after a crash: dispatch of records, snapshots, metadata against the scan,
reports, and the checks that a batch, a checkpoint or a step has to pass before it counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Kinds of records, the version of markers, statuses of a recording that still ran.
MARKER_VERSION = 1
RUNNING = ("starting", "recording")
#: The steps of a rollover, in order.
PHASES = ("prepared", "successor_created", "boundary_committed", "topology_activated", "complete")


def dispatch(log: DataFrame, kind: Column, version: Column, payload: Column) -> DataFrame:
    """log with evidence (event, loss_window, terminal_loss or marker) or issue (malformed_ and the record's kind).

    Payloads are JSON with ``kind``: a capture event is any known kind, a loss window's record has to hold a loss window,
    a terminal loss a first and last sequence in order, a marker the known version and a count.
    """
    read = F.from_json(payload, "kind string, first long, last long, records long")
    inner = read["kind"]
    ok = (
        F.when(kind == "capture_event", inner.isNotNull())
        .when(kind == "loss_window", inner == "loss_window_observed")
        .when(kind == "terminal_loss", (version == MARKER_VERSION) & (read["first"] <= read["last"]))
        .when(kind == "commit_marker", (version == MARKER_VERSION) & (read["records"] >= 0))
    )
    good = F.coalesce(ok, F.lit(False))
    evidence = F.when((kind == "capture_event") & (inner != "loss_window_observed"), "event").when(kind.isin("capture_event", "loss_window"), "loss_window").when(kind == "terminal_loss", "terminal_loss").otherwise("marker")
    return log.withColumn("evidence", F.when(good, evidence)).withColumn("issue", F.when(~good, F.concat(F.lit("malformed_"), kind)))


def committed_snapshot(log: DataFrame, part: list[str], sequence: str, size: str, is_marker: Column, segment: str, data: list[str]) -> DataFrame:
    """part, marker, records, bytes, first_segment, last_segment, marker_digest, input_digest of every log with a marker:
    what stands up to the last marker; markers count as no records. The input's digest is the exclusive or of its rows'
    hashes, with their sequences in them, so it needs no order and partial sums unite it."""
    last = log.where(is_marker).groupBy(*part).agg(F.max(sequence).alias("marker"))
    inside = log.withColumn("_mark", is_marker).join(last, part).where(F.col(sequence) <= F.col("marker"))
    row, data_row = F.xxhash64(F.col(sequence), *data), ~F.col("_mark")
    return inside.groupBy(*part, "marker").agg(F.count_if(data_row).alias("records"), F.coalesce(F.sum(F.when(data_row, F.col(size))), F.lit(0)).alias("bytes"), F.min(segment).alias("first_segment"), F.max(segment).alias("last_segment"), F.bit_xor(F.when(F.col(sequence) == F.col("marker"), row)).alias("marker_digest"), F.bit_xor(row).alias("input_digest"))


def post_marker(log: DataFrame, part: list[str], sequence: str, size: str, is_marker: Column) -> DataFrame:
    """part, marker (null: none), committed_records, committed_bytes, uncommitted_records, uncommitted_bytes,
    first_uncommitted, last_uncommitted. Markers count as no committed records."""
    last = log.where(is_marker).groupBy(*part).agg(F.max(sequence).alias("marker"))
    rows = log.withColumn("_mark", is_marker).join(last, part, "left").withColumn("_in", F.coalesce(F.col(sequence) <= F.col("marker"), F.lit(False)))
    data = F.col("_in") & ~F.col("_mark")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(size))), F.lit(0))
    after = F.when(~F.col("_in"), F.col(sequence))
    return rows.groupBy(*part).agg(F.max("marker").alias("marker"), F.count_if(data).alias("committed_records"), total(data).alias("committed_bytes"), F.count_if(~F.col("_in")).alias("uncommitted_records"), total(~F.col("_in")).alias("uncommitted_bytes"), F.min(after).alias("first_uncommitted"), F.max(after).alias("last_uncommitted"))


def reconcile_metadata(scanned: DataFrame, metadata: DataFrame, part: str) -> DataFrame:
    """scanned (the result of post_marker) with status, shutdown_reason, error and updated.

    metadata: part, selector, wanted_selector, status, shutdown_reason, marker, committed_records, committed_bytes,
    uncommitted_records, uncommitted_bytes. The log decides boundary and counts; without metadata, or where it says that
    the recorder still ran, the recording was aborted by a crash. Another selector than the wanted one is an error.
    """
    counted = ["marker", "committed_records", "committed_bytes", "uncommitted_records", "uncommitted_bytes"]
    said = metadata.select(part, "selector", "wanted_selector", F.col("status").alias("_status"), F.col("shutdown_reason").alias("_reason"), F.lit(True).alias("_here"), *[F.col(c).alias(f"_{c}") for c in counted])
    met = scanned.join(said, part, "left")
    crashed = F.col("_here").isNull() | F.col("_status").isin(*RUNNING)
    same = F.coalesce(F.col("_here"), F.lit(False)) & ~F.coalesce(F.col("_status").isin(*RUNNING), F.lit(False))
    for c in counted:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    error = F.when(F.col("wanted_selector").isNotNull() & ~F.col("selector").eqNullSafe(F.col("wanted_selector")), "selector_mismatch")
    return met.select(*scanned.columns, F.when(crashed, "aborted").otherwise(F.col("_status")).alias("status"), F.when(crashed, "process_crash_recovered").otherwise(F.col("_reason")).alias("shutdown_reason"), error.alias("error"), (~same).alias("updated"))


def recovery_report(reconciled: DataFrame, part: str, tails: DataFrame, more: DataFrame) -> DataFrame:
    """reconciled with partial_tail_offset, repaired_bytes, limit_loss_records and issues (distinct codes, sorted, joined).

    tails: part, partial_tail_offset, repaired_bytes, limit_loss_records. more: part, code of issues found elsewhere.
    """
    codes = more.groupBy(part).agg(F.collect_set("code").alias("_codes"))
    met = reconciled.join(tails, part, "left").join(codes, part, "left")
    own = F.array_compact(F.array(F.when(F.col("repaired_bytes") > 0, "tail_repaired"), F.when(F.col("partial_tail_offset").isNotNull(), "partial_tail"), F.when(F.col("limit_loss_records") > 0, "wal_limit_loss")))
    issues = F.array_join(F.array_sort(F.array_union(own, F.coalesce("_codes", F.array().cast("array<string>")))), ",")
    return met.withColumn("issues", issues).drop("_codes")


def parent_context(epochs: DataFrame, catalog: DataFrame) -> DataFrame:
    """epoch, parent, ordinal, verdict: found, or unknown_epoch, of every epoch asked about, by the catalog (epoch, parent, ordinal)."""
    return epochs.select("epoch").join(catalog, "epoch", "left").select("epoch", "parent", "ordinal", F.when(F.col("parent").isNull(), "unknown_epoch").otherwise("found").alias("verdict"))


def repair_tail(rows: DataFrame, tails: DataFrame, part: list[str], segment: str, offset: str, size: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, report): of each log the bytes of its final segment from the tail's offset on go.

    tails: part, tail_offset (null: the log ends whole). report: part, truncated_to, repaired_bytes. Tails in other
    segments than the final one are damage, not tails, and stay.
    """
    final = rows.groupBy(*part).agg(F.max(segment).alias("_final"))
    met = rows.join(final, part).join(tails, part, "left")
    gone = F.coalesce((F.col(segment) == F.col("_final")) & (F.col(offset) >= F.col("tail_offset")), F.lit(False))
    report = met.groupBy(*part).agg(F.max("tail_offset").alias("truncated_to"), F.coalesce(F.sum(F.when(gone, F.col(size))), F.lit(0)).alias("repaired_bytes"))
    return met.where(~gone).select(rows.columns), report


def plan_batches(checkpoints: DataFrame, rows: DataFrame, part: str, sequence: str, lineage: DataFrame) -> DataFrame:
    """part, verdict, first_new, new_rows of an incremental batch: regression, lineage_mismatch or gap refuse it, else ok.

    checkpoints: part, last_marker, last_digest (null: none yet), marker, digest (of the snapshot), first_sequence.
    rows: part and sequence of the snapshot's rows. lineage: part, ordinal, and old_ and new_ first, last, digest of each
    segment that was or is known. Rows are compared with their neighbours, so a log is one ordered pass.
    """
    w = W.partitionBy(part).orderBy(sequence)
    fresh = rows.join(checkpoints.select(part, "last_marker", "first_sequence"), part).where(F.col("last_marker").isNull() | (F.col(sequence) > F.col("last_marker")))
    before = F.coalesce(F.lag(sequence).over(w), F.col("last_marker"), F.col("first_sequence") - 1)
    seen = fresh.withColumn("_gap", F.col(sequence) != before + 1).groupBy(part).agg(F.max("_gap").alias("_gap"), F.min(sequence).alias("first_new"), F.max(sequence).alias("_last"), F.count("*").alias("new_rows"))
    old = F.col("old_first").isNotNull()
    fork = old & (F.col("new_first").isNull() | (F.col("old_first") != F.col("new_first")) | (F.col("old_last") > F.col("new_last")) | ((F.col("old_last") == F.col("new_last")) & (F.col("old_digest") != F.col("new_digest"))))
    forks = lineage.groupBy(part).agg(F.max(F.coalesce(fork, F.lit(False))).alias("_fork"))
    met = checkpoints.join(seen, part, "left").join(forks, part, "left")
    marked = F.coalesce("last_marker", F.lit(0))
    verdict = (
        F.when(F.col("marker") < F.col("last_marker"), "regression")
        .when((F.col("marker") == F.col("last_marker")) & ~F.col("digest").eqNullSafe(F.col("last_digest")), "lineage_mismatch")
        .when(F.col("new_rows").isNull() & (F.col("marker") != marked), "gap")
        .when(F.col("_gap") | (F.col("_last") != F.col("marker")), "gap")
        .when(F.col("last_marker").isNotNull() & F.col("_fork"), "lineage_mismatch")
        .otherwise("ok")
    )
    return met.select(part, verdict.alias("verdict"), "first_new", F.coalesce("new_rows", F.lit(0)).alias("new_rows"))


def recover_publication(candidates: DataFrame, existing: DataFrame, store: DataFrame, part: str) -> DataFrame:
    """part, outcome of every interrupted publication: output_lineage (the pending checkpoint does not extend the durable
    one, or an output of that is gone), verification (an output differs from the store's), discarded (an output was
    never written), already_consistent, adopted_output, or repaired_checkpoint (there was no durable one).

    candidates and existing: part, ordinal, key, digest of the outputs that a checkpoint lists. store: key, digest.
    """
    had = existing.select(part, "ordinal", F.col("key").alias("_key"), F.col("digest").alias("_digest"), F.lit(True).alias("_old"))
    rows = candidates.withColumn("_new", F.lit(True)).join(had, [part, "ordinal"], "full_outer").join(store.select("key", F.col("digest").alias("_stored")), "key", "left")
    old, new = F.coalesce("_old", F.lit(False)), F.coalesce("_new", F.lit(False))
    told = rows.groupBy(part).agg(
        F.max(new).alias("_any"),
        F.max(old & (~new | (F.col("key") != F.col("_key")) | (F.col("digest") != F.col("_digest")))).alias("_fork"),
        F.max(new & (F.col("_stored") != F.col("digest"))).alias("_differs"),
        F.max(old & new & F.col("_stored").isNull()).alias("_lost"),
        F.max(new & F.col("_stored").isNull()).alias("_absent"),
        F.max(old).alias("_had"),
        F.max(new & ~old).alias("_more"),
    )
    outcome = F.when(F.col("_fork"), "output_lineage").when(F.col("_differs"), "verification").when(F.col("_lost"), "output_lineage").when(F.col("_absent"), "discarded").when(~F.col("_had"), "repaired_checkpoint").when(F.col("_more"), "adopted_output").otherwise("already_consistent")
    return told.where("_any").select(part, outcome.alias("outcome"))


def compact_lifecycle(entries: DataFrame, part: list[str], ordinal: str, complete: Column, retain_from: Column) -> DataFrame:
    """part, kept, dropped, first_retained, error of every index of cleaned segments: entries from an epoch on stay, older
    ones go if their cleanup is complete; an older one that is not refuses the compaction."""
    young = F.col(ordinal) >= retain_from
    rows = entries.withColumn("_kept", young | ~complete).withColumn("_stuck", ~young & ~complete)
    return rows.groupBy(*part).agg(F.count_if("_kept").alias("kept"), F.count_if(~F.col("_kept")).alias("dropped"), F.min(F.when(F.col("_kept"), F.col(ordinal))).alias("first_retained"), F.when(F.max("_stuck"), "metadata_limit").alias("error"))


def rollover_steps(journal: DataFrame, part: list[str], order: str, phase: str) -> DataFrame:
    """part, order, phase, legal of every entry: a rollover begins prepared and goes on by one phase at a time."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col(phase)) - 1
    before = F.lag(rank).over(W.partitionBy(*part).orderBy(order))
    return journal.select(*part, order, phase, F.coalesce(rank == F.coalesce(before + 1, F.lit(0)), F.lit(False)).alias("legal"))


def outcome_ranges(ranges: DataFrame, admitted: DataFrame, part: list[str], first: str, last: str) -> DataFrame:
    """part, first, last, verdict of every range of observations that an epoch's end assigned: backward, beyond (what was
    admitted), overlaps (an earlier range), or ok. One ordered pass: a range overlaps if one before it reaches into it."""
    reach = F.max(last).over(W.partitionBy(*part).orderBy(first, last).rowsBetween(W.unboundedPreceding, -1))
    met = ranges.withColumn("_reach", reach).join(admitted, part, "left")
    verdict = F.when(F.col(first) > F.col(last), "backward").when(F.col(last) >= F.coalesce("admitted", F.lit(0)), "beyond").when(F.col(first) <= F.col("_reach"), "overlaps").otherwise("ok")
    return met.select(*part, first, last, verdict.alias("verdict"))


def admit(rows: DataFrame, part: list[str], order: str, size: str, most: int, most_bytes: int) -> DataFrame:
    """rows with outcome: accepted, rejected (the queue of ``most`` between two drains is full) or terminal_loss (the log
    of ``most_bytes`` is full; nothing is accepted from there on). part ends with what counts the drains."""
    w = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*part[:-1]).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = rows.withColumn("_n", F.count("*").over(w)).withColumn("_sum", F.sum(F.when(F.col("_n") <= most, F.col(size)).otherwise(0)).over(whole))
    return queued.withColumn("outcome", F.when(F.col("_sum") > most_bytes, "terminal_loss").when(F.col("_n") > most, "rejected").otherwise("accepted")).drop("_n", "_sum")
