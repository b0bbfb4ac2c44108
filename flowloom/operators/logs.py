"""Operators over a numbered log: what is committed, what is missing, what may go.

Every function takes column names and partitions its windows by ``part`` (a recording, a segment's owner), so a log of
many recordings is spread by recording; a log of one is read in order once, as any reader of it must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _all(w):
    return w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def sequence_gaps(df: DataFrame, part: list[str], sequence: str) -> DataFrame:
    """part, after, before, missing: places where the next sequence is not the last one plus one."""
    last = F.lag(sequence).over(W.partitionBy(*part).orderBy(sequence))
    return df.select(*part, last.alias("after"), F.col(sequence).alias("before")).where(F.col("before") != F.col("after") + 1).withColumn("missing", F.col("before") - F.col("after") - 1)


def committed_prefix(df: DataFrame, part: list[str], sequence: str, is_marker: Column) -> DataFrame:
    """df with committed: whether the row stands at or before its part's last marker. Later rows are invisible to readers."""
    last = df.where(is_marker).groupBy(*part).agg(F.max(sequence).alias("_marker"))
    return df.join(last, part, "left").withColumn("committed", F.coalesce(F.col(sequence) <= F.col("_marker"), F.lit(False))).drop("_marker")


def post_commit_counts(df: DataFrame, part: list[str], sequence: str, is_marker: Column) -> DataFrame:
    """part, committed_records, ignored_post_commit_records: data rows before and after the last marker."""
    return committed_prefix(df, part, sequence, is_marker).where(~is_marker).groupBy(*part).agg(F.count_if("committed").alias("committed_records"), F.count_if(~F.col("committed")).alias("ignored_post_commit_records"))


def commit_batches(df: DataFrame, part: list[str], sequence: str, size: Column, is_marker: Column) -> DataFrame:
    """One row per marker: the batch it closes (first, last, records, bytes) and the durable totals through it."""
    order = W.partitionBy(*part).orderBy(sequence)
    batch = F.coalesce(F.sum(is_marker.cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = df.withColumn("_data", ~is_marker).withColumn("_size", size).withColumn("batch", batch)
    rows = cut.groupBy(*part, "batch").agg(
        F.min(F.when(F.col("_data"), F.col(sequence))).alias("batch_first"), F.max(F.when(F.col("_data"), F.col(sequence))).alias("batch_last"),
        F.count_if("_data").alias("records"), F.coalesce(F.sum(F.when(F.col("_data"), F.col("_size"))), F.lit(0)).alias("bytes"), F.max(F.when(~F.col("_data"), F.col(sequence))).alias("marker"),
    ).where("marker is not null")
    so_far = W.partitionBy(*part).orderBy("batch").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("durable_records", F.sum("records").over(so_far)).withColumn("durable_bytes", F.sum("bytes").over(so_far))


def check_markers(batches: DataFrame, markers: DataFrame, part: list[str]) -> DataFrame:
    """Markers whose own counts (marker, durable_records, durable_bytes, batch_first, batch_last) disagree with the log."""
    said = markers.select(*part, "marker", *[F.col(c).alias(f"_{c}") for c in ("durable_records", "durable_bytes", "batch_first", "batch_last")])
    same = F.lit(True)
    for c in ("durable_records", "durable_bytes", "batch_first", "batch_last"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return said.join(batches, [*part, "marker"], "left").where(~same).select(*part, "marker")


def ordered_digest(df: DataFrame, part: list[str], order: str, value: Column, between: str = ",") -> DataFrame:
    """part, digest: SHA-256 of a part's values in the order of ``order``. A part is a batch, whose size is bounded."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*part).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["v"]), between), 256).alias("digest"))


def batch_cut(df: DataFrame, part: list[str], sequence: str, is_marker: Column, cursor: Column, least: int) -> DataFrame:
    """part, cut, new_records: the first marker after the cursor with ``least`` new data rows before it, else the last with any."""
    fresh = df.where(F.col(sequence) > cursor).withColumn("_data", (~is_marker).cast("long"))
    seen = F.sum("_data").over(W.partitionBy(*part).orderBy(sequence).rowsBetween(W.unboundedPreceding, W.currentRow))
    marks = fresh.withColumn("_seen", seen).where("_data = 0 and _seen > 0")
    cut = marks.groupBy(*part).agg(F.min(F.when(F.col("_seen") >= least, F.struct(sequence, "_seen"))).alias("_full"), F.max(F.struct(sequence, "_seen")).alias("_last"))
    chosen = F.coalesce("_full", "_last")
    return cut.select(*part, chosen[sequence].alias("cut"), chosen["_seen"].alias("new_records"))


def lag_report(df: DataFrame, part: list[str], sequence: str, size: Column, is_marker: Column, committed: Column, created: Column, cursor: Column, now: Column) -> DataFrame:
    """part, records, bytes, age_seconds: the committed rows after the cursor that are no markers, and how long ago the
    segment of the first of them was created (created and now in milliseconds; 0 without such rows, and never less)."""
    late = committed & ~is_marker & (F.col(sequence) > cursor)
    since = F.greatest(now - F.min_by(F.when(late, created), F.when(late, F.col(sequence))), F.lit(0))
    return df.groupBy(*part).agg(F.count_if(late).alias("records"), F.coalesce(F.sum(F.when(late, size)), F.lit(0)).alias("bytes"), F.coalesce(F.floor(since / 1000), F.lit(0)).alias("age_seconds"))


def keep_last(df: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """The last row of each key in the order of position."""
    last = F.row_number().over(W.partitionBy(*key).orderBy(*[F.desc(c) for c in position]))
    return df.withColumn("_n", last).where("_n = 1").drop("_n")


def segment_rollup(df: DataFrame, segment: list[str], sequence: str, size: Column, is_marker: Column, committed: str = "committed") -> DataFrame:
    """Per segment: first and last committed sequence, first and last marker, records, bytes, and whether it has committed rows."""
    inside = F.when(F.col(committed), F.col(sequence))
    marker = F.when(is_marker, F.col(sequence))
    return df.groupBy(*segment).agg(F.min(inside).alias("first_sequence"), F.max(inside).alias("last_committed"), F.min(marker).alias("first_marker"), F.max(marker).alias("last_marker"), F.count("*").alias("records"), F.sum(size).alias("bytes"), F.max(committed).alias("has_committed"))


def reopen_preview(df: DataFrame, part: list[str], sequence: str, size: Column, segment: str, is_marker: Column) -> DataFrame:
    """What reopening a log would discard: complete rows and bytes after the last marker, segments that lie behind it
    whole, the next sequence and the projected size."""
    cut = committed_prefix(df, part, sequence, is_marker).withColumn("_size", size)
    whole = cut.groupBy(*part, segment).agg(F.max("committed").alias("_any"), F.sum("_size").alias("_bytes"))
    gone = whole.groupBy(*part).agg(F.count_if(~F.col("_any")).alias("removed_segments"))
    rows = cut.groupBy(*part).agg(F.count_if(~F.col("committed")).alias("discarded_records"), F.coalesce(F.sum(F.when(~F.col("committed"), F.col("_size"))), F.lit(0)).alias("discarded_bytes"), (F.coalesce(F.max(F.when(F.col("committed"), F.col(sequence))), F.lit(-1)) + 1).alias("next_sequence"), F.coalesce(F.sum(F.when(F.col("committed"), F.col("_size"))), F.lit(0)).alias("projected_bytes"))
    return rows.join(gone, part)


def retention_candidates(df: DataFrame, part: list[str], order: list[str], size: str, limit: int | None, old_enough: Column) -> DataFrame:
    """Rows that may go, oldest first, while what remains of those old enough is over the limit (without one: all)."""
    old = df.where(old_enough)
    order_by = W.partitionBy(*part).orderBy(*order)
    before = F.coalesce(F.sum(size).over(order_by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = old.withColumn("remaining", F.sum(size).over(_all(W.partitionBy(*part))) - before)
    return marked if limit is None else marked.where(F.col("remaining") > limit)


def ahead_of_log(manifest: DataFrame, scanned: DataFrame, segment: list[str]) -> DataFrame:
    """Manifest rows that the log does not bear out: no such segment, another first sequence, a later end, another digest."""
    real = scanned.select(*segment, F.col("first_sequence").alias("_first"), F.col("last_sequence").alias("_last"), F.col("digest").alias("_digest"))
    wrong = F.col("_first").isNull() | (F.col("first_sequence") != F.col("_first")) | (F.col("last_sequence") > F.col("_last")) | (F.col("digest").isNotNull() & (F.col("digest") != F.col("_digest")))
    return manifest.join(real, segment, "left").where(wrong).select(*segment)


def overlapping_ranges(df: DataFrame, part: list[str], first: str, last: str, active: str | None = None) -> DataFrame:
    """part, violations: ranges that begin before the one ahead of them ends, and more than one active range."""
    before = F.lag(last).over(W.partitionBy(*part).orderBy(first))
    seen = df.withColumn("_over", F.coalesce(F.col(first) <= before, F.lit(False)))
    actives = F.greatest(F.count_if(F.col(active)) - 1, F.lit(0)) if active else F.lit(0)
    return seen.groupBy(*part).agg((F.count_if("_over") + actives).alias("violations"))


def lineage(known: DataFrame, current: DataFrame, part: list[str], ordinal: str, digest: str) -> DataFrame:
    """part, relation: equal, prefix, or fork of the known list of (ordinal, digest) against the current one."""
    a = known.select(*part, ordinal, F.col(digest).alias("_known"))
    b = current.select(*part, ordinal, F.col(digest).alias("_now"))
    both = a.join(b, [*part, ordinal], "full_outer")
    fork = F.count_if(F.col("_known").isNotNull() & ~F.col("_known").eqNullSafe(F.col("_now")))
    return both.groupBy(*part).agg(F.when(fork > 0, "fork").when(F.count_if(F.col("_known").isNull()) > 0, "prefix").otherwise("equal").alias("relation"))


def checkpoint_agrees(checkpoints: DataFrame, log: DataFrame, part: list[str], sequence: str, digest: str) -> DataFrame:
    """checkpoints with verdict: agrees, missing (no such sequence in the log) or conflict (another digest)."""
    real = log.select(*part, sequence, F.col(digest).alias("_digest"))
    verdict = F.when(F.col("_digest").isNull(), "missing").when(F.col("_digest") != F.col(digest), "conflict").otherwise("agrees")
    return checkpoints.join(real, [*part, sequence], "left").withColumn("verdict", verdict).drop("_digest")
