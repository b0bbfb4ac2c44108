"""State that goes on from one epoch to the next: whether a snapshot may be restored, when it may be exported, and that a
successor takes it once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the version of state snapshots.
SNAPSHOT_VERSION = 1
#: Limits that a snapshot states, and that those of the restoring side have to equal.
LIMITS = ("max_active", "max_bytes", "max_chunks", "idle_ns")
#: Counts that an exported state has; all but the first are 0.
COUNTS = ("connections", "generations", "partial_frame_bytes", "correlations", "loss_windows", "issues", "segments")


def restore_verdict(snapshots: DataFrame, connections: DataFrame, limits: dict[str, int], part: str, identity: str, finalized: str) -> DataFrame:
    """part, connections, verdict: restored, or the first that holds of unsupported_version, limit_mismatch, bounds (more
    active connections than allowed), duplicate_connection (among them), bounds (of finalized ones), duplicate_connection.

    snapshots: part, version and LIMITS; a null differs from any limit. connections: part, identity, finalized. Counts are
    summed for each connection before each snapshot, so a large snapshot is spread over its connections.
    """
    each = connections.groupBy(part, identity).agg(F.count_if(~F.col(finalized)).alias("_active"), F.count_if(F.col(finalized)).alias("_done"))
    sums = each.groupBy(part).agg(F.sum("_active").alias("_active"), F.sum("_done").alias("_done"), F.max(F.col("_active") > 1).alias("_twice"), F.max(F.col("_active") + F.col("_done") > 1).alias("_again"))
    met = snapshots.join(sums, part, "left").na.fill(0, ["_active", "_done"]).na.fill(False, ["_twice", "_again"])
    other = F.lit(False)
    for name in LIMITS:
        other |= ~F.col(name).eqNullSafe(F.lit(limits[name]))
    verdict = (
        F.when(~F.col("version").eqNullSafe(F.lit(SNAPSHOT_VERSION)), "unsupported_version")
        .when(other, "limit_mismatch")
        .when(F.col("_active") > limits["max_active"], "bounds")
        .when(F.col("_twice"), "duplicate_connection")
        .when(F.col("_done") > limits["max_active"], "bounds")
        .when(F.col("_again"), "duplicate_connection")
        .otherwise("restored")
    )
    return met.select(part, (F.col("_active") + F.col("_done")).alias("connections"), verdict.alias("verdict"))


def export_step(processed: Column, processed_digest: Column, marker: Column, digest: Column) -> Column:
    """catch_up if the processor has not come to the log's last marker, export if it has and their digests agree, else
    digest_mismatch. After catching up it stands at the marker, so it exports."""
    return F.when(~processed.eqNullSafe(marker), "catch_up").when(processed_digest.eqNullSafe(digest), "export").otherwise("digest_mismatch")


def exported_counts(pending: Column) -> list[Column]:
    """COUNTS of an export."""
    return [F.coalesce(pending, F.lit(0)).cast("long").alias(COUNTS[0]), *[F.lit(0).cast("long").alias(c) for c in COUNTS[1:]]]


def hand_over(journal: DataFrame, part: list[str], order: str, state: str, digest: str) -> DataFrame:
    """journal with verdict: accepted, invalid_transition or checksum_mismatch. What is handed over begins as pending;
    from there it gets ready (with a digest), unavailable or failed, and ready it is consumed once, by the same digest.
    A refused entry changes nothing, and one that would consume what is not ready has the wrong checksum.

    So the first entry that leaves pending and, if that was ready, the first that consumes its digest are the accepted
    ones: two aggregations, no pass in order. Entries of a null part are left out.
    """
    s, at = F.col(state), F.col(order)
    left = journal.where(s.isin("ready", "unavailable", "failed")).groupBy(*part).agg(F.min_by(F.struct(at.alias("at"), s.alias("state"), F.col(digest).alias("digest")), at).alias("_left"))
    met = journal.join(left, part, "left")
    takes = (s == "consumed") & (F.col("_left.state") == "ready") & (F.col("_left.digest") == F.col(digest)) & (at > F.col("_left.at"))
    taken = met.where(takes).groupBy(*part).agg(F.min(order).alias("_taken"))
    met = met.join(taken, part, "left")
    good = F.coalesce((at == F.col("_left.at")) | (at == F.col("_taken")), F.lit(False))
    return met.withColumn("verdict", F.when(good, "accepted").when(s == "consumed", "checksum_mismatch").otherwise("invalid_transition")).drop("_left", "_taken")
