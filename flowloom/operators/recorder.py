"""What a recorder decides while it runs: when to commit and rotate, when to sample losses, whether a capture fits, what a
socket's evidence is, and how an interrupted clean-up goes on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.sources.log import MARKER, RECORD_HEADER, SEGMENT_HEADER

# Milliseconds between commits of a group, and a segment's age when it is closed.
COMMIT_EVERY_MS, SEGMENT_AGE_MS = 10, 5 * 60 * 1000
# Fixed value: nanoseconds between samples of the loss counters.
SAMPLE_EVERY_NS = 100_000_000


def segment_poll(now: Column, started: Column, segment_bytes: Column, pending: Column, last_sync: Column, max_age: int = SEGMENT_AGE_MS) -> Column:
    """struct(commit, rotate) of a poll at ``now``: a segment that holds more than its header rotates at its age, and
    pending records are committed before; else they are committed after the interval. A null start: no segment is open."""
    old = F.coalesce((segment_bytes > SEGMENT_HEADER.size) & (F.greatest(now - started, F.lit(0)) >= max_age), F.lit(False))
    waited = F.greatest(now - last_sync, F.lit(0)) >= COMMIT_EVERY_MS
    return F.struct(((pending > 0) & (old | waited)).alias("commit"), old.alias("rotate"))


def due_samples(polls: DataFrame, part: str, at: str, attached: str, every: int = SAMPLE_EVERY_NS) -> DataFrame:
    """part, at of the polls at which a sample is due: the first one ``every`` or later after ``attached``, and from then
    on after the last sample. Null times are never due; polls at one time give one sample.

    A sample depends on the one before, so a part is one pass over its sorted times; what is kept is the next due time,
    and within a batch a binary search finds the next sample.
    """
    rows = polls.where(F.col(at).isNotNull()).select(part, F.col(at).cast("long").alias(at), F.col(attached).cast("long").alias("_attached"))
    schema = rows.select(part, at).schema

    def run(batches):
        own, due = None, 0
        for batch in batches:
            keys, times, began = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            picked = []
            for a, b in zip(starts, starts[1:], strict=False):
                if own is None or own[0] != keys[a]:
                    own, due = (keys[a],), int(began[a]) + every
                i = a + int(np.searchsorted(times[a:b], due))
                while i < b:
                    picked.append(i)
                    due = int(times[i]) + every
                    i = a + int(np.searchsorted(times[a:b], due))
            yield batch.select([0, 1]).take(pa.array(picked, pa.int64()))

    return rows.repartition(F.col(part)).sortWithinPartitions(part, at).mapInArrow(run, schema)


def capture_fits(records: DataFrame, part: list[str], payload_bytes: str, limit: Column, exists: Column) -> DataFrame:
    """part, bytes, verdict: whether captures fit one segment with its header, every record's header and one marker.
    ``exists`` and ``limit`` are said of the part; a destination that exists is refused before anything is counted."""
    fixed = SEGMENT_HEADER.size + RECORD_HEADER.size + MARKER.size
    sums = records.groupBy(*part).agg((F.sum(F.col(payload_bytes) + RECORD_HEADER.size) + fixed).cast("long").alias("bytes"))
    verdict = F.when(exists, "destination_exists").when(F.col("bytes") > limit, "too_large").otherwise("fits")
    return sums.select(*part, "bytes", verdict.alias("verdict"))


def evidence_cache(evidence: DataFrame, socket: list[str], order: str, agree: list[str]) -> DataFrame:
    """evidence with verdict: cached (a socket's first), refreshed (agrees with it in all columns of ``agree``, nulls too)
    or conflict. Evidence of a null socket is left out. The first comes by partial aggregation, so a hot socket is not sorted."""
    first = evidence.groupBy(*socket).agg(F.min_by(F.struct(*agree), order).alias("_first"), F.min(order).alias("_at"))
    met = evidence.join(first, socket)
    same = F.struct(*agree).eqNullSafe(F.col("_first"))
    return met.withColumn("verdict", F.when(F.col(order) == F.col("_at"), "cached").when(same, "refreshed").otherwise("conflict")).drop("_first", "_at")


def cleanup_recovery(enabled: Column, transaction: Column, digest: Column, safe: Column, source: Column, trashed: Column, tombstone: Column) -> Column:
    """How an interrupted clean-up goes on, or why it may not. transaction and digest are the intent's (null digest: no
    intent); source, trashed and tombstone are the digests found in each place, null for none.

    A segment is in its place or in the trash, never in both; only one with the intent's digest is moved or deleted.
    """
    valid = F.coalesce(transaction.rlike("^[A-Za-z0-9_-]{1,128}$") & digest.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    gone = F.when(tombstone.isNull(), "missing_artifact").when(tombstone == digest, "forget_intent").otherwise("invalid_intent")
    return (
        F.when(~enabled, "production_disabled")
        .when(digest.isNull(), "missing_intent")
        .when(~valid, "invalid_intent")
        .when(~safe, "unsafe_path")
        .when(source.isNotNull() & trashed.isNotNull(), "invalid_intent")
        .when(F.coalesce(source, trashed).isNull(), gone)
        .when(F.coalesce(source, trashed) != digest, "digest_mismatch")
        .when(source.isNotNull(), "move_and_delete")
        .otherwise("delete")
    )
