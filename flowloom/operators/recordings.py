"""Operators over the catalog: merging what is known of recordings, listing them, and the decisions of running them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Bounds that reports keep to.
MOST_ISSUES, MOST_LISTED = 64, 256


def merge_catalog(sources: list[DataFrame], key: list[str], fields: list[str]) -> DataFrame:
    """One row for each key in any source, each field from the first source (in the order given) that has it, and
    ``found_in``, the positions of the sources that have the key."""
    rows = None
    for i, s in enumerate(sources):
        one = s.select(*key, F.lit(i).alias("_source"), *[(F.col(f) if f in s.columns else F.lit(None)).alias(f) for f in fields])
        rows = one if rows is None else rows.unionByName(one)
    first = lambda f: F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_source"))).alias(f)
    return rows.groupBy(*key).agg(*[first(f) for f in fields], F.array_sort(F.collect_set("_source")).alias("found_in"))


def reconcile_status(published: Column, log_incomplete: Column, log_present: Column, advisory: Column) -> Column:
    """What the stored session and the log say, before the catalog's advisory status: a published session stands unless its
    log is incomplete; a log without one can be recovered, unless the catalog claims that it was published; without either
    the catalog's status holds, and a recording that nothing is known of is in progress."""
    with_log = F.when(advisory.eqNullSafe("published"), "inconsistent").otherwise("recoverable")
    return F.when(published, F.when(log_incomplete, "inconsistent").otherwise("published")).when(log_present, with_log).otherwise(F.coalesce(advisory, F.lit("in_progress")))


def index_by_two_keys(df: DataFrame, first: str, second: str, order: list[str]) -> DataFrame:
    """Rows under either of two keys (null: not under it), the first one winning where a key names several."""
    both = df.withColumn("index_key", F.explode(F.array_distinct(F.array_compact(F.array(first, second)))))
    n = F.row_number().over(W.partitionBy("index_key").orderBy(*order))
    return both.withColumn("_n", n).where("_n = 1").drop("_n")


def latest(df: DataFrame, order: list[str]) -> DataFrame:
    """The one greatest row."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(1)


def resolve(df: DataFrame, reference: str, ident: str, name: str, order: list[str]) -> DataFrame:
    """A reference's rows: latest, else the id, else the exact name if just one row has it."""
    if reference == "latest":
        return latest(df, order)
    match = F.when(F.col(ident).cast("string") == reference, 0).when(F.col(name) == reference, 1)
    found = df.withColumn("_match", match).where("_match is not null")
    w = W.partitionBy()
    best = found.withColumn("_best", F.min("_match").over(w)).where("_match = _best").withColumn("_n", F.count("*").over(w))
    return best.where((F.col("_best") == 0) | (F.col("_n") == 1)).drop("_match", "_best", "_n")


def parent_rollup(df: DataFrame, parent: list[str], operations: str, published: Column) -> DataFrame:
    """parent, sessions, operations, published."""
    return df.groupBy(*parent).agg(F.count("*").alias("sessions"), F.sum(operations).alias("operations"), F.count_if(published).alias("published"))


def null_poison_sum(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, total: a sum that is unknown if any part of it is, or if it does not fit."""
    total = F.try_sum(F.col(value))
    return df.groupBy(*group).agg(F.when(F.count(value) == F.count("*"), total).alias("total"))


def merge_sessions(df: DataFrame, parent: list[str], order: list[str], start: str, end: str, status: str, complete: str = "completed") -> DataFrame:
    """parent, started_at, ended_at, status (the last that is not complete, else complete), sessions."""
    at = F.struct(*order)
    other = F.max_by(F.when(F.col(status) != complete, F.col(status)), F.when(F.col(status) != complete, at))
    return df.groupBy(*parent).agg(F.min(start).alias("started_at"), F.max(end).alias("ended_at"), F.coalesce(other, F.lit(complete)).alias("status"), F.count("*").alias("sessions"))


def merged_evidence(df: DataFrame, parent: list[str], order: str, evidence: str) -> DataFrame:
    """parent, ordinal (from 0), item: the evidence of a parent's sessions one after the other, a row for each item, so that
    no list grows with the sessions. Null and empty lists have no items; only the lists' lengths are put in order."""
    before = W.partitionBy(*parent).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    based = df.select(*parent, order, F.coalesce(F.array_size(evidence), F.lit(0)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    items = df.select(*parent, order, F.posexplode(evidence).alias("_at", "item")).join(based.drop("_n"), [*parent, order])
    return items.select(*parent, (F.col("_base") + F.col("_at")).cast("long").alias("ordinal"), "item")


def epoch_chain(df: DataFrame, parent: list[str], ordinal: str, ident: str, previous: str, following: str, active: str) -> DataFrame:
    """parent, violations: ordinals that skip, links that are not mutual, and another number of active epochs than one.
    Epochs of one ordinal stand in the order of their ids."""
    w = W.partitionBy(*parent).orderBy(ordinal, ident)
    skips = F.coalesce(F.col(ordinal) != F.lag(ordinal).over(w) + 1, F.lit(False))
    linked = df.withColumn("_bad", skips.cast("int") + (~F.col(previous).eqNullSafe(F.lag(ident).over(w))).cast("int") + (~F.col(following).eqNullSafe(F.lead(ident).over(w))).cast("int"))
    return linked.groupBy(*parent).agg((F.sum("_bad") + (F.count_if(active) != 1).cast("int")).alias("violations"))


#: Evidence that is derived from the epochs and can be built again.
DERIVED_EVIDENCE = ("run_summary", "checkpoint")


def reconcile_epochs(catalog: DataFrame, epochs: DataFrame, evidence: DataFrame) -> DataFrame:
    """parent, verdict: of each parent of catalog (parent, digest) with epochs (parent, epoch, ordinal, path) and evidence
    (place, authority, catalog_parent, parent, epoch, ordinal, path, digest), the first error in the order of place, else
    rebuild_derived if derived evidence has another digest, else authoritative; no evidence is no reason to rebuild.

    catalog_parent says whose catalog is asked; errors are mtime_selection_forbidden, parent_identity_conflict,
    lineage_fork (no such epoch, or another ordinal or path) and authority_conflict (a digest that is not derived).
    """
    known = epochs.select(F.col("parent").alias("catalog_parent"), "epoch", F.col("ordinal").alias("_ordinal"), F.col("path").alias("_path"))
    seen = evidence.join(catalog.select(F.col("parent").alias("catalog_parent"), F.col("digest").alias("_digest")), "catalog_parent").join(known, ["catalog_parent", "epoch"], "left")
    other = ~F.col("digest").eqNullSafe(F.col("_digest"))
    error = (
        F.when(F.col("authority") == "filesystem_mtime", "mtime_selection_forbidden")
        .when(~F.col("parent").eqNullSafe(F.col("catalog_parent")), "parent_identity_conflict")
        .when(~F.col("ordinal").eqNullSafe(F.col("_ordinal")) | ~F.col("path").eqNullSafe(F.col("_path")) | F.col("_ordinal").isNull(), "lineage_fork")
        .when(other & ~F.col("authority").isin(*DERIVED_EVIDENCE), "authority_conflict")
    )
    told = seen.withColumn("_error", error).groupBy("catalog_parent").agg(F.min_by("_error", F.when(F.col("_error").isNotNull(), F.col("place"))).alias("_first"), F.max(other).alias("_other"))
    verdict = F.coalesce("_first", F.when(F.col("_other"), "rebuild_derived"), F.lit("authoritative"))
    return catalog.select("parent").join(told.withColumnRenamed("catalog_parent", "parent"), "parent", "left").select("parent", verdict.alias("verdict"))


def cap_issues(df: DataFrame, part: list[str], order: list[str], columns: list[str], most: int = MOST_ISSUES) -> DataFrame:
    """part, ordinal, columns: the first ``most`` issues of a part, and one more row that says how many were left out."""
    n = F.row_number().over(W.partitionBy(*part).orderBy(*order))
    ranked = df.withColumn("ordinal", n)
    kept = ranked.where(F.col("ordinal") <= most).select(*part, "ordinal", *columns, F.lit(0).cast("long").alias("left_out"))
    rest = ranked.where(F.col("ordinal") > most).groupBy(*part).agg(F.count("*").alias("left_out"))
    more = rest.select(*part, F.lit(most + 1).alias("ordinal"), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns], "left_out")
    return kept.unionByName(more)


def union_evidence(parts: dict[str, DataFrame], columns: list[str], order: str) -> DataFrame:
    """All evidence in one table with its kind, by the order given, what has none first."""
    out = None
    for kind, df in parts.items():
        one = df.select(F.lit(kind).alias("kind"), *columns)
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.asc_nulls_first(order))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, rows in a but not b, and in b but not a, as often as they are; nothing if the two are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys of more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def at_most(df: DataFrame, part: list[str], most: int) -> DataFrame:
    """df, or an error as soon as a part has more rows than allowed."""
    n = F.count("*").over(W.partitionBy(*part))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > most, F.raise_error(F.format_string("limit of %d rows exceeded: %d", F.lit(most), F.col("_n"))).cast("boolean")).otherwise(True)).drop("_n")


def put_if_absent(stored: DataFrame, incoming: DataFrame, key: str, digest: str, tombstones: DataFrame | None = None) -> DataFrame:
    """incoming with outcome: created, already_exists_matching, or conflict (another digest, or a tombstone)."""
    have = stored.select(key, F.col(digest).alias("_have"))
    out = incoming.join(have, key, "left")
    gone = F.lit(False)
    if tombstones is not None:
        out = out.join(tombstones.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
        gone = F.coalesce("_gone", F.lit(False))
    outcome = F.when(gone, "conflict").when(F.col("_have").isNull(), "created").when(F.col("_have") == F.col(digest), "already_exists_matching").otherwise("conflict")
    return out.withColumn("outcome", outcome).drop("_have", "_gone")


def tombstone(stored: DataFrame, requests: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, the tombstones): rows are deleted where key and digest agree."""
    hits = stored.join(requests.select(key, digest).distinct(), [key, digest], "left_semi")
    return stored.join(hits.select(key, digest), [key, digest], "left_anti"), hits.select(key, digest)


def list_prefix(df: DataFrame, key: str, prefix: str, limit: int) -> DataFrame:
    """Keys that begin so, sorted, a page of at most MOST_LISTED."""
    return df.where(F.col(key).startswith(prefix)).orderBy(key).limit(min(limit, MOST_LISTED))


def content_addressed(df: DataFrame, session: list[str], data: Column) -> DataFrame:
    """session, payloads, payload_bytes, distinct_payloads, distinct_bytes: bodies by digest, empty ones stay inline."""
    sized = df.select(*session, F.sha2(data.cast("binary"), 256).alias("_sha"), F.octet_length(data).cast("long").alias("_bytes")).where("_bytes > 0")
    one = sized.groupBy(*session, "_sha").agg(F.count("*").alias("_n"), F.max("_bytes").alias("_bytes"))
    return one.groupBy(*session).agg(F.sum("_n").alias("payloads"), F.sum(F.col("_n") * F.col("_bytes")).alias("payload_bytes"), F.count("*").alias("distinct_payloads"), F.sum("_bytes").alias("distinct_bytes"))


def quota_pressure(free: Column, reserved: Column, quota: Column, least_free: Column, managed: Column) -> Column:
    """none while the least free space is there and holds what is reserved; under pressure terminal if the managed bytes
    alone exceed the quota, else recoverable. Subtraction stops at 0."""
    pressured = (free < least_free) | (reserved > F.greatest(free - least_free, F.lit(0)))
    return F.when(~pressured, "none").when(managed > quota, "terminal").otherwise("recoverable")


def reservation_ledger(df: DataFrame, part: list[str], order: str, delta: str, headroom: Column) -> DataFrame:
    """df with reserved (the running sum of reservations and releases) and fits."""
    w = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("reserved", F.sum(delta).over(w)).withColumn("fits", F.col("reserved") <= headroom)


def recorder_status(lifecycle: Column, health: Column, capture: Column, owner_live: Column) -> Column:
    """What a recorder's metadata says of it: failed if it failed or its owner is gone while it worked; ready if it runs
    and captures; starting, recovering, or loading_ebpf while it runs without capturing yet; degraded otherwise."""
    abandoned = ~owner_live & lifecycle.isin("running", "recovering", "draining")
    failed = abandoned | (lifecycle == "failed") | (health == "failed")
    running = lifecycle == "running"
    return F.when(failed, "failed").when(running & (capture == "ready"), "ready").when(lifecycle.isin("starting", "recovering"), lifecycle).when(running, "loading_ebpf").otherwise("degraded")


def illegal_transitions(df: DataFrame, part: list[str], order: str, state: str, allowed: DataFrame) -> DataFrame:
    """part, order, from_state, to_state of steps that the table of allowed ones (from_state, to_state) does not have."""
    steps = df.select(*part, order, F.lag(state).over(W.partitionBy(*part).orderBy(order)).alias("from_state"), F.col(state).alias("to_state")).where("from_state is not null")
    return steps.join(allowed, ["from_state", "to_state"], "left_anti").select(*part, order, "from_state", "to_state")


def stop_reason(fatal: Column, user: Column, source_done: Column, deadline: Column, attached: Column, policy: Column | None = None) -> Column:
    """First that holds and that the policy lets end a run (source_completion, explicit_stop, deadline; by default
    any_terminal_condition). A failure or a user's wish ends any run; an attached target never counts as done."""
    policy = F.lit("any_terminal_condition") if policy is None else policy
    may = lambda name: policy.isin(name, "any_terminal_condition")
    return F.when(fatal, "fatal").when(user, "user").when(source_done & ~attached & may("source_completion"), "source_completed").when(deadline & may("deadline"), "deadline")


def worst_status(df: DataFrame, group: list[str], status: str, required: str) -> DataFrame:
    """group, status, exit_code of probes: unsupported, else not_checked, if a required one is; warnings if any probe has
    one, or one that is not required is unsupported or not checked; else supported. The first two exit with 4."""
    s, must = F.col(status), F.col(required)
    missing = s.isin("unsupported", "not_checked")
    unsupported, unchecked = F.max(must & (s == "unsupported")), F.max(must & (s == "not_checked"))
    warned = F.max((s == "supported_with_warnings") | (~must & missing))
    worst = F.when(unsupported, "unsupported").when(unchecked, "not_checked").when(warned, "supported_with_warnings").otherwise("supported")
    return df.groupBy(*group).agg(worst.alias("status"), F.when(unsupported | unchecked, 4).otherwise(0).alias("exit_code"))


def uncovered(ranges: DataFrame, rows: DataFrame, part: list[str], first: str, last: str, ordinal: str) -> DataFrame:
    """part, ordinal, times of rows that are not in exactly one range. Ranges are marked on the running line of their
    ends (+1 at the start, -1 after the end), so neither side is unfolded."""
    marks = ranges.select(*part, F.col(first).alias("_at"), F.lit(1).alias("_d")).union(ranges.select(*part, (F.col(last) + 1).alias("_at"), F.lit(-1).alias("_d")))
    line = marks.withColumn("_row", F.lit(False)).union(rows.select(*part, F.col(ordinal).alias("_at"), F.lit(0).alias("_d"), F.lit(True).alias("_row")))
    w = W.partitionBy(*part).orderBy("_at", "_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    return line.withColumn("times", F.sum("_d").over(w)).where(F.col("_row") & (F.col("times") != 1)).select(*part, F.col("_at").alias(ordinal), "times")


def ingest_counters(df: DataFrame, group: list[str], kinds: dict[str, Column], size: str) -> DataFrame:
    """A pair of records and bytes for each kind."""
    out = []
    for name, holds in kinds.items():
        out += [F.count_if(holds).alias(f"{name}_records"), F.coalesce(F.sum(F.when(holds, F.col(size))), F.lit(0)).alias(f"{name}_bytes")]
    return df.groupBy(*group).agg(*out)
