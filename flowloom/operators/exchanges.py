"""Operators over decoded operations: pairing, completeness, replay decisions, verification, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Methods by effect, headers that are not sent on, headers that are not compared.
READS = ("GET", "HEAD", "OPTIONS")
WRITES = ("POST", "PUT", "PATCH", "DELETE")
NOT_SENT = ("connection", "keep-alive", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "authorization", "proxy-authorization", "cookie", "forwarded", "expect", "host", "content-length")
NOT_SENT_PREFIX = "x-forwarded-"
NOT_COMPARED = ("date", "server", "content-length", "connection", "transfer-encoding", "keep-alive", "set-cookie")


def effect(method: Column) -> Column:
    """read, write or unknown."""
    return F.when(method.isin(*READS), "read").when(method.isin(*WRITES), "write").otherwise("unknown")


def pair_by_rank(df: DataFrame, conn: list[str], sequence: str, is_request: Column, is_response: Column) -> DataFrame:
    """conn, rank, request, response: the i-th request with the i-th response, leftovers of both kinds kept. Right where
    every response follows its request; ``pair_fifo`` is the queue itself."""
    n = F.row_number().over(W.partitionBy(*conn).orderBy(sequence))
    asked = df.where(is_request).select(*conn, n.alias("rank"), F.col(sequence).alias("request"))
    told = df.where(is_response).select(*conn, n.alias("rank"), F.col(sequence).alias("response"))
    return asked.join(told, [*conn, "rank"], "full_outer")


def pair_fifo(df: DataFrame, conn: str, sequence: str, kind: str) -> DataFrame:
    """conn, request, response, state (paired, orphan_response, unmatched_request): a queue per connection. A response
    takes the oldest request that waits; one that finds none is an orphan. kind holds request and response.

    Without its orphans, the k-th response takes the k-th request; ``fifo_states`` tells the orphans."""
    asks = F.col(kind) == "request"
    rows = fifo_states(df.where(F.col(kind).isin("request", "response")).select(conn, sequence, kind), [conn], sequence, asks, F.col(kind) == "response")
    rank = F.row_number().over(W.partitionBy(conn, kind, "orphan").orderBy(sequence))
    place = F.struct("orphan", rank.alias("rank"))
    met = rows.withColumn("_place", place).groupBy(conn, "_place").agg(F.max(F.when(asks, F.col(sequence))).alias("request"), F.max(F.when(~asks, F.col(sequence))).alias("response"))
    state = F.when(F.col("response").isNull(), "unmatched_request").when(F.col("request").isNull(), "orphan_response").otherwise("paired")
    return met.select(conn, "request", "response", state.alias("state"))


def fifo_states(df: DataFrame, conn: list[str], sequence: str, is_request: Column, is_response: Column) -> DataFrame:
    """The queue's states without a queue: df's requests and responses with waiting (requests outstanding after the row)
    and orphan (a response that found none). What waits is the running sum minus its lowest point so far."""
    step = F.when(is_request, 1).when(is_response, -1)
    w = W.partitionBy(*conn).orderBy(sequence).rowsBetween(W.unboundedPreceding, W.currentRow)
    s = df.withColumn("_step", step).where("_step is not null").withColumn("_sum", F.sum("_step").over(w))
    floor = F.least(F.lit(0), F.min("_sum").over(w))
    before = F.least(F.lit(0), F.min("_sum").over(W.partitionBy(*conn).orderBy(sequence).rowsBetween(W.unboundedPreceding, -1)))
    return s.withColumn("waiting", F.col("_sum") - floor).withColumn("orphan", (F.col("_step") == -1) & (floor < F.coalesce(before, F.lit(0)))).drop("_step", "_sum")


def completeness(codes: Column, truncated: Column, has_response: Column, gap: Column, has_provenance: Column) -> Column:
    """First that holds: malformed, unsupported, truncated, unmatched, incomplete, complete."""
    unsupported = F.exists(codes, lambda c: (c == "pipelined") | c.startswith("unsupported_"))
    return (
        F.when(F.exists(codes, lambda c: c == "malformed"), "malformed").when(unsupported, "unsupported").when(truncated, "truncated")
        .when(~has_response, "unmatched").when(gap | ~has_provenance, "incomplete").otherwise("complete")
    )


def replay_decision(supported: Column, authorized: Column, carries_credentials: Column, has_target: Column, is_recorded_destination: Column, allowed: Column) -> Column:
    """First that holds: what keeps an operation from being replayed, else execute."""
    return (
        F.when(~supported, "unsupported").when(~authorized, "not_authorized").when(carries_credentials, "authorization_header").when(~has_target, "missing_target")
        .when(is_recorded_destination, "recorded_destination").when(~allowed, "effect_not_allowed").otherwise("execute")
    )


def allowed_by(policy: Column, effect_: Column) -> Column:
    """A policy's (a map of effects to booleans) word on an effect; what it does not name is not allowed."""
    return F.coalesce(F.try_element_at(policy, effect_), F.lit(False))


def first_rule(operations: DataFrame, rules: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """operations with the target of the first rule (by ordinal) whose fields agree; a null field of a rule agrees with all.

    Rules are split by which fields they name, each kind is joined by equality on those, so nothing is tried on every
    pair; a rule table is joined as Spark sees fit for its size.
    """
    found = None
    for mask in range(1 << len(fields)):
        named = [f for i, f in enumerate(fields) if mask >> i & 1]
        some = rules
        for f in fields:
            some = some.where(F.col(f).isNotNull() if f in named else F.col(f).isNull())
        some = some.groupBy(*named).agg(F.min(F.struct("ordinal", "target")).alias("_rule"))
        met = operations.select(key, *fields).join(some, named) if named else operations.select(key).join(F.broadcast(some.where("_rule is not null")))
        met = met.select(key, "_rule")
        found = met if found is None else found.unionByName(met)
    best = found.groupBy(key).agg(F.min("_rule").alias("_rule"))
    return operations.join(best, key, "left").withColumn("target", F.col("_rule.target")).withColumn("rule", F.col("_rule.ordinal")).drop("_rule")


def sanitized_headers(headers: Column, host: Column, length: Column) -> Column:
    """Headers (array of name, value) that may be sent on, names in lower case: Host first, then those that are no
    hop-by-hop, credential or forwarding ones and that Connection does not name, Content-Length last."""
    lists = F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == "connection"), lambda h: F.lower(h["value"].cast("string")))
    named = F.transform(F.split(F.array_join(lists, ","), ","), lambda t: F.trim(t))
    lower = F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    kept = F.filter(lower, lambda h: ~h["name"].isin(*NOT_SENT) & ~h["name"].startswith(NOT_SENT_PREFIX) & ~F.array_contains(named, h["name"]))
    one = lambda name, value: F.array(F.struct(F.lit(name).alias("name"), value.cast("binary").alias("value")))
    return F.concat(one("host", host), kept, one("content-length", length.cast("string")))


def comparable_headers(headers: Column) -> Column:
    """Headers in order, duplicates kept, without those that differ between two runs by nature."""
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin(*NOT_COMPARED))


def normalized_headers(headers: Column) -> Column:
    return F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))


def verify(recorded: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """key, verdict: passed, or the first difference (no_response, status, headers, body) between recorded and observed
    (status, headers, body)."""
    seen = observed.select(key, *[F.col(c).alias(f"_{c}") for c in ("status", "headers", "body")], F.lit(True).alias("_here"))
    body = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("").cast("binary")), 256)
    same = comparable_headers(F.col("headers")).eqNullSafe(comparable_headers(F.col("_headers")))
    verdict = F.when(F.col("_here").isNull(), "no_response").when(~F.col("status").eqNullSafe(F.col("_status")), "status").when(~same, "headers").when(body("body") != body("_body"), "body").otherwise("passed")
    return recorded.join(seen, key, "left").select(key, verdict.alias("verdict"))


def payload_size(kind: Column, data: Column, size: Column, original: Column) -> Column:
    """Bytes of a payload reference: inline, artifact or redacted; a missing one has none."""
    return F.when(kind == "inline", F.octet_length(data)).when(kind == "artifact", size).when(kind == "redacted", original)


def replay_counts(df: DataFrame, group: list[str], state: str, states: tuple[str, ...]) -> DataFrame:
    """Conditional counts, one column for each state, and the total."""
    return df.groupBy(*group).agg(F.count("*").alias("total"), *[F.count_if(F.col(state) == s).alias(s) for s in states])


def replayability(df: DataFrame, group: list[str], executable: Column) -> DataFrame:
    """group, executable, blocked, replayability: fully, partially or not replayable."""
    yes, no = F.count_if(executable), F.count_if(~executable)
    return df.groupBy(*group).agg(yes.alias("executable"), no.alias("blocked"), F.when(yes == 0, "not_replayable").when(no > 0, "partially_replayable").otherwise("fully_replayable").alias("replayability"))


def blocker_sets(df: DataFrame, group: list[str], reasons: list[Column]) -> DataFrame:
    """group, blockers: the distinct reasons (null: none) of a group's rows, sorted and joined."""
    each = F.array_distinct(F.array_compact(F.array(*reasons)))
    return df.groupBy(*group).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(each)))), ",").alias("blockers"))


def stop_at_failure(df: DataFrame, part: list[str], order: list[str], executes: Column, passed: Column) -> DataFrame:
    """df with outcome: skipped, passed, failed, or not_attempted once an earlier executed row failed."""
    earlier = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    stopped = F.coalesce(F.max((executes & ~passed).cast("int")).over(earlier), F.lit(0)) == 1
    return df.withColumn("outcome", F.when(~executes, "skipped").when(stopped, "not_attempted").when(passed, "passed").otherwise("failed"))


def epoch_offsets(df: DataFrame, parent: list[str], ordinal: list[str], largest: str) -> DataFrame:
    """df with base: the sum of (largest offset + 1) of the epochs ahead of it, with which its offsets are shifted."""
    ahead = W.partitionBy(*parent).orderBy(*ordinal).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("base", F.coalesce(F.sum(F.col(largest) + 1).over(ahead), F.lit(0)))


def scheduled(df: DataFrame, part: list[str], offset: str, sequence: str) -> DataFrame:
    """df with position: the order of replay."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(*part).orderBy(offset, sequence)))


def slice_provenance(ranges: DataFrame, messages: DataFrame, part: list[str], order: str, length: str) -> DataFrame:
    """Which bytes of which range each message took: part, message, order, taken_from, taken_to (within the range).

    Messages consume bytes in order, so both sides become intervals of one running offset and are joined on it.
    """
    w = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    a = ranges.withColumn("_end", F.sum(length).over(w)).withColumn("_start", F.col("_end") - F.col(length))
    m = W.partitionBy(*part).orderBy("message").rowsBetween(W.unboundedPreceding, W.currentRow)
    b = messages.withColumn("_to", F.sum("consumed").over(m)).withColumn("_from", F.col("_to") - F.col("consumed"))
    met = a.join(b, part).where((F.col("_start") < F.col("_to")) & (F.col("_from") < F.col("_end")))
    return met.select(*part, "message", order, (F.greatest("_start", "_from") - F.col("_start")).alias("taken_from"), (F.least("_end", "_to") - F.col("_start")).alias("taken_to"))
