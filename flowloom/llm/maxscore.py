"""Exact top-k by inner product of whole numbers, with MaxScore.

Dimensions are the terms, a vector's whole-numbered components its postings, kept term by term. In a shard the terms of a
query, largest first, have bounds on what those from any one on can add: the sum of each term's largest contribution, or
the lengths of what is left of the query and of the vectors, whichever is less. The first term from which on the rest
cannot reach the score to beat alone splits the query: the terms before are essential and are traversed for the whole
shard, the others are probed, a few at a time, only for vectors that still compete.

The score to beat is the k-th best of a first shard, which a first pass searches for all queries; the other shards begin
with it. Each shard returns what reaches it, k of each query at most, and the shards' answers are merged.

A query set is matched with all rows in blocks: a block of queries and a shard of rows make a task, so no table is
broadcast and no task holds more than one of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import materialize, small_batches, spark_schema, stamps

#: Rows of a shard, queries of a block, and terms that are probed before candidates are counted again.
SHARD_ROWS, BLOCK_QUERIES, PROBED = 8192, 2048, 8
#: Sums of whole numbers up to here are exact in 32 bits.
EXACT_SINGLE = 1 << 24
#: Whole numbers up to here are exact as doubles; scores that could be larger are worked out in Python's own integers.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _pack(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """number, dims, ids, numbers: blocks of up to ``size`` vectors of one length, as whole numbers floor(scale * x)."""

    def run(batches):
        own, waiting = stamps(), {}

        def block(dims: int, ids, x):
            most = np.abs(x).max(initial=0)
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
            return pa.RecordBatch.from_arrays([pa.array([next(own)]), pa.array([dims], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([kind])], ["number", "dims", "ids", "numbers", "kind"])

        for batch in batches:
            lists, ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                x = np.floor(scale * flat[(ends[at] - dims)[:, None] + np.arange(dims)].astype(np.float64))
                held_ids, held = waiting.get(dims, (np.empty(0, np.int64), np.empty((0, dims))))
                held_ids, held = np.concatenate([held_ids, ids[at]]), np.concatenate([held, x])
                while len(held) >= size:
                    yield block(dims, held_ids[:size], held[:size])
                    held_ids, held = held_ids[size:], held[size:]
                waiting[dims] = held_ids, held
        for dims, (held_ids, held) in waiting.items():
            if len(held):
                yield block(dims, held_ids, held)

    return rows.mapInArrow(run, spark_schema(number="long", dims="int", ids="binary", numbers="binary", kind="string"))


class Shard:
    """A shard's postings, a row for each term, with each term's bounds and each vector's length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.terms = ids, np.ascontiguousarray(x.T)
        self.low, self.high = x.min(axis=0, initial=np.inf).astype(np.float64), x.max(axis=0, initial=-np.inf).astype(np.float64)
        if x.dtype != object:
            self.lengths = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)) * (1 + 1e-9)
            self.longest = self.lengths.max(initial=0.0)

    def top(self, q: np.ndarray, own, k: int, to_beat: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the k largest q . x (ties: smaller id) among rows whose id is not ``own``, without those
        that score less than ``to_beat``; and how many products that took."""
        ids = self.ids
        if self.terms.dtype == object:  # beyond exact doubles: all of them, stopped at the ends of a long
            alive = np.flatnonzero(ids != own)
            score = np.array([max(-LONG - 1, min(LONG, int(s))) for s in q @ self.terms[:, alive]], object) if len(alive) else np.empty(0, object)
            order = sorted(range(len(alive)), key=lambda r: (-score[r], ids[alive[r]]))[:k]
            return alive[order], score[order], self.terms.size
        wide = q.astype(np.float64)
        terms = np.argsort(-np.abs(wide), kind="stable")
        best = np.maximum(wide * self.low, wide * self.high)[terms] if len(ids) else np.zeros(len(q))
        by_term = np.append(best[::-1].cumsum()[::-1], 0.0)  # the most that the terms from here on add: term by term,
        by_length = np.append(np.sqrt((wide[terms] ** 2)[::-1].cumsum()[::-1]), 0.0) * (1 + 1e-9)  # or by lengths
        enough = np.minimum(by_term, by_length * self.longest) < to_beat
        done = int(np.argmax(enough)) if enough.any() else len(terms)
        score, products = q[terms[:done]] @ self.terms[terms[:done]], done * len(ids)
        alive = np.arange(len(ids))
        while True:
            competes = score + np.minimum(by_term[done], by_length[done] * self.lengths[alive]) >= to_beat
            alive, score = alive[competes], score[competes]
            if done == len(terms):
                break
            probed = terms[done : done + PROBED]
            score = score + q[probed] @ self.terms[np.ix_(probed, alive)]
            products += len(probed) * len(alive)
            done += len(probed)
        other = ids[alive] != own
        alive, score = alive[other], score[other]
        if len(alive) > k:  # only what can be among the k best has to be put in order
            least = -np.partition(-score, k - 1)[k - 1]
            alive, score = alive[score >= least], score[score >= least]
        order = np.lexsort((ids[alive], -score))[:k]
        return alive[order], score[order], products


def _sides(queries: pa.Table, rows: pa.Table):
    """A block's query ids, queries and scores to beat, and a shard, in the narrowest numbers that are exact."""
    read = lambda t: (np.frombuffer(t.column("ids")[0].as_py(), "<i8"), np.frombuffer(t.column("numbers")[0].as_py(), t.column("kind")[0].as_py()).reshape(-1, t.column("dims")[0].as_py()))
    (own, q), (ids, x) = read(queries), read(rows)
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if reach >= EXACT:
        q, x = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (q, x))
    else:
        q, x = (m.astype(np.float32 if reach < EXACT_SINGLE else np.float64) for m in (q, x))
    return own, q, Shard(ids, x)


def _first(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """A block with what its first shard has: the k best of each query, and each query's score to beat."""
        own, q, shard = _sides(queries, rows)
        found, scores, many, beat = [], [], [], []
        for one, x in zip(own, q, strict=True):
            at, score, _ = shard.top(x, one, k, -np.inf)
            found.append(shard.ids[at])
            scores.append(score.astype(np.int64))
            many.append(len(at))
            beat.append(np.nextafter(float(score[-1]), -np.inf) if len(at) == k else -np.inf)
        packed = [np.concatenate(found).astype("<i8"), np.concatenate(scores).astype("<i8"), np.array(many, "<i4"), np.array(beat, "<f8")]
        return pa.table({"block": queries.column("number"), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("found", "scores", "many", "beat"), packed, strict=True)}})

    return run


def _unfold(batches):
    for batch in batches:
        for ids, found, scores, many in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            queries = np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(many, "<i4"))
            yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(np.frombuffer(found, "<i8")), pa.array(np.frombuffer(scores, "<i8"))], ["query_id", "vec_id", "score"])


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        own, q, shard = _sides(queries, rows)
        beat = np.frombuffer(queries.column("beat")[0].as_py(), "<f8")
        out = [[np.empty(0, np.int64)] for _ in range(3)]
        for one, x, least in zip(own, q, beat, strict=True):
            at, score, _ = shard.top(x, one, k, least)
            out[0].append(np.full(len(at), one))
            out[1].append(shard.ids[at])
            out[2].append(score.astype(np.int64))
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["query_id", "vec_id", "score"])

    return run


def maxscore(df: DataFrame, queries: Column, k: int, scale: float = 64.0, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): for every row that the condition ``queries`` chooses, the k rows of
    df with the largest inner product of floor(scale * x), ties to the smaller id; all, if there are fewer.

    A query is not matched with rows of its own id. Null ids, and vectors that are null or hold null or non-finite
    components, take no part; only vectors of one length are compared. A repeated row is one candidate each time; of
    queries with one id, one is asked (the smallest by its components). Scores beyond a long count as its ends. An empty
    table, or no query, gives no rows.
    """
    small_batches(df.sparkSession)
    rows = df.where(finite(df[vector]) & df[ident].isNotNull()).select(df[ident].cast("long").alias("vec_id"), df[vector].alias("vector"), queries.alias("_query"))
    shards = materialize(_pack(rows.select("vec_id", "vector"), SHARD_ROWS, scale), "none")
    asked = rows.where("_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = materialize(_pack(asked, BLOCK_QUERIES, scale), "none")
    # every block meets the first shard of its length, then all others; lists of numbers say whom to meet
    firsts = shards.groupBy("dims").agg(F.min("number").alias("_first"))
    of_blocks = blocks.groupBy("dims").agg(F.collect_list("number").alias("_blocks"))
    of_shards = shards.join(firsts, "dims").where("number <> _first").groupBy("dims").agg(F.collect_list("number").alias("_shards"))
    left = blocks.withColumn("block", F.col("number"))
    right = shards.join(of_blocks, "dims").withColumn("block", F.explode("_blocks")).drop("_blocks")
    opened = right.join(firsts, "dims").where("number = _first").drop("_first")
    first = materialize(left.groupBy("block").cogroup(opened.groupBy("block")).applyInArrow(_first(k), spark_schema(block="long", found="binary", scores="binary", many="binary", beat="binary")), "none")
    known = left.join(first, "block")
    asked = known.drop("found", "scores", "many").join(of_shards, "dims").withColumn("shard", F.explode("_shards")).drop("_shards")
    others = right.join(firsts, "dims").where("number <> _first").withColumn("shard", F.col("number")).drop("_first")
    keys, answer = ["block", "shard"], spark_schema(query_id="long", vec_id="long", score="long")
    best = asked.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(_search(k), answer).union(known.select("ids", "found", "scores", "many").mapInArrow(_unfold, answer))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
