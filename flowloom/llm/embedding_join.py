"""Near copies among vectors by a subspace pigeonhole join.

Unit vectors of cosine c or more are at a squared distance of 2 - 2c at most. All vectors are turned by one fixed
rotation and cut into blocks of dimensions; if a pair is that near, some block holds no more than its share of the
squared distance. Each block is joined by range: vectors lie in slabs of the width of the block's radius along its
first axis, pairs come from one slab or two neighbouring ones, then from a window along its second axis, then from the
distance in the block. Every candidate is verified by its cosine in double precision. A pair that meets in several
blocks counts in the first of them, which both vectors tell, so links are counted without listing them: a task returns
a row for each of its vectors, with its number of links and the smallest of its component there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Forest, connected_components, materialize, small_batches, spark_schema

#: Dimensions of a block, vectors that one side of a task holds at most, and rows of a tile of distances.
BLOCK_DIMS, SIDE_ROWS, TILE = 16, 16_384, 512
#: Turned components are kept as this many steps from -1 to 1, so all tasks see the same blocks.
STEPS = 32_000
SEED = 20240229


def valid(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[slice]:
    return [slice(i, min(dims, i + BLOCK_DIMS)) for i in range(0, dims, BLOCK_DIMS)]


def radius(block: slice, dims: int, least: float) -> float:
    """The block's share of the distance, with room for the steps."""
    return math.sqrt((2 - 2 * least + 1e-9) * (block.stop - block.start) / dims) + 2 * math.sqrt(BLOCK_DIMS) / STEPS


def _turn(vectors: DataFrame, least: float) -> DataFrame:
    """dims, block, slab, cls, copies, turned (int16), vector (float64 or float32) of each class of equal vectors."""
    wide = dict(vectors.dtypes)["vector"] != "array<float>"
    raw, out_type = ("<f8", pa.float64()) if wide else ("<f4", pa.float32())

    def run(batches):
        rotations = {}
        for batch in batches:
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
            cls, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for dims in np.unique(lengths).tolist():
                if dims not in rotations:
                    rotations[dims] = rotation(dims)
                rows = np.flatnonzero(lengths == dims)
                x = flat[(ends[rows] - dims)[:, None] + np.arange(dims)].astype(np.float64)
                big = np.abs(x).max(axis=1, keepdims=True)
                unit = x / big
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                turned = np.rint(unit @ rotations[dims] * STEPS).astype("<i2")
                for b, block in enumerate(blocks_of(dims)):
                    slab = np.floor(turned[:, block.start] / (STEPS * radius(block, dims, least))).astype(np.int32)
                    fixed = lambda m: [r.tobytes() for r in m]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(slab), pa.array(cls[rows]), pa.array(copies[rows]), pa.array(fixed(turned), pa.binary()), pa.array(fixed(x.astype(raw)), pa.binary())], ["dims", "block", "slab", "cls", "copies", "turned", "vector"])

    return vectors.select("cls", "copies", "vector").mapInArrow(run, spark_schema(dims="int", block="int", slab="int", cls="long", copies="long", turned="binary", vector="binary"))


def _join(least: float, raw: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dims, b, _, across = (k.as_py() for k in key[:4])
        blocks, block = blocks_of(dims), blocks_of(dims)[b]
        cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        turned = np.frombuffer(b"".join(table.column("turned").to_pylist()), "<i2").reshape(-1, dims)
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), raw).reshape(-1, dims).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        two = across or second.any()
        axis = turned[:, min(block.start + 1, block.stop - 1)].astype(np.float32) / STEPS
        left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if two else (np.arange(len(cls)),) * 2
        left, right = left[np.argsort(axis[left], kind="stable")], right[np.argsort(axis[right], kind="stable")]
        reach = radius(block, dims, least)
        part = turned[:, block].astype(np.float32) / STEPS
        norm = (part * part).sum(axis=1)
        limits = [int((radius(c, dims, least) * STEPS) ** 2) for c in blocks]
        links, forest = np.zeros(len(cls), np.int64), Forest(len(cls))
        at = axis[right]
        for t in range(0, len(left), TILE):
            rows = left[t : t + TILE]
            lo = np.searchsorted(at, axis[rows[0]] - reach - 1e-4) if two else t
            hi = np.searchsorted(at, axis[rows[-1]] + reach + 1e-4, "right")
            for u in range(lo, hi, 8 * TILE):
                others = right[u : min(hi, u + 8 * TILE)]
                near = norm[rows][:, None] + norm[others][None, :] - 2 * (part[rows] @ part[others].T)
                i, j = np.nonzero(near <= reach * reach + 1e-4)
                if not two:
                    keep = u + j > t + i  # each pair of one side once
                    i, j = i[keep], j[keep]
                for c in range(0, len(i), 1 << 16):
                    p, q = rows[i[c : c + (1 << 16)]], others[j[c : c + (1 << 16)]]
                    d = turned[p].astype(np.int64) - turned[q]
                    d *= d
                    ok = d[:, block].sum(axis=1) <= limits[b]
                    for k in range(b):  # an earlier block has the pair
                        ok &= d[:, blocks[k]].sum(axis=1) > limits[k]
                    p, q = p[ok], q[ok]
                    ok = np.einsum("ij,ij->i", x[p], x[q]) >= least
                    p, q = p[ok], q[ok]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    forest.link(p, q)
        met = np.flatnonzero(links)
        return pa.table({"cls": pa.array(cls[met], pa.int64()), "links": pa.array(links[met], pa.int64()), "root": pa.array(cls[forest.root[met]], pa.int64())})

    return run


def embedding_join(df: DataFrame, least: float, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of df: rows of cosine ``least`` (over 0) or more are linked.

    Vectors that are null, zero or empty, or hold null or non-finite components, link with nothing; neither do vectors
    of different lengths. A pair at the bound itself is linked, by its cosine in double precision. Equal vectors are one
    class from the start (by 64 bits of their hash). component_id is the smallest id that links lead
    to; a null id stays null unless a linked row has one, and is never kept. An empty table stays empty; columns of df
    other than the two are not read.
    """
    spark = df.sparkSession
    small_batches(spark)

    rows = df.select(df[ident].cast("long").alias("vec_id"), F.when(valid(df[vector]), F.col(vector)).alias("vector")).withColumn("cls", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    classes = materialize(rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.first("vector").alias("vector")))
    raw = "<f4" if dict(classes.dtypes)["vector"] == "array<float>" else "<f8"
    turned = materialize(_turn(classes, least))
    # as many rows as there are slabs: 2 / radius for each block
    held = turned.groupBy("dims", "block", "slab").agg(F.ceil(F.count("*") / SIDE_ROWS).cast("int").alias("parts"))
    spot = ["dims", "block", "slab"]
    after = held.select("dims", "block", (F.col("slab") - 1).alias("slab"), F.col("parts").alias("_next"))
    before = held.select("dims", "block", (F.col("slab") + 1).alias("slab"), F.col("parts").alias("_last"))
    sides = held.join(after, spot, "left").join(before, spot, "left").na.fill(0, ["_next", "_last"])
    dealt = turned.join(F.broadcast(sides), spot).withColumn("_own", F.expr("cast(pmod(xxhash64(cls, 1), parts) as int)"))




    roles = F.concat(
        F.transform(F.expr("sequence(0, parts - 1)"), lambda k: F.struct(F.lit(False).alias("across"), F.col("slab").alias("low"), F.least(k, "_own").alias("first"), F.greatest(k, "_own").alias("other"), (F.col("_own") > k).alias("second"))),
        F.transform(F.expr("if(_next > 0, sequence(0, _next - 1), array())"), lambda k: F.struct(F.lit(True).alias("across"), F.col("slab").alias("low"), F.col("_own").alias("first"), k.alias("other"), F.lit(False).alias("second"))),
        F.transform(F.expr("if(_last > 0, sequence(0, _last - 1), array())"), lambda k: F.struct(F.lit(True).alias("across"), (F.col("slab") - 1).alias("low"), k.alias("first"), F.col("_own").alias("other"), F.lit(True).alias("second"))),
    )
    tasks = dealt.withColumn("_role", F.explode(roles)).select("dims", "block", "_role.*", "cls", "copies", "turned", "vector")
    found = materialize(tasks.groupBy("dims", "block", "low", "across", "first", "other").applyInArrow(_join(least, raw), spark_schema(cls="long", links="long", root="long")))
    links = found.groupBy("cls").agg(F.sum("links").alias("_links"))
    part = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    known = classes.select("cls", "copies").join(links, "cls", "left").join(part, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    own = rows.select("vec_id", "cls").join(known, "cls", "left")
    least_id = rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("_least")).join(known.select("cls", "component"), "cls").groupBy("component").agg(F.min("_least").alias("_least"))
    out = own.join(least_id, "component", "left").withColumn("component_id", F.coalesce("_least", "vec_id"))
    return out.select("vec_id", F.coalesce(F.col("_links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
