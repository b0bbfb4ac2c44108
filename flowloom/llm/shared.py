"""What the operators of this subpackage share: the folder that all machines see, packing of texts, running sums
over many partitions, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Bytes of text that a packed chunk aims at; one longer text makes a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Level of compression of packed chunks, which are written once and moved several times.
CHUNK_LEVEL = 6
#: Rows that one cell of a distributed running sum aims at.
CELL_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode only, one of our own where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="flowloom-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and survives the loss of executors."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/flowloom-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bounds the bytes of a batch that a Python worker gets at once, since texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > size:
        spark.conf.set(name, str(size))


def stamps() -> Iterator[int]:
    """Numbers that no other task gives out, the same ones when a task runs again over the same rows."""
    n = TaskContext.get().partitionId() << 33
    while True:
        yield n
        n += 1


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def spark_schema(**fields: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in fields.items()))


def running_sum(df: DataFrame, part: list[str], order: list[str], fine: Column, value: Column, out: str, cells: int, bits: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one of the same ``part`` in the order of ``order``.

    ``fine`` is a long in [0, 2**bits) that ``order`` begins with, spread evenly; its top bits cut each part into
    ``cells`` (a power of two) cells. Rows are summed within a cell, cells by a window over one row each, so a part
    with most of the rows is still spread over ``cells`` groups.
    """
    shift = bits - (cells - 1).bit_length()
    cut = df.withColumn("_cell", F.shiftright(fine, shift)).withColumn("_value", value)
    per_cell = cut.groupBy(*part, "_cell").agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*part).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    base = per_cell.select(*part, "_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*part, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = cut.withColumn(out, F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return own.join(base, [*part, "_cell"]).withColumn(out, F.col(out) + F.col("_base")).drop("_cell", "_value", "_base")


def cells_for(rows: int, least: int = 32) -> int:
    """A power of two of cells for so many rows."""
    return 1 << max(rows // CELL_ROWS, least - 1).bit_length()


def pack(df: DataFrame, text: str, others: list[str], target: int = CHUNK_BYTES) -> DataFrame:
    """Packs rows into compressed chunks of about ``target`` bytes of text: chunk long, n_rows int, n_bytes long, blob."""
    small_batches(df.sparkSession)

    def run(batches):
        number, rows, held = stamps(), [], 0
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False)
            start = 0
            for i, size in enumerate(sizes):
                if held and held + size > target:
                    if i > start:
                        rows.append(batch.slice(start, i - start))
                    if rows:
                        yield _chunk(next(number), rows, held)
                    rows, held, start = [], 0, i
                held += int(size)
            if start < batch.num_rows:
                rows.append(batch.slice(start))
        if rows:
            yield _chunk(next(number), rows, held)

    return df.select(text, *others).mapInArrow(run, spark_schema(chunk="long", n_rows="int", n_bytes="long", blob="binary"))


def _chunk(number: int, rows: list[pa.RecordBatch], held: int) -> pa.RecordBatch:
    whole = pa.Table.from_batches(rows).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", CHUNK_LEVEL))) as out:
        out.write_table(whole)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([whole.num_rows], pa.int32()), pa.array([held], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "n_rows", "n_bytes", "blob"])


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


class Forest:
    """Components of rows under links that come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            order = np.argsort(low, kind="stable")[::-1]  # of several lower roots the lowest is written last
            self.root[high[order]] = low[order]
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
            a, b = a[apart], b[apart]


def connected_components(edges: DataFrame) -> DataFrame:
    """node long, component long (its smallest node) of every node that stands in ``edges`` (a long, b long).

    Alternating large-star and small-star steps (Kiveris et al., "Connected components in MapReduce and beyond"):
    each keeps at most as many edges as there were, all that a step needs is a group's minimum, which partial
    aggregation finds, and the number of rounds grows with the logarithm of the longest path. Each round is written
    to the shared folder. Edges of a node to itself count as a node without links. There is no limit of rounds: a round
    that changes an edge lowers the smaller end of one or drops one, so the rounds end.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return e.join(low, "a")

    now = materialize(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    seen = None
    while True:
        large = star(both(now)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = star(down).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = materialize(small)
        # the sums of an unchanged edge set are unchanged; a changed one lowers b or drops edges
        sums = now.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        seen = sums
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
