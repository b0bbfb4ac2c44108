"""Shards of near equal bytes by histogram sort, in DataFrame functions alone.

Rows are ordered by a key. For each of the borders between shards, candidate keys are probed: one aggregation counts
the exact bytes below every candidate, over all partitions at once. The interval between the two candidates around the
wanted count is probed again, until a border meets the tolerance or no key lies between. Only then do rows move, once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cells_for, materialize, running_sum

#: Keys are longs in [0, 2**KEY_BITS).
KEY_BITS = 62
#: Candidates in an interval, for each border in each round.
PROBES = 64


def even_key(*columns: Column) -> Column:
    """A key that spreads rows evenly; equal values get equal keys."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - KEY_BITS)


def below(key: Column, borders: Sequence[int], first: int = 0) -> Column:
    """How many of the sorted borders are at most key: a binary search as one expression."""
    if not borders:
        return F.lit(first)
    mid = len(borders) // 2
    return F.when(key < F.lit(borders[mid]), below(key, borders[:mid], first)).otherwise(below(key, borders[mid + 1 :], first + mid + 1))


def find_borders(df: DataFrame, key: str, size: str, shards: int, tolerance: float = 0.0005, probes: int = PROBES) -> list[int]:
    """The shards - 1 keys where shards begin, so that the bytes below each are as near to its share as the tolerance (a
    fraction of a shard) asks, or as near as single keys allow. At most shards * probes sums reach the driver a round."""
    total = df.agg(F.sum(size)).first()[0] or 0
    want = [total * i // shards for i in range(1, shards)]
    low, high, under = [0] * len(want), [1 << KEY_BITS] * len(want), [0] * len(want)
    best: list[tuple[int, int]] = [(w, 0) for w in want]  # distance, border
    for i, w in enumerate(want):
        best[i] = min(best[i], (abs(total - w), 1 << KEY_BITS))
    open_ = set(range(len(want))) if total else set()
    while open_:
        spans = sorted({(low[i], high[i]) for i in open_})  # equal or disjoint
        edges = sorted({x for s in spans for x in s})
        starts = {x: k + 1 for k, x in enumerate(edges)}
        steps = {s: max(1, -(-(s[1] - s[0]) // probes)) for s in spans}
        span = below(F.col(key), edges)
        lows = F.array(*[F.lit(x) for x in [0, *edges]])
        widths = F.array(*[F.lit(steps.get((a, b), 0)) for a, b in zip([-1, *edges], [*edges, -1], strict=True)])
        cells = df.withColumn("_span", span + 1).withColumn("_low", F.element_at(lows, F.col("_span"))).withColumn("_step", F.element_at(widths, F.col("_span"))).where("_step > 0")
        cells = cells.withColumn("_cell", F.expr(f"({key} - _low) div _step")).groupBy("_span", "_cell").agg(F.sum(size).alias("b"), F.count("*").alias("n"))
        got: dict[int, dict[int, tuple[int, int]]] = {}
        for r in cells.collect():
            got.setdefault(r["_span"] - 1, {})[r["_cell"]] = (r["b"], r["n"])
        for i in sorted(open_):
            lo, hi, step = low[i], high[i], steps[low[i], high[i]]
            count, at = under[i], lo
            counted = got.get(starts[lo], {})
            for c in range(-(-(hi - lo) // step)):
                (more, rows), border = counted.get(c, (0, 0)), min(lo + (c + 1) * step, hi)
                after = count + more
                best[i] = min(best[i], (abs(after - want[i]), border), (abs(count - want[i]), at))
                if after >= want[i]:
                    low[i], high[i], under[i] = at, border, count
                    if rows <= 1:  # no key lies between
                        open_.discard(i)
                    break
                count, at = after, border
            if best[i][0] <= tolerance * total / shards or high[i] - low[i] <= 1:
                open_.discard(i)
    borders = [b for _, b in best]
    for i in range(1, len(borders)):
        borders[i] = max(borders[i], borders[i - 1])
    return borders


def histogram_shards(df: DataFrame, key: Column, size: Column, shards: int, tolerance: float = 0.0005) -> DataFrame:
    """df with size long, shard int (0 to shards - 1) and slot long (from 0 without gaps in each shard).

    ``key`` is a long in [0, 2**62); rows of one key stay in one shard, in an order of their own if they are equal. So
    a key of the text alone keeps equal texts together, at the price of shards as large as the largest group of them;
    a key of id and text spreads such a group, and near equal sizes hold whatever its share. Sizes null count as 0. A
    text is one size, of any length: a shard exceeds its share by the tolerance and the rows of a key at most. An empty table stays empty;
    a shard may be empty if there are fewer keys than shards. Columns of df named size, shard or slot are replaced (key
    and size may read them). Columns of df other than those used are carried along through the one exchange; names that begin with ``_`` are
    taken. Without columns of texts the table is small, so it is written to the shared folder before it is probed.
    """
    slim = materialize(df.withColumn("_key", key).withColumn("size", F.coalesce(size, F.lit(0)).cast("long")))
    borders = find_borders(slim, "_key", "size", shards, tolerance)
    rows = slim.count()
    sharded = slim.withColumn("shard", below(F.col("_key"), borders).cast("int"))
    # Within a shard keys are spread evenly over its interval; the cells of the running count cut that interval.
    cells = cells_for(rows // shards)
    starts = [0, *borders]
    widths = [max(1, b - a) for a, b in zip(starts, [*borders, 1 << KEY_BITS], strict=True)]
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("shard") + 1)
    inside = (F.col("_key") - pick(starts)).cast("double") / pick(widths).cast("double")
    fine = F.greatest(F.lit(0), F.least(F.lit((1 << 40) - 1), F.floor(inside * F.lit(float(1 << 40))))).cast("long")
    ties = [n for n, t in df.dtypes if not n.startswith("_") and n not in ("shard", "slot") and "map<" not in t and t != "variant"]  # what can be ordered
    ordered = running_sum(sharded.withColumn("_fine", fine), ["shard"], ["_fine", "_key", *ties], F.col("_fine"), F.lit(1), "slot", cells, 40)
    return ordered.withColumn("slot", F.col("slot").cast("long")).drop("_key", "_fine")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes a sharded table, one folder for each shard, in the order of slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
