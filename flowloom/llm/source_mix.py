"""Mixing sources to target weights along a van der Corput sequence, in DataFrame functions alone.

Each source's documents are shuffled and laid end to end; the stream is cut into blocks of equally many words. The
sources' weights, their targets in blocks, are laid end to end as well. Each point of a van der Corput sequence of base 2
falls into the stretch of one source, which gets that slot of the mix, so every stretch of the mix holds the sources near
their weights. (The points of a whole period are evenly spaced; those in a source's stretch are listed, and each one's
place in the sequence is its binary digits read backwards, so no slot has to look for its source.) A source's slots are
ranked in the order of the mix; the k-th takes its k-th block, beginning anew when all were taken. So the sequence says
when a document is met, and in which order its parts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import CELL_ROWS, cells_for, materialize, running_sum

#: Words in a block at most, and blocks that a source is cut into at least (a word each if it has fewer words).
BLOCK_WORDS, LEAST_BLOCKS = 2048, 512
#: Slots that one row is unfolded into at most.
UNFOLD = 4096
KEY_BITS = 62


def count_words(text: Column) -> Column:
    """Words of one or more characters other than space and \\x09 to \\x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc: str, source: str, text: str) -> Column:
    """What a source's rows are shuffled by."""
    return F.xxhash64(F.col(doc), F.col(source), F.col(text))


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """sizes (src_null, src, source_size) with target: sources by code point, null last, weigh 1, 2, 3, repeating, and
    share the sum of all sizes by weight; none gets over ``most`` times its size, the excess is shared by weight again.

    Sources are filled in the order of the level at which they reach their limit: those before the first that does not
    reach it at the level of the rest stop there. One row for each source, so one window over them all is small.
    """
    order = W.orderBy("src_null", "src")
    w = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("_cap", F.col("source_size") * F.lit(most))
    full = W.orderBy(F.col("_cap") / F.col("weight"), "src_null", "src")
    before, all_ = full.rowsBetween(W.unboundedPreceding, -1), full.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("_level", rest / weight).withColumn("_stops", F.col("_cap") <= F.col("_level") * F.col("weight"))
    free = F.min(F.when(~F.col("_stops"), F.col("_level"))).over(all_)
    # the level of the first source that stays below its limit holds for all that follow
    level = F.first(F.when(~F.col("_stops"), F.col("_level")), ignorenulls=True).over(all_)
    return w.withColumn("target", F.when(F.col("_stops"), F.col("_cap")).otherwise(F.coalesce(level, free) * F.col("weight"))).drop("_cap", "_level", "_stops")


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """src_null, src, position (in the mix), rank (among the source's slots): one row for each slot of plan (src_null, src, n_slots)."""
    bits = max(1, (slots - 1).bit_length())
    before = W.orderBy("src_null", "src").rowsBetween(W.unboundedPreceding, -1)
    placed = plan.withColumn("_first", F.coalesce(F.sum("n_slots").over(before), F.lit(0)))
    parts = placed.where("n_slots > 0").withColumn("_part", F.explode(F.expr(f"sequence(0L, (n_slots - 1) div {UNFOLD})")))
    spread = parts.repartition(*[F.col(c) for c in ("src_null", "src", "_part")])
    each = spread.withColumn("_k", F.explode(F.expr(f"sequence(_part * {UNFOLD}, least(n_slots, (_part + 1) * {UNFOLD}) - 1)")))
    # the point (first + k) / 2**bits stands in the sequence where its bits, read backwards, say
    point = F.lpad(F.bin(F.col("_first") + F.col("_k")), bits, "0")
    at = each.withColumn("position", F.conv(F.reverse(point), 2, 10).cast("long")).select("src_null", "src", "position")
    return running_sum(at, ["src_null", "src"], ["position"], F.col("position"), F.lit(1), "rank", min(cells_for(slots), 1 << bits), bits)


def source_mix(docs: DataFrame, source: str = "source", text: str = "text", doc: str = "doc_id", most: float = 3.0, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, parts, slots). rows: one for each row of docs with doc_id, the columns of keep, src_null, src, size,
    source_size, target, taken (words the mix takes of it, repeats counted), first_position (in the mix; null if it is
    never taken), epochs (in how many rounds of its source it is taken). parts: one for each row and round, with epoch,
    words (taken in it: all, or the first ones where the mix ends) and position (where it is first met). slots: the mix
    itself, src_null, src, position, rank, epoch, block.

    Null sources are one source, the last. Texts without words (null too) have size 0 and are never taken; a source of
    such texts has target 0. Rows with equal values are rows of their own; equal texts are spread by their ids. A text of
    any length is as many pieces as it touches blocks. An empty table gives empty ones. No row is taken beyond ``most``
    times its size. Columns of docs not named are not read.
    """
    key = F.shiftrightunsigned(place(doc, source, text), 64 - KEY_BITS)
    slim = materialize(docs.select(F.col(doc).alias("doc_id"), *keep, F.col(source).isNull().alias("src_null"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), count_words(F.col(text)).alias("size"), key.alias("_key")))
    rows = slim.count()
    plan = materialize(targets(slim.groupBy("src_null", "src").agg(F.sum("size").alias("source_size")), most))
    # equal blocks: the first (source_size mod n_blocks) hold a word more
    least = F.least(F.col("source_size"), F.lit(LEAST_BLOCKS))
    some = F.col("n_blocks") > 0
    plan = plan.withColumn("n_blocks", F.greatest(least, F.ceil(F.col("source_size") / F.lit(block_words))))
    plan = plan.withColumn("_words", F.when(some, F.expr("source_size div n_blocks")).otherwise(0)).withColumn("_longer", F.when(some, F.expr("source_size % n_blocks")).otherwise(0))
    per = F.col("target") * F.col("n_blocks") / F.col("source_size")
    plan = plan.withColumn("n_slots", F.when(F.col("source_size") > 0, F.least(F.floor(per + 0.5), F.floor(F.lit(most) * F.col("n_blocks")))).otherwise(0).cast("long"))
    slots = plan.agg(F.sum("n_slots")).first()[0] or 0
    by = ["src_null", "src"]
    mix = schedule(plan.select(*by, "n_slots"), max(1, slots)).join(plan.select(*by, "n_blocks"), by).withColumn("block", F.expr("rank % n_blocks")).withColumn("epoch", F.expr("rank div n_blocks")).drop("n_blocks")

    laid = running_sum(slim.where("size > 0"), by, ["_key", "doc_id", "size"], F.col("_key"), F.col("size"), "_start", cells_for(rows), KEY_BITS)
    laid = laid.join(plan.select(*by, "source_size", "target", "_words", "_longer"), by)
    block_of = "if({0} < _longer * (_words + 1), {0} div (_words + 1), _longer + ({0} - _longer * (_words + 1)) div greatest(_words, 1))"
    first_word = "(block * _words + least(block, _longer))"
    pieces = laid.withColumn("_end", F.col("_start") + F.col("size")).withColumn("block", F.explode(F.expr(f"sequence({block_of.format('_start')}, {block_of.format('(_end - 1)')})")))
    pieces = pieces.withColumn("_overlap", F.expr(f"least(_end, {first_word} + _words + if(block < _longer, 1, 0)) - greatest(_start, {first_word})"))
    own = ["doc_id", *keep, *by, "size", "source_size", "target"]
    met = pieces.join(mix.select(*by, "block", "epoch", "position"), [*by, "block"], "left")
    parts = met.groupBy(*own, "_start", "epoch").agg(F.sum(F.when(F.col("epoch").isNotNull(), F.col("_overlap")).otherwise(0)).cast("long").alias("words"), F.min("position").alias("position"))
    taken = parts.groupBy(*own, "_start").agg(F.sum("words").cast("long").alias("taken"), F.min("position").alias("first_position"), F.count("epoch").alias("epochs")).drop("_start")
    none = slim.where("size = 0").join(plan.select(*by, "source_size", "target"), by).select(*own, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_position"), F.lit(0).cast("long").alias("epochs"))
    return taken.unionByName(none), parts.where("epoch is not null"), mix
