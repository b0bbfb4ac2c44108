"""From documents to token ids: toxic documents go, near copies go, repeated passages go, sources are mixed to their
weights, and what stays is encoded and decoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the folder of
``spark.checkpoint.dir`` and reads it as the next stage's documents. All but the last return the columns of documents,
and leave other columns behind.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import ngram_join as near
from flowloom.llm import source_mix as mix
from flowloom.llm.byte_bpe import byte_bpe, read_ranks
from flowloom.llm.shared import materialize, table
from flowloom.llm.suffix_dedup import suffix_dedup
from flowloom.llm.toxicity import THRESHOLD, doc_bucket, toxicity, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle and percent of similarity of near copies.
SHINGLE, SIMILAR = 5, 80
#: Words that a worker keeps the ids of; an executor's workers of all stages share its memory.
CACHED_WORDS = 120_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under the threshold; null and empty texts score the model's bias alone."""
    docs = docs.select(*COLUMNS)
    model = train(docs, table(spark, sf_dir, "labels"), doc_bucket(F.col("doc_id"), 3) != 1)
    return toxicity(docs, model, out="_toxicity").where(F.col("_toxicity") < THRESHOLD).select(*COLUMNS)


def row_name(docs: DataFrame) -> DataFrame:
    """docs with _a and _b, 128 bits that tell rows apart by all columns; rows that agree in all of them are the same."""
    parts = [F.col(c) for c in COLUMNS] + [F.col(c).isNull() for c in COLUMNS]
    return docs.withColumn("_a", F.xxhash64(F.lit(1), *parts)).withColumn("_b", F.xxhash64(F.lit(2), *parts))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, that with the smallest id (of several, with the smallest name). Wordless and
    null texts are in no group: all stay. Equal rows count as one. A text of any length is compared whole; no rows give none."""
    docs = row_name(docs.select(*COLUMNS))
    groups = near.ngram_join(docs, SHINGLE, SIMILAR, keep=("_a", "_b")).where("component is not null")
    first = groups.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "_a", "_b")).alias("_first"))
    chosen = docs.join(first.select("_first._a", "_first._b"), ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"])
    wordless = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return chosen.unionByName(wordless).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the passages that rows with smaller ids have; characters cut in two go whole. A null
    text stays null; n_chars counts what stays."""
    docs = docs.select(*COLUMNS)
    kept = suffix_dedup(docs.withColumn("_null", F.col("text").isNull()), keep=("lang", "source", "n_chars", "_null"), characters=True)
    kept = kept.withColumn("text", F.when(~F.col("_null"), F.col("kept").cast("string")))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in its order: each text once for each round of its source that takes it, where the mix first meets it;
    whole, or up to its last word that is taken if the mix ends in it. Rows of which the mix takes nothing go, those
    without words among them. Equal rows are mixed each. A text of any length is one row of a round; no rows give none."""
    docs = row_name(docs.select(*COLUMNS))
    _, parts, _ = mix.source_mix(docs, keep=("_a", "_b"))
    each = docs.dropDuplicates(["_a", "_b"]).join(parts.select("_a", "_b", "words", "size", "position", "epoch"), ["_a", "_b"])
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)  # with what is before them
    part = F.array_join(F.slice(words, 1, F.col("words").cast("int")), "")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(part)
    each = each.withColumn("n_chars", F.when(F.col("words") == F.col("size"), F.col("n_chars")).otherwise(F.length(text).cast("long"))).withColumn("text", text)
    return each.orderBy("position", "doc_id", "epoch").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (base64 of little-endian unsigned 32-bit integers), ids_sha256, decoded_sha256."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), cached=CACHED_WORDS)
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.base64("ids").alias("ids"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]
#: The stages hash, fit and sort in ways that SQL has not; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
