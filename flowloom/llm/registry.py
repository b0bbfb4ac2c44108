"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe, read_ranks
from .embedding_join import embedding_join
from .histogram_sort import even_key, histogram_shards
from .lattice_lm import lattice_scores, read_pieces
from .license_scan import license_spans
from .maxscore import maxscore
from .ngram_join import ngram_join
from .shared import table
from .source_mix import source_mix
from .suffix_dedup import suffix_dedup
from .toxicity import THRESHOLD, doc_bucket, toxicity, train


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability by words and by subword lattices, learned from nine tenths of the ids."""
    learn = doc_bucket(F.col("doc_id"), 10) != 0
    scored = lattice_scores(table(spark, sf_dir, "documents"), learn, read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    held = F.coalesce(doc_bucket(F.col("doc_id"), 10) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every 20th vector with all others."""
    return maxscore(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score by a classifier that saw labels of two thirds of the ids only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), doc_bucket(F.col("doc_id"), 3) != 1)
    scored = toxicity(docs, model)
    held = F.coalesce(doc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every text; phrases by their places, longer notices if most of them is there."""
    spans = license_spans(table(spark, sf_dir, "documents"))
    exact = lambda c: F.when(F.col("exact"), F.col(c))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  a handful of labels
    found = spans.groupBy("_row", "doc_id", "n_words").agg(F.count_if("exact").alias("n_base"), F.min(exact("first_word")).alias("first_word"), F.max(exact("first_word")).alias("last_word"), joined(exact("label")).alias("base_labels"), joined("label").alias("labels"), F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"))
    return found.drop("_row")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by sets of 4-word shingles of Jaccard similarity 0.85 or more, and the groups these links make."""
    return ngram_join(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes. Null texts have 16 bytes and the checksum of no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), F.octet_length(text).alias("_bytes"), even_key(F.col("doc_id"), text).alias("_place"))
    sharded = histogram_shards(docs, F.col("_place"), F.col("_bytes") + 16, 40)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as ids and back. Null texts count as empty."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without the 50-byte strings of documents with smaller ids."""
    kept = suffix_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.95 or more, and the groups these links make."""
    return embedding_join(table(spark, sf_dir, "embeddings"), 0.95)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed from all sources; how many words of each the mix takes, where first and in how many rounds."""
    rows, _, _ = source_mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_position", "epochs")


QUERIES = {f.__name__: f for f in (op1_lattice_lm, op2_maxscore, op3_toxicity, op4_license_scan, op5_ngram_join, op6_histogram_sort, op7_byte_bpe, op8_suffix_dedup, op9_embedding_join, op10_source_mix)}
ORACLES: dict[str, str] = {
    "op2_maxscore": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
    "op9_embedding_join": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
             r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
             c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
             n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
    """,
    "op5_ngram_join": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM t),
             x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM g),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (total - shared)),
             r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
             c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM g JOIN c USING (doc_id)
    """,
    "op8_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
         h AS (SELECT doc_id, hex(t) AS h, octet_length(t) AS n FROM d),
         b AS (SELECT doc_id, n, k, substr(h, 2 * k + 1, 2 * (1024 + 49)) AS h FROM (SELECT *, unnest(range(0, greatest(n - 49, 0), 1024)) AS k FROM h)),
         x AS (SELECT doc_id, k + j AS i, md5(w) AS s FROM (SELECT doc_id, k, j, substr(h, 2 * j + 1, 100) AS w FROM (SELECT doc_id, n, k, h, unnest(range(0, least(1024, n - 49 - k))) AS j FROM b))),
         m AS (SELECT s, min(doc_id) AS f FROM x GROUP BY s HAVING min(doc_id) < max(doc_id)),
         g AS (SELECT x.doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY x.doc_id ORDER BY i) > 50, true) AS new FROM x JOIN m USING (s) WHERE x.doc_id > f),
         r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM g) GROUP BY doc_id, q),
         p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM r),
         k AS (SELECT p.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS h FROM p JOIN h USING (doc_id) GROUP BY p.doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, h.h))) AS kept_sha256 FROM h LEFT JOIN k USING (doc_id)
    """,
}
