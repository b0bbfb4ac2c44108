"""Published sessions on a shared file system: written whole to a staging folder, then moved into place once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def externalize(operations: DataFrame, session: list[str], body: str) -> tuple[DataFrame, DataFrame]:
    """(operations with <body>_sha and empty bodies inline, payloads: session, sha, bytes once each)."""
    sha = F.when(F.octet_length(body) > 0, F.sha2(F.col(body), 256))
    named = operations.withColumn(f"{body}_sha", sha)
    payloads = named.where(f"{body}_sha is not null").select(*session, F.col(f"{body}_sha").alias("sha"), F.col(body).alias("bytes")).dropDuplicates([*session, "sha"])
    return named.withColumn(body, F.when(F.col(f"{body}_sha").isNull(), F.col(body))), payloads


def hydrate(operations: DataFrame, payloads: DataFrame, session: list[str], body: str) -> DataFrame:
    """Bodies back in place; a payload whose bytes do not have its digest is an error."""
    good = F.when(F.sha2("bytes", 256) == F.col("sha"), F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("payload does not match "), F.col("sha"))).cast("binary"))
    back = payloads.select(*session, F.col("sha").alias(f"{body}_sha"), good.alias("_bytes"))
    return operations.join(back, [*session, f"{body}_sha"], "left").withColumn(body, F.coalesce("_bytes", body)).drop("_bytes", f"{body}_sha")


def publish(df: DataFrame, path: str) -> str:
    """created, or already_published if the folder has the same rows; other rows there are an error. Readers see all or nothing."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        old = spark.read.parquet(path)
        if old.exceptAll(df).isEmpty() and df.exceptAll(old).isEmpty():
            return "already_published"
        raise FileExistsError(f"{path} holds another session")
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    if not fs.rename(_fs(spark, staged)[1], target):
        fs.delete(_fs(spark, staged)[1], True)
        raise FileExistsError(path)
    return "created"


def summaries(spark: SparkSession, path: str, session: list[str], limit: int) -> DataFrame:
    """session, operation_count: bodies are never read; sorted, then cut."""
    return spark.read.parquet(path).groupBy(*session).agg(F.count("*").alias("operation_count")).orderBy(*session).limit(limit)
