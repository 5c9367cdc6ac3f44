"""Content-addressed artefacts: stored once under the hash of their bytes, verified when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def addressed(rows: DataFrame, content: str = "content") -> DataFrame:
    """Rows with the SHA-256 of their content and the path that it gives: source/aa/bb/hash."""
    out = rows.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    return out.withColumn("stored_in", F.concat_ws("/", "source_id", F.substring("sha256", 1, 2), F.substring("sha256", 3, 2), "sha256"))


def absent(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The first of each new content: what an insert-if-absent adds."""
    return rows.dropDuplicates(["sha256"]).join(held.select("sha256"), "sha256", "left_anti")


def put(rows: DataFrame, folder: str) -> None:
    """Append new artefacts, partitioned by source; what is held already is not written again."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    held = spark.read.parquet(folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else spark.createDataFrame([], "sha256 string")
    absent(addressed(rows), held).write.mode("append").partitionBy("source_id").parquet(folder)


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """Stored artefacts with whether their bytes still have the hash that they are filed under."""
    return spark.read.parquet(folder).withColumn("sound", F.sha2(F.col("content").cast("binary"), 256) == F.col("sha256"))


def adopted(claimed: DataFrame, stored: DataFrame) -> DataFrame:
    """What becomes of rows without a store: adopted, missing or mismatched, counted."""
    j = claimed.join(stored.select(F.col("stored_in"), F.col("sha256").alias("_held")), "stored_in", "left")
    outcome = F.when(F.col("_held").isNull(), "missing").when(F.col("_held") == F.col("sha256"), "adopted").otherwise("mismatched")
    return j.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
