"""One document per file, and containers of documents in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modified, length, content: one row per file. Without content in the plan, files are listed but not read."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length", "content")


def file_digests(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Hex SHA-256 of each file (up to 2 GB)."""
    return read_files(spark, path, glob).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files held against a table (name, sha256): verified, mismatch, or missing."""
    found = file_digests(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    joined = expected.withColumnRenamed("sha256", "expected").join(found, "name", "left")
    return joined.select("name", "expected", "sha256", F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("expected"), "verified").otherwise("mismatch").alias("status"))


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
