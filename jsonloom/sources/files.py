"""Documents from files, one document a file or one a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(doc_id STRING, json BINARY, size): one document per file, bytes as they are; doc_id is the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("doc_id"), F.col("content").alias("json"), F.col("length").alias("size"))


def list_datasets(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(name, size) of the documents in a folder, smallest first; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size")).orderBy("size", "name")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(json STRING) of each non-blank line of text files."""
    return spark.read.text(path).select(F.col("value").alias("json")).where("trim(json) <> ''")
