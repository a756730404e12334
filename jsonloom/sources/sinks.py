"""JSON text out of columns and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_documents(df: DataFrame, id_col: str) -> DataFrame:
    """(doc_id, json): each row as an object; nulls are written."""
    return df.select(F.col(id_col).alias("doc_id"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_lines(docs: DataFrame, path: str, json_col: str = "json") -> None:
    """One document a line, as text files."""
    docs.select(F.col(json_col)).write.mode("overwrite").text(path)
