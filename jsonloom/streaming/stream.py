"""Parsing in Structured Streaming: stateless and row-local, or batch by batch for full errors and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.lex import utf8_error
from ..operators.validate import is_valid, parse
from ..plans.options import ParseOptions


def parse_stream(stream: DataFrame, json_col: str = "json", options: ParseOptions = ParseOptions()) -> DataFrame:
    """A stream with ``ok``: no shuffle, no state, any output mode."""
    fits = F.octet_length(json_col) <= options.max_input_bytes
    good = fits & utf8_error(F.col(json_col).cast("binary")).isNull()
    return stream.withColumn("ok", F.when(F.col(json_col).isNotNull(), F.when(good, is_valid(F.col(json_col).cast("string"), options)).otherwise(F.lit(False))))


def parse_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], json_col: str = "json", id_col: str = "doc_id", options: ParseOptions = ParseOptions()) -> DataStreamWriter:
    """A writer that gives each micro-batch with ``ok`` and ``error`` to ``sink(batch, number)``."""
    return stream.writeStream.foreachBatch(lambda batch, k: sink(parse(batch, json_col, options, id_col), k))
