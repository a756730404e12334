"""Per-document statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lex import GOOD_STRING, NUMBER, SPACE, tokens_of
from ..functions.scalars import double_bits, number_kind, unescape, unsigned_bits
from ..plans.options import ParseOptions
from .nodes import valid


def number_bits(text: Column) -> Column:
    """The 64-bit payload of a number token."""
    kind = number_kind(text)
    return F.when(kind == "int64", text.try_cast("bigint")).when(kind == "uint64", unsigned_bits(text.try_cast("decimal(20,0)"))).when(kind == "double", double_bits(text.try_cast("double")))


def stats(docs: DataFrame, json_col: str = "json", id_col: str = "doc_id", options: ParseOptions = ParseOptions()) -> DataFrame:
    """(doc_id, node_count, string_bytes, number_xor) of the valid documents.

    Nodes are strings (keys too), numbers, literals and containers;
    ``string_bytes`` counts unescaped bytes; ``number_xor`` is the XOR of the
    payloads of all numbers, 0 without any. Tokens are exploded and aggregated
    by document with map-side sums, so no token is shuffled.
    """
    d = valid(docs, json_col, id_col, options)
    t = d.select("doc_id", F.explode(F.transform(tokens_of(F.col("json")), lambda x: F.ltrim(x, F.lit(SPACE)))).alias("t"))
    first = F.substring("t", 1, 1)
    is_string, is_number = first == '"', first.rlike("[-0-9]")
    t = t.withColumn("bits", F.when(is_number, number_bits(F.col("t"))))
    node = is_string | is_number | first.isin("{", "[", "t", "f", "n")
    return t.groupBy("doc_id").agg(
        F.count_if(node).alias("node_count"),
        F.coalesce(F.sum(F.when(is_string, F.octet_length(unescape(F.col("t"))))), F.lit(0)).cast("bigint").alias("string_bytes"),
        F.coalesce(F.bit_xor("bits"), F.lit(0)).alias("number_xor"),
    )


def node_count(text: Column) -> Column:
    """Nodes of a valid document, row-local: strings fold to one character, then value starts are counted."""
    plain = F.regexp_replace(F.regexp_replace(text, GOOD_STRING, "q"), NUMBER + "|true|false|null", "s")
    return F.length(plain) - F.length(F.translate(plain, "qs{[", ""))


def checksum(records: DataFrame, id_col: str, flag: Column, text: Column, score: Column) -> DataFrame:
    """An order-free checksum of typed records: one row of record count, id XOR (shifted by the flag), bytes and score XOR."""
    r = records.select((F.col(id_col) + flag.cast("bigint")).alias("i"), F.octet_length(text).alias("n"), double_bits(score).alias("s"))
    return r.agg(F.count("*").alias("records"), F.bit_xor("i").alias("id_xor"), F.sum("n").alias("bytes"), F.bit_xor("s").alias("score_xor"))
