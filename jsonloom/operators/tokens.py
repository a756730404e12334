"""The token table and its structural columns, by windows over documents.

Tables here have one row a token: (doc_id, tok, pos, kind, text). ``pos`` is a
byte offset. A string is one token; ``two_token_index`` gives the numbering in
which it is two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lex import SPACE, token_kind, tokens_of

OPENS, CLOSES, SEPARATORS = ("{", "["), ("}", "]"), (":", ",")


def by_doc() -> Window:
    return Window.partitionBy("doc_id").orderBy("tok")


def tokens(docs: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """Tokens of each document, white space left out. Nulls and empty texts have none."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(json_col).cast("string").alias("json"))
    raw = d.select("doc_id", F.posexplode(tokens_of(F.col("json"))).alias("raw_tok", "raw"))
    run = Window.partitionBy("doc_id").orderBy("raw_tok").rowsBetween(Window.unboundedPreceding, 0)
    text = F.ltrim("raw", F.lit(SPACE))
    t = raw.withColumn("end", F.sum(F.octet_length("raw")).over(run)).withColumn("text", text)
    # only the last token can be white space alone, so the rank is the place
    return t.select("doc_id", F.col("raw_tok").alias("tok"), (F.col("end") - F.octet_length("text")).cast("bigint").alias("pos"), token_kind(F.col("text")).alias("kind"), "text").where("kind <> 'w'")


def footprint(kind: Column, text: Column) -> Column:
    """Tape words of a token: containers' brackets, strings and literals 1, numbers 2, separators 0."""
    return F.when(kind.isin(*SEPARATORS), 0).when((kind == "s") & ~text.isin("true", "false", "null"), 2).otherwise(1)


def two_token_index(t: DataFrame) -> DataFrame:
    """``t`` with ``tok2``, the index of a token where strings count as two."""
    return t.withColumn("tok2", (F.col("tok") + F.coalesce(F.sum(F.col("kind").isin("q").cast("int")).over(by_doc().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int"))


def totals(t: DataFrame) -> DataFrame:
    """Per document: tokens, skeleton records, strings, scalars, tape words."""
    return t.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"),
        F.count_if(F.col("kind").isin(*OPENS, *CLOSES, *SEPARATORS)).alias("n_skeleton"),
        F.count_if(F.col("kind") == "q").alias("n_strings"),
        F.count_if(F.col("kind") == "s").alias("n_scalars"),
        F.sum(footprint(F.col("kind"), F.col("text"))).alias("tape_words"),
    )


def skeleton(t: DataFrame) -> DataFrame:
    """Structural tokens with depth, pairing, opener and child counts.

    Columns: doc_id, tok, pos, kind, depth (brackets share their container's,
    separators take it), skel, match_tok, opener, opener_tok, child_count,
    next_kind and next_tok (within the depth group, for member checks).
    """
    s = t.where(F.col("kind").isin(*OPENS, *CLOSES, *SEPARATORS)).select("doc_id", "tok", "pos", "kind")
    w = by_doc()
    weight = F.when(F.col("kind").isin(*OPENS), 1).when(F.col("kind").isin(*CLOSES), -1).otherwise(0)
    s = s.withColumn("skel", F.row_number().over(w) - 1)
    s = s.withColumn("depth", (F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.when(weight == -1, 1).otherwise(0)).cast("int"))
    g = Window.partitionBy("doc_id", "depth").orderBy("tok")
    before = g.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id", "depth").orderBy(F.desc("tok")).rowsBetween(Window.unboundedPreceding, -1)
    bracket = F.when(weight != 0, F.struct("tok", "kind"))
    s = s.withColumn("_b", F.last(bracket, ignorenulls=True).over(before)).withColumn("_a", F.last(bracket, ignorenulls=True).over(after))
    s = s.withColumn("next_kind", F.lead("kind").over(g)).withColumn("next_tok", F.lead("tok").over(g))
    upto = g.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_commas", F.count_if(F.col("kind") == ",").over(upto)).withColumn("_colons", F.count_if(F.col("kind") == ":").over(upto))
    is_open, is_close = F.col("kind").isin(*OPENS), F.col("kind").isin(*CLOSES)
    in_open = F.col("_b.kind").isin(*OPENS)
    s = s.withColumn("match_tok", F.when(is_open & F.col("_a.kind").isin(*CLOSES), F.col("_a.tok")).when(is_close & in_open, F.col("_b.tok")))
    s = s.withColumn("opener", F.when(~is_open & in_open, F.col("_b.kind"))).withColumn("opener_tok", F.when(~is_open & in_open, F.col("_b.tok")))
    # what the close has counted beyond the open, seen from the open by the next close of its group
    closed = F.last(F.when(is_close, F.struct("_commas", "_colons")), ignorenulls=True).over(after)
    s = s.withColumn("_end", closed)
    count = F.when(F.col("kind") == "{", F.col("_end._colons") - F.col("_colons")).otherwise(F.when(F.col("match_tok") == F.col("tok") + 1, 0).otherwise(F.col("_end._commas") - F.col("_commas") + 1))
    s = s.withColumn("child_count", F.when(is_open & F.col("match_tok").isNotNull(), count).cast("int"))
    return s.select("doc_id", "skel", "tok", "pos", "kind", "depth", "match_tok", "opener", "opener_tok", "child_count", "next_kind", "next_tok")


def depth_order(s: DataFrame) -> DataFrame:
    """``s`` with ``place``, from 0 in each document: a stable sort of the skeleton by depth."""
    return s.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("depth", "tok")) - 1)
