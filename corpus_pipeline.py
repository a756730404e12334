"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

toxicity -> line dedup -> near duplicates -> source mix -> packing. Every stage
works on all that its predecessor kept; all but the last return the columns of
documents. Stages that change a text bring n_chars up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from jsonloom.llm.common import read, table
from jsonloom.llm.queries import tokenizer_file

#: The contract of near duplicates on word shingles.
WORDS, PERCENT = 5, 80


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("bigint"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go. It learns from the labelled rows that ``op1`` may learn from."""
    labels = read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id", 4, 2)))
    names = docs.columns
    kept = toxicity.score(docs, model, keep=[c for c in names if c != "doc_id"])
    return kept.where("predicted = 0").select(*names)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document that loses all of them goes too, one that was empty stays."""
    bitmaps = line_dedup.keep_bitmaps(docs)
    kept = line_dedup.apply_bitmaps(docs, bitmaps, keep=[c for c in docs.columns if c not in ("doc_id", "text")])
    return _counted(kept.where("n_dropped < n_lines").select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays."""
    found = jaccard_join.near_duplicates(docs, WORDS, PERCENT)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, cut at each source's budget."""
    return _counted(mixing.apply_mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("jaccard_join", drop_near_duplicates), ("source_mix", mix), ("packing", pack)]
#: Toxicity is a fitted model and packing a greedy search: SQL expresses neither.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
