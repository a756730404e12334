"""Line-level deduplication across documents, with DataFrame operators only.

Hashes of lines, never their text, are range-partitioned and sorted by
document and position; each key's first document is streamed out of the sorted
runs, and what comes back per document is a run-length keep bitmap.

Skew: a key may be in a third of all documents. The range key is (hash, salt)
with the salt taken from the document, so such a key spreads over ``SALTS``
runs. A run's later documents are known to be repeats at once; only each run's
first document meets the other runs of its key, at most ``SALTS`` documents.

Texts are split and hashed once: the narrow hashes are written to the shared
folder before ranges are sampled from them, and the sorted runs' verdicts after
the one shuffle of all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, drop_table, pick, table

#: Runs over which the lines of one key are spread.
SALTS = 256


def line_key(line: Column) -> Column:
    """What makes two lines the same: ends stripped, A-Z lowered."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, salts: int = SALTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs ARRAY<INT>, n_dropped BIGINT) of each document that loses a line.

    ``runs`` is the keep bitmap in run-length form: lengths of runs of kept
    and dropped lines in turn, kept first (maybe 0); lines behind the last run
    are kept. A key is identified by 96 bits (two hash functions); keys under
    ``min_chars`` code points are never dropped. The rows of a repeated doc_id
    count as one document. Nulls: a null text is one empty line; a null doc_id
    counts as the smallest document. An empty table gives no rows.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    lines = d.select("doc_id", F.posexplode(F.transform(F.split("text", "\n", -1), line_key)).alias("pos", "key"))
    hashed = lines.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), "doc_id", "pos"
    )
    hashed = table(hashed)
    run = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    firsts = hashed.repartitionByRange("h1", "h2", "salt").withColumn("first", F.first("doc_id").over(run)).withColumn("again", ~F.col("doc_id").eqNullSafe(F.col("first")))
    firsts = table(firsts.select("h1", "h2", "doc_id", "pos", "again"))
    drop_table(hashed)
    across = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    heads = firsts.where(~F.col("again")).withColumn("first", F.first("doc_id").over(across))
    drops = firsts.where("again").select("doc_id", "pos").unionByName(heads.where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "pos"))
    return _runs(drops)


def _runs(drops: DataFrame) -> DataFrame:
    """Dropped positions as run lengths; islands of consecutive positions have a constant pos - rank."""
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    islands = drops.withColumn("island", F.col("pos") - F.dense_rank().over(by_doc))
    spans = islands.groupBy("doc_id", "island").agg(F.min("pos").alias("at"), (F.max("pos") - F.min("pos") + 1).alias("n"))
    per_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("gaps"), F.sum("n").cast("bigint").alias("n_dropped"))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("gaps", i - 1)["at"] + F.get("gaps", i - 1)["n"])
    runs = F.flatten(F.transform("gaps", lambda g, i: F.array((g["at"] - before(i)).cast("int"), g["n"].cast("int"))))
    return per_doc.select("doc_id", runs.alias("runs"), "n_dropped")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, *keep) of every document, its text without the dropped lines; ``keep`` names columns to carry."""
    keep = keep or []
    d = pick(docs, doc_id=id_col, text=text_col, **{f"k{i}": c for i, c in enumerate(keep)})
    b = bitmaps.select(F.col("doc_id").alias("b_id"), "runs", "n_dropped")
    both = d.join(b, d.doc_id.eqNullSafe(b.b_id), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # kept runs stand at even places of runs; its prefix sums say where each starts
    ends = F.aggregate("runs", F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    both = both.withColumn("ls", lines).withColumn("ends", F.when(F.size("runs") <= 64, ends).otherwise(_prefix("runs")))
    starts = F.filter("ends", lambda e, i: i % 2 == 0)
    kept = F.flatten(F.transform(starts, lambda s, i: F.slice("ls", s + 1, F.coalesce(F.get("runs", i * 2), F.size("ls")))))
    text = F.when(F.col("runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    counts = F.size("ls").cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped")
    return both.select("doc_id", text.alias("text"), *counts, *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])


def _prefix(runs: str) -> Column:
    """Prefix sums of a long array by blocks of 64, so that no step copies the whole of it."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / 64).cast("int")), lambda b: F.slice(runs, b * 64 + 1, 64))
    inner = F.transform(blocks, lambda x: F.aggregate(x, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))))
    sums = F.transform(inner, lambda a: F.element_at(a, -1))
    heads = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return F.concat(F.flatten(F.transform(inner, lambda a, b: F.transform(F.slice(a, 1, F.size(a) - 1), lambda x: x + F.get(heads, b)))), F.array(F.element_at(heads, -1)))


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without its lines that an earlier document holds.

    Lines are what lies between \\n; their key is the line with white space
    stripped at both ends and A-Z lowered. Keys of at least ``min_chars`` code
    points found in two documents or more stay only in the smallest doc_id.
    Returns doc_id, text, n_lines, n_dropped; null and empty texts are one
    empty line, which stays; a document may lose all its lines (empty text).
    Repeated rows of a doc_id are one document, and each of its rows comes back.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, SALTS, id_col, text_col), id_col, text_col)
