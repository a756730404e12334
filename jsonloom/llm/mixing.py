"""Mixing sources to target weights, with DataFrame operators only.

Each document gets a hash-random key; the documents of a source are sorted by
it in ranges, token counts are summed as distributed prefix sums (totals per
range, then within the range), and every source is cut at its exact budget.
Only (doc_id, source, size, key) moves between executors, never a text.

Skew: a source may hold a third of all rows. Its documents are dealt over
``RANGES`` ranges of the random key, and no window spans more than one range;
the window across ranges sees one row per range, pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, pick, table

#: Hex digits of the random key that name its range: 16 ** 3 ranges in a source.
RANGE_DIGITS = 3


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): words of each document, 0 for a null text."""
    d = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    return d.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): each source's share of ``share`` times all sizes, ``most`` times its own at most.

    Sources stand in code point order, null last, and take ``weights`` in turn.
    What a capped source leaves goes to the others by weight until none is
    above its cap: with sources by rising cap / weight, the first k are capped
    for the least k at which the level of the others is under the next cap.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # the windows below see one row per source
    ordered = by_source.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("n") - 1, F.lit(len(weights))))
    w = ordered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(1))
    before = Window.partitionBy(F.lit(1)).orderBy("ratio", "n").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("capped")) / (F.sum("weight").over(everything) - F.col("used")))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "n", "level"))).over(everything)["level"]
    return w.withColumn("at", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(sized: DataFrame, goals: DataFrame, seed: int = 0, digits: int = RANGE_DIGITS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document.

    ``taken`` counts the words the mix takes of it over all epochs. A source's
    target, rounded to words, is whole epochs over all its documents and then
    its documents in order of the random key up to the exact budget, so one
    document in each source is taken in part. Equal rows take turns in any
    order, alike in every run. A source of size 0 and a document of size 0
    give 0; nulls in doc_id and source are values like others.
    """
    keyed = sized.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("range", F.substring("key", 1, digits))
    in_range = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = keyed.repartitionByRange("source", "range").withColumn("inner", F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    across = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("source", "range").agg(F.sum("size").alias("in_range")).withColumn("outer", F.coalesce(F.sum("in_range").over(across), F.lit(0)))
    g = goals.withColumn("budget", F.floor(F.col("target") + 0.5).cast("bigint"))
    g = g.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    g = g.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    offsets = starts.alias("s").join(g.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        F.col("s.source").alias("o_source"), F.col("s.range").alias("o_range"), "outer", "source_size", "target", "epochs", "rest"
    )
    both = dealt.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    left = F.col("rest") - F.col("outer") - F.col("inner")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), left))
    return both.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``mix`` over documents: (doc_id, source, size, source_size, target, taken), one row per row of ``docs``.

    Texts are read once; their sizes are kept as a narrow table from which
    totals, prefix sums and cuts come. An empty table gives no rows.
    """
    sized = table(sizes(docs, id_col, text_col, source_col))
    return mix(sized, targets(sized, weights, share, most), seed)


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them, with all their columns.

    A document comes as often as the mix takes it whole and, at its source's
    cut, once more with its first words only (a row of empty text where the
    cut is before its first word does not come). Documents of no words come
    once per whole epoch of their source. Rows that share doc_id, source and
    size are numbered on both sides and matched one to one.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    i, t, s = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    mixed = mix_sources(docs, weights, share, most, seed, id_col, text_col, source_col)
    mixed = mixed.withColumn("epochs", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).when(F.col("source_size") > 0, F.floor((F.col("target") + 0.5) / F.col("source_size"))).otherwise(F.lit(1)).cast("int"))
    mixed = mixed.withColumn("part", F.col("taken") - F.col("epochs") * F.col("size")).where("epochs > 0 OR part > 0")
    mixed = mixed.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "epochs", "part")
    mixed = mixed.withColumn("m_n", F.row_number().over(Window.partitionBy("m_id", "m_source", "m_size").orderBy("epochs", "part")))
    plain = plain.withColumn("size", F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("bigint"))
    plain = plain.withColumn("n", F.row_number().over(Window.partitionBy(i, s, "size").orderBy(t)))
    both = plain.join(mixed, F.col(i).eqNullSafe(F.col("m_id")) & F.col(s).eqNullSafe(F.col("m_source")) & (F.col("size") == F.col("m_size")) & (F.col("n") == F.col("m_n")))
    whole = F.when(F.col("epochs") > 0, F.array_repeat(F.lit(None).cast("bigint"), F.col("epochs"))).otherwise(F.array().cast("array<bigint>"))
    cut = F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>"))
    both = both.withColumn("words", F.explode(F.concat(whole, cut)))
    first = F.array_join(F.slice(F.regexp_extract_all(t, F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words").isNull(), F.col(t)).otherwise(first)
    return both.withColumn(t, text).select(*[F.col(f"c{k}") for k in range(len(names))]).toDF(*names)
