"""Document fingerprints as a homomorphic multiset hash, with DataFrame operators only.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed
to a wide vector and a document's fingerprint is the sum of its vectors, lane
by lane modulo a power of two. So the order of paragraphs doesn't matter, and
a paragraph is inserted or deleted by adding or subtracting its vector.

A vector has two parts:

* ``EQUAL`` = 16 lanes modulo 2**32, cut from two SHA-256 digests of the whole
  paragraph: equality of multisets.
* ``LIKE`` = 96 lanes modulo 2**30, and a count. Each clause of the paragraph
  (what lies between punctuation) adds one hash bit to each lane. A lane that
  counts c ones among n clauses stands for 2c - n, a sum of random signs, and
  the cosine of two such vectors estimates the cosine of the clause multisets.

Lanes of the second part stand two to a 64-bit word, 32 bits apart, and are
masked after each addition, which is the reduction modulo 2**30. No text that
fits a row has as many clauses, so no lane of one wraps.

A text without punctuation is one clause, like its equals only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: Lanes of 32 bits for equality; words of two 30-bit lanes for likeness, 24 from each half of a clause hash (its low 60 bits).
EQUAL, HASHES, SHIFTS = 16, 2, 24
LIKE = HASHES * SHIFTS * 2
#: Two lanes' lowest bits, and all their bits.
ONES, LANES = 0x0000000100000001, 0x3FFFFFFF3FFFFFFF
CLAUSE = "[\\n.,;:!?]+"


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def clauses(text: Column) -> Column:
    """Clauses of all paragraphs, stripped; empty ones go. Paragraph ends are clause ends."""
    return F.filter(F.transform(F.split(text, CLAUSE, -1), lambda c: F.btrim(c)), lambda c: c != "")


def _number(hexed: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(hexed, at, digits), 16, 10).cast("bigint")


def _sums(hashes: Column, mask: int, parts: list) -> list[Column]:
    zero = F.lit(0).cast("bigint")
    one = lambda p: F.aggregate(hashes, zero, lambda a, h: (a + p(h)).bitwiseAND(F.lit(mask)))
    return [one(p) for p in parts]


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the fingerprint of ``text`` (null: empty) as ARRAY<BIGINT> ``name``: equality lanes, likeness words, clause count."""
    df = df.withColumn("_p", F.transform(paragraphs(F.coalesce(text, F.lit(""))), lambda p: F.concat(F.sha2(F.concat(F.lit("0"), p), 256), F.sha2(F.concat(F.lit("1"), p), 256))))
    df = df.withColumn("_c", F.transform(clauses(F.coalesce(text, F.lit(""))), F.md5))
    df = df.withColumn("_c", F.transform("_c", lambda m: F.struct(_number(m, 1, 15).alias("a"), _number(m, 17, 15).alias("b"))))
    equal = _sums(F.col("_p"), 0xFFFFFFFF, [lambda h, k=k: _number(h, 8 * k + 1, 8) for k in range(EQUAL)])
    words = [_sums(F.col("_c"), LANES, [lambda h, k=k, f=f: F.shiftright(h[f], k).bitwiseAND(F.lit(ONES)) for k in range(SHIFTS)]) for f in ("a", "b")]
    return df.withColumn(name, F.array(*equal, *words[0], *words[1], F.size("_c").cast("bigint"))).drop("_p", "_c")


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of both multisets together; with sign -1 of the first without the second."""
    n = EQUAL + HASHES * SHIFTS

    def lane(x: Column, y: Column, i: Column) -> Column:
        if sign < 0:
            y = F.when(i < EQUAL, F.lit(1 << 32) - y).when(i < n, (F.lit(LANES) - y + F.lit(ONES)).bitwiseAND(F.lit(LANES))).otherwise(-y)
        return F.when(i < EQUAL, (x + y).bitwiseAND(F.lit(0xFFFFFFFF))).when(i < n, (x + y).bitwiseAND(F.lit(LANES))).otherwise(x + y)

    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z, i: lane(z["x"], z["y"], i))


def as_text(fp: Column) -> Column:
    """Hex: 8 digits a lane for equality, 16 digits a word for likeness and the count."""
    return F.array_join(F.transform(fp, lambda x, i: F.lower(F.lpad(F.hex(x), F.when(i < EQUAL, 8).otherwise(16), "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine that the likeness lanes estimate, at least 0 and under 1.

    Sums of sign products are over integers, so they are exact in any order.
    """
    n = EQUAL + HASHES * SHIFTS

    def dot(x: Column, y: Column) -> Column:
        def word(i: Column) -> Column:
            u, v, m, k = F.get(x, i), F.get(y, i), F.get(x, F.lit(n)), F.get(y, F.lit(n))
            signs = lambda w, c, s: F.shiftright(w, s).bitwiseAND(F.lit(0x3FFFFFFF)) * 2 - c
            return signs(u, m, 0) * signs(v, k, 0) + signs(u, m, 32) * signs(v, k, 32)

        return F.aggregate(F.sequence(F.lit(EQUAL), F.lit(n - 1)), F.lit(0).cast("bigint"), lambda acc, i: acc + word(i)).cast("double")

    norm = dot(a, a) * dot(b, b)
    cosine = F.when(norm > 0, dot(a, b) / F.sqrt(norm)).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(0.999), F.greatest(F.lit(0.0), cosine)))


#: Bytes of text that a range of ids holds about, and the most ranges (what is collected: one id each).
RANGE, MOST_RANGES = 4 << 20, 8192


def _ranges(df: DataFrame, id_col: str, text_col: str) -> int:
    """How many ranges of ``RANGE`` bytes the texts fill."""
    size = df.agg(F.sum(F.octet_length(text_col).cast("bigint") + 64).alias("b")).first()["b"] or 0
    return int(min(MOST_RANGES, max(8, -(-size // RANGE))))


def with_next(df: DataFrame, add: Callable[[DataFrame], DataFrame], carried: list[str], id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """``add(df)`` with ``next_<c>``: column c (of ``carried``) of the next row by ascending id, after the last row the first one's.

    Rows are dealt to ``blocks`` ranges of the id, cut at quantiles, as many as
    the texts' bytes ask for; inside one the next row is a window's lead, and
    each range's last row takes the first row of the next range. Those first
    rows are found on bare ids and texts, and ``add`` sees only them again.
    Nulls come first; ties go by their texts.
    """
    blocks = blocks or _ranges(df, id_col, text_col)
    cuts = df.agg(F.percentile_approx(id_col, [i / blocks for i in range(1, blocks)], 10 * blocks).alias("c")).first()["c"] if blocks > 1 else []  # at most `blocks` numbers
    cuts = sorted(set(cuts or []))
    # a binary search as a sum: how many cuts are at or under the id
    df = df.withColumn("_block", F.lit(0))
    if cuts:
        # one literal once folded: an array of literals takes a minute to plan for thousands of cuts
        all_cuts = F.split(F.lit(",".join(map(str, cuts))), ",").cast(f"array<{df.schema[id_col].dataType.simpleString()}>")
        step = 1 << (len(cuts).bit_length() - 1)
        while step:
            df = df.withColumn("_block", F.when(F.coalesce(F.get(all_cuts, F.col("_block") + step - 1) <= F.col(id_col), F.lit(False)), F.col("_block") + step).otherwise(F.col("_block")))
            step >>= 1
    df = df.withColumn("_block", F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(F.col("_block")))
    inside = Window.partitionBy("_block").orderBy(F.col(id_col).asc_nulls_first(), F.col(text_col))
    led = add(df).withColumn("_next", F.lead(F.struct(*carried)).over(inside))
    heads = df.groupBy("_block").agg(F.min(F.struct(id_col, text_col)).alias("_first")).select("_block", f"_first.{id_col}", f"_first.{text_col}")
    heads = add(heads).select("_block", F.struct(*carried).alias("_head"))
    ring = Window.orderBy("_block")  # a row for each range
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("_block").alias("_at"), F.coalesce(F.lead("_head").over(ring), F.first("_head").over(whole)).alias("_after"))
    both = led.join(heads, led["_block"] == heads["_at"])
    chosen = F.coalesce("_next", "_after")
    return both.select(*[c for c in led.columns if c not in ("_block", "_next")], *[chosen[c].alias(f"next_{c}") for c in carried])


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by as
    many first ones (or all) of the next document by ascending doc_id, after
    the last the first. Returns doc_id, n_chars, edited, fingerprint and
    edited_fingerprint as hex, near_edited and near_next. Null texts are
    empty; equal texts have equal fingerprints; a table of one document is its
    own next; an empty table gives no rows; tied ids go by their texts.
    """
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    d = with_next(d, lambda x: with_fingerprint(x, F.col("text"), "fp"), ["text", "fp"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    d = d.withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited).drop("text", "next_text")
    d = with_fingerprint(d, F.col("edited"), "edited_fp")
    return d.select("doc_id", "n_chars", "edited", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
                    likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
