"""The tape: each document as an array of 64-bit words and a string buffer.

A word is a tag in its top 8 bits and a payload of 56. Containers hold the
place of their other end (an open: one past the close, and its child count in
bits 32 to 55); strings the offset of their record; numbers take a second word
of raw bits. Records are a 4-byte little-endian length, the text and a NUL, in
slots of raw length + 5 whose rest is zero.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import number_kind, unescape
from ..plans.options import MAX_COUNT, ParseOptions
from .nodes import valid
from .stats import number_bits
from .tokens import CLOSES, OPENS, by_doc, footprint, skeleton

#: Fixed values of the layout.
TAG_SHIFT, PAYLOAD, COUNT_SHIFT, HEADER, TRAILER = 56, (1 << 56) - 1, 32, 4, 1
QUOTE, CLOSE, ROOT = b'"}r'
#: Tokens of a valid document, without separators; what makes a number a double.
VALUES, FRACTION = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]]|[^ \t\n\r{}\[\]:,"]++', re.DOTALL), re.compile(rb"[.eE]")
#: Bytes of words and records laid out at a time, or those of one document.
PART = 1 << 20


def word(tag: Column, payload: Column) -> Column:
    """A tape word as a signed BIGINT; ``tag`` is one character."""
    return F.shiftleft(F.ascii(tag).cast("bigint"), TAG_SHIFT).bitwiseOR(payload.cast("bigint"))


def tag_of(w: Column) -> Column:
    return F.chr(F.shiftrightunsigned(w, TAG_SHIFT))


def payload_of(w: Column) -> Column:
    return w.bitwiseAND(F.lit(PAYLOAD))


def end_of(w: Column) -> Column:
    """Place one past a container's close, of its open word; place of the open, of its close word."""
    return w.bitwiseAND(F.lit((1 << COUNT_SHIFT) - 1))


def count_of(w: Column) -> Column:
    return F.shiftright(w, COUNT_SHIFT).bitwiseAND(F.lit(MAX_COUNT))


def records(t: DataFrame) -> DataFrame:
    """(doc_id, tok, record_offset, raw_len, str) of the string tokens."""
    raw = F.octet_length("text") - 2
    s = t.where("kind = 'q'").withColumn("raw_len", raw.cast("int"))
    before = F.sum(F.col("raw_len") + HEADER + TRAILER).over(by_doc().rowsBetween(Window.unboundedPreceding, -1))
    return s.select("doc_id", "tok", F.coalesce(before, F.lit(0)).cast("bigint").alias("record_offset"), "raw_len", unescape(F.col("text")).alias("str"))


def tape_words(t: DataFrame) -> DataFrame:
    """(doc_id, idx, word) of the tokens of valid documents, root words included."""
    w = by_doc()
    up = w.rowsBetween(Window.unboundedPreceding, -1)
    kind, text = F.col("kind"), F.col("text")
    p = t.withColumn("at", (1 + F.coalesce(F.sum(footprint(kind, text)).over(up), F.lit(0))).cast("bigint"))
    slot = F.when(kind == "q", F.octet_length("text") - 2 + HEADER + TRAILER).otherwise(0)
    p = p.withColumn("record", F.coalesce(F.sum(slot).over(up), F.lit(0)).cast("bigint"))
    s = skeleton(t).where(F.col("kind").isin(*OPENS, *CLOSES)).select("doc_id", "tok", "match_tok", "child_count")
    places = p.select("doc_id", F.col("tok").alias("match_tok"), F.col("at").alias("other"))
    p = p.join(s.join(places, ["doc_id", "match_tok"]).drop("match_tok"), ["doc_id", "tok"], "left")
    other, count = F.col("other"), F.least("child_count", F.lit(MAX_COUNT)).cast("bigint")
    number = number_kind(text)
    mark = F.when(number == "int64", "l").when(number == "uint64", "u").otherwise("d")
    zero = F.lit(0).cast("bigint")
    words = (
        F.when(kind.isin(*OPENS), F.array(word(kind, F.shiftleft(count, COUNT_SHIFT).bitwiseOR(other + 1))))
        .when(kind.isin(*CLOSES), F.array(word(kind, other)))
        .when(kind == "q", F.array(word(F.lit('"'), F.col("record"))))
        .when((kind == "s") & text.isin("true", "false", "null"), F.array(word(F.substring(text, 1, 1), zero)))
        .when(kind == "s", F.array(word(mark, zero), number_bits(text)))
    )
    body = p.where(~kind.isin(":", ",")).select("doc_id", "at", F.posexplode(words).alias("i", "word")).select("doc_id", (F.col("at") + F.col("i")).alias("idx"), "word")
    size = t.groupBy("doc_id").agg((F.sum(footprint(kind, text)) + 1).alias("last"))
    ends = size.select("doc_id", F.explode(F.array(F.struct(zero.alias("idx"), word(F.lit("r"), F.col("last")).alias("word")), F.struct(F.col("last").alias("idx"), word(F.lit("r"), zero).alias("word")))).alias("r")).select("doc_id", "r.*")
    return body.unionByName(ends)


def lay(text: bytes, words: array, strings: bytearray) -> None:
    """Adds the tape of one valid document to ``words`` and its records to ``strings``; memory is what is added, and the open brackets."""
    base, record = len(words), len(strings)
    words.append(0)
    opens, children = [], [0]
    for m in VALUES.finditer(text):
        t = m[0]
        c = t[0]
        if c in b"}]":
            at, n = opens.pop(), children.pop()
            # keys are strings too, so a member counts twice
            words[base + at] = (c - 2) << TAG_SHIFT | min(n // 2 if c == CLOSE else n, MAX_COUNT) << COUNT_SHIFT | (len(words) - base + 1)
            words.append(c << TAG_SHIFT | at)
            continue
        children[-1] += 1
        if c == QUOTE:
            words.append(QUOTE << TAG_SHIFT | (len(strings) - record))
            body = t[1:-1] if b"\\" not in t else json.loads(t).encode()
            strings += len(body).to_bytes(HEADER, "little")
            strings += body
            strings += bytes(len(t) - 2 - len(body) + TRAILER)
        elif c in b"{[":
            opens.append(len(words) - base)
            children.append(0)
            words.append(0)
        elif c in b"tfn":
            words.append(c << TAG_SHIFT)
        else:
            words.extend(_number(t))
    words[base] = ROOT << TAG_SHIFT | (len(words) - base)
    words.append(ROOT << TAG_SHIFT)


def _number(t: bytes) -> tuple[int, int]:
    """The two words of a number: its kind and its bits, as ``number_kind`` and ``number_bits`` give them."""
    if len(t) <= 20 and not FRACTION.search(t):
        n = int(t)
        if -1 << 63 <= n < 1 << 63:
            return ord("l") << TAG_SHIFT, n
        if 0 < n < 1 << 64:
            return ord("u") << TAG_SHIFT, n - (1 << 64)
    return ord("d") << TAG_SHIFT, struct.unpack("<q", struct.pack("<d", float(t)))[0]


def _laid(docs: DataFrame) -> DataFrame:
    """(doc_id, tape, strings) of valid documents (doc_id, json), row by row: nothing is shuffled, and no id is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first = batch.column("json"), 0
            while first < len(texts):
                words, strings, ends, cuts, at = array("q"), bytearray(), [0], [0], first
                while at < len(texts) and 8 * len(words) + len(strings) < PART:
                    lay(texts[at].as_py().encode(), words, strings)
                    ends.append(len(words))
                    cuts.append(len(strings))
                    at += 1
                tape = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.Array.from_buffers(pa.int64(), len(words), [None, pa.py_buffer(words)]))
                held = pa.Array.from_buffers(pa.large_binary(), at - first, [None, pa.py_buffer(array("q", cuts)), pa.py_buffer(strings)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, at - first), tape.cast(pa.list_(pa.int64())), held.cast(pa.binary())], ["doc_id", "tape", "strings"])
                first = at

    return docs.select("doc_id", "json").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tape array<bigint>, strings binary")


def string_buffer(docs: DataFrame) -> DataFrame:
    """(doc_id, strings BINARY) of valid documents (doc_id, json); bytes are laid out on Arrow batches."""
    return _laid(docs).select("doc_id", "strings")


def documents(docs: DataFrame, json_col: str = "json", id_col: str = "doc_id", options: ParseOptions = ParseOptions()) -> DataFrame:
    """(doc_id, tape ARRAY<BIGINT>, strings BINARY) of the valid documents: self-contained parsed values.

    A row a document, made in its own row, so ids may repeat or be null. The
    words are those of ``tape_words``.
    """
    return _laid(valid(docs, json_col, id_col, options))


def record_text(strings: Column, offset: Column) -> Column:
    """The text of the record at an offset of a string buffer."""
    little = sum((F.conv(F.hex(F.substring(strings, (offset + 1 + i).cast("int"), F.lit(1))), 16, 10).cast("bigint") * (1 << (8 * i)) for i in range(1, HEADER)), F.conv(F.hex(F.substring(strings, (offset + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint"))
    return F.substring(strings, (offset + 1 + HEADER).cast("int"), little.cast("int")).cast("string")
