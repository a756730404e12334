"""Packing by lexical retrieval: windows filled with BM25 neighbours of a seed.

1. Documents become token ids (plus an end id). Whole windows are cut off the
   front of long ones; what is left, under a window, is to be packed.
2. Document frequencies of the terms (token ids) are counted over all rests.
3. Rests are dealt to index shards of bounded size by their rarest terms that
   other rests hold, so that documents alike meet in one. A shard builds an inverted index; each unused document seeds a window, its
   rarest terms query the index, and its unused neighbours, best first, fill
   the window greedily. Where they are too few, all of the seed's terms query
   the index for the rest, so every unused document of the shard that shares a
   term with the seed is ranked before one that shares none. The last one is
   cut where the window ends, and what is left of it stays in the index. Each
   shard ends with one window that is not full, so padding is under one window
   a shard.

Only ids of rests move, once, to their shards. A shard holds about
``SHARD`` tokens, at most twice that, whatever the input; the number of shards
grows with it. A query does not leave its shard: a neighbour that shares other
terms than the rarest one may be in another shard and is not found.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, table
from .words import coded, flat, released, slices

#: Tokens of a shard, on average, and terms of a seed's first query; the second has all.
SHARD, TERMS = 2_000_000, 12
#: Parts of the rests of one rarest term, by their second rarest.
PARTS = 64
#: BM25's parameters.
K1, B = 1.2, 0.75
#: Bytes of text encoded at a time.
TEXT = 1 << 22
#: Fixed value: the split of byte-level BPE, as the file's pre-tokenizer makes it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts that are not words between single spaces and newlines, by all white space that Unicode knows.
ODD = r"\A\z|[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"

_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*b",.;:!?"]] = True


class Encoder:
    """Token ids of texts by a tokenizers file, exactly as ``encode`` gives them.

    A byte-level BPE without normalisation splits before each single space
    between other characters, around each single newline, and between letters
    and punctuation. Where a text's white space is only that, it is cut there,
    and each distinct piece of many texts is merged once, by rank, where ids
    follow the order of merges, as in files of this kind. Any other text, and
    any that holds a special token's string, goes to the library as a whole,
    and so do all where the file is of another kind. Nothing learnt is kept.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD, *map(re.escape, self.special)])
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_rank = self._ranked(json.loads(self.tokenizer.to_str()))

    def _ranked(self, spec: dict):
        """A merger by rank, None where the file is not a plain byte-level BPE with ids in order of merges."""
        import tiktoken

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or split.get("use_regex") is False or spec.get("normalizer"):
            return None
        # the characters that stand for bytes: printable ones for themselves, the others from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in set(own)]
        byte_of = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(others)}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.special and all(c in byte_of for c in t)}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or len(ranks) < 256 or max(ranks[bytes([x])] for x in range(256)) >= merged[0]:
            return None
        self.line = ranks[b"\n"]
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has; none is empty, and newlines stand alone.

        They are merged in one call, with newlines between them: a newline is one id, and no other id holds one.
        """
        lines = np.array([p == b"\n" for p in pieces])
        out = self.by_rank.encode_to_numpy("\n".join([p.decode() for p in pieces if p != b"\n"]), disallowed_special=())
        ends = np.flatnonzero(out == self.line)
        sizes = np.ones(len(pieces), np.int64)
        if not lines.all():
            sizes[~lines] = np.diff(np.concatenate([[-1], ends, [len(out)]])) - 1
        every = np.full(int(sizes.sum()), self.line, self.kind)
        every[np.repeat(~lines, sizes)] = out[out != self.line]
        return every, sizes

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts whose white space is single spaces and newlines between words: each distinct word is merged once."""
        data, bounds = flat(texts)
        start = data == 0x20
        line = data == 0x0A
        start |= line
        start[1:] |= line[:-1] | _LETTER[data[:-1]] & _MARK[data[1:]]
        start[bounds[:-1]] = True  # no text here is empty
        starts = np.flatnonzero(start)
        codes, distinct = coded(data, np.append(starts, len(data)))
        every, sizes = self._merged(distinct)
        # the ids of each word, one after the other
        n = sizes[codes]
        ends = np.cumsum(n)
        out = every[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - n), n)]
        return np.split(out, ends[np.searchsorted(starts, bounds[1:-1]) - 1])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string column; null texts are empty."""
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, self.odd)) if self.by_rank is not None else pa.array(np.zeros(len(texts), bool))
        plain = plain.to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        if plain.any():
            for i, ids in zip(np.flatnonzero(plain).tolist(), self._by_words(texts.filter(pa.array(plain))), strict=True):
                out[i] = ids
        for i in np.flatnonzero(~plain).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.kind)
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenised(docs: DataFrame, path: str, window: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, crcs, rest): count of ids with the end id, crc32 of each whole window, and the ids that are left as bytes."""
    d = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        try:
            for batch in batches:
                for part in slices(batch, "text", TEXT):
                    n, crcs, rest = [], [], []
                    for ids in encoder.encode(part.column("text")):
                        ids = np.append(ids, encoder.kind.type(end))
                        whole = len(ids) // window * window
                        n.append(len(ids))
                        crcs.append([zlib.crc32(w.astype("<u4").tobytes()) for w in ids[:whole].reshape(-1, window)])
                        rest.append(ids[whole:].tobytes())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary())], ["doc_id", "n", "crcs", "rest"])
        finally:
            released()

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n bigint, crcs array<bigint>, rest binary")


def document_frequencies(tokens: DataFrame, kind: np.dtype) -> tuple[np.ndarray, int]:
    """How many rests hold each id, and how many rests there are: one number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(0, np.int64), 0
        for batch in batches:
            for r in batch.column("rest"):
                ids = np.unique(np.frombuffer(r.as_py(), kind))
                if len(ids):
                    if ids[-1] >= len(total):
                        total = np.concatenate([total, np.zeros(int(ids[-1]) + 1 - len(total), np.int64)])
                    total[ids] += 1
                    rows += 1
        t = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(t, -1)), pa.array(np.append(total[t], rows))], ["t", "c"])

    found = tokens.select("rest").mapInArrow(run, "t bigint, c bigint").groupBy("t").agg(F.sum("c").alias("c")).toPandas()
    counts = dict(zip(found["t"], found["c"], strict=True))
    n = int(counts.pop(-1, 0))
    df = np.zeros(max(counts, default=0) + 1, np.int64)
    df[list(counts)] = list(counts.values())
    return df, n


def routes(rests: list[np.ndarray], rank: np.ndarray) -> np.ndarray:
    """For each rest its rarest term and a part by its second rarest, as one number; terms that no other rest holds don't count.

    ``rank`` orders terms by rarity, with the number of terms for those of one rest.
    """
    none, out = len(rank), np.empty(len(rests), np.int64)
    for i, rest in enumerate(rests):
        r = rank[rest]
        first = int(r.min(initial=none))
        second = int(r[r != first].min(initial=none))
        out[i] = first * PARTS + second % PARTS if first < none else none * PARTS
    return out


def ranges(codes: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, shards) of each of the ascending ``codes``: neighbouring codes share a shard, one over ``most`` is dealt over several."""
    many = np.maximum(1, -(-sizes // most))
    return (np.cumsum(sizes) - sizes) // most, many


class Shard:
    """An inverted BM25 index over the rests of one shard."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray) -> None:
        self.n, self.rests, self.terms_of_all = len(rests), rests, len(idf)
        lengths = np.array([len(r) for r in rests], np.float32)
        parts = [np.unique(r, return_counts=True) for r in rests]
        doc = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in parts])
        term = np.concatenate([t for t, _ in parts]).astype(np.int32)
        tf = np.concatenate([c for _, c in parts]).astype(np.float32)
        weight = idf.astype(np.float32)[term]
        impact = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(1.0, lengths.mean())))
        # by document, for queries of all terms
        self.by_doc, self.held = (doc, term, impact), self.n
        order = np.argsort(term, kind="stable")
        names, starts = np.unique(term[order], return_index=True)
        self.at = dict(zip(names.tolist(), zip(starts.tolist(), np.append(starts[1:], len(order)).tolist(), strict=True), strict=True))
        self.doc, self.impact = doc[order], impact[order]
        # a query: the rarest terms of a document that another one of the shard holds
        shared = np.bincount(np.searchsorted(names, term), minlength=len(names))[np.searchsorted(names, term)] > 1
        best = np.lexsort((term, -weight, doc))
        best = best[shared[best]]
        rank = np.arange(len(best)) - np.searchsorted(doc[best], doc[best])
        best = best[rank < TERMS]
        self.terms = np.split(term[best], np.searchsorted(doc[best], np.arange(1, self.n)))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All unused documents that share a term of the seed's query, best first; the seed is not one of them."""
        scores = np.zeros(self.n)
        for t in self.terms[seed].tolist():
            a, b = self.at[t]
            scores[self.doc[a:b]] += self.impact[a:b]  # a document is once in a list
        return self._ranked(scores, seed, unused)

    def others(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All unused documents that share any term with the seed, best first by all of its terms; the seed is not one of them.

        ``unused`` only ever loses documents: when it has lost half of those held by document, they are dropped there.
        """
        if 2 * (left := np.count_nonzero(unused)) < self.held:
            keep = unused[self.by_doc[0]]
            self.by_doc, self.held = tuple(x[keep] for x in self.by_doc), left
        doc, term, impact = self.by_doc
        asked = np.zeros(self.terms_of_all, bool)
        asked[self.rests[seed]] = True
        met = asked[term]
        return self._ranked(np.bincount(doc[met], impact[met], self.n), seed, unused)

    def _ranked(self, scores: np.ndarray, seed: int, unused: np.ndarray) -> np.ndarray:
        scores[~unused] = 0
        scores[seed] = 0
        some = np.nonzero(scores > 0)[0]
        return some[np.lexsort((some, -scores[some]))]


def pack_shard(rests: list[np.ndarray], idf: np.ndarray, window: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start in its rest, length) that hold each id of ``rests`` once.

    All sequences but those of the last window are full; the last one is cut
    into lengths that are powers of two, which take no padding.
    """
    lengths, taken = np.array([len(r) for r in rests], np.int64), np.zeros(len(rests), np.int64)
    unused, first, out = lengths > 0, 0, []
    index = Shard(rests, idf) if unused.any() else None
    while True:
        while first < len(rests) and not unused[first]:
            first += 1
        if first == len(rests):
            break
        pieces, room, later = [], window, first

        def place(i: int) -> None:
            nonlocal room
            size = int(min(room, lengths[i] - taken[i]))
            pieces.append((i, int(taken[i]), size))
            taken[i] += size
            unused[i] = taken[i] < lengths[i]
            room -= size

        place(first)
        for search in (index.neighbours, index.others):
            for i in search(first, unused).tolist() if room else ():
                if not room:
                    break
                place(i)
        while room and later < len(rests):  # no document that is left shares a term: the next unused ones
            if unused[later]:
                place(later)
            else:
                later += 1
        out.append(pieces)
    if out and (short := sum(p[2] for p in out[-1])) < window:
        pieces, at = out.pop(), 0
        for bit in range(short.bit_length() - 1, -1, -1):
            if short >> bit & 1:
                room, part = 1 << bit, []
                while room:
                    i, start, size = pieces[at]
                    use = min(size, room)
                    part.append((i, start, use))
                    room -= use
                    pieces[at] = (i, start + use, size - use)
                    at += use == size
                out.append(part)
    return out


def _dealt(tokens: DataFrame, df: np.ndarray, kind: np.dtype, most: int) -> DataFrame:
    """``tokens`` with the shard of each rest, ``most`` bytes on average: sizes of routes are summed, then cut into ranges."""
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))
    rank[df < 2] = len(df)
    ranks = tokens.sparkSession.sparkContext.broadcast(rank)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rests = batch.column("rest").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(routes([np.frombuffer(r, kind) for r in rests], ranks.value)), pa.array(list(map(len, rests)), pa.int64())], ["code", "size"])

    # a row for each rarest term and part at most
    held = tokens.select("rest").mapInArrow(sizes, "code bigint, size bigint").groupBy("code").agg(F.sum("size").alias("size")).orderBy("code").toPandas()
    codes = held["code"].to_numpy()
    cut = tokens.sparkSession.sparkContext.broadcast((codes, *ranges(codes, held["size"].to_numpy(), most)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, many = cut.value
        for batch in batches:
            at = np.searchsorted(known, routes([np.frombuffer(r, kind) for r in batch.column("rest").to_pylist()], ranks.value))
            shard = first[at] + batch.column("h").to_numpy() % many[at]
            names = [n for n in batch.schema.names if n != "h"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(shard, pa.int64())], [*names, "shard"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.withColumn("h", F.xxhash64("doc_id", "rest")).mapInArrow(deal, f"{kinds}, shard bigint")


def pack_documents(docs: DataFrame, path: str, window: int = 2048, end: int = 1, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece.

    Every id of every document is in exactly one piece; sequences are full
    (``window``) or as long as a power of two. Null and empty texts are their
    end id alone. Each row of a repeated doc_id is a document. An empty table
    gives no rows. Equal inputs give equal packings.
    """
    kind = _encoder(path).kind
    tokens = table(tokenised(docs, path, window, end, id_col, text_col))
    df, n = document_frequencies(tokens, kind)
    spread = tokens.sparkSession.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))
    size = kind.itemsize
    total = tokens.agg(F.sum(F.octet_length("rest"))).first()[0] or 0
    dealt = tokens.withColumn("shard", F.lit(0).cast("bigint")) if total <= size * shard else _dealt(tokens, df, kind, size * shard)

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "n", "rest"], kind="stable")
        rests = [np.frombuffer(r, kind) for r in f["rest"]]
        ids, counts, base = f["doc_id"].to_numpy(), f["n"].to_numpy(), int(f["shard"].iloc[0]) << 32
        rows, sequence = [], base
        for i, crcs in enumerate(f["crcs"]):
            for w, crc in enumerate(crcs):
                rows.append((ids[i], w * window, window, crc, counts[i], sequence, 0))
                sequence += 1
        for pieces in pack_shard(rests, spread.value, window):
            at = 0
            for i, start, length in pieces:
                crc = zlib.crc32(rests[i][start : start + length].astype("<u4").tobytes())
                rows.append((ids[i], counts[i] - len(rests[i]) + start, length, crc, counts[i], sequence, at))
                at += length
            sequence += 1
        released()
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind_of = docs.schema[id_col].dataType.simpleString()
    return dealt.groupBy("shard").applyInPandas(pack, f"doc_id {kind_of}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
