"""N-gram Jaccard self-join by adaptive multi-match prefixes.

A document is its set of word shingles. Under one order of all shingles, two
sets of Jaccard similarity t or more share l of the first
``n - ceil(t n) + l`` shingles of each (n its own size), for any l from 1 on.
So each document is indexed under a prefix, and a pair is verified only if it
shares at least the smaller of its two documents' l. A larger l makes a longer
prefix and asks for more matches; each document takes the l that costs least
by the document frequencies of its prefix.

The order puts frequent shingles last, and before them those of short words,
so prefixes hold rare ones. Any order is right; the frequent ones are found over all documents (a shingle is
reported by a batch in which it is frequent, so none frequent overall is
missed) and the ``hot`` most frequent are kept, a bound on what is broadcast.

Groups of copies never become pairs. Equal sets are one class from the start.
Then every class is compared with the hub of each prefix list it is in, the
class whose shingles others share most, which joins most of a group to it; what is left are pairs of
classes of different components, and lists within one component are gone.

Candidates meet as bitmaps first. Each shingle of a set flips one bit of its
bitmap, so two sets differ in at least as many shingles as their bitmaps in
bits; only pairs that may still be similar fetch their whole sets. Shingles
that one document alone has in its prefix, and documents without a partner,
are held back by Bloom filters of fixed size. These let some more through when
they fill up, and never lose any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, pick, table
from .graph import components
from .words import map_slices, word_hashes

#: Hubs that a class is compared with in the first pass: those sharing most prefix shingles.
HUBS = 3
#: Frequent shingles that are ordered by their frequency; the least share of a batch's documents that hold one.
HOT, SHARE = 1 << 17, 0.0005
#: The values of l that a document may take; the costs of dealing a posting and of counting a candidate whose bitmap
#: fits, in units of comparing two bitmaps; partners that a shingle is expected to have beyond those known of.
MATCHES, POSTING, COUNT, PARTNERS = tuple(1 << i for i in range(11)), 20.0, 10.0, 0.02
#: Bytes of text in which frequent shingles are counted at a time.
READ = 1 << 22
#: Words of 64 bits in a set's bitmap; bits of the filters for shingles and for documents (their bound when broadcast).
BITMAP, SHINGLE_BITS, DOC_BITS = 16, 24, 22

#: Odd multipliers (fixed values) that mix word hashes into shingle hashes.
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


def shingles_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles as numbers; fewer words are one shingle, no word is none.

    The top byte is less the longer the shingle, and the others are its hash:
    in ascending order, those of long words come first, which few texts share
    by chance.
    """
    h, bytes_, sizes = word_hashes(texts)
    # a shingle of fewer words is padded with zeros: each text gets k - 1 of them behind it
    padded, long = np.zeros(len(h) + (k - 1) * len(texts) + k, np.uint64), np.zeros(len(h) + (k - 1) * len(texts) + k, np.int64)
    starts = np.cumsum(sizes + (k - 1)) - (sizes + (k - 1))
    places = np.arange(len(h)) + np.repeat((k - 1) * np.arange(len(texts)), sizes)
    padded[places], long[places] = h, bytes_
    rolled, size = np.zeros(len(padded) - k + 1, np.uint64), np.zeros(len(padded) - k + 1, np.int64)
    for i in range(k):
        rolled *= MIX
        rolled += padded[i : i + len(rolled)]
        rolled ^= rolled >> np.uint64(29)
        size += long[i : i + len(rolled)]
    rolled = _mixed(rolled) >> np.uint64(8) | (255 - np.minimum(size, 255)).astype(np.uint64) << np.uint64(56)
    out = []
    for at, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        s = np.sort(rolled[at : at + max(1, n - k + 1)]) if n else np.zeros(0, np.uint64)
        out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    return out


def shingles(text: str | None, k: int) -> np.ndarray:
    return shingles_of(pa.array([text], pa.string()), k)[0]


def need(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set at ``percent`` similarity or more."""
    return -(-percent * n // 100)


def prefix(s: np.ndarray, percent: int, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The prefix of a sorted set, its l, and how many of 1000 shingles are frequent: most where others are variants of this set.

    ``hot`` holds frequent shingles, sorted; ``rank`` their document frequencies.
    """
    n, a = len(s), need(len(s), percent)
    if not n:
        return s, 1, 0
    df = np.ones(n, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        df = np.where(hot[at] == s, rank[at], 1)
    order = np.lexsort((s, df))
    cost = np.cumsum(np.maximum(df[order] - 1, 0))
    full = 128 * BITMAP  # bitmaps of larger sets tell little: their candidates are verified
    best, l = None, 1
    for m in MATCHES:
        if m > a:
            break
        size = n - a + m
        met = cost[size - 1] + PARTNERS * size  # bitmaps met; a candidate takes m of them
        c = POSTING * size + met + met / m * (COUNT + (n if n > full else 0))
        if best is None or c < best:
            best, l = c, m
    return s[order[: n - a + l]], l, int(1000 * np.count_nonzero(df > 1) // n)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _read(docs: DataFrame, k: int, share: float) -> DataFrame:
    """One reading of all texts: (doc_id, n, s1, s2, null, null) with the size and 128-bit hash of each document's set,
    and (null, null, null, null, h, c) for the shingles that ``share`` of a batch's documents (4 at least) hold."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles_of(part.column("text"), k)
        n = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        ends = np.append(0, np.cumsum(n))
        # sums and XORs per set as differences of running ones
        total = np.append(np.uint64(0), np.cumsum(_mixed(every), dtype=np.uint64))
        parity = np.append(np.uint64(0), np.bitwise_xor.accumulate(_mixed(every * MIX)))
        s1, s2 = total[ends[1:]] - total[ends[:-1]], parity[ends[1:]] ^ parity[ends[:-1]]
        every.sort()
        first = np.nonzero(np.append(True, every[1:] != every[:-1]))[0] if len(every) else np.zeros(0, np.int64)
        c = np.diff(np.append(first, len(every)))
        some = c >= max(4, share * len(sets))
        h, c, rows = every[first[some]], c[some], len(sets)
        gone, none = pa.nulls(len(h), pa.int64()), pa.nulls(rows, pa.int64())
        both = lambda x, y: pa.concat_arrays([x.cast(pa.int64()), y])
        return pa.RecordBatch.from_arrays([both(part.column("doc_id"), gone), both(pa.array(n), gone), both(_signed(s1), gone), both(_signed(s2), gone), both(none, _signed(h)), both(none, pa.array(c.astype(np.int64)))], ["doc_id", "n", "s1", "s2", "h", "c"])

    return map_slices(docs, run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, h bigint, c bigint", most=READ)


def _frequent(read: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent shingles, sorted, and the documents of the batches that reported them."""
    found = read.where("h IS NOT NULL").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(most).toPandas()
    h, c = found["h"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _prefixes(docs: DataFrame, k: int, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, n, l, c, p, m): the prefix of each document's set, as bytes, and its bitmap; ``c`` as of ``prefix``."""
    spread = docs.sparkSession.sparkContext.broadcast(hot)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        frequent, df = spread.value
        sets = shingles_of(part.column("text"), k)
        made = [prefix(s, percent, frequent, df) for s in sets]
        steps = pa.array(np.arange(len(sets) + 1) * BITMAP, pa.int32())
        maps = pa.ListArray.from_arrays(steps, _signed(np.concatenate([bitmap(s) for s in sets])))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array([l for _, l, _ in made], pa.int32()), pa.array([c for _, _, c in made], pa.int32()), pa.array([p.tobytes() for p, _, _ in made], pa.binary()), maps], ["id", "n", "l", "c", "p", "m"])

    return map_slices(docs, run, "id bigint, n int, l int, c int, p binary, m array<bigint>")


def _places(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a Bloom filter that values set, as numbers."""
    h = _mixed(x * MIX)
    return h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)


def bloom(values: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of 2 ** bits bits over the only (BIGINT) column of ``values``; words meet by a distributed OR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([_signed(x >> np.uint64(6)), _signed(np.uint64(1) << (x & np.uint64(63)))], ["w", "m"])

    words = values.mapInArrow(run, "w bigint, m bigint").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64).view(np.uint64)
    return out


def inside(held: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """Which values the filter may hold."""
    ok = np.ones(len(x), bool)
    for at in _places(x, bits):
        ok &= (held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _postings(prefixes: DataFrame, held: np.ndarray) -> DataFrame:
    """(h, id, n, l, c) of the prefix shingles that the filter may hold."""
    spread = prefixes.sparkSession.sparkContext.broadcast(held)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        h, rows = _shingles_in(part)
        ok = inside(spread.value, h, SHINGLE_BITS)
        rows = pa.array(rows[ok])
        return pa.RecordBatch.from_arrays([_signed(h[ok]), *[part.column(c).take(rows) for c in ("id", "n", "l", "c")]], ["h", "id", "n", "l", "c"])

    return map_slices(prefixes.select("id", "n", "l", "c", "p"), run, "h bigint, id bigint, n int, l int, c int", "p")


def _shingles_in(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a batch's prefixes, one after the other, and the row that each is of."""
    p = part.column("p").to_pylist()
    return np.frombuffer(b"".join(p), np.uint64), np.repeat(np.arange(len(p)), [len(x) // 8 for x in p])


def _shared_shingles(prefixes: DataFrame) -> DataFrame:
    """(h): shingles in two prefixes or more."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(_shingles_in(part)[0])], ["h"])

    return map_slices(prefixes.select("p"), run, "h bigint", "p").groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")


def bitmap(s: np.ndarray, words: int = BITMAP) -> np.ndarray:
    """The parity bitmap of a set: each shingle flips one bit."""
    at = _mixed(s) >> np.uint64(64 - (words * 64).bit_length() + 1)
    flips = np.bincount(at.astype(np.int64), minlength=words * 64) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def _with_sets(docs: DataFrame, k: int, held: np.ndarray) -> DataFrame:
    """(id, s): the whole sets of the documents that the filter may hold."""
    spread = docs.sparkSession.sparkContext.broadcast(held)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        part = part.take(pa.array(np.nonzero(inside(spread.value, ids.view(np.uint64), DOC_BITS))[0]))
        sets = shingles_of(part.column("text"), k)
        offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, _signed(np.concatenate([np.zeros(0, np.uint64), *sets])))], ["id", "s"])

    return map_slices(docs.select("doc_id", "text"), run, "id bigint, s array<bigint>")


def _near(na: Column, nb: Column, apart: Column, percent: int) -> Column:
    """Whether sets of na and nb shingles whose bitmaps differ in ``apart`` bits may be similar enough: they share (na + nb - apart) / 2 at most."""
    most = F.floor((na + nb - apart) / 2)
    return most * 100 >= percent * (na + nb - most)


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Sets are made of the documents in pairs only."""
    ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    sets = table(_with_sets(texts, k, bloom(ids, DOC_BITS)))
    sa, sb = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(sa, "a").join(sb, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    found = table(both.where(F.col("i") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b").distinct())
    drop_table(sets)
    return found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Words are what lies between white space, A-Z lowered; two documents link
    where 100 * intersection >= percent * union of their sets of distinct
    k-word shingles, and ``component_id`` is the smallest doc_id reachable.
    Fewer than k words make one shingle; a null, empty or blank text makes
    none and links with nothing (its component is itself). No pair is missed;
    shingles are compared by 64-bit hashes. Rows of one doc_id but different
    texts count as different texts of one document: all are linked through
    it. Null doc_ids stay out of the join and are their own component. An
    empty table gives no rows.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    d = d.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    texts = d.where("doc_id IS NOT NULL")
    read = table(_read(d, k, SHARE))
    sized = read.where("h IS NULL").select("doc_id", "n", "s1", "s2")
    # classes of equal sets, named by their least document
    full = sized.where("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"))
    members = table(full.join(classes, ["n", "s1", "s2"]).select("doc_id", "id"))
    heads = classes.select("id").distinct()
    # a document of several texts is in several classes: it links them
    twice = members.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("c")).where("b <> c").select("doc_id", "b")
    own = members.join(twice, "doc_id").select(F.col("id").alias("a"), "b").where("a <> b")
    links = _links(texts, heads, _frequent(read, HOT), k, percent).unionByName(own)
    roots = components(links).withColumnRenamed("node", "id")
    named = members.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("root")).groupBy("doc_id").agg(F.min("root").alias("root"))
    return sized.join(named.withColumnRenamed("doc_id", "v"), sized.doc_id == F.col("v"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _merged_lists(post: DataFrame) -> DataFrame:
    """(h, w) of the prefix lists that hold two classes or more; of those that hold the same classes, one, for all ``w`` of them.

    The shingles of a passage have the same list, so that copies of passages
    are matched once and not once a shingle. Lists are compared by count and
    128 bits of their classes.
    """
    one = post.groupBy("h").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    return one.where("k > 1").groupBy("k", "x", "y").agg(F.min("h").alias("h"), F.count("*").alias("w")).select("h", "w")


def _hubs(post: DataFrame) -> DataFrame:
    """(h, hub, m): the class of each list that shares most of its shingles, so the origin of variants, and its size."""
    return post.groupBy("h").agg(F.min(F.struct((-F.col("c")).alias("c"), "id", "n")).alias("hub")).select("h", F.col("hub.id").alias("hub"), F.col("hub.n").alias("m"))


def _links(texts: DataFrame, heads: DataFrame, hot: tuple[np.ndarray, np.ndarray], k: int, percent: int) -> DataFrame:
    """Links (a, b) that join every two classes that similar pairs connect: of the first pass, each class with the root it has by then."""
    fits = F.least("n", "m") * 100 >= percent * F.greatest("n", "m")
    prefixes = table(_prefixes(texts, k, percent, hot).join(heads, "id", "left_semi"))  # copies are not compared
    post = table(_postings(prefixes, bloom(_shared_shingles(prefixes), SHINGLE_BITS)))
    some = table(post.join(_merged_lists(post), "h"))
    maps = prefixes.select("id", F.col("n").alias("size"), F.col("m").alias("map"))
    # first pass: each class with the hubs of its lists
    stars = some.join(_hubs(some), "h").where("id <> hub").where(fits).groupBy("id", "hub").agg(F.sum("w").alias("c"))
    best = stars.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", (-F.col("hub")).alias("v"))), False), 1, HUBS).alias("top"))
    pairs = best.select("id", F.explode("top").alias("t")).withColumn("hub", -F.col("t.v"))
    pairs = table(pairs.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct())
    ma, mb = maps.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("map").alias("ma")), maps.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("map").alias("mb"))
    apart = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, c: t + c)
    maybe = table(pairs.join(ma, "a").join(mb, "b").where(_near(F.col("na"), F.col("nb"), apart, percent)).select("a", "b"))
    links = _linked(maybe, texts, k, percent)
    roots = table(components(links))
    # second pass: pairs of lists that still hold several components; bitmaps are compared inside the join
    named = table(some.select("h", "id", "n", "l", "w").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    mixed = named.groupBy("h").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("h")
    left = table(named.join(mixed, "h", "left_semi").join(maps.select("id", *[F.get("map", F.lit(i)).alias(f"m{i}") for i in range(BITMAP)]), "id"))
    words = [f"m{i}" for i in range(BITMAP)]
    x = left.select("h", "w", F.col("id").alias("a"), "n", F.col("l").alias("la"), F.col("root").alias("ra"), *words)
    y = left.select(F.col("h").alias("g"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("l").alias("lb"), F.col("root").alias("rb"), *[F.col(w).alias(f"o{w}") for w in words])
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"o{w}"))) for w in words), F.lit(0))
    met = x.join(y, (F.col("h") == F.col("g")) & (F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb")) & fits & _near(F.col("n"), F.col("m"), apart, percent))
    rest = met.groupBy("a", "b").agg(F.sum("w").alias("c"), F.min(F.least("la", "lb")).alias("l")).where("c >= l").select("a", "b")
    again = table(rest.join(pairs, ["a", "b"], "left_anti"))
    more = _linked(again, texts, k, percent)
    for t in (left, named, some, post, prefixes, pairs, maybe, links, again):
        drop_table(t)
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
