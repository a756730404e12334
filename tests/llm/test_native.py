"""Line dedup, mixing and fingerprints against brute force, with their edge cases."""

import hashlib

from pyspark.sql import functions as F

from jsonloom.llm import fingerprint, line_dedup, mixing

TEXTS = [(0, "A common line here\nown line number 0\n\nshort"), (1, "x\n  a COMMON line here\t\na common line here\nshort"), (2, None), (3, ""), (4, "a common line here"), (5, "É common line here\né common line here"), (6, "é common line here"), (6, "é common line here"), (9, "\n".join(["own line number 0", "z"] * 200))]


def docs(spark, rows=None, extra=False):
    d = spark.createDataFrame(TEXTS if rows is None else rows, "doc_id bigint, text string")
    return d.select("*", F.lit("clash").alias("n_lines"), F.lit(1).alias("salt"), F.lit("other").alias("TEXT")) if extra else d


def lines_by_hand(rows):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            first[low(x)] = min(i, first.get(low(x), i))
    return sorted((i, "\n".join(x for x in (t or "").split("\n") if len(low(x)) < 10 or first[low(x)] == i)) for i, t in rows)


def test_line_dedup(spark):
    for d in (docs(spark), docs(spark, extra=True)):
        got = line_dedup.dedup_lines(d).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == lines_by_hand(TEXTS)
    upper = spark.createDataFrame(TEXTS, "DOC_ID bigint, Text string")
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(upper).collect()) == lines_by_hand(TEXTS)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_lines"], by[1]["n_dropped"]) == (4, 2) and by[4]["text"] == "" and by[9]["n_dropped"] == 200
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    runs = {r["doc_id"]: r["runs"] for r in line_dedup.keep_bitmaps(docs(spark)).collect()}
    assert runs[1] == [1, 2] and runs[4] == [0, 1]


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), ["a", "b", None, "z"][i % 4 if i % 3 else 0]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit(9)).withColumn("key", F.lit("k"))
    got = mixing.mix_sources(d).collect()
    assert len(got) == 400 and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(d.repartition(7)).collect()))
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert abs(sum(rs[0]["target"] for rs in by.values()) - 1.5 * total) < 1e-6
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 1 and rs[0]["target"] <= 2 * rs[0]["source_size"]
    mixed = mixing.apply_mix(d)
    assert mixed.columns == d.columns
    words = mixed.select(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != "")))).first()[0]
    assert words == sum(r["taken"] for r in got)
    assert mixing.mix_sources(d.limit(0)).count() == 0


def test_fingerprints(spark):
    rows = [(i, t) for i, t in enumerate(["one two. three\nfour", "four\none two. three", None, "", "ab", "x" * 5, "one two. three\nfour", "é☃ long. text, of; words"])]
    d = docs(spark, rows)
    got = {r["doc_id"]: r for r in fingerprint.compare_with_edited(d).collect()}
    assert len(got) == 8
    texts = [t or "" for _, t in rows]
    for i, t in enumerate(texts):
        after, half = texts[(i + 1) % 8], len(t) // 2
        assert got[i]["edited"] == t[: len(t) - half] + after[:half] and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"] == got[6]["fingerprint"] != got[4]["fingerprint"] and got[0]["near_next"] == 1
    assert fingerprint.compare_with_edited(docs(spark, [])).count() == 0
    assert fingerprint.compare_with_edited(docs(spark, [(7, "solo. text")])).first()["edited"] == "solo.solo."


def test_fingerprints_add_and_take_away(spark):
    d = spark.createDataFrame([("a. b\nc", "d, e\nf", "a. b\nc\nd, e\nf")], "x string, y string, z string")
    for c in "xyz":
        d = fingerprint.with_fingerprint(d, F.col(c), f"f{c}")
    r = d.select(fingerprint.add(F.col("fx"), F.col("fy")).alias("s"), fingerprint.add(F.col("fz"), F.col("fy"), -1).alias("t"), "fx", "fz").first()
    assert r["s"] == r["fz"] and r["t"] == r["fx"]


def test_likeness_of_many_equal_clauses(spark):
    d = spark.createDataFrame([("a. " * 20_000, "a. " * 10_000, "b. " * 20_000)], "x string, y string, z string")
    for c in "xyz":
        d = fingerprint.with_fingerprint(d, F.col(c), f"f{c}")
    r = d.select(fingerprint.likeness(F.col("fx"), F.col("fy")).alias("same"), fingerprint.likeness(F.col("fx"), F.col("fz")).alias("other")).first()
    assert r["same"] == 0.999 and r["other"] < 0.5


def test_hash_is_sha256(spark):
    r = line_dedup.dedup_lines(docs(spark, [(1, "q")])).select(F.sha2("text", 256)).first()[0]
    assert r == hashlib.sha256(b"q").hexdigest()
