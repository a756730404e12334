"""Tokens, structure, nodes, navigation, tape, statistics and typed values on small documents."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from jsonloom.functions.udtf import register
from jsonloom.operators import materialize, navigate, nodes, stats, tape, tokens
from jsonloom.plans.golden import ENUMS, MAPS, POSITIONS, TAPE
from jsonloom.plans.queries import tape_words, typed_enum, typed_map_keys, typed_positional
from jsonloom.sources import generate


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, json string")


def test_tokens_and_structure(spark):
    t = tokens.tokens(docs(spark, '{"a":[1,2.5],"b":"x\\n"}'))
    rows = t.orderBy("tok").collect()
    assert [r["kind"] for r in rows] == list("{q:[s,s],q:q}")
    assert [r["pos"] for r in rows] == [0, 1, 4, 5, 6, 7, 8, 11, 12, 13, 16, 17, 22]
    two = tokens.two_token_index(t).orderBy("tok").collect()
    assert [r["tok2"] for r in two][-1] == 15  # 16 tokens where strings count as two
    s = tokens.skeleton(tokens.tokens(docs(spark, '{"a":[{}]}'))).orderBy("tok").collect()
    assert [(r["kind"], r["depth"], r["match_tok"], r["child_count"]) for r in s] == [("{", 1, 7, 1), (":", 1, None, None), ("[", 2, 6, 1), ("{", 3, 5, 0), ("}", 3, 4, None), ("]", 2, 3, None), ("}", 1, 0, None)]


def test_navigation(spark):
    d = docs(spark, '{"k":1,"n":null,"k":2,"a":[10,"x",{"y":[]}],"u":18446744073709551615,"e\\u0301":true}')
    n = nodes.nodes(d).cache()
    r = nodes.root(n)
    assert [(x["key"], x["kind"]) for x in nodes.entries(n, r).orderBy("ordinal").collect()] == [("k", "int64"), ("n", "null"), ("k", "int64"), ("a", "array"), ("u", "uint64"), ("é", "bool")]
    assert nodes.get(n, r, "k").first()["i64"] == 1 and nodes.last_of(n, r, "k").first()["i64"] == 2
    assert nodes.get(n, r, "absent").count() == 0 and nodes.get(n, r, "n").select(nodes.is_null().alias("x")).first()["x"]
    a = nodes.get(n, r, "a")
    assert nodes.element(n, a, 1).first()["str"] == "x" and nodes.element(n, a, 3).count() == 0
    assert a.select(nodes.length().alias("x"), nodes.is_empty().alias("y"), nodes.raw_count().alias("z")).first()[:] == (3, False, 3)
    assert nodes.get(n, r, "u").select(nodes.as_f64().alias("x"), nodes.as_i64().alias("y")).first()[:] == (18446744073709551615.0, None)
    assert nodes.descendants(n, a).count() == 4
    assert nodes.raw_text(a, d).first()["raw"] == '[10,"x",{"y":[]}]'
    assert nodes.duplicate_keys(n).select("key", "n").first()[:] == ("k", 2)
    n.unpersist()


def test_row_local_navigation(spark):
    j = F.col("json")
    got = docs(spark, '{"k":"5","z":null}', "[1,2]", "7").select(navigate.kind(j), navigate.length(j), navigate.get_i64(j, "k"), navigate.has(j, "z"), navigate.at(j, 1), navigate.elements(j)).collect()
    assert [tuple(r) for r in got] == [("object", 2, None, True, None, None), ("array", 2, None, False, "2", ["1", "2"]), ("int64", None, None, False, None, None)]


def test_tape(spark):
    assert [(r["idx"], r["word"]) for r in tape_words(spark, "").orderBy("idx").collect()] == list(enumerate(TAPE[1]))
    r = tape.documents(docs(spark, TAPE[0], "42", '{"k":"\\n"}', "true")).orderBy("doc_id").collect()
    assert bytes(r[0]["strings"]) == b"\x01\0\0\0a\0\x01\0\0\0b\0\x02\0\0\0x\n\0\0"
    assert [len(x["tape"]) for x in r] == [13, 4, 6, 3] and len(r[2]["strings"]) == 13 and r[2]["strings"][-1] == 0


def test_tapes_are_laid_row_by_row(spark):
    texts = ['{"a":[],"b":{},"c":[{"d":"e,:]}"}]}', "[0,-0,-1.5e-3,1E2,-9223372036854775808,9223372036854775807]", "[9223372036854775808,18446744073709551615,18446744073709551616,-9223372036854775809,123456789012345678901234]", ' [ "é\\u00e9\\ud83d\\ude00\\"\\\\" , "" , null , false ] ', '"x"', "[" * 40 + "]" * 40, '{"k":1,"k":2}']
    d = docs(spark, *texts)
    laid = tape.documents(d)
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    # the words and records are those of the token table
    got = {r["doc_id"]: r for r in laid.collect()}
    words = tape.tape_words(tokens.tokens(d)).orderBy("doc_id", "idx").collect()
    assert {i: [r["word"] for r in words if r["doc_id"] == i] for i in got} == {i: r["tape"] for i, r in got.items()} and len(got) == len(texts)
    for r in tape.records(tokens.tokens(d)).collect():
        held, text = bytes(got[r["doc_id"]]["strings"])[r["record_offset"] :], r["str"].encode()
        assert held[: r["raw_len"] + 5] == (len(text).to_bytes(4, "little") + text).ljust(r["raw_len"] + 5, b"\0")
    # ids may repeat or be null
    same = d.unionByName(docs(spark, "[1", "7")).select(F.when(F.col("doc_id") > 0, 1).alias("doc_id"), "json")
    assert sorted((r["tape"], bytes(r["strings"])) for r in tape.documents(same).collect()) == sorted((r["tape"], bytes(r["strings"])) for r in [*got.values(), *tape.documents(docs(spark, "7")).collect()])


def test_stats(spark):
    r = stats.stats(docs(spark, '{"a":[1,2,null],"é":"x\\n"}', "[]")).orderBy("doc_id").collect()
    assert [tuple(x)[1:] for x in r] == [(8, 5, 3), (1, 0, 0)]
    assert [x[0] for x in docs(spark, '{"a":[1,2,null],"é":"x\\n"}', "[]").select(stats.node_count(F.col("json"))).collect()] == [8, 1]


def test_typed_values(spark):
    got = {r["doc_id"]: (r["a"], r["b"], r["error"]) for r in typed_positional(spark, "").collect()}
    assert got == {i: tuple(p[1:]) for i, p in enumerate(POSITIONS)}
    assert {r["doc_id"]: (r["entries"], r["failed"]) for r in typed_map_keys(spark, "").collect()} == {i: tuple(m[1:]) for i, m in enumerate(MAPS)}
    assert {r["doc_id"]: (r["variant"], r["has_payload"], r["failed"]) for r in typed_enum(spark, "").collect()} == {i: tuple(e[1:]) for i, e in enumerate(ENUMS)}
    n = nodes.nodes(docs(spark, '{"t":[1,"x"],"s":null,"x":1}', '{"t":[1]}', '{"t":[]}'))
    v = materialize.materialize(n, nodes.root(n), T.StructType.fromDDL("t array<string>, s struct<q:int>")).orderBy("doc_id").collect()
    assert v[0]["error"] == "invalid type: integer, expected a string" and v[2]["value"]["t"] == []
    t = materialize.as_tuple(n, nodes.get(n, nodes.root(n), "t"), [T.LongType(), T.StringType()]).orderBy("doc_id").collect()
    assert tuple(t[0]["value"]) == (1, "x") and "invalid length 1" in t[1]["error"]


def test_table_functions_and_generators(spark):
    register(spark)
    assert spark.sql("""SELECT count(*) FROM json_tokens('{"a":[1]}')""").first()[0] == 7
    assert [r["value"] for r in spark.sql("""SELECT * FROM json_nodes('{"a":[1,"é"]}') WHERE parent_id > 0 ORDER BY node_id""").collect()] == ["1", "é"]
    assert generate.parse_size("2k") == 2048
    rows = generate.feed(spark, 5).unionByName(generate.events(spark, 5)).unionByName(generate.escapes(spark)).collect()
    assert all(json.loads(r["json"]) for r in rows) and rows == generate.feed(spark, 5).unionByName(generate.events(spark, 5)).unionByName(generate.escapes(spark)).collect()
    made = generate.expand(docs(spark, '{"x":1}', '{"yy":2}'), 100).first()["json"]
    assert len(made) >= 100 and [list(x)[0] for x in json.loads(made)][:3] == ["x", "yy", "x"]


def test_files_and_stream(spark, tmp_path):
    from jsonloom.sources.files import list_datasets, read_files, read_lines
    from jsonloom.streaming.stream import parse_batches, parse_stream

    (tmp_path / "a.json").write_bytes(b'{"a":1}')
    (tmp_path / "b.json").write_bytes(b"[1,\x80]")
    from jsonloom.operators.validate import parse

    got = {r["doc_id"][-6:]: (r["ok"], r["error"] and r["error"]["offset"]) for r in parse(read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.json": (True, None), "b.json": (False, 3)}
    assert [r["name"] for r in list_datasets(spark, str(tmp_path)).collect()] == ["b.json", "a.json"]
    assert read_lines(spark, str(tmp_path / "a.json")).count() == 1
    lines = tmp_path / "in"
    lines.mkdir()
    (lines / "x.txt").write_text('{"a":1}\n{"a":}\n[]\n')
    stream = parse_stream(spark.readStream.text(str(lines)).withColumnRenamed("value", "json"))
    q = stream.writeStream.format("memory").queryName("parsed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["ok"] for r in spark.sql("SELECT ok FROM parsed").collect()) == [False, True, True]
    seen = []
    ids = spark.readStream.text(str(lines)).select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("json"))
    q = parse_batches(ids, lambda b, k: seen.extend(r["error"]["kind"] for r in b.where("NOT ok").collect())).start()
    q.processAllAvailable()
    q.stop()
    assert seen == ["UnexpectedToken"]
