"""The pipeline, each stage on what its predecessor kept, against brute force."""

import sys
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from jsonloom.llm import toxicity

from .test_models_and_joins import near_by_hand
from .test_native import lines_by_hand

SF = "/root/testdata/sf0.001"


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, kept = docs.columns, texts(docs), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
            assert docs.where("n_chars <> char_length(text)").count() == 0
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    first = texts(kept["toxicity"])
    gone = {i for i, _ in before - first}
    # so small a table has too few confirmed documents to reject many; test_toxicity and test_on_the_test_tables judge the model
    assert not first - before and len(gone - toxic) <= 0.02 * sum(before.values())
    assert (before - first).keys() and sum((before - first).values()) < 0.2 * sum(before.values())
    assert gone & toxic
    by_line = Counter({(i, t): 1 for i, t in lines_by_hand(list(first)) if t != "" or (i, t) in first})
    assert texts(kept["line_dedup"]) == by_line
    roots, _ = near_by_hand(list(by_line), corpus_pipeline.WORDS, corpus_pipeline.PERCENT)
    assert texts(kept["jaccard_join"]) == Counter({(i, t): 1 for i, t in by_line if roots[i] == i})
    rows = {r["doc_id"]: len(r["text"].split()) for r in kept["jaccard_join"].collect()}
    mixed = Counter()
    for i, t in texts(kept["source_mix"]).elements():
        mixed[i] += len(t.split())
    assert all(mixed[i] <= 2 * rows[i] for i in mixed) and abs(sum(mixed.values()) - 1.5 * sum(rows.values())) <= 30
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    wanted = Counter()
    for (i, t), n in texts(kept["source_mix"]).items():
        wanted[i] += n * (len(encode(t or "", add_special_tokens=False).ids) + 1)
    got = Counter()
    for r in kept["packing"].collect():
        got[r["doc_id"]] += r["length"]
    assert got == wanted


def test_stages_on_no_rows_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words in a row here", "en", "b", 24)], docs.schema)
    for rows in (docs.limit(0), odd):
        held = rows
        for _, stage in corpus_pipeline.STAGES:
            held = spark.createDataFrame(stage(spark, held, SF).collect(), stage(spark, held, SF).schema)


def test_nothing_else_imports_the_operators():
    assert toxicity.__name__.startswith("jsonloom.llm")
    code = "import sys; sys.modules['jsonloom.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 20"
    import subprocess

    assert subprocess.run([sys.executable, "-c", code], check=False, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0]).returncode == 0
