"""Validation against golden errors, an exhaustive set of token sequences, and mutated documents."""

import itertools
import json
import random

from pyspark.sql import functions as F

from jsonloom.functions.lex import surely_valid
from jsonloom.operators.validate import is_valid, parse
from jsonloom.plans.golden import ERRORS, NUMBERS, STRINGS
from jsonloom.plans.options import ParseOptions
from jsonloom.plans.queries import error_report, number_kinds, string_errors


def strict(text: str) -> bool:
    def no(x):
        raise ValueError(x)

    def number(x):
        if abs(float(x)) == float("inf"):
            raise ValueError(x)
        return float(x)

    try:
        json.loads(text, parse_constant=no, parse_float=number)
        return True
    except (ValueError, RecursionError):
        return False


def test_golden_errors(spark):
    got = {(r["doc_id"], r["policy"]): (r["error"], r["at"]) for r in error_report(spark, "").collect()}
    for i, (_, _, error, stage, earliest) in enumerate(ERRORS):
        assert got[i, "stage"] == (error, stage), ERRORS[i]
        assert got[i, "earliest"] == (error, earliest), ERRORS[i]


def test_policies_differ_on_two_errors(spark):
    d = spark.createDataFrame([(1, '{"a":"\\q","b":01}')], "doc_id int, json string")
    at = {p: parse(d, options=ParseOptions(error_policy=p)).select("error.kind", "error.offset", "error.message").first() for p in ("stage", "earliest")}
    assert tuple(at["stage"]) == ("InvalidNumber", 14, "JSON syntax error at byte 14: invalid number")
    assert tuple(at["earliest"])[:2] == ("InvalidStringEscape", 6)


def test_every_short_token_sequence(spark):
    symbols = ["{", "}", "[", "]", ":", ",", '"a"', "1", "true", "null", '"b"', "-2.5e1"]
    texts = [" ".join(s) for n in (1, 2, 3, 4) for s in itertools.product(symbols, repeat=n)]
    assert len(texts) == 22_620
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, json string")
    got = d.select("json", surely_valid(F.col("json"), 1024).alias("a"), is_valid(F.col("json")).alias("b")).collect()
    wrong = [r["json"] for r in got if not r["a"] == r["b"] == strict(r["json"])]
    assert not wrong


def test_mutated_documents(spark):
    rng = random.Random(3)

    def value(depth):
        k = rng.randrange(8 if depth else 6)
        if k == 7:
            return {rng.choice("abé\"\\n"): value(depth - 1) for _ in range(rng.randrange(3))}
        if k == 6:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return [None, True, rng.randrange(10**rng.randrange(1, 19)), -1.5e-3, "x\ty é ☃", ""][k]

    texts = []
    for _ in range(1500):
        t = list(json.dumps(value(4), ensure_ascii=rng.random() < 0.5))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice('{}[]:,"1e.-tfn \\')
        texts.append("".join(t))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, json string")
    got = parse(d).select("json", "ok", is_valid(F.col("json")).alias("local"), F.col("error.code").isNull().alias("clean")).collect()
    wrong = [r["json"] for r in got if not r["ok"] == r["clean"] == r["local"] == strict(r["json"])]
    assert not wrong and {r["ok"] for r in got} == {True, False}


def test_deep_documents_row_local(spark):
    texts = ["[" * n + "]" * n for n in (8, 9, 40, 1024, 1025)] + ["[" * 20 + "]" * 19, '{"a":' * 12 + "1" + "}" * 12, '{"a":' * 12 + "1e999" + "}" * 12]
    d = spark.createDataFrame([(t,) for t in texts], "json string")
    assert [r[0] for r in d.select(is_valid(F.col("json"))).collect()] == [True, True, True, True, False, False, True, False]


def test_numbers_and_strings(spark):
    assert {(r["text"], r["kind"], r["bits"]) for r in number_kinds(spark, "").collect()} == set(NUMBERS)
    assert {(r["text"], r["at"], r["error"]) for r in string_errors(spark, "").collect()} == set(STRINGS)


def test_nulls_and_size_limit(spark):
    d = spark.createDataFrame([(1, None), (2, "[1]"), (3, "[1,2,3,4]")], "doc_id int, json string")
    got = {r["doc_id"]: (r["ok"], r["error"] and r["error"]["code"]) for r in parse(d, options=ParseOptions(max_input_bytes=5)).collect()}
    assert got == {1: (None, None), 2: (True, None), 3: (False, "InputTooLarge")}


def test_errors_need_no_ids(spark):
    rows = [(None, "[1,"), (None, "[1]"), (4, "{"), (4, "]"), (4, None), (4, '{"a":1}')]
    d = spark.createDataFrame(rows, "doc_id int, json string")
    got = sorted((str(r["json"]), r["ok"], r["error"] and (r["error"]["kind"], r["error"]["offset"])) for r in parse(d).collect())
    assert got == sorted([("[1,", False, ("UnexpectedToken", 3)), ("[1]", True, None), ("{", False, ("UnbalancedBrackets", 0)), ("]", False, ("UnexpectedToken", 0)), ("None", None, None), ('{"a":1}', True, None)])
    plan = parse(d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
