"""Validation: every document gets ``ok`` and an ``error`` with its byte offset.

The verdict is row-local: most documents are valid and shallow, and one
expression proves it (``surely_valid``); the others are walked. Only documents
that fail are tokenised and checked rule by rule for the error that they
report, in their own row: nothing is shuffled, and no id is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import TYPE, error
from ..functions.lex import HUGE, LEXICAL, SPACE, kind_string, surely_valid, token_kind, tokens_of, utf8_error
from ..functions.scalars import is_number, number_kind, string_error
from ..plans.options import ParseOptions
from .tokens import CLOSES, OPENS, SEPARATORS

STARTS, ENDS = ("q", "u", "s", "{", "["), ("q", "s", "}", "]")


def _found(stage: int, key: Column, rank: int, code: Column, tok: Column, at: Column | None = None) -> Column:
    """A violation where ``code`` is not null. Its place is a token and a byte in it; the end of input is the token after the last."""
    zero = F.lit(0).cast("bigint")
    fields = {"stage": F.lit(stage), "key": key.cast("bigint"), "within": zero if stage < 4 else at.cast("bigint"), "rank": F.lit(rank), "tok": tok.cast("bigint"), "at": zero if at is None else at.cast("bigint"), "code": code}
    return F.when(code.isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))


def _token_errors(text: Column, i: Column, kinds: Column) -> Column:
    """Violations of the context-free rules at token ``i``, and of its own text.

    One token's adjacency comes before its own rule; the end of input is a
    token after the last.
    """
    at = lambda k: F.when(i + k >= 0, F.get(kinds, i + k))
    k, p, n = F.get(kinds, i), at(-1), at(1)
    starts = k.isin(*STARTS)
    allowed = (
        F.when(p.isNull() | p.isin(":", ","), starts)
        .when(p == "{", k.isin("q", "u", "}"))
        .when(p == "[", starts | (k == "]"))
        .when(p == "q", k.isin(":", ",", "}", "]"))
        .otherwise(k.isin(",", "}", "]"))
    )
    pair = F.when(~allowed, F.when(p.isin(*ENDS) & starts, "MissingComma").otherwise("UnexpectedToken"))
    first = F.substring(text, 1, 1)
    keyless = (k == "{") & (n == "q") & ~F.coalesce(at(2) == ":", F.lit(False))
    own = (
        F.when(keyless, "MissingColon")
        .when((k == ":") & ~F.coalesce(at(-2).isin("{", ","), F.lit(False)), "UnexpectedToken")
        .when((k == "s") & first.isin("t", "f", "n") & ~text.isin("true", "false", "null"), "InvalidLiteral")
        .when((k == "s") & ~first.rlike("[-0-9tfn]"), "UnexpectedToken")
    )
    end = F.when(n.isNull(), F.when(k == "u", "UnterminatedString").when(k.isin(*OPENS), "UnbalancedBrackets").when(k.isin(":", ","), "UnexpectedToken"))
    number = (k == "s") & text.rlike("^[-0-9]")
    bad = F.when(number & (~is_number(text) | number_kind(text).isNull()), "InvalidNumber")
    within, kind = string_error(text)
    kind = F.when(k == "q", kind)
    return F.array(
        _found(1, i * 2, 0, pair, i),
        _found(1, i * 2, 1, own, F.when(keyless, i + 2).otherwise(i)),
        _found(1, i * 2 + 1, 0, end, F.when(k.isin(":", ","), i + 1).otherwise(i)),
        _found(3, i, 0, bad, i),
        _found(4, i, 0, kind, i, within),
    )


def _structure_error(kinds: Column, max_depth: int) -> Column:
    """The first violation among brackets and separators, by one fold with the open brackets as state.

    After it only the height counts: whether the outermost open bracket, which
    comes before, is ever closed.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("open"), F.lit(0).alias("height"), F.lit(0).alias("depth"), F.lit(0).alias("bottom"), F.lit(None).cast("struct<tok:int,rank:int,code:string>").alias("e"))

    def step(a: Column, k: Column) -> Column:
        opens, closes = k.isin(*OPENS), k.isin(*CLOSES)
        top, clean = F.right(a["open"], F.lit(1)), a["e"].isNull()
        member = F.coalesce((F.get(kinds, a["i"] + 2) == ":") & ~F.get(kinds, a["i"] + 1).isin(*OPENS, *CLOSES, *SEPARATORS), F.lit(False))
        code = (
            F.when(opens, F.when(a["depth"] + 1 > max_depth, "DepthLimit"))
            .when(closes, F.when((top == "") | (k == "}") & (top == "[") | (k == "]") & (top == "{"), "UnbalancedBrackets"))
            .when(k.isin(*SEPARATORS) & (top == ""), "TrailingContent")
            .when((k == ":") & (top == "["), "UnexpectedToken")
            .when((k == ",") & (top == "{") & ~member, "MissingColon")
        )
        e = F.when(clean & code.isNotNull(), F.struct(a["i"].alias("tok"), F.when(code == "DepthLimit", 0).otherwise(1).alias("rank"), code.alias("code"))).otherwise(a["e"])
        kept = F.when(opens, F.concat(a["open"], k)).when(closes & (top != ""), F.substring(a["open"], F.lit(1), F.length(a["open"]) - 1)).otherwise(a["open"])
        change = F.when(opens, 1).when(closes, -1).otherwise(0)
        height = F.greatest(F.lit(0), a["height"] + change)
        bottom = F.when(opens & (a["height"] == 0), a["i"]).otherwise(a["bottom"])
        return F.struct((a["i"] + 1).alias("i"), F.when(e.isNull(), kept).otherwise(F.lit("")).alias("open"), height.alias("height"), (a["depth"] + change).alias("depth"), bottom.alias("bottom"), e.alias("e"))

    def last(a: Column) -> Column:
        left = F.when(a["height"] > 0, F.struct(a["bottom"].alias("tok"), F.lit(1).alias("rank"), F.lit("UnbalancedBrackets").alias("code")))
        return F.least(a["e"], left)

    return F.aggregate(kinds, start, step, last)


def first_error(kinds: str, texts: str, structure: str, policy: str) -> Column:
    """The violation to report of a document, from columns with its tokens' kinds and texts and its structure error."""
    s = F.col(structure)
    each = F.flatten(F.transform(F.col(texts), lambda t, i: _token_errors(t, i, F.col(kinds))))
    every = F.concat(F.filter(each, lambda x: x.isNotNull()), F.filter(F.array(_found(2, s["tok"], 0, F.when(s["rank"] == 0, s["code"]), s["tok"]), _found(2, s["tok"], 1, F.when(s["rank"] == 1, s["code"]), s["tok"])), lambda x: x.isNotNull()))
    if policy == "stage":
        return F.array_min(every)

    def by_place(x: Column) -> Column:
        # an odd number of quotes is seen first, and at the end of input
        odd = x["code"] == "UnterminatedString"
        tok = F.when(odd, F.size(texts).cast("bigint")).otherwise(x["tok"])
        return F.struct(F.when(odd, 0).when(x["stage"] == 1, 1).otherwise(2).alias("phase"), tok.alias("tok"), x["at"].alias("at"), x["stage"].alias("stage"), x["rank"].alias("rank"), x["code"].alias("code"))

    return F.array_min(F.transform(every, by_place))


def parse(df: DataFrame, json_col: str = "json", options: ParseOptions = ParseOptions(), id_col: str = "doc_id", strict: bool = False) -> DataFrame:
    """``df`` with ``ok`` and ``error``. ``json_col`` is STRING or BINARY; all is row-local, so ids may repeat or be null (``id_col`` is not read).

    A null document is neither good nor bad: ``ok`` and ``error`` are null.
    With ``strict`` the first failed document that is read fails the job.
    """
    d = gated(df, json_col, options)
    fits = F.col("_size") <= options.max_input_bytes
    bad = F.col(json_col).isNotNull() & ~F.col("_good") & fits & F.col("_utf8").isNull()
    # each step is a column, made once, and null for good documents
    d = d.withColumn("_raw", F.when(bad, tokens_of(F.col(json_col).cast("string"))))
    d = d.withColumn("_text", F.filter(F.transform("_raw", lambda x: F.ltrim(x, F.lit(SPACE))), lambda x: x != ""))  # the last may be white space alone
    d = d.withColumn("_kind", F.transform("_text", token_kind))
    d = d.withColumn("_structure", _structure_error(F.col("_kind"), options.max_depth))
    d = d.withColumn("_first", first_error("_kind", "_text", "_structure", options.error_policy))
    tok = F.col("_first.tok").cast("int")
    before = F.aggregate(F.slice("_raw", F.lit(1), tok + 1), F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x))
    place = F.when(tok >= F.size("_text"), F.col("_size")).otherwise(before - F.octet_length(F.get("_text", tok)) + F.col("_first.at"))
    empty = bad & (F.size("_text") == 0)
    code = F.when(F.col(json_col).isNull() | F.col("_good"), F.lit(None)).when(~fits, "InputTooLarge").when(F.col("_utf8").isNotNull(), "Utf8").when(empty, "EmptyInput").otherwise(F.col("_first.code"))
    offset = F.when(F.col("_utf8").isNotNull(), F.col("_utf8")).when(empty, F.lit(0).cast("bigint")).otherwise(place)
    d = d.withColumn("_code", code).withColumn("_offset", offset)
    problem = error(F.col("_code"), F.col("_offset"), F.col("_size"), options.max_depth, options.max_input_bytes)
    if strict:
        problem = F.when(F.col("_code").isNotNull(), F.raise_error(problem["message"]).cast(TYPE))
    return d.select(*df.columns, F.when(F.col(json_col).isNotNull(), F.col("_good")).alias("ok"), problem.alias("error"))


def gated(df: DataFrame, json_col: str, options: ParseOptions) -> DataFrame:
    """``df`` with ``_size``, ``_utf8`` and the row-local verdict ``_good``, which is exact."""
    d = df.withColumn("_size", F.octet_length(json_col).cast("bigint")).withColumn("_utf8", utf8_error(F.col(json_col).cast("binary")))
    fine = (F.col("_size") <= options.max_input_bytes) & F.col("_utf8").isNull()
    return d.withColumn("_good", F.when(fine, is_valid(F.col(json_col).cast("string"), options)).otherwise(F.lit(False)))


def is_valid(text: Column, options: ParseOptions = ParseOptions()) -> Column:
    """A row-local verdict, for streams and filters: exact for documents of any depth up to the limit.

    Shallow documents are folded; deeper ones are walked over their kind string
    with the open brackets as the only state.
    """
    quick = surely_valid(text, options.max_depth)
    kinds = kind_string(text)
    pairs = F.filter(F.split(kinds, ""), lambda c: c != "")
    opens = F.aggregate(
        pairs,
        F.struct(F.lit("").alias("open"), F.lit("").alias("p"), F.lit("").alias("p2"), F.lit(True).alias("ok"), F.lit(False).alias("done")),
        lambda a, c: _step(a, c, options.max_depth),
        lambda a: a["ok"] & (a["open"] == "") & a["done"],
    )
    huge = F.exists(F.filter(tokens_scalars(text), lambda x: is_number(x)), lambda x: F.abs(x.try_cast("double")) == float("inf"))
    slow = F.coalesce(text.rlike(LEXICAL) & ~F.when(text.rlike(HUGE), huge).otherwise(F.lit(False)) & opens, F.lit(False))
    return F.when(quick, F.lit(True)).otherwise(slow)


def tokens_scalars(text: Column) -> Column:
    return F.transform(tokens_of(text), lambda x: F.ltrim(x, F.lit(SPACE)))


def _step(a: Column, c: Column, max_depth: int) -> Column:
    """One token of the walk; p and p2 are the two tokens before."""
    top = F.right(a["open"], F.lit(1))
    start = c.isin("q", "s", "{", "[")
    end = a["p"].isin("q", "s", "}", "]")
    # where a value may stand: at the start, after [ or :, or after a comma of an array
    value = (a["p"] == "") | (a["p"] == "[") | (a["p"] == ":") | ((a["p"] == ",") & (top == "["))
    key = (c == "q") & (top == "{") & a["p"].isin("{", ",")
    fine = (
        F.when(start, (value | key) & ~a["done"])
        .when(c == ":", (a["p"] == "q") & (top == "{") & a["p2"].isin("{", ","))
        .when(c == ",", end & ((top == "[") | ((top == "{") & ~((a["p"] == "q") & (a["p2"] != ":")))))
        .when(c == "}", (top == "{") & ((a["p"] == "{") | (end & ~((a["p"] == "q") & (a["p2"] != ":")))))
        .otherwise((top == "[") & ((a["p"] == "[") | end))
    )
    opened = F.when(c.isin("{", "["), F.concat(a["open"], c)).when(c.isin("}", "]"), F.substring(a["open"], F.lit(1), F.length(a["open"]) - 1)).otherwise(a["open"])
    deep = F.length(opened) <= max_depth
    done = (opened == "") & c.isin("q", "s", "}", "]")
    return F.struct(opened.alias("open"), c.alias("p"), a["p"].alias("p2"), (a["ok"] & F.coalesce(fine, F.lit(False)) & deep).alias("ok"), done.alias("done"))
