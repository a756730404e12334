"""Errors as values: STRUCT<code, kind, offset, limit, message>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of the syntax error kinds, as users of such parsers see them.
TEXTS = {
    "UnexpectedToken": "unexpected token",
    "UnbalancedBrackets": "unbalanced brackets",
    "InvalidLiteral": "invalid literal",
    "InvalidNumber": "invalid number",
    "InvalidStringEscape": "invalid string escape",
    "UnterminatedString": "unterminated string",
    "ControlCharacterInString": "unescaped control character in string",
    "MissingColon": "missing ':' in object member",
    "MissingComma": "missing ',' between values",
    "EmptyInput": "empty input",
}
CODES = ("Utf8", "Syntax", "DepthLimit", "TrailingContent", "InputTooLarge", "Io", "Deserialize")
#: Numbers of the errors in a packed error word.
NUMBERS = {"Utf8": 1, "DepthLimit": 3, "TrailingContent": 4, "InvalidNumber": 5, "InvalidStringEscape": 6, "ControlCharacterInString": 6, "MissingColon": 16, "MissingComma": 17, "UnexpectedToken": 18, "InvalidLiteral": 19, "UnbalancedBrackets": 20, "UnterminatedString": 21, "EmptyInput": 22}
#: The packed word of a document without an error: all ones.
CLEAN = -1
TYPE = "struct<code:string,kind:string,offset:bigint,limit:bigint,message:string>"


def error(code: Column, offset: Column, size: Column, max_depth: int, max_bytes: int) -> Column:
    """The error of a failed document; ``code`` is a code or a syntax kind, null without an error."""
    kind = F.when(code.isin(*TEXTS), code)
    text = F.create_map(*[F.lit(x) for kv in TEXTS.items() for x in kv])[kind]
    message = (
        F.when(kind.isNotNull(), F.format_string("JSON syntax error at byte %d: %s", offset, text))
        .when(code == "Utf8", F.format_string("invalid UTF-8 sequence at byte %d", offset))
        .when(code == "DepthLimit", F.format_string(f"nesting depth exceeds the limit of {max_depth} at byte %d", offset))
        .when(code == "TrailingContent", F.format_string("trailing content after the top-level JSON value at byte %d", offset))
        .when(code == "InputTooLarge", F.format_string(f"input of %d bytes exceeds the maximum supported size of {max_bytes} bytes", size))
    )
    limit = F.when(code == "DepthLimit", F.lit(max_depth)).when(code == "InputTooLarge", F.lit(max_bytes)).cast("bigint")
    made = F.struct(F.when(kind.isNotNull(), "Syntax").otherwise(code).alias("code"), kind.alias("kind"), F.when(code != "InputTooLarge", offset).cast("bigint").alias("offset"), limit.alias("limit"), message.alias("message"))
    return F.when(code.isNotNull(), made)


def pack(problem: Column) -> Column:
    """An error as one BIGINT, ``offset << 32 | number``; ``CLEAN`` without an error, null for errors that have no number."""
    name = F.coalesce(problem["kind"], problem["code"])
    number = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])[name].cast("bigint")
    return F.when(problem.isNull(), F.lit(CLEAN).cast("bigint")).otherwise(F.shiftleft(problem["offset"], 32).bitwiseOR(number))


def unpack(word: Column) -> Column:
    """STRUCT<name, offset> of a packed word, null where it is clean; both kinds of bad strings are InvalidStringEscape."""
    names = {n: k for k, n in reversed(NUMBERS.items())}
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[word.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")]
    return F.when(word != CLEAN, F.struct(name.alias("name"), F.shiftrightunsigned(word, 32).alias("offset")))


def deserialize_error(message: Column) -> Column:
    """A value that does not fit its type, as an error; null without a message."""
    made = F.struct(F.lit("Deserialize").alias("code"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("limit"), message.alias("message"))
    return F.when(message.isNotNull(), made)
