"""Numbers, literals and strings of single tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lex import GOOD_BODY, NUMBER

#: Bounds of the unsigned kind, and 2**64.
U64_FIRST, U64_LAST, U64_SIZE = "9223372036854775808BD", "18446744073709551615BD", "18446744073709551616BD"


def is_number(token: Column) -> Column:
    return token.rlike("^" + NUMBER + r"\z")


def number_kind(token: Column) -> Column:
    """int64, uint64 or double of a number token; null for a bad one and for one that is infinite as a double."""
    whole = ~token.rlike("[.eE]") & (F.length(token) <= 20)
    small = F.when(whole, token.try_cast("bigint"))
    large = F.when(whole, token.try_cast("decimal(20,0)"))
    fits = large.between(F.expr(U64_FIRST), F.expr(U64_LAST))
    finite = F.abs(token.try_cast("double")) < float("inf")
    return F.when(is_number(token), F.when(small.isNotNull(), "int64").when(fits, "uint64").when(finite, "double"))


def scalar_kind(token: Column) -> Column:
    """Kind of a scalar token that is not a string; null for a bad one."""
    return F.when(token.isin("true", "false"), "bool").when(token == "null", "null").otherwise(number_kind(token))


def string_error(token: Column) -> tuple[Column, Column]:
    """(offset in the token, kind) of the first error of a complete string token, nulls where it is good."""
    good = F.regexp_extract(token, '^"' + GOOD_BODY, 0)
    at = F.octet_length(good)
    bad = F.char_length(good) < F.char_length(token) - 1
    nxt = token.substr(F.char_length(good) + 1, F.lit(1))
    kind = F.when(nxt == "\\", "InvalidStringEscape").otherwise("ControlCharacterInString")
    return F.when(bad, at.cast("bigint")), F.when(bad, kind)


def unescape(token: Column) -> Column:
    """Text of a good string token; tokens without a backslash are only cut."""
    body = token.substr(F.lit(2), F.char_length(token) - 2)
    decoded = F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")
    return F.when(F.instr(token, "\\") == 0, body).otherwise(F.get(decoded, F.lit(0)))


def double_bits(value: Column) -> Column:
    """The 64 bits of a double as a BIGINT."""
    return F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value).cast("bigint")


def unsigned_bits(value: Column) -> Column:
    """The 64 bits of an unsigned value as a BIGINT."""
    return F.when(value >= F.expr(U64_FIRST), value - F.expr(U64_SIZE)).otherwise(value).cast("bigint")
