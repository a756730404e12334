"""Lexical patterns and the columns made of them. All quantifiers over input are possessive, so stacks stay flat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\r"
ESCAPE = r'\\(?:["\\/bfnrt]|u(?:[0-9a-cA-CeEfF][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2}|[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}))'
#: What a string may start with, after its opening quote; the first error follows it.
GOOD_BODY = r'(?:[^"\\\x00-\x1f]++|' + ESCAPE + ")*+"
GOOD_STRING = '"' + GOOD_BODY + '"'
NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
LITERAL = "(?:true|false|null)"
#: Tokens with the white space before them; strings are one token, a dangling quote takes the rest.
TOKEN = r'[ \t\n\r]*+(?:"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|[{}\[\]:,]|(?:\\["\\]|[^ \t\n\r{}\[\]:,"])++|"[\s\S]*+)|[ \t\n\r]++'
#: A text all of whose tokens are good.
LEXICAL = r"^(?:[ \t\n\r{}\[\]:,]++|" + GOOD_STRING + "|(?:" + LITERAL + "|" + NUMBER + r')(?=[ \t\n\r{}\[\]:,"]|\z))*+\z'
#: Scalars that may be infinite as doubles.
HUGE = r"[eE]\+?[0-9]{3,}|[0-9]{300,}"
UTF8 = "^(?:[\\x00-\\x7f]++|[\\xc2-\\xdf][\\x80-\\xbf]|\\xe0[\\xa0-\\xbf][\\x80-\\xbf]|[\\xe1-\\xec\\xee\\xef][\\x80-\\xbf]{2}|\\xed[\\x80-\\x9f][\\x80-\\xbf]|\\xf0[\\x90-\\xbf][\\x80-\\xbf]{2}|[\\xf1-\\xf3][\\x80-\\xbf]{3}|\\xf4[\\x80-\\x8f][\\x80-\\xbf]{2})*+"
#: Containers of values only, in a text of one character a token: q string, s other scalar, v container.
INNERMOST = r"\{(?:q:[qsv](?:,q:[qsv])*+)?+\}|\[(?:[qsv](?:,[qsv])*+)?+\]"
#: Rounds of reduction on the fast way; deeper texts go the exact way.
ROUNDS = 8


def utf8_error(content: Column) -> Column:
    """Offset of the first byte that is not UTF-8, null where all is."""
    return F.when(~F.is_valid_utf8(content.cast("string")), F.length(F.regexp_extract(F.decode(content, "ISO-8859-1"), UTF8, 0)).cast("bigint"))


def kind_string(text: Column) -> Column:
    """One character a token of a text that matches LEXICAL: operators as they are, q for strings, s for other scalars."""
    names = F.regexp_replace(text, GOOD_STRING, "q")
    return F.regexp_replace(F.regexp_replace(names, "true|false|null|-?[0-9][-+.eE0-9]*+", "s"), "[ \\t\\n\\r]++", "")


def surely_valid(text: Column, max_depth: int, rounds: int = ROUNDS) -> Column:
    """True for valid documents that nest at most ``rounds`` deep; false says nothing yet.

    Good tokens are checked by one possessive pattern; structure by folding
    innermost containers into one character, one level a round.
    """
    kinds = kind_string(text)
    for _ in range(min(rounds, max_depth)):
        kinds = F.regexp_replace(kinds, INNERMOST, "v")
    return F.coalesce(text.rlike(LEXICAL) & ~text.rlike(HUGE) & kinds.isin("q", "s", "v"), F.lit(False))


def tokens_of(text: Column) -> Column:
    """All tokens of a text in order, each with the white space before it; they cover the text without gaps."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_kind(token: Column) -> Column:
    """Operator character, q string, u unterminated string, s other run, w white space only."""
    first = F.substring(token, 1, 1)
    return (
        F.when(token == "", F.lit("w"))
        .when(first.isin(*"{}[]:,"), first)
        .when((first == '"') & token.rlike(r'^"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"\z'), F.lit("q"))
        .when(first == '"', F.lit("u"))
        .otherwise(F.lit("s"))
    )
