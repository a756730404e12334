"""Row-local navigation: columns over the JSON text of valid documents.

For documents that passed ``parse``. Nothing is shuffled, and these run in
streams. They stay right where the JVM's extractors differ: a JSON null is not
an absent member, strings are not numbers, and the first duplicate wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lex import SPACE
from ..functions.scalars import number_kind

#: Nesting from which the JVM's JSON functions refuse a text; deeper ones are navigated as nodes.
JVM_DEPTH = 1000


def first_byte(text: Column) -> Column:
    return F.substring(F.ltrim(text, F.lit(SPACE)), 1, 1)


def kind(text: Column) -> Column:
    """Kind of a document's root value."""
    t = F.trim(F.translate(text, "\t\n\r", "   "))
    b = F.substring(t, 1, 1)
    return F.when(b == "{", "object").when(b == "[", "array").when(b == '"', "string").when(b.isin("t", "f"), "bool").when(b == "n", "null").otherwise(number_kind(t))


def _path(key: str) -> str:
    if "'" in key or "]" in key:
        raise ValueError("a key with ' or ] has no path; use the node table")
    return f"$['{key}']"


def get(text: Column, key: str) -> Column:
    """Text of a member (a string's content without quotes), null if absent or JSON null."""
    return F.when(first_byte(text) == "{", F.get_json_object(text, _path(key)))


def has(text: Column, key: str) -> Column:
    """Whether an object has a member, null ones too."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))


def at(text: Column, i: int) -> Column:
    """Text of an array's element ``i`` from 0, null out of range or for other kinds."""
    return F.when(first_byte(text) == "[", F.get_json_object(text, f"$[{i}]"))


def get_i64(text: Column, key: str) -> Column:
    """A member as a 64-bit integer; null for every other kind, strings of digits too.

    Also null where an object holds the key more than once: the JVM's parser
    would take the last one. The node table has the first.
    """
    held = F.from_json(text, T.StructType([T.StructField(key, T.LongType())]))
    once = F.size(F.filter(F.json_object_keys(text), lambda k: k == key)) <= 1
    return F.when((first_byte(text) == "{") & once, held[key])


def length(text: Column) -> Column:
    """Members or elements of the root, duplicates too; null for scalars."""
    b = first_byte(text)
    return F.when(b == "{", F.size(F.json_object_keys(text))).when(b == "[", F.json_array_length(text))


def is_empty(text: Column) -> Column:
    return length(text) == 0


def keys(text: Column) -> Column:
    """An object's keys in document order, duplicates too."""
    return F.json_object_keys(text)


def elements(text: Column) -> Column:
    """Texts of an array's elements in order."""
    return F.when(first_byte(text) == "[", F.from_json(text, "array<string>"))


__all__ = ["at", "elements", "first_byte", "get", "get_i64", "has", "is_empty", "keys", "kind", "length"]
