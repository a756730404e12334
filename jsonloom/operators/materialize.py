"""Typed materialization of nodes into caller-supplied schemas.

Each level of a schema is one aggregate over the children of its nodes, so
depth of the schema, not of the data, decides the number of shuffles. A value
that does not fit becomes a null with an error text; no row fails the job.

Rules: options are nullable; structs come from objects (a declared field twice
is an error, unknown fields are skipped, a missing field is null) or from
arrays by position (exact arity); maps keep the last duplicate and parse their
keys; integers are range-checked and never taken from doubles; floats take all
numbers; strings are not numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import deserialize_error
from ..plans.options import ParseOptions
from .nodes import nodes
from .validate import parse

#: Names of kinds in error texts.
NAMES = {"object": "map", "array": "sequence", "string": "string", "int64": "integer", "uint64": "integer", "double": "floating point", "bool": "boolean", "null": "null"}
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


def invalid_type(expected: str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[F.col("kind")]
    return F.concat(F.lit("invalid type: "), names, F.lit(f", expected {expected}"))


def scalar(kind: T.DataType) -> tuple[Column, Column]:
    """(value, error) of node rows for a scalar type."""
    name = kind.simpleString()
    if isinstance(kind, T.StringType):
        return F.col("str"), F.when(~F.col("kind").isin("string", "null"), invalid_type("a string"))
    if isinstance(kind, T.BinaryType):
        return F.encode("str", "UTF-8"), F.when(~F.col("kind").isin("string", "null"), invalid_type("bytes"))
    if isinstance(kind, T.BooleanType):
        return F.col("bool"), F.when(~F.col("kind").isin("bool", "null"), invalid_type("a boolean"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.coalesce("f64", F.col("i64").cast("double"), F.col("u64").cast("double"))
        return value.cast(kind), F.when(~F.col("kind").isin("int64", "uint64", "double", "null"), invalid_type(name))
    if isinstance(kind, INTEGERS):
        whole = F.coalesce(F.col("i64").cast("decimal(38,0)"), F.col("u64").cast("decimal(38,0)"))
        value = whole.try_cast(kind)
        return value, F.when(~F.col("kind").isin("int64", "uint64", "null"), invalid_type(name)).when(whole.isNotNull() & value.isNull(), F.format_string(f"invalid value: integer `%s`, expected {name}", whole.cast("string")))
    raise TypeError(f"no JSON value becomes {name}")


def parse_typed(df: DataFrame, kind: T.DataType, json_col: str = "json", id_col: str = "doc_id", options: ParseOptions = ParseOptions()) -> DataFrame:
    """``df`` with ``value`` and ``error`` in one call: an error of the parse, else one of code Deserialize where the value does not fit.

    Rows are told apart by ``id_col``, which must be unique and not null.
    """
    checked = parse(df, json_col, options).withColumnRenamed("error", "_parse").drop("ok")
    n = nodes(df, json_col, id_col, options)
    made = materialize(n, n.where("parent_id IS NULL"), kind).select(F.col("doc_id").alias("_id"), "value", F.col("error").alias("_text"))
    both = checked.join(made, F.col(id_col) == F.col("_id"), "left")
    return both.select(*df.columns, "value", F.coalesce("_parse", deserialize_error(F.col("_text"))).alias("error"))


def materialize(n: DataFrame, at: DataFrame, kind: T.DataType, positional: bool = False) -> DataFrame:
    """(doc_id, node_id, value, error) of the nodes ``at`` among all nodes ``n``.

    ``positional`` lets arrays stand for structs. A JSON null gives a null
    without an error, as every value is an option here.
    """
    at = at.select("doc_id", "node_id", "kind", "str", "i64", "u64", "f64", "bool")
    if isinstance(kind, T.StructType):
        return _struct(n, at, kind, positional)
    if isinstance(kind, T.ArrayType):
        return _array(n, at, kind, positional)
    if isinstance(kind, T.MapType):
        return _map(n, at, kind, positional)
    value, error = scalar(kind)
    return at.select("doc_id", "node_id", value.alias("value"), error.alias("error"))


def _children(n: DataFrame, at: DataFrame) -> DataFrame:
    return n.where("parent_id IS NOT NULL").join(at.select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi")


def _struct(n: DataFrame, at: DataFrame, kind: T.StructType, positional: bool) -> DataFrame:
    c = _children(n, at)
    if positional:
        names = F.array(*[F.lit(f.name) for f in kind.fields])
        c = c.withColumn("key", F.coalesce("key", F.get(names, F.col("ordinal").cast("int")))).withColumn("_extra", F.col("key").isNull())
    parts = None
    for i, f in enumerate(kind.fields):
        some = c.where(F.col("key") == f.name)
        v = materialize(n, some, f.dataType, positional).withColumnRenamed("node_id", "child")
        v = some.select("doc_id", "parent_id", F.col("node_id").alias("child")).join(v, ["doc_id", "child"])
        empty = [F.lit(None).cast(g.dataType).alias(f"v{k}") if k != i else F.col("value").cast(f.dataType).alias(f"v{k}") for k, g in enumerate(kind.fields)]
        v = v.select("doc_id", "parent_id", *empty, F.lit(i).alias("field"), "error")
        parts = v if parts is None else parts.unionByName(v)
    first = lambda k: F.first(F.when(F.col("field") == k, F.col(f"v{k}")), ignorenulls=True)
    per_field = F.array(*[F.when(F.count_if(F.col("field") == k) > 1, F.lit(f"duplicate field `{f.name}`")) for k, f in enumerate(kind.fields)])
    g = parts.groupBy("doc_id", "parent_id").agg(
        F.struct(*[first(k).alias(f.name) for k, f in enumerate(kind.fields)]).alias("_v"),
        F.coalesce(F.get(F.filter(per_field, lambda x: x.isNotNull()), F.lit(0)), F.min("error")).alias("_e"),
    )
    sizes = c.groupBy("doc_id", "parent_id").agg(F.count("*").alias("_n"))
    both = at.join(g.withColumnRenamed("parent_id", "node_id"), ["doc_id", "node_id"], "left").join(sizes.withColumnRenamed("parent_id", "node_id"), ["doc_id", "node_id"], "left")
    arity = len(kind.fields)
    size = F.coalesce("_n", F.lit(0))
    ok = (F.col("kind") == "object") | (F.col("kind") == "array") if positional else F.col("kind") == "object"
    length = F.when((F.col("kind") == "array") & (size > arity), F.format_string("invalid length %d, expected fewer elements in array", size)).when((F.col("kind") == "array") & (size < arity), F.format_string(f"invalid length %d, expected struct with {arity} elements", size))
    error = F.when(F.col("kind") == "null", F.lit(None)).when(~ok, invalid_type("struct")).otherwise(F.coalesce(length if positional else F.lit(None), "_e"))
    nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
    value = F.when(error.isNull() & ok, F.coalesce("_v", nothing))
    return both.select("doc_id", "node_id", value.alias("value"), error.alias("error"))


def _array(n: DataFrame, at: DataFrame, kind: T.ArrayType, positional: bool) -> DataFrame:
    c = _children(n, at.where("kind = 'array'"))
    v = materialize(n, c, kind.elementType, positional).withColumnRenamed("node_id", "child")
    v = c.select("doc_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"), "ordinal").join(v, ["doc_id", "child"])
    g = v.groupBy("doc_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct("value").alias("x"))), lambda a, b: F.when(a["ordinal"] < b["ordinal"], -1).otherwise(1)), lambda s: s["x"]["value"]).alias("_v"), F.min("error").alias("_e"))
    both = at.join(g, ["doc_id", "node_id"], "left")
    error = F.when(~F.col("kind").isin("array", "null"), invalid_type("array")).otherwise(F.col("_e"))
    return both.select("doc_id", "node_id", F.when((F.col("kind") == "array") & error.isNull(), F.coalesce("_v", F.array().cast(kind))).alias("value"), error.alias("error"))


def _map(n: DataFrame, at: DataFrame, kind: T.MapType, positional: bool) -> DataFrame:
    c = _children(n, at.where("kind = 'object'"))
    v = materialize(n, c, kind.valueType, positional).withColumnRenamed("node_id", "child")
    v = c.select("doc_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"), "ordinal", "key").join(v, ["doc_id", "child"])
    key = F.col("key")
    strict = {"boolean": key.isin("true", "false")}.get(kind.keyType.simpleString(), key.rlike(r"^-?(?:0|[1-9][0-9]*)\z"))
    typed = key if isinstance(kind.keyType, T.StringType) else F.when(strict, key.try_cast(kind.keyType))
    v = v.withColumn("_k", typed).withColumn("error", F.coalesce("error", F.when(typed.isNull(), F.concat(F.lit("invalid type: string, expected "), F.lit(kind.keyType.simpleString()), F.lit(" map key")))))
    last = v.where("_k IS NOT NULL").groupBy("doc_id", "node_id", "_k").agg(F.max_by(F.struct("value"), "ordinal").alias("_l"))
    g = last.groupBy("doc_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", F.col("_l.value")))).alias("_v"))
    errors = v.groupBy("doc_id", "node_id").agg(F.min("error").alias("_e"))
    both = at.join(g, ["doc_id", "node_id"], "left").join(errors, ["doc_id", "node_id"], "left")
    error = F.when(~F.col("kind").isin("object", "null"), invalid_type("a map")).otherwise(F.col("_e"))
    return both.select("doc_id", "node_id", F.when((F.col("kind") == "object") & error.isNull(), F.coalesce("_v", F.create_map().cast(kind))).alias("value"), error.alias("error"))


def unit(n: DataFrame, at: DataFrame) -> DataFrame:
    """(doc_id, node_id, error): only null is a unit."""
    return at.select("doc_id", "node_id", F.when(F.col("kind") != "null", invalid_type("unit")).alias("error"))


def as_tuple(n: DataFrame, at: DataFrame, kinds: list[T.DataType]) -> DataFrame:
    """Arrays of exact arity as a struct of fields _1, _2, ..."""
    schema = T.StructType([T.StructField(f"_{i + 1}", k) for i, k in enumerate(kinds)])
    made = materialize(n, at, schema, positional=True)
    only = at.select("doc_id", "node_id", "kind")
    return made.join(only, ["doc_id", "node_id"]).select("doc_id", "node_id", F.when(F.col("kind") == "array", F.col("value")).alias("value"), F.when(~F.col("kind").isin("array", "null"), invalid_type("tuple")).otherwise(F.col("error")).alias("error"))


def as_enum(n: DataFrame, at: DataFrame, variants: list[str]) -> DataFrame:
    """(doc_id, node_id, variant, payload_id, error): a string is a unit variant, an object of one member a variant with that payload."""
    c = _children(n, at.where("kind = 'object'"))
    one = c.groupBy("doc_id", "parent_id").agg(F.count("*").alias("_n"), F.min_by("key", "node_id").alias("_key"), F.min("node_id").alias("_payload"))
    both = at.select("doc_id", "node_id", "kind", "str").join(one.withColumnRenamed("parent_id", "node_id"), ["doc_id", "node_id"], "left")
    name = F.when(F.col("kind") == "string", F.col("str")).when((F.col("kind") == "object") & (F.col("_n") == 1), F.col("_key"))
    error = F.when(~F.col("kind").isin("string", "object"), invalid_type("string or map")).when(name.isNull(), F.lit("invalid value: map, expected map with a single key")).when(~name.isin(variants), F.concat(F.lit("unknown variant `"), name, F.lit("`")))
    return both.select("doc_id", "node_id", F.when(error.isNull(), name).alias("variant"), F.when(error.isNull() & (F.col("kind") == "object"), F.col("_payload")).alias("payload_id"), error.alias("error"))
