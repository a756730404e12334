"""The node table of valid documents, and navigation over it.

One row a value: doc_id, node_id (its token), parent_id, ordinal (0-based in
its container), key, kind, str, i64, u64, f64, bool, pos and end_pos (bytes of
its text), end_id (token of a container's close), depth (containers around
it), n_children. Document order and duplicate keys survive; a JSON null is a
row of kind null, an absent member is no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import scalar_kind, unescape
from ..plans.options import MAX_COUNT, ParseOptions
from .tokens import CLOSES, OPENS, by_doc, tokens
from .validate import gated

KINDS = ("object", "array", "string", "int64", "uint64", "double", "bool", "null")


def valid(docs: DataFrame, json_col: str = "json", id_col: str = "doc_id", options: ParseOptions = ParseOptions()) -> DataFrame:
    """Only the valid documents, as (doc_id, json); row-local."""
    return gated(docs, json_col, options).where("_good").select(F.col(id_col).alias("doc_id"), F.col(json_col).cast("string").alias("json"))


def values_of(kind: Column, text: Column) -> dict[str, Column]:
    """Typed columns of a token, by its node kind."""
    whole = F.when(kind.isin("int64", "uint64"), text)
    return {
        "str": F.when(kind == "string", unescape(text)),
        "i64": F.when(kind == "int64", whole.try_cast("bigint")),
        "u64": F.when(kind == "uint64", whole.try_cast("decimal(20,0)")),
        "f64": F.when(kind == "double", text.try_cast("double")),
        "bool": F.when(kind == "bool", text == "true"),
    }


def node_kind(kind: Column, text: Column) -> Column:
    return F.when(kind == "{", "object").when(kind == "[", "array").when(kind == "q", "string").otherwise(scalar_kind(text))


def nodes_of_tokens(t: DataFrame) -> DataFrame:
    """Nodes of the tokens of valid documents: two shuffles, by document and by (document, depth)."""
    w = by_doc()
    k = F.col("kind")
    weight = F.when(k.isin(*OPENS), 1).when(k.isin(*CLOSES), -1).otherwise(0)
    t = t.withColumn("depth", (F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.when(k.isin(*OPENS), 1).otherwise(0)).cast("int"))
    t = t.withColumn("_next", F.lead("kind").over(w)).withColumn("_p", F.lag("kind").over(w)).withColumn("_key", F.lag("text", 2).over(w))
    is_key = (k == "q") & F.coalesce(F.col("_next") == ":", F.lit(False))
    keep = (k.isin("q", "s", *OPENS) & ~is_key) | k.isin(*CLOSES)
    t = t.where(keep).withColumn("_key", F.when(F.col("_p") == ":", F.col("_key")))
    # an open stands twice: as a child of its container, and in the group of its own children
    role = F.when(k.isin(*OPENS), F.array(F.lit("child"), F.lit("open"))).when(k.isin(*CLOSES), F.array(F.lit("close"))).otherwise(F.array(F.lit("child")))
    r = t.withColumn("role", F.explode(role)).withColumn("level", F.col("depth") + F.when(F.col("role").isin("open", "close"), 1).otherwise(0))
    g = Window.partitionBy("doc_id", "level").orderBy("tok")
    upto = g.rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_open", F.last(F.when(F.col("role") == "open", F.col("tok")), ignorenulls=True).over(upto))
    r = r.withColumn("_n", F.count_if(F.col("role") == "child").over(upto))
    r = r.withColumn("_at", F.last(F.when(F.col("role") == "open", F.col("_n")), ignorenulls=True).over(upto))
    ends = r.where("role = 'close'").select("doc_id", F.col("_open").alias("node_id"), F.col("tok").alias("end_id"), (F.col("pos") + 1).alias("_end"), (F.col("_n") - F.coalesce("_at", F.lit(0))).cast("bigint").alias("n_children"))
    c = r.where("role = 'child'").select("doc_id", F.col("tok").alias("node_id"), F.col("_open").alias("parent_id"), (F.col("_n") - F.coalesce("_at", F.lit(0)) - 1).cast("bigint").alias("ordinal"), F.when(F.col("_key").isNotNull(), unescape(F.col("_key"))).alias("key"), node_kind(k, F.col("text")).alias("kind"), "text", "pos", "depth")
    both = c.join(ends, ["doc_id", "node_id"], "left")
    typed = values_of(F.col("kind"), F.col("text"))
    return both.select("doc_id", "node_id", "parent_id", "ordinal", "key", "kind", *[v.alias(n) for n, v in typed.items()], "pos", F.coalesce("_end", F.col("pos") + F.octet_length("text")).alias("end_pos"), "end_id", "depth", "n_children")


def nodes(docs: DataFrame, json_col: str = "json", id_col: str = "doc_id", options: ParseOptions = ParseOptions()) -> DataFrame:
    """Nodes of the valid ones of ``docs``; failed and null documents have none."""
    return nodes_of_tokens(tokens(valid(docs, json_col, id_col, options)))


def root(n: DataFrame) -> DataFrame:
    return n.where("parent_id IS NULL")


def get(n: DataFrame, at: DataFrame, key: str) -> DataFrame:
    """The member ``key`` of each node of ``at``, the first of duplicates; no row where there is none."""
    first = _children(n, at).where(F.col("key") == key)
    return _only(first, "min")


def last_of(n: DataFrame, at: DataFrame, key: str) -> DataFrame:
    """As ``get``, but the last of duplicates."""
    return _only(_children(n, at).where(F.col("key") == key), "max")


def element(n: DataFrame, at: DataFrame, i: int) -> DataFrame:
    """The element ``i`` (from 0) of each array of ``at``; no row out of range or for other kinds."""
    return _children(n, at.where("kind = 'array'")).where(F.col("ordinal") == i)


def entries(n: DataFrame, at: DataFrame) -> DataFrame:
    """Members of the objects of ``at`` with their keys, duplicates too; order is ``ordinal``."""
    return _children(n, at.where("kind = 'object'"))


def elements(n: DataFrame, at: DataFrame) -> DataFrame:
    """Elements of the arrays of ``at``; order is ``ordinal``."""
    return _children(n, at.where("kind = 'array'"))


def descendants(n: DataFrame, at: DataFrame) -> DataFrame:
    """All nodes under each node of ``at``, by its range of tokens."""
    a = at.select("doc_id", F.col("node_id").alias("a_id"), F.col("end_id").alias("a_end"))
    return n.join(a, "doc_id").where("node_id > a_id AND node_id < a_end").withColumnRenamed("a_id", "ancestor_id").drop("a_end")


def _children(n: DataFrame, at: DataFrame) -> DataFrame:
    p = at.select("doc_id", F.col("node_id").alias("parent_id"))
    return n.join(p, ["doc_id", "parent_id"], "left_semi")


def _only(children: DataFrame, which: str) -> DataFrame:
    row = F.struct("node_id", *[c for c in children.columns if c not in ("doc_id", "parent_id", "node_id")])
    best = children.groupBy("doc_id", "parent_id").agg((F.min_by if which == "min" else F.max_by)(row, F.col("node_id")).alias("r"))
    return best.select("doc_id", "parent_id", "r.*").select(*children.columns)


# Scalar accessors: columns over a node row, null where the kind is another.
def as_str() -> Column:
    return F.col("str")


def as_i64() -> Column:
    return F.col("i64")


def as_u64() -> Column:
    return F.col("u64")


def as_f64() -> Column:
    """Doubles, and integers of both kinds widened."""
    return F.coalesce("f64", F.col("i64").cast("double"), F.col("u64").cast("double"))


def as_bool() -> Column:
    return F.col("bool")


def is_null() -> Column:
    return F.col("kind") == "null"


def length() -> Column:
    """Members or elements; null for scalars."""
    return F.when(F.col("kind").isin("object", "array"), F.coalesce("n_children", F.lit(0)))


def is_empty() -> Column:
    return length() == 0


def raw_count() -> Column:
    """The child count as a tape word holds it; null for scalars."""
    return F.when(length().isNotNull(), F.least(length(), F.lit(MAX_COUNT)))


def raw_text(n: DataFrame, docs: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """``n`` with ``raw``, the text of each node's subtree."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(json_col).cast("binary").alias("_b"))
    return n.join(d, "doc_id").withColumn("raw", F.substring("_b", (F.col("pos") + 1).cast("int"), (F.col("end_pos") - F.col("pos")).cast("int")).cast("string")).drop("_b")


def duplicate_keys(n: DataFrame) -> DataFrame:
    """(doc_id, parent_id, key, n) of the keys that an object holds more than once."""
    return n.where("key IS NOT NULL").groupBy("doc_id", "parent_id", "key").agg(F.count("*").alias("n")).where("n > 1")

