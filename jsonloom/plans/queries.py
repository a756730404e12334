"""Registered queries: each runs an operator over a whole table, or over golden inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import pack, unpack
from ..functions.scalars import number_kind, string_error
from ..functions.udtf import register
from ..operators import materialize as typed
from ..operators import navigate, nodes, stats, tape, tokens, validate
from ..sources import generate
from ..sources.sinks import to_documents
from ..streaming.stream import parse_stream
from . import report
from .golden import ACCESS, CROSSOVER, ENUMS, ERRORS, MAPS, NUMBERS, POSITIONS, SORTED, STRINGS, TAPE, TUPLES, WIDE
from .options import ParseOptions


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "event_type", F.col("props").alias("json"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return to_documents(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderkey")


def nested(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their line items as an array."""
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))).alias("lines"))
    o = read(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return to_documents(o.select("o_orderkey", "o_orderstatus", "lines"), "o_orderkey")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return to_documents(read(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")


def parsed(docs: DataFrame) -> DataFrame:
    """The node table, held for the lookups of one query: in memory, then on disk, and made again where it is lost."""
    return nodes.nodes(docs).persist()


def golden(spark: SparkSession, rows: tuple, ddl: str) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


def flagship_events(spark, sf):
    """Valid documents, sum of a member and nodes, per event type."""
    v = validate.parse(events(spark, sf)).where("ok")
    n = v.select("event_type", navigate.get_i64(F.col("json"), "k").alias("k"), stats.node_count(F.col("json")).alias("n"))
    return n.groupBy("event_type").agg(F.count("*").alias("docs"), F.sum("k").alias("sum_k"), F.sum("n").cast("bigint").alias("nodes"))


def validate_counts(spark, sf):
    parts = [("events", events), ("orders", orders), ("nested", nested), ("documents", texts)]
    out = None
    for name, f in parts:
        d = validate.parse(f(spark, sf)).agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad")).select(F.lit(name).alias("source"), "good", "bad")
        out = d if out is None else out.unionByName(d)
    return out


def error_report(spark, sf):
    """Golden errors under both policies."""
    d = golden(spark, [(i, bytearray(c), m) for i, (c, m, *_) in enumerate(ERRORS)], "doc_id bigint, json binary, max_depth int")
    out = None
    for depth in sorted({m for _, m, *_ in ERRORS}):
        for policy in ("stage", "earliest"):
            p = validate.parse(d.where(F.col("max_depth") == depth), options=ParseOptions(max_depth=depth, error_policy=policy))
            p = p.select("doc_id", F.lit(policy).alias("policy"), F.coalesce("error.kind", "error.code", F.lit("ok")).alias("error"), F.coalesce("error.offset", F.lit(-1)).cast("bigint").alias("at"))
            out = p if out is None else out.unionByName(p)
    return out


def token_counts(spark, sf):
    t = tokens.totals(tokens.tokens(orders(spark, sf)))
    return t.agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.sum("n_skeleton").alias("skeleton"), F.sum("n_strings").alias("strings"), F.sum("n_scalars").alias("scalars"), F.sum("tape_words").cast("bigint").alias("tape_words"))


def depth_profile(spark, sf):
    s = tokens.skeleton(tokens.tokens(nested(spark, sf)))
    return s.where(F.col("kind").isin("{", "[")).groupBy("depth", F.when(F.col("kind") == "{", "object").otherwise("array").alias("container")).agg(F.count("*").alias("n"))


def child_counts(spark, sf):
    """Elements of each order's array, from its brackets."""
    s = tokens.skeleton(tokens.tokens(nested(spark, sf)))
    return s.where("kind = '['").select("doc_id", F.col("child_count").cast("bigint").alias("lines"), (F.col("match_tok") > F.col("tok")).alias("paired"))


def number_kinds(spark, sf):
    d = golden(spark, [(t,) for t, *_ in NUMBERS], "text string")
    return d.select("text", F.coalesce(number_kind(F.col("text")), F.lit("bad")).alias("kind"), F.coalesce(stats.number_bits(F.col("text")), F.lit(0)).alias("bits"))


def string_errors(spark, sf):
    d = golden(spark, [(t,) for t, *_ in STRINGS], "text string")
    at, kind = string_error(F.col("text"))
    return d.select("text", F.coalesce(at, F.lit(-1)).cast("bigint").alias("at"), F.coalesce(kind, F.lit("ok")).alias("error"))


def unescape_roundtrip(spark, sf):
    n = parsed(texts(spark, sf))
    return n.where("key = 'text'").select("doc_id", F.col("str").alias("text"))


def record_offsets(spark, sf):
    r = tape.records(tokens.tokens(orders(spark, sf)))
    return r.groupBy("doc_id").agg(F.count("*").alias("records"), F.max("record_offset").alias("last_offset"), F.sum("raw_len").alias("raw_bytes"))


def get_path(spark, sf):
    n = parsed(orders(spark, sf))
    r = nodes.root(n)
    price, status = nodes.get(n, r, "o_totalprice"), nodes.get(n, r, "o_orderstatus")
    return price.select("doc_id", nodes.as_f64().alias("price")).join(status.select("doc_id", nodes.as_str().alias("status")), "doc_id")


def at_index(spark, sf):
    """Quantity of each order's first and third line item."""
    n = parsed(nested(spark, sf))
    lines = nodes.get(n, nodes.root(n), "lines")
    out = None
    for i in (0, 2):
        q = nodes.get(n, nodes.element(n, lines, i), "l_quantity").select("doc_id", F.lit(i).alias("i"), nodes.as_f64().alias("quantity"))
        out = q if out is None else out.unionByName(q)
    return out


def row_local_navigation(spark, sf):
    j = F.col("json")
    lines = navigate.get(j, "lines")
    d = nested(spark, sf)
    return d.select("doc_id", navigate.length(j).cast("bigint").alias("members"), navigate.length(lines).cast("bigint").alias("lines"), navigate.get_i64(navigate.at(lines, 0), "l_linenumber").alias("first_line"), navigate.has(j, "absent").alias("has_absent"), navigate.kind(j).alias("kind"))


def entries(spark, sf):
    n = parsed(orders(spark, sf))
    e = nodes.entries(n, nodes.root(n))
    return e.groupBy("key", "ordinal", "kind").agg(F.count("*").alias("n"))


def elements(spark, sf):
    n = parsed(nested(spark, sf))
    lines = nodes.get(n, nodes.root(n), "lines")
    item = nodes.elements(n, lines)
    number = nodes.get(n, item, "l_linenumber").select("doc_id", F.col("parent_id").alias("node_id"), F.col("i64").alias("line"))
    return item.join(number, ["doc_id", "node_id"]).select("doc_id", "ordinal", "line", F.col("n_children").alias("members"))


def descendants(spark, sf):
    n = parsed(nested(spark, sf))
    return nodes.descendants(n, nodes.get(n, nodes.root(n), "lines")).groupBy("doc_id").agg(F.count("*").alias("nodes"))


def duplicates(spark, sf):
    """First and last of duplicate members, and their number."""
    d = read(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit('{"k":'), F.col("event_id").cast("string"), F.lit(',"x":0,"k":'), (F.col("event_id") * 2).cast("string"), F.lit("}")).alias("json"))
    n = parsed(d)
    r = nodes.root(n)
    first = nodes.get(n, r, "k").select("doc_id", F.col("i64").alias("first"))
    last = nodes.last_of(n, r, "k").select("doc_id", F.col("i64").alias("last"))
    return first.join(last, "doc_id").join(nodes.duplicate_keys(n).select("doc_id", F.col("n").alias("copies")), "doc_id")


def stats_walk(spark, sf):
    d = to_documents(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    return stats.stats(d)


def typed_struct(spark, sf):
    n = parsed(orders(spark, sf))
    schema = T.StructType.fromDDL("o_orderkey bigint, o_orderstatus string, o_totalprice double, absent int")
    return typed.materialize(n, nodes.root(n), schema).where("error IS NULL").select("doc_id", F.col("value.o_orderkey").alias("orderkey"), F.col("value.o_orderstatus").alias("status"), F.col("value.o_totalprice").alias("price"), F.col("value.absent").alias("absent"))


def typed_array(spark, sf):
    n = parsed(nested(spark, sf))
    schema = T.StructType.fromDDL("lines array<struct<l_linenumber:int,l_quantity:double>>")
    v = typed.materialize(n, nodes.root(n), schema).select("doc_id", F.posexplode("value.lines").alias("i", "x"), "error")
    return v.select("doc_id", "i", F.col("x.l_linenumber").alias("line"), F.col("x.l_quantity").alias("quantity"), F.coalesce("error", F.lit("")).alias("error"))


def typed_positional(spark, sf):
    d = golden(spark, [(i, t) for i, (t, *_) in enumerate(POSITIONS)], "doc_id bigint, json string")
    n = parsed(d)
    v = typed.materialize(n, nodes.root(n), T.StructType.fromDDL("a tinyint, b string"), positional=True)
    return v.select("doc_id", F.col("value.a").cast("int").alias("a"), F.col("value.b").alias("b"), F.coalesce("error", F.lit("")).alias("error"))


def typed_map_keys(spark, sf):
    d = golden(spark, [(i, t) for i, (t, *_) in enumerate(MAPS)], "doc_id bigint, json string")
    n = parsed(d)
    v = typed.materialize(n, nodes.root(n), T.MapType(T.IntegerType(), T.StringType()))
    return v.select("doc_id", F.coalesce(F.array_join(F.transform(F.array_sort(F.map_keys("value")), lambda k: F.concat(k.cast("string"), F.lit("="), F.col("value")[k])), ","), F.lit("null")).alias("entries"), F.col("error").isNotNull().alias("failed"))


def typed_enum(spark, sf):
    d = golden(spark, [(i, t) for i, (t, *_) in enumerate(ENUMS)], "doc_id bigint, json string")
    n = parsed(d)
    e = typed.as_enum(n, nodes.root(n), ["Unit", "Newtype", "Tuple", "Struct"])
    return e.select("doc_id", F.coalesce("variant", F.lit("")).alias("variant"), F.col("payload_id").isNotNull().alias("has_payload"), F.col("error").isNotNull().alias("failed"))


def tape_words(spark, sf):
    d = golden(spark, [(0, TAPE[0])], "doc_id bigint, json string")
    return tape.tape_words(tokens.tokens(d)).select("idx", "word")


def tape_buffers(spark, sf):
    """Sizes of all documents' tapes and buffers, and one record read back."""
    t = tape.documents(orders(spark, sf))
    return t.select("doc_id", F.size("tape").cast("bigint").alias("words"), F.octet_length("strings").cast("bigint").alias("bytes"), tape.record_text(F.col("strings"), F.lit(0)).alias("first_string"), tape.tag_of(F.get("tape", F.lit(1))).alias("tag"), tape.count_of(F.get("tape", F.lit(1))).alias("members"))


def gen_corpus(spark, sf):
    t = read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("doc_id"), F.to_json(F.struct("n_nationkey", "n_name")).alias("json"))
    d = generate.expand(t, 5000)
    return d.select("doc_id", F.octet_length("json").cast("bigint").alias("bytes"), F.json_array_length("json").cast("bigint").alias("records"), F.md5("json").alias("md5"))


def crossover(spark, sf):
    d = golden(spark, CROSSOVER, "dataset string, contender string, bytes bigint, seconds double")
    return report.crossover(report.sweep(report.medians(d), "a", "b")).select(F.round("bytes", 3).alias("bytes"))


def nodes_relational(spark, sf):
    """Join, aggregate and rank over nodes: the three dearest orders of each status by a member of their documents."""
    n = parsed(orders(spark, sf))
    r = nodes.root(n)
    price = nodes.get(n, r, "o_totalprice").select("doc_id", nodes.as_f64().alias("price"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))
    w = Window.partitionBy("status").orderBy(F.desc("price"), "doc_id")
    return o.join(price, "doc_id").withColumn("place", F.row_number().over(w)).where("place <= 3").select("status", "place", "doc_id", "price")


def damaged(spark, sf):
    """Documents of which one in twenty is damaged, in four ways."""
    j = F.format_string('{"id":%d,"lang":"%s","n":%d}', "doc_id", "lang", "n_chars")
    way = F.when(F.col("doc_id") % 20 == 3, F.floor(F.col("doc_id") / 20) % 4)
    broken = F.when(way == 0, F.expr("left(j, length(j) - 1)")).when(way == 1, F.concat("j", F.lit("}"))).when(way == 2, F.regexp_replace("j", '^\\{"id":', '{"id"')).when(way == 3, F.concat("j", F.lit(" x"))).otherwise(F.col("j"))
    return read(spark, sf, "documents").withColumn("j", j).select("doc_id", broken.alias("json"))


def errors_of_table(spark, sf):
    """Errors of damaged documents, whose ids are no help: all are null while they are parsed."""
    d = damaged(spark, sf).select(F.lit(None).cast("bigint").alias("doc_id"), "json", F.col("doc_id").alias("row"))
    p = validate.parse(d).withColumn("packed", pack(F.col("error")))
    return p.select(F.col("row").alias("doc_id"), "ok", F.coalesce("error.kind", F.lit("")).alias("error"), F.coalesce("error.offset", F.lit(-1)).alias("at"), "packed", F.coalesce(unpack(F.col("packed"))["name"], F.lit("")).alias("unpacked"))


def typed_in_one_call(spark, sf):
    """Typed values of damaged documents, with errors of both sorts: ids over 127 do not fit."""
    v = typed.parse_typed(damaged(spark, sf), T.StructType.fromDDL("id tinyint, lang string"))
    return v.select("doc_id", F.coalesce(F.col("value.id").cast("int"), F.lit(-1)).alias("id"), F.col("value.lang").alias("lang"), F.coalesce("error.code", F.lit("")).alias("error"))


def scalar_accessors(spark, sf):
    n = nodes.root(parsed(golden(spark, [(i, t) for i, (t, *_) in enumerate(ACCESS)], "doc_id bigint, json string")))
    return n.select("doc_id", nodes.as_u64().cast("string").alias("u64"), nodes.as_bool().alias("bool"), nodes.is_null().alias("is_null"), nodes.is_empty().alias("is_empty"), F.coalesce(nodes.raw_count(), F.lit(-1)).cast("bigint").alias("raw_count"))


def typed_wide(spark, sf):
    """Widening to doubles, 128-bit integers and the unit."""
    n = parsed(golden(spark, [(i, t) for i, (t, *_) in enumerate(WIDE)], "doc_id bigint, json string"))
    r = nodes.root(n)
    real, whole = (typed.materialize(n, r, kind).select("doc_id", F.col("value").alias(name)) for kind, name in ((T.DoubleType(), "real"), (T.DecimalType(38, 0), "whole")))
    unit = typed.unit(n, r).select("doc_id", F.col("error").isNull().alias("unit"))
    return real.join(whole, "doc_id").join(unit, "doc_id").select("doc_id", "real", F.col("whole").cast("string").alias("whole"), "unit")


def typed_tuple(spark, sf):
    n = parsed(golden(spark, [(i, t) for i, (t, *_) in enumerate(TUPLES)], "doc_id bigint, json string"))
    v = typed.as_tuple(n, nodes.root(n), [T.LongType(), T.StringType()])
    return v.select("doc_id", F.coalesce("value._1", F.lit(-1).cast("bigint")).alias("a"), F.col("value._2").alias("b"), F.coalesce("error", F.lit("")).alias("error"))


def depth_sort(spark, sf):
    d = golden(spark, [(0, SORTED[0])], "doc_id bigint, json string")
    return tokens.depth_order(tokens.skeleton(tokens.tokens(d))).select(F.col("skel").cast("int").alias("skel"), "place")


def record_checksum(spark, sf):
    o = read(spark, sf, "orders")
    return stats.checksum(o, "o_orderkey", F.col("o_orderstatus") == "O", F.col("o_orderpriority"), F.lit(1.0))


def feed_records(spark, sf):
    """The record generator's edges, read back from its documents."""
    d = generate.feed(spark, 200)
    n = parsed(d)
    ids = nodes.get(n, nodes.root(n), "id").agg(F.count("*").alias("docs"), F.sum("i64").alias("ids"))
    edges = n.agg(F.count_if(F.col("kind") == "uint64").alias("unsigned"), F.count_if((F.col("key") == "description") & (F.col("kind") == "null")).alias("without"), F.count_if(F.col("key") == "url").alias("urls"))
    return ids.join(edges)  # a row each


def sql_functions(spark, sf):
    """Tokens and nodes by the table functions, in SQL."""
    register(spark)
    read(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("json")).createOrReplaceTempView("nation_documents")
    return spark.sql("SELECT n_nationkey, count(*) AS nodes, max(CASE WHEN key = 'n_name' THEN value END) AS name FROM nation_documents, LATERAL json_nodes(json) GROUP BY n_nationkey")


def stream_counts(spark, sf):
    """Good documents of each type, counted by a stream over the table's files."""
    held = read(spark, sf, "events")
    s = spark.readStream.schema(held.schema).parquet(f"{sf}/event[s].parquet").withColumnRenamed("props", "json")
    good = parse_stream(s).where("ok").groupBy("event_type").agg(F.count("*").alias("docs"))
    q = good.writeStream.format("memory").queryName("stream_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("stream_counts")


def queries() -> dict:
    names = (flagship_events, validate_counts, error_report, token_counts, depth_profile, child_counts, number_kinds, string_errors, unescape_roundtrip, record_offsets, get_path, at_index, row_local_navigation, entries, elements, descendants, duplicates, stats_walk, typed_struct, typed_array, typed_positional, typed_map_keys, typed_enum, tape_words, tape_buffers, gen_corpus, crossover, nodes_relational, errors_of_table, typed_in_one_call, scalar_accessors, typed_wide, typed_tuple, depth_sort, record_checksum, feed_records, sql_functions, stream_counts)
    return {f.__name__: f for f in names}
