"""Deterministic documents: typed events, records of a social feed, and arrays of cycled templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONS = {"ignoreNullFields": "false"}

#: The first whole number that a double does not hold; edges of the number kinds.
PAST_DOUBLES = 2**53 + 1
EDGES = ("9223372036854775807BD", "-9223372036854775808BD", "9223372036854775808BD", "18446744073709551615BD", "0BD")


def parse_size(text: str) -> int:
    """Bytes of a size such as 512k, 4m, 1g or plain digits."""
    m = re.fullmatch(r"(\d+)([kKmMgG]?)", text)
    if not m:
        raise ValueError(f"bad size {text!r}")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]


def events(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(doc_id, json) of n typed event records, the same for the same seed."""
    r = spark.range(n).withColumn("h", F.xxhash64("id", F.lit(seed)))
    pick = lambda k, m: F.pmod(F.xxhash64("h", F.lit(k)), F.lit(m))
    word = lambda k: F.concat(F.lit("w"), pick(k, 1000).cast("string"))
    record = F.struct(
        F.col("id"),
        F.concat(F.lit("user_"), pick(1, 10_000).cast("string")).alias("user"),
        F.concat_ws(" ", *[word(10 + i) for i in range(8)]).alias("message"),
        (pick(2, 100_000) / 1000).alias("score"),
        (pick(3, 2) == 1).alias("active"),
        F.array(word(4), word(5)).alias("tags"),
    )
    return r.select(F.col("id").alias("doc_id"), F.to_json(record, OPTIONS).alias("json"))


def feed_record(i: Column) -> Column:
    """One record of a social feed as a struct, from its number alone."""
    text = lambda c: c.cast("string")
    mod = lambda m: F.pmod(i, F.lit(m))
    return F.struct(
        (i * 1_000_003 + PAST_DOUBLES).alias("id"),
        text(i * 1_000_003 + PAST_DOUBLES).alias("id_str"),
        F.format_string("Mon Jan %02d %02d:%02d:%02d +0000 2024", mod(28) + 1, mod(24), mod(60), mod(60)).alias("created_at"),
        F.concat(F.lit("record "), text(i), F.lit(' says "hi"\n\t'), F.lit("é ☃ 😀 \\ /")).alias("text"),
        (mod(2) == 0).alias("truncated"),
        F.struct(mod(997).alias("id"), F.concat(F.lit("user_"), text(mod(997))).alias("screen_name"), F.concat(F.lit("Name "), text(mod(97))).alias("name"), (mod(5000) * 3).alias("followers_count"), (mod(7) == 0).alias("verified"), F.when(mod(5) != 0, F.concat(F.lit("describes "), text(mod(89)))).alias("description")).alias("user"),
        mod(101).alias("retweet_count"),
        mod(53).alias("favorite_count"),
        F.when(mod(4) == 0, F.array(mod(180) - 90.5, mod(360) - 180.25)).alias("coordinates"),
        F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "ja"))), (mod(4) + 1).cast("int")).alias("lang"),
        F.struct(F.transform(F.sequence(F.lit(0).cast("bigint"), mod(3)), lambda k: F.struct(F.concat(F.lit("tag"), text(k)).alias("text"), F.array(k * 5, k * 5 + 4).alias("indices"))).alias("hashtags"), F.when(mod(2) == 0, F.array(F.struct(F.concat(F.lit("https://example.com/"), text(i)).alias("url"), F.array(F.lit(0), F.lit(23)).alias("indices")))).otherwise(F.array().cast("array<struct<url:string,indices:array<int>>>")).alias("urls")).alias("entities"),
        F.struct(F.array(*[F.expr(x) for x in EDGES]).alias("whole"), F.array(F.lit(0.1), F.lit(-2.5e-7), F.lit(1.7976931348623157e308), F.lit(5e-324)).alias("real")).alias("edge_numbers"),
        F.when(mod(3) == 0, i + 1).alias("in_reply_to_status_id"),
    )


def feed(spark: SparkSession, n: int) -> DataFrame:
    """(doc_id, json) of n feed records."""
    return spark.range(n).select(F.col("id").alias("doc_id"), F.to_json(feed_record(F.col("id")), OPTIONS).alias("json"))


def escapes(spark: SparkSession) -> DataFrame:
    """(doc_id, json): one document that holds every kind of escape."""
    text = r'["\"","\\","\/","\b","\f","\n","\r","\t","A","é","☃","\ud83d\ude00","a\u0000b",{"key\n":"v"}]'
    return spark.createDataFrame([(0, text)], "doc_id bigint, json string")


def expand(templates: DataFrame, size: int, parts: int = 1, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """(doc_id, json): ``parts`` arrays, each cycling the templates in id order until it has ``size`` bytes.

    The array is made without a loop: its record count follows from the
    templates' sizes, whole cycles first and then a prefix of one.
    """
    t = templates.agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(json_col).alias("j")))).alias("t")).select(F.transform("t", lambda x: x["j"]).alias("t"))  # a template set is small by its use
    sizes = F.transform("t", lambda j: F.octet_length(j).cast("bigint") + 1)
    t = t.withColumn("cycle", F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)).withColumn("sizes", sizes)
    whole = F.floor((F.lit(size) - 1) / F.col("cycle"))
    left = F.lit(size) - 1 - whole * F.col("cycle")
    some = F.size(F.filter(F.transform("sizes", lambda x, k: F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0).cast("bigint"), lambda a, y: a + y)), lambda s: s < left))
    t = t.withColumn("n", (whole * F.size("t") + some).cast("int"))
    record = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1), lambda k: F.get("t", F.pmod(k, F.size("t"))))
    made = t.select(F.concat(F.lit("["), F.array_join(record, ","), F.lit("]")).alias("json"))
    return made.crossJoin(F.broadcast(templates.sparkSession.range(parts))).select(F.col("id").alias("doc_id"), "json")
