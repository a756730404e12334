"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.operators import navigate, stats, validate
from jsonloom.plans import queries as q
from jsonloom.sources.sinks import to_documents


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def held(df: DataFrame) -> DataFrame:
        df = df.repartition(int(cpus)).cache()
        df.count()
        return df

    orders = held(q.orders(spark, sf))
    texts = held(to_documents(q.read(spark, sf, "documents"), "doc_id"))
    size = {n: d.agg(F.sum(F.octet_length("json"))).first()[0] for n, d in (("orders", orders), ("texts", texts))}
    j = F.col("json")
    runs = {
        "flagship_events": lambda: q.flagship_events(spark, sf),
        "validate_orders": lambda: validate.parse(orders).select("doc_id", "ok"),
        "validate_texts": lambda: validate.parse(texts).select("doc_id", "ok"),
        "stats_orders": lambda: stats.stats(orders),
        "stats_texts": lambda: stats.stats(texts),
        "row_local_navigation": lambda: orders.select(navigate.length(j), navigate.get(j, "o_orderstatus"), navigate.get_i64(j, "o_orderkey")),
    }
    took = {}
    for name, run in runs.items():
        samples = []
        for _ in range(3):
            began = time.time()
            run().write.format("noop").mode("overwrite").save()
            samples.append(time.time() - began)
        took[name] = round(statistics.median(samples[1:]), 3)
    rates = {n: round(size[n.split("_")[1]] / 1e9 / took[n], 4) for n in took if n.split("_")[1] in size}
    print(json.dumps({"metric": "parse and stats over documents, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf.rstrip("/").rsplit("sf", 1)[-1]) if "sf" in sf else None, "gb_per_s": rates}))


if __name__ == "__main__":
    main()
