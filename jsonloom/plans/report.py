"""Benchmark reports as queries: medians, throughput, speedup and the crossover size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def medians(samples: DataFrame) -> DataFrame:
    """(dataset, contender, bytes, seconds, gbps) of samples (dataset, contender, bytes, seconds)."""
    m = samples.groupBy("dataset", "contender", "bytes").agg(F.percentile("seconds", 0.5).alias("seconds"))
    return m.withColumn("gbps", F.col("bytes") / 1e9 / F.col("seconds"))


def sweep(m: DataFrame, ours: str, theirs: str) -> DataFrame:
    """(dataset, bytes, ours, theirs, speedup), by size."""
    a = m.where(F.col("contender") == ours).select("dataset", "bytes", F.col("seconds").alias("ours"))
    b = m.where(F.col("contender") == theirs).select("dataset", F.col("seconds").alias("theirs"))
    return a.join(b, "dataset").withColumn("speedup", F.col("theirs") / F.col("ours"))


def crossover(rows: DataFrame) -> DataFrame:
    """(bytes): where ``ours`` stops being slower, by linear interpolation between sizes; no row if it never does."""
    w = Window.orderBy("bytes")  # one row for each size of a sweep
    r = rows.withColumn("d", F.col("ours") - F.col("theirs")).withColumn("d0", F.lag("d").over(w)).withColumn("b0", F.lag("bytes").over(w))
    r = r.where("d0 > 0 AND d <= 0")
    return r.select((F.col("b0") + (F.col("bytes") - F.col("b0")) * F.col("d0") / (F.col("d0") - F.col("d"))).alias("bytes")).orderBy("bytes").limit(1)


def render(rows: DataFrame) -> str:
    """A Markdown table of a sweep; it has a row for each dataset."""
    lines = ["| dataset | bytes | ours s | theirs s | speedup |", "|---|---:|---:|---:|---:|"]
    for r in rows.orderBy("bytes").collect():
        lines.append(f"| {r['dataset']} | {r['bytes']} | {r['ours']:.4f} | {r['theirs']:.4f} | {r['speedup']:.2f} |")
    return "\n".join(lines)
