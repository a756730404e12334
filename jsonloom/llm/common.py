"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and line contract here: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
#: One word, as a Java and Python pattern.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """``df`` with only the wanted columns, ``new=old``; other columns, even of clashing names, go.

    The first column whose name equals ``old`` is taken, else the first that
    differs in case only, as Spark's names do; neither repeated names nor names
    that differ in case are ambiguous.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    lower = [n.lower() for n in names]
    place = lambda old: names.index(old) if old in names else lower.index(old.lower())
    return plain.select(*[F.col(f"c{place(old)}").alias(new) for new, old in wanted.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; one under /tmp only in local mode where none is set."""
    set_one = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not set_one and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (set_one or "/tmp/checkpoints").rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._shared_path = path
    return back


def drop_table(df: DataFrame) -> None:
    """Deletes what ``table`` wrote, once nothing reads it any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is; pure ASCII takes the byte-wise way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
