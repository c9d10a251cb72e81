"""What the operators share: reading tables, choosing columns, written tables, words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.sources.shared import new_dir

SPACE = " \t\n\x0b\f\r"  # all that separates words: [\x20\x09-\x0D]
SPACES = "[ \\t-\\r]+"
NODE_BITS = 64  # of the first hash that names a row; tests shorten it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(frame: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name; the others may clash as they like."""
    plain = frame.toDF(*(f"c{i}" for i in range(len(frame.columns))))
    return plain.select(*(F.col(f"c{frame.columns.index(n)}").alias(n) for n in names))


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage and
    outlives lost executors."""
    path = new_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_key(text: Column) -> Column:
    """Tells rows apart that share an id; rows equal in both are one document."""
    return F.xxhash64(text)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def name_nodes(rows: DataFrame, keys: list[str], name: str, seed: int = 0) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows, different in ``keys``, with a long ``node`` each, none twice; and what
    adds the same nodes to other frames that hold the keys.

    A node is a hash of the keys. Rows whose hashes meet, a handful among 10^11, are named
    anew by another seed until none meet, so a pass more is due for these alone.
    """
    first = F.call_function("shiftrightunsigned", F.xxhash64(*keys, F.lit(seed)), F.lit(64 - NODE_BITS))
    met: list[DataFrame] = []

    def renamed(frame: DataFrame, twice: DataFrame, again: int) -> DataFrame:
        anew = F.when(F.col("twice").isNotNull(), F.xxhash64(*keys, F.lit(again))).otherwise(F.col("node"))
        return frame.join(twice, F.col("node") == F.col("twice"), "left").withColumn("node", anew).drop("twice")

    def add(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("node", first)
        for i, twice in enumerate(met, 1):
            frame = renamed(frame, twice, seed + i)
        return frame

    while True:
        out = add(rows)
        twice = saved(out.groupBy("node").count().where("count > 1").select(F.col("node").alias("twice")), name)
        if twice.isEmpty():
            return out, add
        met.append(twice)
