"""Time series of entry counts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.functions.times import HOUR, bucket_label, check_width, time_bucket
from loglantern.operators.aggregates import WEIGHT, tally

MINUTE = timedelta(minutes=1)


def time_series(entries: DataFrame, width: timedelta = HOUR, aligned: bool = False) -> DataFrame:
    """``time, count, label`` per non-empty bucket, oldest first.

    Buckets that do not divide the hour are added up from the counts by minute.
    """
    check_width(width)
    rows = entries.where(F.col("ts").isNotNull()).select("ts", *[c for c in (WEIGHT,) if c in entries.columns])
    count = tally(rows)
    if not aligned and width < HOUR and 60 % (width // MINUTE):
        rows = rows.groupBy(time_bucket(F.col("ts"), MINUTE).alias("ts")).agg(count.alias("n"))
        count = F.sum("n")
    return (
        rows.groupBy(time_bucket(F.col("ts"), width, aligned).alias("time"))
        .agg(count.alias("count"))
        .withColumn("label", bucket_label(F.col("time"), width))
        .orderBy("time")
    )
