"""A skip index for message search: which three-letter runs the messages of a file hold.

Each file of a part gets a bit set of the hashed runs of its messages, as rows of up to
32,768 bits. A file can hold a searched text only if all bits of the text's runs are set;
others are not read. Bits may be set by other runs, so what is read is still searched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3
# Positions of hashed runs. A file has at most so many bits, 128 KB, and one row of the
# index for each 32,768 of them.
POSITIONS = 1 << 20

GRAM_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("ingest_date", T.DateType()),
        T.StructField("part", T.StringType()),
    ]
)


def gram_positions(text: Column) -> Column:
    """Positions (from 1) of the runs of a text, each once. The case of ASCII letters, and
    only of these, is folded, as the search does."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    letters = F.split(folded, "")
    follow = [F.slice(letters, n, F.greatest(F.size(letters), F.lit(1))) for n in range(2, GRAM + 1)]
    runs = letters
    for later in follow:  # null where no letter follows
        runs = F.zip_with(runs, later, lambda run, letter: F.concat(run, letter))
    whole = F.array_distinct(F.filter(runs, lambda run: run.isNotNull()))
    return F.transform(whole, lambda run: F.pmod(F.xxhash64(run), F.lit(POSITIONS)) + 1)


def index_files(rows: DataFrame, *by: str) -> DataFrame:
    """The index of the files that ``rows`` are read from, with their columns ``by``.

    Positions are made distinct before they are gathered, first in each task, so a file
    sends at most ``POSITIONS`` narrow rows however many messages it has.
    """
    runs = rows.select(*by, F.col("_metadata.file_name").alias("file"), F.explode(gram_positions(F.col("message"))).alias("at"))
    sets = runs.distinct().groupBy("file", F.bitmap_bucket_number("at").alias("bucket"), *by)
    return sets.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).select(*GRAM_SCHEMA.names)


def searched_positions(spark: SparkSession, text: str) -> list[tuple[int, int]]:
    """Rows of the index and bits in them that a text needs; wildcards part it into runs
    that are looked up by themselves. Empty when no run is long enough."""
    pieces = [piece for piece in re.split("[%_]", text) if len(piece) >= GRAM]
    if not pieces:
        return []
    at = F.array_distinct(F.flatten(F.array(*(gram_positions(F.lit(piece)) for piece in pieces))))
    needed = spark.range(1).select(F.explode(at).alias("at"))
    return [tuple(r) for r in needed.select(F.bitmap_bucket_number("at"), F.bitmap_bit_position("at")).collect()]


def files_with(index: DataFrame, needed: list[tuple[int, int]]) -> DataFrame:
    """The files whose bits are all set."""
    by_row: dict[int, list[int]] = {}
    for bucket, bit in needed:
        by_row.setdefault(bucket, []).append(bit)

    def is_set(bit: int) -> Column:
        byte = F.conv(F.hex(F.substring("bits", bit // 8 + 1, 1)), 16, 10).cast("int")
        return byte.bitwiseAND(F.lit(1 << bit % 8)) != 0

    holds = F.lit(False)
    for bucket, bits in by_row.items():
        every = F.lit(True)
        for bit in bits:
            every = every & is_set(bit)
        holds = holds | ((F.col("bucket") == bucket) & every)
    hits = index.where(F.col("bucket").isin(list(by_row)) & holds).groupBy("ingest_date", "part", "file").count()
    return hits.where(F.col("count") == len(by_row)).select("ingest_date", "part", "file")
