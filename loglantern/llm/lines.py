"""Operator 2: removing repeated lines by overlapping three-line windows.

Three lines in a row are a window, known by 128 bits of hash. A window that stands again
(in a document with a larger doc_id, or further down in the same one) is a later
occurrence; the lines under later occurrences go. Windows are judged on the input. Counts
and first places come from a partial and a final aggregate, so a window that stands in a
third of all documents sends one row per task; the join that finds its later occurrences
meets one row per window and is split by Spark where a window is skewed.

Defined cases: lines end at a line feed; a null text has no lines, an empty one a single
empty line; texts under three lines stay; windows of blank lines only do not count; ties of
doc_id are ordered by a hash of the text, and rows equal in both are one document, cut
alike; a null doc_id comes first; of no rows come none; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm.common import SPACE, pick, table, text_key

WINDOW = 3


def _windows(lines: Column) -> Column:
    """(h1, h2) of each window in order; null where all its lines are blank."""

    def window(line: Column, i: Column) -> Column:
        three = [line, F.get(lines, i + 1), F.get(lines, i + 2)]
        hashes = F.struct(F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(1), *reversed(three)).alias("h2"))
        return F.when(F.btrim(F.concat(*three), F.lit(SPACE)) != "", hashes)

    return F.transform(F.slice(lines, 1, F.greatest(F.lit(0), F.size(lines) - (WINDOW - 1))), window)


def _spans(places: Column) -> Column:
    """Sorted places of windows merged to spans (first, past) of lines."""
    opens = F.filter(places, lambda p, i: F.coalesce(p - F.get(places, i - 1) > WINDOW, F.lit(True)))
    closes = F.filter(places, lambda p, i: F.coalesce(F.get(places, i + 1) - p > WINDOW, F.lit(True)))
    return F.zip_with(opens, closes, lambda a, z: F.struct(a.alias("first"), (z + WINDOW).alias("past")))


def _outside(lines: Column, spans: Column) -> Column:
    """The lines between the spans."""

    def gap(k: Column) -> Column:
        begin = F.coalesce(F.get(spans, k - 1)["past"], F.lit(0))
        end = F.coalesce(F.get(spans, k)["first"], F.size(lines))
        return F.slice(lines, begin + 1, end - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), gap))


def remove_lines(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, n_lines, spans of removed lines, n_removed and kept_text of each row."""
    keyed = pick(docs, "doc_id", "text").withColumn("tkey", text_key(F.col("text")))
    windows = (
        keyed.withColumn("lines", F.split("text", "\n"))
        .where(F.size("lines") >= WINDOW)
        .select("doc_id", "tkey", F.posexplode(_windows(F.col("lines"))).alias("place", "w"))
        .where(F.col("w").isNotNull())
        .select("w.h1", "w.h2", F.struct("doc_id", "tkey", "place").alias("at"))
    )
    firsts = windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(firsts, ["h1", "h2"]).where(~F.col("at").eqNullSafe(F.col("first")))
    places = later.groupBy(F.col("at.doc_id").alias("d"), F.col("at.tkey").alias("k")).agg(F.sort_array(F.collect_set("at.place")).alias("places"))
    joined = keyed.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")), "left")
    lines = F.when(F.col("text").isNotNull(), F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    found = joined.select("doc_id", "tkey", lines.alias("lines"), _spans(F.coalesce("places", F.array().cast("array<int>"))).alias("spans"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["past"] - x["first"])
    return found.select(
        "doc_id",
        "tkey",
        F.size("lines").cast("long").alias("n_lines"),
        "spans",
        removed.alias("n_removed"),
        F.array_join(_outside(F.col("lines"), F.col("spans")), "\n").alias("kept_text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents
), w AS (
  SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS g
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM w
  WHERE regexp_matches(g, '[^\\x20\\x09-\\x0D]')
), g AS (
  SELECT doc_id, list(DISTINCT i + k) AS gone FROM r, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(l, lambda v, j: gone IS NULL OR NOT list_contains(gone, j)), chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
