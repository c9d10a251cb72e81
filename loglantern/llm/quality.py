"""Operator 10: quality rules judged by document and by host.

Every document is measured by built-in functions over its whole text. The host (here
the source) of the documents gets its rate of failures, shrunk towards the rate of all
hosts by a beta prior fitted to them, and its verdict is joined back to its documents.

Defined cases: a null text has no words and fails; a null source is a host of its own;
repeated rows each get a row; of no rows come none; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglantern.llm.common import SPACE, pick, saved, table, words

MIN_WORDS = 50
MAX_REPEATED = 0.5
SYMBOLS = "#*$%&|<>"
MAX_HOST_RATE = 0.5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    """The text without these ASCII characters, one fast byte search each."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _grams(w: Column, room: Column) -> Column:
    """One sorted number for each three-word window. Above ``room``, the least power of
    two over the number of words, it hashes the words; below it is the place."""
    hashed = F.lit(2**63 - 1).bitwiseAND(-room)

    def gram(word: Column, i: Column) -> Column:
        return F.xxhash64(word, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(hashed).bitwiseOR(i)

    return F.sort_array(F.transform(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 2)), gram))


def _repeated_places(grams: Column, room: Column) -> Column:
    """Sorted places of the windows whose words stand twice or more in the text."""

    def same(x: Column, i: Column) -> Column:
        return x.bitwiseXOR(F.get(grams, i)) < room

    twice = F.filter(grams, lambda x, i: same(x, i - 1) | same(x, i + 1))
    return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(room - 1)))


def _covered(places: Column) -> Column:
    """Words under the three-word windows that start at these places."""
    gaps = F.transform(places, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(places, i + 1) - p, F.lit(3).cast("long"))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The frame with ``MEASURES`` in place of its text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    symbols = F.octet_length(t) - F.octet_length(_without(t, SYMBOLS))
    counted = docs.withColumn("_w", words(F.col(text))).withColumn("_lines", lines).select(
        *(c for c in docs.columns if c != text),
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(_without(t, SPACE)).cast("long").alias("word_chars"),
        F.when(t.rlike("[#*$%&|<>]"), symbols).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size("_w") + 1)).cast("int")).alias("_room"),
    )
    room = F.col("_room")
    return (
        counted.withColumn("_grams", _grams(F.col("_w"), room))
        .withColumn("_places", _repeated_places(F.col("_grams"), room))
        .withColumn("n_repeat_words", _covered(F.col("_places")))
        .drop("_w", "_room", "_grams", "_places")
    )


def fails(min_words: int = MIN_WORDS, max_repeated: float = MAX_REPEATED) -> Column:
    """The rules on one document: too few words, or too many in repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_repeated) * F.col("n_words"))


def host_rates(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """Per host: documents, failures, and the rate of failures under a beta prior.

    The prior's mean is the rate over all documents; its strength comes from how far
    the hosts differ beyond chance (moments over all hosts, summed up in one row). Equal
    hosts give a strong prior, very different ones a weak one, at least one document's.
    """
    hosts = judged.groupBy(host).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col(failed).cast("long")).alias("failures"))
    d, f = F.col("docs"), F.col("failures")
    n, x, k, nn, xx = hosts.agg(F.sum(d), F.sum(f), F.count(d), F.sum(d.cast("double") * d), F.sum(f.cast("double") * f / d)).first()
    mean, strength = _prior(n or 0, x or 0, k, nn or 0.0, xx or 0.0)
    return hosts.select(host, "docs", "failures", ((f + mean * strength) / (d + strength)).alias("rate"))


def _prior(n: int, x: int, k: int, nn: float, xx: float) -> tuple[float, float]:
    """Mean and strength from the sums of n, x, n * n and x * x / n over k hosts."""
    mean = x / n if n else 0.0
    chance = mean * (1 - mean)
    if k < 2 or chance == 0 or n * n == nn:
        return mean, 1.0
    # the weighed squares hold chance * (k - 1) + between * (n - nn / n), nearly
    between = (xx - mean * mean * n - chance * (k - 1)) / (n - nn / n)
    return mean, min(1e6, max(1.0, chance / between - 1)) if between > 0 else 1e6


def judge(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: doc_id, host, measures, base_failed, host_rate, kept.

    A document is kept if it passes the rules itself and its host's shrunk rate of
    failures is at most ``max_host_rate``. The measures, a few numbers per row, are
    written once and read for the rates and for the verdicts.
    """
    measured = saved(measure(pick(docs, "doc_id", host, "text")).withColumn("base_failed", fails()), "quality")
    rates = host_rates(measured.select(F.col(host).alias("_host"), "base_failed"), "_host", "base_failed")
    joined = measured.join(rates.select("_host", F.col("rate").alias("host_rate")), F.col(host).eqNullSafe(F.col("_host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)).drop("_host")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_FIELDS = "[^\\x20\\x09-\\x0D]+"

SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_FIELDS}') AS w
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), p AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM p, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_FIELDS}') GROUP BY doc_id
), m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {round(100 * MAX_REPEATED)} * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS docs, sum(CAST(base_failed AS BIGINT)) AS failures FROM b GROUP BY source
), s AS (
  SELECT sum(docs) AS n, sum(failures) / sum(docs) AS mean, count(*) AS k, sum(docs * docs) AS nn,
         sum(failures * failures / docs) AS xx FROM h
), v AS (
  SELECT mean, k, n, nn, mean * (1 - mean) AS chance,
         CASE WHEN n * n <> nn THEN (xx - mean * mean * n - mean * (1 - mean) * (k - 1)) / (n - nn / n) END AS between_
  FROM s
), q AS (
  SELECT mean, CASE WHEN k < 2 OR chance = 0 OR n * n = nn THEN 1.0 WHEN between_ <= 0 THEN 1e6
                    ELSE least(1e6, greatest(1.0, chance / between_ - 1)) END AS strength FROM v
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (failures + mean * strength) / (docs + strength) <= {MAX_HOST_RATE} AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source, q
"""
