"""From raw documents to token ids in five stages, each an operator of loglantern.llm.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last have the
columns of documents. ``run`` writes what each stage gives to the shared folder and reads
it again for the next, so a lost executor costs one stage's task, not the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm import bpe, language, lines, minhash, mixing
from loglantern.llm.common import SPACE, pick, saved, table, text_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Below this the machines do not know the language at all; clean texts score above.
MIN_LANGUAGE_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; ``lang`` becomes the predicted one."""
    rows = pick(docs, *COLUMNS)
    model = language.fit(rows.where(~language.held_out(F.col("doc_id"))))
    told = language.predict(rows.withColumn("whole", F.col("text")), model)
    kept = told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select("doc_id", F.col("whole").alias("text"), F.col("lang_pred").alias("lang"), "source", "n_chars")


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line windows; what has no word left then goes.

    A document of which nothing is removed stays as it is, whatever is in it.
    """
    rows = pick(docs, *COLUMNS)
    cut = lines.remove_lines(rows.select("doc_id", "text")).where("n_removed > 0").dropDuplicates(["doc_id", "tkey"])
    cut = cut.select(F.col("doc_id").alias("d"), F.col("tkey").alias("k"), "kept_text")
    joined = rows.join(cut, F.col("doc_id").eqNullSafe(F.col("d")) & (text_key(F.col("text")) == F.col("k")), "left")
    whole = F.col("kept_text").isNull()
    text = F.coalesce("kept_text", "text")
    left = joined.where(whole | (F.btrim("kept_text", F.lit(SPACE)) != ""))
    return left.select("doc_id", text.alias("text"), "lang", "source", F.when(whole, F.col("n_chars")).otherwise(F.char_length("kept_text")).cast("long").alias("n_chars"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest doc_id. Rows
    are told apart by id and text, for ids may be null or shared."""
    rows = pick(docs, *COLUMNS)
    gone = minhash.near_duplicates(rows).where("NOT kept").select(F.col("doc_id").alias("d"), F.col("tkey").alias("k")).distinct()
    left = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (minhash.body_key(F.col("text")) == F.col("k")), "left_anti")
    return left.dropDuplicates(["doc_id", "text"])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix reads them: some not at all, some in part, some repeatedly."""
    placed = saved(mixing.place_documents(docs), "mix-placed")
    return mixing.mixed_documents(docs, mixing.mix_sources(placed))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix, with the digests of ids and decoded text."""
    return bpe.digests(docs)


STAGES = [
    ("language", identify_language),
    ("lines", remove_lines),
    ("minhash", remove_near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

ORACLE_SQL = None  # the machines of the first stage are trained


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
