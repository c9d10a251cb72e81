"""Queries with SQL, against it: on the small tables and on odd rows."""

import duckdb
import pytest
from oracle import connect, differences

from loglantern.llm import chat, lines, quality, substring

MODULES = {"lines": lines, "chat": chat, "substring": substring, "quality": quality}


@pytest.mark.parametrize("name", MODULES)
def test_small_tables(spark, sf_dir, name):
    assert differences(MODULES[name].query(spark, sf_dir), connect(sf_dir), MODULES[name].SQL) == ""


@pytest.mark.parametrize("name", ["lines", "substring", "quality"])
@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_odd_rows(spark, odd_docs, tmp_path, name, kind):
    """Without repeated rows and null ids, which SQL takes for more than one document."""
    rows = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]) if kind == "odd" else odd_docs.where("false")
    rows.drop("bucket").toDF("doc_id", "text", "lang", "source", "x", "node").write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    module = MODULES[name]
    assert differences(module.query(spark, str(tmp_path)), connection, module.SQL) == ""


def test_repeated_rows_are_one_document(spark, odd_docs):
    cut = lines.remove_lines(odd_docs).collect()
    assert len(cut) == odd_docs.count()
    twins = [r for r in cut if r.doc_id == 3]
    assert len(twins) == 2 and twins[0] == twins[1] and twins[0].n_removed == 0
    cut = substring.remove_repeats(odd_docs).collect()
    assert len(cut) == odd_docs.count()
    twins = [r for r in cut if r.doc_id == 3]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert twins[0].n_words == 320 and twins[0].n_removed == 200
    assert [r.n_removed for r in cut if r.doc_id == 10] == [4999]  # only the first word is under no window that starts earlier
    judged = quality.judge(odd_docs).collect()
    assert len(judged) == odd_docs.count() and not any(r.kept for r in judged if r.n_words < 50)


def test_substring_in_small_batches(spark, sf_dir):
    """Anchors that reach over many batches, and folds inside them, change nothing."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r.doc_id: tuple(r) for r in substring.query(spark, sf_dir).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.doc_id: tuple(r) for r in substring.query(spark, sf_dir).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
