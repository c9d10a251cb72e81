import zlib

from pyspark.sql import functions as F

from loglantern.llm import language


def test_held_out_accuracy(spark):
    docs = language.table(spark, "/root/testdata/sf0.01", "documents")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = language.table(spark, "/root/testdata/sf0.001", "documents")
    spoiled = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    want = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spoiled).collect()} == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id in (4, 5, 6):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language.identify(no_docs).count() == 0


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "hello", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {tuple(r)[2:] for r in language.identify(rows).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, f"hello {i}", "en") for i in range(8)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(one).collect()} == {"en"}
