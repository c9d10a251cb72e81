import ast
from pathlib import Path

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from loglantern.llm import language, lines, minhash, mixing
from loglantern.llm.common import saved, table

ROOT = Path(__file__).resolve().parents[2]


def test_stages_in_order():
    assert [name for name, _ in cp.STAGES] == ["language", "lines", "minhash", "mix", "encode"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What goes into each stage, and what comes out of the last."""
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in cp.STAGES:
        out.append(docs)
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return [*out, docs]


def test_columns(stages):
    kinds = stages[0].dtypes
    assert all(s.dtypes == kinds for s in stages[:5])


def test_each_stage_does_what_its_operator_says(spark, sf_dir, stages):
    raw, told, cut, single, mixed, encoded = stages
    langs = {r.doc_id: r for r in language.identify(raw).collect()}
    assert {r.doc_id: r.lang for r in told.collect()} == {i: r.lang_pred for i, r in langs.items() if r.lang_pred != "und" and r.score >= cp.MIN_LANGUAGE_SCORE}
    removed = {r.doc_id: r for r in lines.remove_lines(told).collect()}
    texts = {r.doc_id: r.text for r in told.collect()}
    want = {i: r.kept_text if r.n_removed else texts[i] for i, r in removed.items()}
    assert {r.doc_id: r.text for r in cut.collect()} == {i: t for i, t in want.items() if t.strip(" \t\n\r\x0b\x0c") or not removed[i].n_removed}
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(cut).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    taken = {r.doc_id: r.taken for r in mixing.taken_words(mixing.place_documents(single), mixing.mix_sources(mixing.place_documents(single))).collect()}
    words = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {i: n for i, n in taken.items() if n}
    assert encoded.count() == mixed.count()
    assert encoded.select("decoded_sha256").exceptAll(mixed.select(F.sha2("text", 256))).isEmpty()


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert cp.run(spark, sf_dir).exceptAll(stages[-1]).isEmpty() and cp.run(spark, sf_dir).count() == stages[-1].count()


def test_odd_and_no_documents(spark, odd_docs):
    docs = odd_docs.drop("bucket").withColumn("n_chars", F.length(F.lit("x")).cast("long"))
    for rows in (docs, docs.where("false")):
        for _, stage in cp.STAGES:
            rows = saved(stage(spark, rows, ""), "stage")
        assert rows.columns[:2] == ["doc_id", "n_tokens"]


def test_near_copies_under_null_and_repeated_ids(spark):
    """Of each class one row is left, and no text goes for another that shares its id."""
    words = [f"w{i}" for i in range(900)]
    a, b, c, d = (" ".join(words[i : i + 200]) for i in (0, 210, 420, 630))
    rows = [
        (None, a + " x"), (None, a + " y"), (None, a + " y"), (5, b), (None, b + " x"), (None, b),
        (7, c), (7, d), (6, c + " x"), (8, d + " x"), (9, "lone words"), (9, c + " y z"), (10, None), (None, "few"), (None, "words"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in cp.remove_near_duplicates(spark, docs, "").collect()]
    first = [t for i, t in left if i is None and (t or "").startswith("w0 ")]
    assert len(first) == 1 and first[0] in (a + " x", a + " y")
    rest = [x for x in left if x[1] != first[0]]
    want = [(5, b), (6, c + " x"), (7, d), (9, "lone words"), (10, None), (None, "few"), (None, "words")]
    assert sorted(rest, key=str) == sorted(want, key=str)


def test_nothing_else_imports_the_folder():
    for file in (ROOT / "loglantern").rglob("*.py"):
        if "llm" in file.parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("loglantern.llm", "corpus_pipeline")) for n in names), file


def test_thirteen_operators_are_registered():
    from loglantern.llm.queries import ORACLES, QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
