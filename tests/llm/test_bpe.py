import hashlib

import pytest

from loglantern.llm import bpe

ODD = [
    None, "", " ", "  a  b\n\n c\t\td ", "it's we'll I'VE don't''s", "!!<|endoftext|>x  <|endoftext|>", "<|endoftext|>",
    "a b　c\u0085d\x1ce\x1ff", "日本語 テキスト १२३ ²½ Ⅷ", "🙂👩‍👩‍👧 é ​﻿ x", "a" * 5000, "\r\n\r\n x\x0b\x0cy\x00z", "it's again again again",
]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield (
            len(ids),
            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
        )


def test_as_the_library(spark, sf_dir):
    rows = {r.doc_id: r.text for r in bpe.table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in bpe.query(spark, sf_dir).collect()}
    assert got == dict(zip(rows, library(rows.values())))


@pytest.mark.parametrize("table_words", [0, 3, bpe.TABLE_WORDS])
def test_odd_texts(spark, table_words):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, TEXT string")
    rows = sorted(bpe.encode(frame, table_words=table_words).collect())
    want = list(library(ODD))
    assert [hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in rows] == [w[1] for w in want]
    assert bpe.word_table(frame, bpe.tokenizer_path(), table_words).count() <= table_words


def test_rows_stay(spark, odd_docs, no_docs):
    assert bpe.digests(odd_docs).count() == odd_docs.count()
    assert bpe.digests(no_docs).count() == 0


def test_broken_ids_decode_to_replacements(spark):
    ids = [r.ids for r in bpe.encode(spark.createDataFrame([(1, "日本")], "doc_id long, text string")).collect()][0]
    cut = spark.createDataFrame([(1, ids[:-1])], "doc_id long, ids array<int>")
    assert "�" in bpe.decode(cut).first().text
