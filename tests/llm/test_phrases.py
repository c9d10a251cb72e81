import re
from collections import Counter

import duckdb
import pytest
from oracle import connect, differences

from loglantern.llm import phrases


def brute_force(rows, min_count=30, top=2000):
    """lang, rank, phrase, a, l, r, n, score from (text, lang) rows, counted one by one."""
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            sizes[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    found = {p for p, c in counts.items() if len(p) > 2 and c >= min_count}
    longest = Counter()
    for p in found:
        for i in range(1, len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) - 1:
                    longest[(p[0], *p[i:j])] = max(longest[(p[0], *p[i:j])], counts[p])
    out = []
    for p in found:
        lang, w, a = p[0], p[1:], counts[p]
        if 100 * longest[p] >= 80 * a:
            continue
        score, _, left, right = min(
            (2_000_000 * a // (counts[(lang, *w[:k])] + counts[(lang, *w[k:])]), k, counts[(lang, *w[:k])], counts[(lang, *w[k:])])
            for k in range(1, len(w))
        )
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    out.sort()
    rank, done = Counter(), []
    for lang, score, a, phrase, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            done.append((lang, rank[lang], phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(done)


def tuples(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r.text, r.lang) for r in phrases.table(spark, sf_dir, "documents").collect()]


def test_small_tables(spark, sf_dir, rows):
    frame = phrases.query(spark, sf_dir)
    assert differences(frame, connect(sf_dir), phrases.SQL) == ""
    assert tuples(frame) == brute_force(rows)


@pytest.mark.parametrize(("min_count", "top", "shards"), [(3, 50, 1), (3, 2000, 40), (7, 7, 5)])
def test_other_supports_and_shards(spark, sf_dir, rows, min_count, top, shards):
    frame = phrases.collocations(phrases.table(spark, sf_dir, "documents"), min_count, top, shards)
    assert tuples(frame) == brute_force(rows, min_count, top)


def test_full_bit_tables_and_small_slices_change_nothing(spark, sf_dir, rows, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 10)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 500)
    few = phrases.table(spark, sf_dir, "documents").limit(40)
    assert tuples(phrases.collocations(few, 5)) == brute_force([(r.text, r.lang) for r in few.collect()], 5)


def test_odd_rows(spark, odd_docs, tmp_path):
    odd = phrases.pick(odd_docs, "doc_id", "text", "lang", "source", "node", "bucket")
    more = spark.createDataFrame(
        [
            (None, "A b\tC  d. A b, C d!" * 20, None, "s", "x", 1),
            (20, "a B c d\na b\x0bc d\r\x0c" * 20, "und", "s", "x", 1),
            (21, "Ünï ünï\x00 É É" * 40, "und", "s", "x", 1),
            (22, "a b a b " * 31, "en", "s", "x", 1),
            (22, "a b a b " * 31, "en", "s", "x", 1),
        ],
        odd.schema,
    )
    docs = odd.unionByName(more)
    assert tuples(phrases.collocations(docs)) == brute_force([(r.text, r.lang) for r in docs.collect()])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(phrases.query(spark, str(tmp_path)), connection, phrases.SQL) == ""
    clash = docs.withColumn("n", docs.bucket).withColumn("phrase", docs.lang).withColumn("part", docs.lang)
    assert tuples(phrases.collocations(clash)) == tuples(phrases.collocations(docs))
    assert tuples(phrases.collocations(docs.where("false"))) == []
    assert tuples(phrases.collocations(docs.select("doc_id", docs.lang.alias("text"), "lang").where("lang IS NULL"))) == []
