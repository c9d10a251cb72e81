import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from loglantern.llm import common, graph, minhash


def brute_force(rows):
    """Class of each id: all pairs by weighted Jaccard, links joined. Equal texts too."""
    sets = {}
    for i, text in rows:
        words = re.findall("[^ \t-\r]+", text or "")
        k = min(5, len(words))
        sets[i] = Counter(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if words else Counter()
    n = len(rows)
    df = Counter(s for c in sets.values() for s in c)
    floor = max(minhash.RARE, sum(sum(c.values()) for c in sets.values()) / n / minhash.MAX_FREQUENT)
    idf = {s: math.log1p(1 / max(d / n, floor)) for s, d in df.items()}
    weights = {i: {s: c * idf[s] for s, c in x.items()} for i, x in sets.items()}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    meet = defaultdict(list)
    for i, w in weights.items():
        for s in w:
            meet[s].append(i)
    pairs = {(a, b) for ids in meet.values() for a in ids for b in ids if a < b}
    texts = defaultdict(list)
    for i, text in rows:
        texts[text or ""].append(i)
    links = [(ids[0], i) for ids in texts.values() for i in ids[1:]]
    for a, b in pairs:
        x, y = weights[a], weights[b]
        shared = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
        if shared >= minhash.SIMILARITY * (sum(x.values()) + sum(y.values()) - shared) - 1e-9:
            links.append((a, b))
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}


def test_small_tables(spark, sf_dir):
    docs = minhash.table(spark, sf_dir, "documents").limit(10**6)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_force(rows)
    assert all(r.kept == (r.class_id == r.doc_id) for r in got) and len(got) == len(rows)


def test_chains_and_edges_of_similarity(spark):
    """Neighbours are similar, ends are not; all is one class. Others stay apart."""
    words = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words[20 * i : 20 * i + 300])) for i in range(12)]
    rows += [(100 + i, " ".join([f"x{j}" for j in range(150)] + [f"y{i}.{j}" for j in range(150)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == brute_force(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].class_id == 1 and not by_id[2].kept and by_id[1].kept
    assert by_id[4].class_id == by_id[5].class_id == 4 and by_id[6].class_id == 6
    assert [r.kept for r in rows if r.doc_id == 3] == [True, True]
    assert minhash.near_duplicates(no_docs).count() == 0


def test_samples_follow_similarity():
    rng = np.random.default_rng(1)
    values = rng.integers(1, 2**63, 400, dtype=np.uint64)
    agree = []
    for t in range(60):
        a, b = rng.gamma(2, 2, 400), rng.gamma(2, 2, 400)
        b[:200] = a[:200]
        order = np.argsort(values)
        _, x = minhash.draw_samples(np.zeros(400, int), values[order] + np.uint64(t), a[order])
        _, y = minhash.draw_samples(np.zeros(400, int), values[order] + np.uint64(t), b[order])
        agree.append((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree)) < 0.03


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 202), (202, 200)]
    edges = spark.createDataFrame(path, "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90, 200: 200, 201: 200, 202: 200}
    assert graph.components(edges.where("false")).count() == 0
    star = spark.range(500).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    assert {r.component for r in graph.components(star).collect()} == {0}


def test_many_near_copies_in_small_blocks_and_slices(spark, monkeypatch):
    """A bucket of 300 near copies over many blocks, verified a few pairs at a time."""
    monkeypatch.setattr(minhash, "BLOCK", 20)
    monkeypatch.setattr(minhash, "PAIR_BYTES", 500)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[: 60 + i % 5], f"x{i % 60}", *words[61 + i % 7 :]])) for i in range(300)]
    rows += [(300 + i, " ".join(f"o{i}-{j}" for j in range(40))) for i in range(20)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_force(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("minhash")]


def test_one_bucket_of_texts_that_mostly_fall_short(spark, monkeypatch):
    """Texts that share three fifths meet in buckets, few of them are linked."""
    monkeypatch.setattr(minhash, "BLOCK", 15)
    common_part = " ".join(f"w{i}" for i in range(70))
    rows = [(i, f"{common_part} " + " ".join(f"x{i // 2 if i < 40 else i}-{j}" for j in range(30)) + f" e{i}") for i in range(150)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_force(rows)
    assert {r.doc_id: r.class_id for r in got} == want and len(set(want.values())) == 130


def test_slots_never_hold_less_than_what_is_shared():
    rng = np.random.default_rng(5)
    for size in (1, 30, 300, 5000):
        values = rng.integers(0, 2**63, size, dtype=np.uint64)
        weights = rng.gamma(1, 3, (2, size)) * (rng.random((2, size)) < 0.7)
        row = np.repeat([0, 1], size)
        sums, step = minhash.slot_sums(row, np.tile(values, 2), weights.ravel(), 2)
        room = np.minimum(sums[0] * step[0], sums[1] * step[1]).sum()
        assert room >= np.minimum(*weights).sum() * (1 - 1e-9)


def test_texts_whose_hashes_meet(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(common, "NODE_BITS", 8)
    test_small_tables(spark, sf_dir)


def test_slots_come_to_the_driver_as_bits(spark, monkeypatch):
    """Not as counts, 64 times as large; and the weights are those of exact counts."""
    docs = spark.createDataFrame([(f"a b c d e f{i}",) for i in range(30)] + [("",), (None,)], "text string")
    collect, got = type(docs).collect, []
    monkeypatch.setattr(type(docs), "collect", lambda self: got.append(collect(self)) or got[-1])
    weights = minhash.fit_weights(docs)
    sent = sum(len(x) for rows in got for r in rows for x in r if isinstance(x, (bytes, bytearray)))
    assert sent <= (1 << minhash._SLOT_BITS) // 8
    assert sorted(weights.idf) == sorted([np.log1p(32 / 30)] + [np.log1p(32)] * 30)
    assert not len(minhash.fit_weights(docs.where("false")).hashes)
