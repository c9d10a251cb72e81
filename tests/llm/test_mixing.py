import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loglantern.llm import mixing


def fair_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, the excess over the caps shared again until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        left = [s for s in order if s not in capped]
        room = total - sum(capped.values())
        level = room / sum(weight[s] for s in left) if left else 0
        over = [s for s in left if level * weight[s] > most * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in order}
        capped.update({s: float(most * sizes[s]) for s in over})


def test_mix_of_small_tables(spark, sf_dir):
    rows = mixing.query(spark, sf_dir).collect()
    sizes = Counter()
    taken = Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = fair_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.query(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_targets_with_caps(spark):
    sizes = {"a": 1000, "b": 3, "c": 40, None: 7, "é": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.recipe(frame).collect()}
    assert got == {s: pytest.approx(t) for s, t in fair_targets(sizes).items()}


def test_tree_keeps_quotas_and_law(spark):
    quotas = {0: 700, 1: 200, 2: 100}
    frame = spark.createDataFrame(list(quotas.items()), "src int, n long")
    lefts = []
    for seed in range(24):
        rows = mixing.split_quotas(frame, 2, seed).collect()
        ranges = defaultdict(list)
        for r in rows:
            ranges[r.src].append((r["first"], r["first"] + r.n))
        for src, n in quotas.items():
            parts = sorted(ranges[src])
            assert parts[0][0] == 0 and parts[-1][1] == n
            assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert all(sum(r.n for r in rows if r.shard == s) == 250 for s in range(4))
        lefts.append(sum(r.n for r in rows if r.src == 1 and r.shard < 2))
    mean = sum(lefts) / len(lefts)
    spread = math.sqrt(sum((x - mean) ** 2 for x in lefts) / len(lefts))
    law = math.sqrt(500 * 0.2 * 0.8 * 500 / 999)
    assert abs(mean - 100) < 4 * law / math.sqrt(24) and 0.6 * law < spread < 1.5 * law


def test_odd_rows_and_slices(spark, odd_docs, no_docs):
    placed = mixing.place_documents(odd_docs).cache()
    slices = mixing.mix_sources(placed, block_words=64, shard_words=1000).cache()
    rows = mixing.taken_words(placed, slices).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken == 0 for r in rows if not r["size"])
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    # slices of one pass never overlap
    seen = Counter((r.src, r["pass"], r.start + i) for r in slices.collect() for i in range(r.first_word, r.first_word + r.n_words))
    assert set(seen.values()) == {1}
    assert slices.select("shard").distinct().count() > 1
    assert mixing.taken_words(mixing.place_documents(no_docs), mixing.mix_sources(mixing.place_documents(no_docs))).count() == 0


def test_mixed_texts(spark):
    texts = [(1, "  one two\nthree\tfour  ", "en", "a"), (2, "five six", "en", "b"), (3, None, None, "c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text"))
    placed = mixing.place_documents(docs)
    slices = mixing.mix_sources(placed, block_words=1)
    mixed = mixing.mixed_documents(docs, slices).collect()
    taken = {r.doc_id: r.taken for r in mixing.taken_words(placed, slices).collect()}
    words = Counter()
    for r in mixed:
        assert r.text in texts[r.doc_id - 1][1] and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    assert {1: words[1], 2: words[2], 3: 0} == taken


def test_mixed_texts_are_shuffled_once(spark):
    """Neither a second time for the join, nor cut in words, which takes three times the room."""
    docs = spark.createDataFrame([(1, "one two three", "en", "a"), (2, "four", "en", "b")], "doc_id long, text string, lang string, source string")
    slices = mixing.mix_sources(mixing.place_documents(docs))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plans = [mixing.mixed_documents(docs, slices)._jdf.queryExecution().executedPlan().executedPlan()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    sent = []
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "Exchange":
            sent.append(plan.schema().catalogString())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    assert sum(s.count(":string") >= 3 for s in sent) == 1  # text, lang and source
    assert not any("array<string>" in s for s in sent)


def test_mixed_rows_of_null_and_zero_ids(spark):
    """A null id is none of the ids, and each reading of a document is a row of its own."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, "en", "a"), (0, text, "fr", "b"), (0, "  x y\n", "de", "b"), (None, "x\ty", "es", "c"), (7, "\n", "en", "c"), (8, None, "en", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    placed = mixing.place_documents(docs)
    for block_words in (3, 4096):
        slices = mixing.mix_sources(placed, block_words=block_words)
        got = mixing.mixed_documents(docs, slices).collect()
        whole = {(i, lang): t for i, t, lang, _ in rows}
        want, words = Counter(), Counter()
        for r in slices.collect():
            want[(r.doc_id, r.tkey)] += r.n_words
        for r in got:
            assert r.text in whole[(r.doc_id, r.lang)] and r.n_chars == len(r.text)
            words[(r.doc_id, r.lang)] += len(r.text.split())
        assert sorted(want.values()) == sorted(words.values()) and sum(words.values()) == 84
        assert all(r.source == {(i, lang): s for i, _, lang, s in rows}[(r.doc_id, r.lang)] for r in got)
