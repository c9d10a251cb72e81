import numpy as np
import pytest

from loglantern.llm import common, vectors


def brute_force(rows, cosine=vectors.COSINE):
    """n_links and component of each row (positions, for ids may repeat)."""
    units = []
    for _, e in rows:
        v = None if e is None else np.array([np.nan if c is None else c for c in e], float)
        ok = v is not None and len(v) and np.isfinite(v).all() and np.abs(v).max() > 0
        units.append(v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) if ok else None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(n)]
    label = [r[0] for r in rows]
    for _ in range(n):
        now = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
        if now == label:
            break
        label = now
    return [(rows[i][0], len(links[i]), label[i], label[i] == rows[i][0]) for i in range(n)]


def as_tuples(frame):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in frame.collect())


def test_small_tables(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in vectors.pick(vectors.table(spark, sf_dir, "embeddings"), "vec_id", "embedding").collect()]
    assert as_tuples(vectors.query(spark, sf_dir)) == sorted(brute_force(rows))


def test_dense_groups_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for size, noise in ((90, 0.2), (40, 0.25), (5, 0.1), (60, 0.3)):
        centre = rng.normal(size=24)
        for _ in range(size):
            rows.append((i, [float(x) for x in centre + noise * rng.normal(size=24)]))
            i += 1
    rows += [(i + k, [float(x) for x in rng.normal(size=24)]) for k in range(150)]
    monkeypatch.setattr(vectors, "BLOCK", 40)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = vectors.near_vectors(frame).collect()
    want = {r[0]: r for r in brute_force(rows)}
    found, true = sum(r.n_links for r in out), sum(w[1] for w in want.values())
    assert 0.97 * true <= found <= true and out[0].recall >= vectors.RECALL
    same = sum(r.component_id == want[r.vec_id][2] for r in out)
    assert same >= 0.97 * len(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, None), (8, []),
        (9, [1.0, 0.0, 0.0]), (10, [1e-300, 1e-301]), (11, [1e300, -1e300]), (12, [1.0, None]), (13, [0.9, 0.43588989435]), (14, [0.0, 1.0]),
    ]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    assert as_tuples(vectors.near_vectors(frame)) == sorted(brute_force(rows))
    assert vectors.near_vectors(frame.where("false")).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert as_tuples(vectors.near_vectors(twice)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    nameless = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert sorted((r.n_links, r.component_id) for r in vectors.near_vectors(nameless).collect()) == [(1, 4), (1, 4)]


def test_lost_small_groups_fail_beside_a_dense_one(spark, monkeypatch):
    """The links of a dense group are nearly all there are: a search that finds no other
    must not pass."""
    rng = np.random.default_rng(7)
    rows = [(i, [1.0] + [float(x) for x in 0.02 * rng.normal(size=15)]) for i in range(60)]
    for i in range(100, 140, 2):
        x = rng.normal(size=16)
        rows += [(i, [float(v) for v in x]), (i + 1, [float(v) for v in x + 0.01 * rng.normal(size=16)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert vectors.near_vectors(frame).first().recall >= vectors.RECALL
    whole = vectors.link
    monkeypatch.setattr(vectors, "link", lambda *args: whole(*args).where("links > 1"))
    with pytest.raises(RuntimeError, match="audited links"):
        vectors.near_vectors(frame)


def test_recall_is_a_column_of_the_query(spark, sf_dir):
    out = vectors.query(spark, sf_dir)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept", "recall"] and out.first().recall >= vectors.LEAST_RECALL


def test_vectors_without_or_with_one_id_stay_apart(spark):
    rows = [
        (None, [1.0, 0.0]), (None, [0.0, 1.0]), (4, [1.0, 0.1]), (5, [0.1, 1.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.1]),
        (7, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0]), (8, [0.1, 1.0, 0.0]), (9, [0.0, 0.0, 1.0]), (None, None),
    ]
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    named = sorted(tuple(r)[:4] for r in out if r.vec_id is not None)
    assert named == [(4, 1, 4, True), (5, 1, 5, True), (7, 0, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True)]
    nameless = sorted((r.n_links, r.component_id or 0, r.kept) for r in out if r.vec_id is None)
    assert nameless == [(0, 0, True), (1, 0, False), (1, 0, True), (1, 4, False), (1, 5, False)]


def test_every_length_is_searched(spark, monkeypatch):
    """More lengths than 64, some of them larger than a block, each with near vectors."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(vectors, "BLOCK", 20)
    rows = []
    for length in [*range(2, 70), *[80] * 20, *[90] * 10]:
        x = rng.normal(size=length)
        for noise in (0, 0.05, 0.1):
            rows.append((len(rows), [float(v) for v in x + noise * rng.normal(size=length)]))
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert as_tuples(out) == sorted(brute_force(rows))


def test_pruned_graph_is_searchable():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = vectors.build_graph(x)
    graph = vectors._padded(lists)
    found = vectors.range_search(x, graph, np.arange(300), np.array([0]), 0.6)
    true = x @ x.T >= 0.6
    assert (found & true).sum() >= 0.97 * true.sum() and not (found & ~true).any()
    assert all(i in lists[j] for i in range(300) for j in lists[i])


@pytest.mark.parametrize("n", [1, 2, 3])
def test_tiny_blocks(n):
    lists = vectors.build_graph(np.eye(4)[:n])
    assert len(lists) == n and all(len(g) <= n - 1 for g in lists)


def test_vectors_whose_hashes_meet(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(common, "NODE_BITS", 8)
    test_small_tables(spark, sf_dir)
