"""Operator 3: near-duplicate embeddings by a robust-pruned flat graph.

Unit vectors fall into overlapping shards: each belongs to its ``OVERLAP`` nearest of the
centroids, which are fitted on a bounded sample, for each length of vectors. A length that
has a block of vectors at most, or too few for the sample, is a shard. A shard larger than ``BLOCK`` is cut in
blocks. Each block builds a graph of its own: the nearest neighbours of a vector, pruned so
that no neighbour lies much nearer to another one kept, and the edges back. The adjacency
lists that a vector has in its blocks are united. Then every two blocks of a shard are
searched: from the other block's medoid each vector walks greedily along the united lists
towards itself, and from all that is near enough the search goes on to their neighbours,
as far as the range reaches. What is found is verified by the cosine in double precision.

Pairs are not expanded across tasks: a task counts its links and sends one edge per vector
to a spanning tree of what it linked. A pair that shares two shards counts in the first.
The recall of the search is audited on vectors picked by hash, against all rows: ``AUDIT``
of them, and more until enough groups are among those with links. It is the mean over these
vectors or, if lower, the mean over their groups, so neither a dense group nor many small
ones hide what the others miss. Below ``RECALL`` the overlap grows and the search is run
again; below ``LEAST_RECALL`` at the last overlap the query fails. The recall is a column of
the result, null where no audited vector has a link but not all were audited.

Exact copies are folded first: they are one node of the graph with a weight. A node is
named by a hash of its content; ids only name components, at the end.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing, nor do vectors of other lengths with each other; rows with one vec_id
count as a vector each and share a component; a null vec_id gets a row, is a vector of its
own and has no component to name but that of its links, and where these are null too, one
vector of them is kept; ties do not matter; of no rows come none; labels and other columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm.common import name_nodes, pick, saved, table
from loglantern.llm.graph import components

COSINE = 0.9
BLOCK = 600
OVERLAP = 2
MAX_OVERLAP = 8
SAMPLE = 20_000  # vectors that centroids are fitted on, and
MAX_CENTROIDS = 2048  # at most so many: what every task holds
NEIGHBOURS, POOL, ALPHA, BEAM = 16, 48, 1.2, 24
AUDIT, MAX_AUDIT, GROUPS = 200, 3200, 50  # vectors audited at first, at most, and groups wanted
RECALL, LEAST_RECALL = 0.95, 0.9  # what is aimed at, and below which there is no result
SEED = 3

_LINKS = "node long, links long, others long, tree long"


# --- centroids ------------------------------------------------------------------------


def _share(*columns: str) -> F.Column:
    return F.pmod(F.xxhash64(*columns, F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit_centroids(nodes: DataFrame) -> dict[int, np.ndarray]:
    """About one centroid for each ``BLOCK`` / 2 vectors of a length (in bytes), from a
    bounded sample; the lengths share ``MAX_CENTROIDS`` by their numbers of vectors."""
    sizes = nodes.groupBy(F.length("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    counts = {r["size"]: r.n for r in sizes.orderBy(F.desc("n"), "size").limit(MAX_CENTROIDS).collect()}
    total = sum(counts.values())
    if not counts:
        return {}
    large = nodes.where(F.length("v").isin(list(counts)))
    drawn = large.where(_share("node") < SAMPLE / total).select("node", "v").orderBy("node").limit(2 * SAMPLE).collect()
    by_size: dict[int, list[bytes]] = {}
    for r in drawn:
        by_size.setdefault(len(r.v), []).append(r.v)
    return {size: _means(_matrix(v), counts[size], MAX_CENTROIDS * counts[size] // total) for size, v in by_size.items() if MAX_CENTROIDS * counts[size] >= total}


def _means(x: np.ndarray, n: int, most: int) -> np.ndarray:
    k = int(min(most, max(1, 2 * n // BLOCK), len(x)))
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        nearest = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


# --- a graph in one block ----------------------------------------------------------------


def robust_prune(sims: np.ndarray, pool: np.ndarray, degree: int = NEIGHBOURS, alpha: float = ALPHA) -> np.ndarray:
    """For each row, at most ``degree`` of its pool (nearest first; -1 is none).

    The nearest is kept and those that lie nearer to it, by ``alpha``, than to the row are
    passed over; then the next. All rows take a step at once.
    """
    n, width = pool.shape
    rows = np.arange(n)
    own = np.where(pool >= 0, np.sqrt(np.maximum(0, 2 - 2 * sims[rows[:, None], pool])), np.inf)
    alive, kept = pool >= 0, np.full((n, degree), -1)
    for d in range(degree):
        has = alive.any(1)
        pick_ = np.argmax(alive, axis=1)
        chosen = np.where(has, pool[rows, pick_], -1)
        kept[:, d] = chosen
        between = np.sqrt(np.maximum(0, 2 - 2 * sims[np.maximum(chosen, 0)[:, None], np.maximum(pool, 0)]))
        alive &= ~(has[:, None] & (alpha * between <= own))
        alive[rows, pick_] = False
    return kept


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each vector of a block, both ways."""
    n = len(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    width = min(POOL, n - 1)
    if width <= 0:
        return [np.zeros(0, int)] * n
    pool = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    pool = np.take_along_axis(pool, np.argsort(-np.take_along_axis(sims, pool, 1), axis=1, kind="stable"), 1)
    kept = robust_prune(sims, pool)
    a, b = np.repeat(np.arange(n), kept.shape[1]), kept.ravel()
    a, b = a[b >= 0], b[b >= 0]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


# --- searching --------------------------------------------------------------------------


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    wide = np.full((len(lists), max([1, *map(len, lists)])), -1)
    for i, x in enumerate(lists):
        wide[i, : len(x)] = x
    return wide


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, cosine: float) -> np.ndarray:
    """Which vectors each query finds within the range: a boolean row per query.

    Greedy: from the entries, the beam's best unexplored vectors open their lists until
    the beam is explored. Range: every vector in reach opens its list, until none is new.
    """
    n, q = len(x), len(queries)
    target = x[queries]
    seen, opened = np.zeros((q, n), bool), np.zeros((q, n), bool)
    score = np.full((q, n), -2.0)
    every = np.arange(q)

    def visit(who: np.ndarray, at: np.ndarray) -> None:
        """Looks at the neighbours of vectors ``at`` for queries ``who``."""
        opened[who, at] = True
        reach = graph[at]
        who, reach = np.repeat(who, reach.shape[1]), reach.ravel()
        fresh = reach >= 0
        who, reach = who[fresh], reach[fresh]
        fresh = ~seen[who, reach]
        key = np.unique(who[fresh] * n + reach[fresh])
        look(key // n, key % n)

    def look(who: np.ndarray, at: np.ndarray) -> None:
        seen[who, at] = True
        for i in range(0, len(who), 20_000):
            a, b = who[i : i + 20_000], at[i : i + 20_000]
            score[a, b] = np.einsum("ij,ij->i", target[a], x[b])

    for e in entries:
        look(every, np.full(q, e))
    width = min(BEAM, n)
    for _ in range(n):
        best = np.argpartition(-score, width - 1, axis=1)[:, :width]
        value = np.where(opened[every[:, None], best], -3.0, np.take_along_axis(score, best, 1))
        top = np.argmax(value, axis=1)
        live = value[every, top] > -2
        if not live.any():
            break
        visit(every[live], best[every, top][live])
    while True:
        who, at = np.nonzero((score >= cosine - 0.05) & ~opened)
        if not len(who):
            break
        for i in range(0, len(who), 5_000):
            visit(who[i : i + 5_000], at[i : i + 5_000])
    return score >= cosine - 1e-6


def _trees(linked: np.ndarray) -> np.ndarray:
    """The first vector that each is connected with, by links or links of links."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        now = np.minimum(label, least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _search_task(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links between two blocks of a shard, or in one: counts, and edges of a forest."""
    shard, left, right = int(pdf.shard.iloc[0]), int(pdf.left.iloc[0]), int(pdf.right.iloc[0])
    pdf = pdf.sort_values("node")
    node, block, weight = pdf.node.to_numpy(), pdf.block.to_numpy(), pdf.weight.to_numpy()
    x = _matrix(list(pdf.v))
    lists = []
    for near in pdf.near:
        near = np.asarray(near)
        at = np.minimum(np.searchsorted(node, near), len(node) - 1)
        lists.append(at[node[at] == near])
    graph = _padded(lists)
    mean = x.mean(0)
    entries = []
    for b in sorted({left, right}):
        members = np.flatnonzero(block == b)
        if len(members):
            entries.append(members[np.argmax(x[members] @ mean)])
    found = np.zeros((len(x), len(x)), bool)
    for i in range(0, len(x), 512):
        queries = np.arange(i, min(len(x), i + 512))
        found[queries] = range_search(x, graph, queries, np.array(entries), cosine)
    found |= found.T
    np.fill_diagonal(found, False)
    a, b = np.nonzero(found)
    mine = a < b
    if left != right:
        mine &= block[a] != block[b]
    a, b = a[mine], b[mine]
    # a pair that shares several shards counts in the first
    shards = np.array(list(pdf.shards))
    first = np.full(len(a), np.iinfo(np.int64).max)
    for i in range(shards.shape[1]):
        shared = (shards[a, i][:, None] == shards[b]).any(1)
        first = np.where(shared, np.minimum(first, shards[a, i]), first)
    a, b = a[first == shard], b[first == shard]
    sure = np.zeros(len(a), bool)
    for i in range(0, len(a), 50_000):
        s = slice(i, i + 50_000)
        sure[s] = np.einsum("ij,ij->i", x[a[s]], x[b[s]]) >= cosine
    a, b = a[sure], b[sure]
    linked = np.zeros((len(x), len(x)), bool)
    linked[a, b] = linked[b, a] = True
    counts = linked @ weight.astype(np.float64)
    has = np.flatnonzero(linked.any(1))
    return pd.DataFrame({"node": node[has], "links": counts[has].astype(np.int64), "others": linked.sum(1)[has], "tree": node[_trees(linked)[has]]})


# --- the operator ------------------------------------------------------------------------


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (unit vector in doubles as bytes, null where it links with nothing)."""

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for e in pdf.embedding:
                v = None if e is None else np.array([np.nan if c is None else c for c in e], np.float64)
                top = 0.0 if v is None or not len(v) else np.abs(v).max()
                if not (np.isfinite(top) and top > 0):
                    out.append(None)
                    continue
                v = v / top
                out.append((v / np.sqrt(v @ v)).tobytes())
            yield pd.DataFrame({"vec_id": pdf.vec_id.astype("Int64"), "v": out})

    rows = pick(vectors, "vec_id", "embedding")
    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInPandas(scale, "vec_id long, v binary")


def _assign(nodes: DataFrame, centroids: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """Adds shards: the nearest centroids, ascending; padded by the last where too few.
    Vectors of a length without centroids are a shard, named by a number below zero."""
    known = nodes.sparkSession.sparkContext.broadcast(centroids)  # MAX_CENTROIDS at most
    offsets, total = {}, 0
    for size in sorted(centroids):
        offsets[size], total = total, total + len(centroids[size])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shards = [None] * len(pdf)
            sizes = pdf.v.map(len).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                c = known.value.get(int(size))
                if c is None:
                    for i in at:
                        shards[i] = np.repeat(-int(size), overlap)
                    continue
                k = min(overlap, len(c))
                nearest = np.argpartition(-(_matrix(list(pdf.v.iloc[at])) @ c.T), k - 1, axis=1)[:, :k]
                for i, row in zip(at, np.sort(nearest, axis=1) + offsets[int(size)]):
                    shards[i] = np.r_[row, np.repeat(row[-1:], overlap - k)]
            yield pdf.assign(shards=shards)

    return nodes.mapInPandas(fill, "node long, weight long, v binary, shards array<long>")


def link(nodes: DataFrame, overlap: int, cosine: float) -> DataFrame:
    """node, links, others, tree: links found per task and node, with copies counted and
    without, and edges of forests."""
    assigned = saved(_assign(nodes, fit_centroids(nodes), overlap), "vectors-shards")
    placed = assigned.withColumn("shard", F.explode(F.array_distinct("shards")))
    blocks = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = placed.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node = pdf.node.to_numpy()
        return pd.DataFrame({"node": node, "near": [node[g] for g in build_graph(_matrix(list(pdf.v)))]})

    near = placed.groupBy("shard", "block").applyInPandas(build, "node long, near array<long>")
    united = saved(near.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vectors-graph")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tasks = placed.join(united, "node").select("node", "weight", "v", "near", "shards", "shard", "block", other)
    tasks = tasks.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other")
    return tasks.groupBy("shard", "left", "right").applyInPandas(lambda pdf: _search_task(pdf, cosine), _LINKS)


def _true_links(nodes: DataFrame, n: int, asked: int, cosine: float) -> dict[int, int]:
    """About ``asked`` nodes with the number of others each links with, by brute force."""
    drawn = nodes.where(_share("node") < asked / max(1, n)).select("node", "v").orderBy("node").limit(2 * asked).collect()
    by_size: dict[int, list] = {}
    for r in drawn:
        by_size.setdefault(len(r.v), []).append(r)
    known = nodes.sparkSession.sparkContext.broadcast({s: (np.array([r.node for r in rs]), _matrix([r.v for r in rs])) for s, rs in by_size.items()})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf.v.map(len).to_numpy()
            for size in np.unique(sizes):
                if size not in known.value:
                    continue
                node, target = known.value[size]
                at, true = np.flatnonzero(sizes == size), np.zeros(len(node), np.int64)
                for i in range(0, len(at), 1000):
                    x = pdf.iloc[at[i : i + 1000]]
                    near = _matrix(list(x.v)) @ target.T >= cosine
                    true += (near & (x.node.to_numpy()[:, None] != node[None, :])).sum(0)
                yield pd.DataFrame({"node": node[true > 0], "true": true[true > 0]})

    sums = nodes.select("node", "v").mapInPandas(count, "node long, true long").groupBy("node").agg(F.sum("true").alias("true")).collect()
    return {r.node: 0 for r in drawn} | {r.node: r.true for r in sums}


def truth(nodes: DataFrame, n: int, cosine: float) -> dict[int, int]:
    """Audited nodes: more of them until those with links lie in ``GROUPS`` groups or so."""
    asked = AUDIT
    while True:
        true = _true_links(nodes, n, asked, cosine) if n else {}
        share = np.array([1 / (1 + t) for t in true.values() if t])
        if asked >= min(n, MAX_AUDIT) or (len(share) and share.sum() ** 2 / (share**2).sum() >= GROUPS):
            return true
        asked *= 4


def audit(true: dict[int, int], found: DataFrame, n: int) -> float | None:
    """The recall of the links of audited nodes: mean over nodes or over groups, the lower."""
    linked = {node: t for node, t in true.items() if t}
    if not linked:
        return 1.0 if len(true) == n else None
    asked = found.sparkSession.createDataFrame([(node,) for node in linked], "asked long")
    sums = found.join(F.broadcast(asked), F.col("node") == F.col("asked")).groupBy("node").agg(F.sum("others").alias("others")).collect()
    got = {r.node: r.others for r in sums}
    each = np.array([min(1.0, got.get(node, 0) / t) for node, t in linked.items()])
    share = np.array([1 / (1 + t) for t in linked.values()])  # a group of t + 1 counts once
    return float(min(each.mean(), each @ share / share.sum()))


def _nodes(whole: DataFrame) -> tuple[DataFrame, int, Callable[[DataFrame], DataFrame]]:
    """node, weight, name (the smallest vec_id), v of every distinct vector, their number,
    and what adds the nodes to other frames of vectors."""
    folded = saved(whole.groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("name")), "vectors-folded")
    named, add_node = name_nodes(folded, ["v"], "vectors-met", SEED)
    nodes = saved(named.select("node", "weight", "name", "v"), "vectors-nodes")
    return nodes, nodes.count(), add_node


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept and the audited recall of each row."""
    rows = saved(unit_vectors(vectors), "vectors-unit")
    whole = rows.where(F.col("v").isNotNull())
    named, n, add_node = _nodes(whole)
    nodes = named.select("node", "weight", "v")
    overlap, true = OVERLAP, truth(nodes, n, cosine)
    while True:
        found = saved(link(nodes, overlap, cosine), "vectors-links")
        recall = audit(true, found, n)
        if recall is None or recall >= RECALL or overlap >= MAX_OVERLAP:
            break
        overlap *= 2
    if recall is not None and recall < LEAST_RECALL:
        raise RuntimeError(f"the search finds {recall:.3f} of the audited links at overlap {overlap}, less than {LEAST_RECALL}")
    node_of = add_node(whole).select("vec_id", "node")
    # the vectors of one id are joined with the first of them
    ids = node_of.where(F.col("vec_id").isNotNull())
    first = ids.groupBy("vec_id").agg(F.min("node").alias("b"), F.max("node").alias("z")).where("b < z").select(F.col("vec_id").alias("i"), "b")
    shared = ids.join(first, F.col("vec_id") == F.col("i")).select(F.col("node").alias("a"), "b")
    classes = components(found.select(F.col("node").alias("a"), F.col("tree").alias("b")).union(shared)).withColumnRenamed("node", "member")
    sums = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "linked")
    facts = named.drop("v").join(sums, F.col("node") == F.col("linked"), "left").join(classes, F.col("node") == F.col("member"), "left")
    facts = saved(facts.select("node", "name", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "vectors-facts")
    names = facts.groupBy("component").agg(F.min("name").alias("component_id")).withColumnRenamed("component", "c")
    facts = facts.join(names, F.col("component") == F.col("c")).select(F.col("node").alias("n"), "n_links", "component_id", (F.col("node") == F.col("component")).alias("head"))
    kept = F.when(F.col("component_id").isNull(), F.col("head")).otherwise(F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    linked = node_of.join(facts, F.col("node") == F.col("n")).select("vec_id", "n_links", "component_id", kept.alias("kept"))
    lone = rows.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(lone).withColumn("recall", F.lit(recall).cast("double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = None  # cosines in doubles differ in the last bits; tests compare with brute force
