"""Operator 6: near-duplicates by consistent weighted sampling over TF-IDF shingles.

Shingles are five words; their weights are the count in the text times

    idf = ln(1 + 1 / max(df / N, floor)),   floor = max(1/1000, mean shingles / 2^19)

with df counted exactly over all N documents. Below the floor all shingles are equally
rare, so only shingles above it need be known everywhere; their number is at most mean
shingles / floor <= 2^19 whatever N. They are found in two passes: a table of fixed size
counts all shingles by slot, then the shingles of slots that could hold a frequent one are
counted exactly.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per distinct text;
texts that agree in a band are candidates (at similarity 0.8 one pair in 5,000 is missed).
Round one verifies every member of a band's bucket against its first. Members that are then
still apart are compared with all others, in blocks of bounded size: pairs count as near if half
their samples agree and their weights leave a link possible. A text's weights are summed up
by the ``SLOTS`` slots of its shingles; the smaller of two sums, added over all slots, is
never less than what the texts share, so no pair is lost by it. Round two verifies the near pairs of the few members that are nearest to most, the middle of a
group of copies, and the nearest two of each member; round three all near pairs that are
left. So a group of copies costs a few pairs for each member, and no link is left out. A
node is one distinct text, named by a hash of its smallest doc_id and its content.
Candidates are verified by the exact weighted Jaccard similarity of the whole texts, which
lie in a table bucketed by node, so no round shuffles them again. Links make components;
the smallest doc_id names the class and stays, of its texts the one with the least node.

Defined cases: null, empty and blank texts have no shingles and stay apart, but equal texts
are one class; texts of one to four words are one shingle; different texts that share a
doc_id are documents each, in one class only if they are near; a null doc_id is named by a
hash of its text above 2^62; rows equal in id and text stay or go alike; ties do not matter;
of no rows come none; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm.common import name_nodes, pick, saved, table, text_key
from loglantern.llm.graph import components
from loglantern.llm.wordhash import Chunk, chunks, mix
from loglantern.sources.shared import new_dir

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
RARE = 1e-3
MAX_FREQUENT = 1 << 19
PAIR_BYTES = 1 << 20  # of text that a worker verifies at once
BLOCK = 1500  # members of a bucket that are compared in one task with as many others
SLOTS = 256  # sums of weights that bound what two texts share
HUBS, NEAREST = 3, 2  # members of a block that round two tries with all, and for each

_SLOT_BITS = 21
_SLICES = 32
_U = np.uint64


# --- shingles -----------------------------------------------------------------------


def _shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle, repeats too, by row."""
    row = np.repeat(np.arange(len(chunk.counts)), chunk.counts)
    hashes, whole = chunk.shingles(SHINGLE)
    at = np.flatnonzero(whole)
    rows, values = [row[at]], [hashes[at]]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(chunk.counts == k)
        if len(short):
            rows.append(short)
            values.append(chunk.shingles(k)[0][chunk.begins[short]])
    return np.concatenate(rows), np.concatenate(values)


def _distinct(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of every distinct shingle, sorted by row and hash."""
    row, value = _shingles(chunk)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]) if len(row) else np.zeros(0, int)
    return row[new], value[new], np.diff(np.r_[new, len(row)])


def _slot(values: np.ndarray) -> np.ndarray:
    return (values >> _U(64 - _SLOT_BITS)).astype(np.int64)


class Weights:
    """The idf of shingles: of the frequent ones by table, of all others the same."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n: int, floor: float):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.idf = np.log1p(1 / np.maximum(df[order] / max(1, n), floor))
        self.rare = float(np.log1p(1 / floor))

    def of(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return counts * self.rare
        at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
        return counts * np.where(self.hashes[at] == values, self.idf[at], self.rare)


def fit_weights(docs: DataFrame) -> Weights:
    """Document frequencies over all texts."""
    texts = docs.select("text")
    n = texts.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, total = np.zeros(1 << _SLOT_BITS, np.int64), 0
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                values = _shingles(chunk)[1]
                total += len(values)
                slots += np.bincount(_slot(values), minlength=len(slots))
        if total:
            parts = slots.astype(np.uint32).reshape(_SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, counts in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                sums[s] = sums.get(s, 0) + np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
        for s, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([counts.tobytes()], pa.binary()), pa.array([int(counts.sum())])], names=["slice", "counts", "total"])

    sums = texts.mapInArrow(count, "slice int, counts binary").repartition(_SLICES, "slice").mapInArrow(add, "slice int, counts binary, total long")
    sums = saved(sums, "minhash-slots")
    floor = max(RARE, (sums.agg(F.sum("total")).first()[0] or 0) / max(1, n) / MAX_FREQUENT)
    least = max(1.0, floor * n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(c.as_buffer(), np.int64) >= least).tobytes() for c in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(bits, pa.binary())], names=["slice", "bits"])

    slots = np.zeros((_SLICES, (1 << _SLOT_BITS) // _SLICES // 8), np.uint8)  # bits alone come to the driver
    for r in sums.select("slice", "counts").mapInArrow(pack, "slice int, bits binary").collect():
        slots[r["slice"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    wanted = docs.sparkSession.sparkContext.broadcast(slots.ravel())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            found = [v[asked[_slot(v)]] for v in (_distinct(c)[1] for c in chunks(batch.column("text")))]
            values, df = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(df.astype(np.int64))], names=["hash", "df"])

    frequent = texts.mapInArrow(exact, "hash long, df long").groupBy("hash").agg(F.sum("df").alias("df")).where(F.col("df") >= least)
    held = frequent.toArrow()  # at most MAX_FREQUENT rows
    return Weights(held.column("hash").to_numpy().view(np.uint64), held.column("df").to_numpy(), n, floor)


# --- samples ------------------------------------------------------------------------


def _gamma_quantiles() -> np.ndarray:
    """Of the gamma distribution with shape 2, at 65,536 even steps."""
    x = np.concatenate([np.linspace(0, 1, 20001), np.linspace(1, 40, 60001)[1:]])
    return np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + x) * np.exp(-x), x)


_R = _gamma_quantiles().astype(np.float32)
_LN_C = np.log(_gamma_quantiles()).astype(np.float32)
_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def draw_samples(row: np.ndarray, values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row in order, ``SAMPLES`` samples as 64-bit numbers. Two weighted sets
    share a sample with the chance of their weighted Jaccard similarity."""
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[begins, len(row)])
    ln_w = np.log(weights).astype(np.float32)
    samples = np.empty((len(begins), SAMPLES), np.uint64)
    mask = _U(0xFFFF)
    for k in range(SAMPLES):
        with np.errstate(over="ignore"):
            u = mix(values ^ _SEEDS[k])
        r = _R[u & mask]
        beta = ((u >> _U(32)) & _U(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(ln_w / r + beta)
        ln_a = _LN_C[(u >> _U(16)) & mask] - r * (t - beta + 1)
        least = np.repeat(np.minimum.reduceat(ln_a, begins), sizes)
        hit = np.flatnonzero(ln_a == least)
        first = hit[np.searchsorted(hit, begins)]
        with np.errstate(over="ignore"):
            samples[:, k] = mix(values[first] + (t[first].astype(np.int64) + 1000).astype(np.uint64) * _U(0x632BE59BD9B4E019))
    return row[begins], samples


def slot_sums(row: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n rows, the weights summed up by slots, as bytes rounded up, and the size of a step."""
    at = row * SLOTS + (values % _U(SLOTS)).astype(np.int64)
    sums = np.bincount(at, weights, minlength=n * SLOTS).reshape(n, SLOTS)
    step = sums.max(1, initial=0) / 255
    return np.minimum(np.ceil(sums / np.where(step > 0, step, 1)[:, None]), 255).astype(np.uint8), step


def sign(docs: DataFrame, weights: Weights) -> DataFrame:
    """name, t1, t2 (128 bits of the text), total (sum of weights), bands, samples (16 bits
    each), slots and their step of every row; no bands where there is no word."""
    known = docs.sparkSession.sparkContext.broadcast(weights)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = known.value
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                n = len(chunk.counts)
                row, values, counts = _distinct(chunk)
                totals, bands, kept, slots = np.zeros(n), [None] * n, [None] * n, [None] * n
                step = np.zeros(n)
                if len(row):
                    weighed = w.of(values, counts)
                    totals += np.bincount(row, weighed, minlength=n)
                    where, samples = draw_samples(row, values, weighed)
                    key = np.zeros((len(where), BANDS), np.uint64)
                    with np.errstate(over="ignore"):
                        for i in range(ROWS):
                            key = mix(key * _U(0x9E3779B97F4A7C15) + samples[:, i::ROWS])
                        key = mix(key + np.arange(BANDS, dtype=np.uint64))
                    key, small = key.view(np.int64), samples.astype(np.uint16)
                    place = np.cumsum(np.r_[0, row[1:] != row[:-1]])
                    sums, step[where] = slot_sums(place, values, weighed, len(where))
                    for j, i in enumerate(where):
                        bands[i], kept[i], slots[i] = key[j], small[j].tobytes(), sums[j].tobytes()
                rest = [batch.column(c).slice(chunk.first, n) for c in ("name", "t1", "t2")]
                out = [*rest, pa.array(totals), pa.array(bands, pa.list_(pa.int64())), pa.array(kept, pa.binary()), pa.array(slots, pa.binary()), pa.array(step)]
                yield pa.RecordBatch.from_arrays(out, names=["name", "t1", "t2", "total", "bands", "samples", "slots", "step"])

    schema = "name long, t1 long, t2 long, total double, bands array<long>, samples binary, slots binary, step double"
    return docs.select("name", "t1", "t2", "text").mapInArrow(fill, schema)


# --- candidates ---------------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one key after the other, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = np.asarray(batch.column(key))
        if held and keys[0] != held[-1].column(key)[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield pa.Table.from_batches(held)


def _compare(batches: Iterator[pa.RecordBatch], every: bool, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of each group, near pairs in different components, one of them apart from the
    bucket's first: all of them, or those of the hubs and the nearest ones."""
    for group in _groups(batches, "task"):
        node, comp, total, step = (group.column(c).to_numpy() for c in ("node", "comp", "total", "step"))
        home = group.column("home").to_numpy()
        samples = np.frombuffer(b"".join(group.column("samples").to_pylist()), np.uint16).reshape(-1, SAMPLES)
        slots = np.frombuffer(b"".join(group.column("slots").to_pylist()), np.uint8).reshape(-1, SLOTS)
        hosts, asked = np.flatnonzero(home), np.flatnonzero(~home)
        mass = np.zeros(len(hosts), np.int64)

        def agreeing(x: np.ndarray, with_: np.ndarray) -> np.ndarray:
            """Samples that members x share with others; 0 where they are not near."""
            agree = (samples[x][:, None, :] == samples[with_][None, :, :]).sum(2)
            near = (2 * agree >= SAMPLES) & (comp[x][:, None] != comp[with_][None, :])
            low, high = np.minimum(total[x][:, None], total[with_][None, :]), np.maximum(total[x][:, None], total[with_][None, :])
            return np.where(near & (low >= (similarity - 1e-6) * high), agree, 0)

        def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Whether the slots of x and y leave room for all that a link has to share."""
            room = np.minimum(slots[x] * step[x][:, None], slots[y] * step[y][:, None]).sum(1)
            return room >= (similarity / (1 + similarity) - 1e-6) * (total[x] + total[y])

        def found(x: np.ndarray, with_: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = np.nonzero(near)
            a, b = x[a], with_[b]
            for i in range(0, len(a), 2048):
                p, q = a[i : i + 2048], b[i : i + 2048]
                fit = possible(p, q)
                p, q = node[p[fit]], node[q[fit]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], names=["a", "b"])

        for i in range(0, len(asked), 64):
            x = asked[i : i + 64]
            agree = agreeing(x, hosts)
            if every:
                yield from found(x, hosts, agree)
                continue
            mass += agree.sum(0)
            if agree.shape[1] > NEAREST:
                least = np.partition(agree, -NEAREST, axis=1)[:, -NEAREST]
                agree[agree < least[:, None]] = 0
                # of many equally near ones the first few do
                agree[np.cumsum(agree > 0, axis=1) > NEAREST] = 0
            yield from found(x, hosts, agree)
        if not every:
            hubs = hosts[np.argsort(-mass, kind="stable")[:HUBS]]
            for i in range(0, len(asked), 1024):
                x = asked[i : i + 1024]
                yield from found(x, hubs, agreeing(x, hubs))


def _apart(members: DataFrame, first: DataFrame, joined: DataFrame, texts: DataFrame, every: bool, similarity: float) -> DataFrame:
    """Candidates among the members of a bucket that the rounds before have not joined.

    Every member is at home in one block of its bucket. Those that are not in the
    component of the bucket's first are dealt to blocks of guests too, and every block of
    guests meets every block at home in a task of its own.
    """
    comp = joined.select(F.col("node").alias("cn"), "component")

    def with_comp(frame: DataFrame, node: str, name: str) -> DataFrame:
        return frame.join(comp, F.col(node) == F.col("cn"), "left").withColumn(name, F.coalesce("component", node)).drop("cn", "component")

    rows = with_comp(members.join(first, "key"), "node", "comp")
    firsts = with_comp(first, "first", "major").select(F.col("key").alias("k"), "major")
    rows = rows.join(firsts, F.col("key") == F.col("k")).drop("k").withColumn("minor", F.col("comp") != F.col("major"))
    torn = rows.where("minor").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("guests")).withColumnRenamed("key", "k")
    rows = rows.join(torn, F.col("key") == F.col("k")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))

    def own(number: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(number))

    def each(number: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1))

    hosts = rows.select("key", "node", "comp", own("blocks").alias("block"), each("guests").alias("guest"), F.lit(True).alias("home"))
    guests = rows.where("minor").select("key", "node", "comp", each("blocks").alias("block"), own("guests").alias("guest"), F.lit(False).alias("home"))
    facts = texts.select(F.col("node").alias("tn"), "total", "samples", "slots", "step")
    dealt = hosts.union(guests).join(facts, F.col("node") == F.col("tn")).select(
        F.xxhash64("key", "block", "guest").alias("task"), "node", "comp", "home", "total", "samples", "slots", "step"
    )
    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(
        lambda batches: _compare(batches, every, similarity), "a long, b long"
    ).distinct()


# --- verification -------------------------------------------------------------------


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, as many as have some ``size`` bytes of text, at least one."""
    lengths = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("text_a", "text_b"))
    ends = np.cumsum(lengths)
    first = 0
    while first < len(batch):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(first, last - first)
        first = last


def _similarity(batch: pa.RecordBatch, w: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of text_a and text_b, row by row."""
    n = len(batch)
    rows, values, weighed = [], [], []
    for name in ("text_a", "text_b"):
        for chunk in chunks(batch.column(name)):
            row, value, counts = _distinct(chunk)
            rows.append(row + chunk.first)
            values.append(value)
            weighed.append(w.of(value, counts))
    row, value, weight = map(np.concatenate, (rows, values, weighed))
    order = np.lexsort((value, row))
    row, value, weight = row[order], value[order], weight[order]
    both = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
    shared = np.bincount(row[both], np.minimum(weight[both], weight[both + 1]), minlength=n)
    every = np.bincount(row, weight, minlength=n) - shared
    return np.divide(shared, every, out=np.zeros(n), where=every > 0)


def verify(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts are similar, with their similarity."""
    known, size = pairs.sparkSession.sparkContext.broadcast(weights), PAIR_BYTES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _slices(batch, size)):
            found = _similarity(part, known.value)
            near = pa.array(found >= similarity - 1e-9)
            out = [part.column("a").filter(near), part.column("b").filter(near), pa.array(found).filter(near)]
            yield pa.RecordBatch.from_arrays(out, names=["a", "b", "similarity"])

    def side(name: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(fill, "a long, b long, similarity double")


def _bucketed(frame: DataFrame, key: str) -> tuple[DataFrame, str]:
    """The rows written to the shared folder in buckets of a key, so that joins on the key
    read them in place, and the name they have in the catalog."""
    spark = frame.sparkSession
    path = new_dir(spark, "minhash-whole")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name), name


def body_key(text: Column) -> Column:
    """The key of a text in what ``near_duplicates`` returns; null and empty are alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, tkey (``body_key`` of the text), class_id (the smallest doc_id of the class),
    kept of each row."""
    docs = pick(docs, "doc_id", "text")
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62).bitwiseOR(F.call_function("shiftrightunsigned", text_key(F.col("text")), F.lit(3))))
    body = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", name.alias("name"), body_key(F.col("text")).alias("t1"), F.xxhash64(F.lit(7), body).alias("t2"), "text")
    weights = fit_weights(named)
    signed = saved(sign(named, weights), "minhash-signed")
    texts = saved(
        signed.groupBy("t1", "t2").agg(F.min("name").alias("name"), F.first("total").alias("total"), *(F.first(c).alias(c) for c in ("bands", "samples", "slots", "step"))),
        "minhash-texts",
    )
    texts, add_node = name_nodes(texts, ["name", "t1", "t2"], "minhash-met")
    members = texts.select("node", F.explode("bands").alias("key"))
    first = saved(members.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash-first")
    members = saved(members.join(first.select("key"), "key", "left_semi"), "minhash-members")
    # the texts that share a bucket with others: nothing else has to be verified
    met = members.select("node").distinct()
    bodies = add_node(named).select("node", "text").join(met.hint("merge"), "node", "left_semi")
    whole, held = _bucketed(bodies.dropDuplicates(["node"]), "node")
    star = members.join(first, "key").select(F.col("node").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()
    links = saved(verify(star, whole, weights, similarity), "minhash-links").select("a", "b")
    for every in (False, True):
        pairs = _apart(members, first, components(links), texts, every, similarity)
        more = saved(verify(pairs, whole, weights, similarity), "minhash-links").select("a", "b")
        links = links.union(more)
    docs.sparkSession.sql(f"DROP TABLE {held}")
    classes = components(links).withColumnRenamed("node", "member")
    facts = texts.select("t1", "t2", "name", "node").join(classes, F.col("node") == F.col("member"), "left")
    facts = saved(facts.select("t1", "t2", "name", "node", F.coalesce("component", "node").alias("component")), "minhash-classes")
    heads = facts.groupBy("component").agg(F.min(F.struct("name", "node")).alias("head"))
    facts = facts.join(heads, "component").select("t1", "t2", F.col("head.name").alias("class_id"), (F.col("node") == F.col("head.node")).alias("first"))
    out = named.select("doc_id", "name", "t1", "t2").join(facts, ["t1", "t2"])
    return out.select("doc_id", F.col("t1").alias("tkey"), "class_id", (F.col("first") & (F.col("name") == F.col("class_id"))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("tkey")


SQL = None  # samples have no SQL; tests compare with all pairs by brute force
