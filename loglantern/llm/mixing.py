"""Operator 1: mixing sources to target weights.

Each source is one long stream of words: its documents in an order given by a hash,
counted on from bucket to bucket, so a hot source is dealt out like the others. The
stream is cut in blocks of ``block_words``. A source whose target is r times its size is
read in floor(r) whole passes and one partial pass; every pass takes the blocks in a
permuted order. Its draws (pass, block) are its quota, exact to the word.

The quotas of all sources are split among the output shards by a tree. At each node half
of the draws go left; how many of each source is drawn from the multivariate
hypergeometric law, source by source. The draws themselves are taken in order, so
shards hold disjoint ranges of them. Inside a shard ``place`` gives a random order.

The recipe has one row per source and each node of the tree one entry per source: sources
are the entries of a mix, not keys of documents. Everything else is dealt out by
(source, bucket) or (source, block), which hold a bounded number of words each.

Defined cases: a null text has size 0 and is not taken; a null source comes last in the
order of sources; repeated rows each count as a document; no rows give no rows; other
columns do not matter. Equal input gives an equal mix, whatever the partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loglantern.llm.common import pick, saved, table, text_key, word_count

WEIGHTS = (1, 2, 3)  # by code point of the source, repeating, null last
MAX_REPEATS = 3
BLOCK_WORDS = 4096
SHARD_WORDS = 1 << 22
BUCKET_DOCS = 8192
SEED = 17

_PRIME = 2147483647  # permutes blocks: coprime to any smaller number of them


def _long(x) -> Column:
    return F.lit(x).cast("long")


# --- recipe -------------------------------------------------------------------


def recipe(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> also src (its rank), target.

    All sizes are shared by weight; a target stops at ``max_repeats`` times its
    source's size and the excess goes to the others. With sources sorted by
    cap / weight, the level is what is left after the first caps, per weight left.
    """
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("src") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("src", F.row_number().over(in_order) - 1).withColumn("w", weight)
    ranked = ranked.withColumn("cap", (max_repeats * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = W.orderBy("ratio", "src")
    everything = W.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    level = ranked.withColumn("level", (total - before) / weight_left)
    level = level.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return level.select("source", "src", "source_size", target.alias("target"))


# --- the splitting tree ---------------------------------------------------------


def _log_factorial(n: Column) -> Column:
    """Stirling's series, moved up by 8 so that it is exact to 1e-12 from 0 on."""
    z = n + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = n + 1.0
    for i in range(2, 9):
        product = product * (n + float(i))
    return series - F.log(product)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hypergeometric(all_: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``all_`` are among the ``good``: inverts the
    distribution at u. Beyond 12 deviations there is nothing a double could hold."""

    def from_range(r: Column) -> Column:
        n, k, d, low, high = (r[x] for x in ("n", "k", "d", "low", "high"))
        logs = F.transform(F.array(k, low, k - low, n - k, d - low, n - k - d + low, n, d, n - d), _log_factorial)
        signs = F.array(*(F.lit(x) for x in (1.0, -1.0, -1.0, 1.0, -1.0, -1.0, -1.0, 1.0, 1.0)))
        chance = F.exp(F.aggregate(F.zip_with(logs, signs, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
        start = F.struct(chance.alias("p"), F.lit(0.0).alias("below"), low.alias("x"))

        def step(s: Column, x: Column) -> Column:
            below = s["below"] + s["p"]
            following = s["p"] * (k - x) * (d - x) / ((x + 1) * F.greatest(n - k - d + x + 1, F.lit(1.0)))
            return F.struct(following.alias("p"), below.alias("below"), F.when(below <= u, x + 1.0).otherwise(s["x"]).alias("x"))

        places = F.sequence(low.cast("long"), high.cast("long"))
        return F.aggregate(places, start, step, lambda s: F.least(s["x"], high).cast("long"))

    def spread(r: Column) -> Column:
        n, k, d = r["n"], r["k"], r["d"]
        return r.withField("mean", d * k / n).withField("deviation", F.sqrt(F.greatest(F.lit(0.0), d * k / n * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0)))))

    def bounds(r: Column) -> Column:
        n, k, d, reach = r["n"], r["k"], r["d"], 12 * r["deviation"] + 12
        low = F.greatest(F.lit(0.0), d - (n - k), F.floor(r["mean"] - reach).cast("double"))
        return r.withField("low", low).withField("high", F.least(d, k, F.ceil(r["mean"] + reach).cast("double")))

    counts = F.struct(all_.cast("double").alias("n"), good.cast("double").alias("k"), draws.cast("double").alias("d"))
    drawn = _let(counts, lambda c: _let(spread(c), lambda r: _let(bounds(r), from_range)))
    return F.when((all_ <= 0) | (good <= 0) | (draws <= 0), _long(0)).otherwise(drawn)


def _left_counts(node: Column, parts: Column, seed: int) -> Column:
    """For each source at a node, how many of its draws go left."""
    total = F.aggregate(parts, _long(0), lambda s, p: s + p["n"])
    start = F.struct(total.alias("rest"), F.floor(total / 2).alias("take"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        u = F.call_function("shiftrightunsigned", F.xxhash64(node, p["src"], F.lit(seed)), F.lit(11)) * 2.0**-53
        return _let(
            _hypergeometric(s["rest"], p["n"], s["take"], u),
            lambda x: F.struct((s["rest"] - p["n"]).alias("rest"), (s["take"] - x).alias("take"), F.array_append(s["out"], x).alias("out")),
        )

    return F.aggregate(parts, start, step, lambda s: s["out"])


def split_quotas(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """src, n -> shard, src, first, n: each of 2^depth shards has the draws from
    ``first`` on of each source."""
    part = F.struct("src", _long(0).alias("first"), "n")
    nodes = quotas.where("n > 0").agg(F.sort_array(F.collect_list(part)).alias("parts")).select(_long(1).alias("node"), "parts")
    for _ in range(depth):
        drawn = nodes.withColumn("left", _left_counts(F.col("node"), F.col("parts"), seed))

        def half(p: Column, i: Column, left: bool) -> Column:
            x = F.get("left", i)
            return F.struct(p["src"].alias("src"), (p["first"] if left else p["first"] + x).alias("first"), (x if left else p["n"] - x).alias("n"))

        halves = (
            F.struct((2 * F.col("node")).alias("node"), F.transform("parts", lambda p, i: half(p, i, True)).alias("parts")),
            F.struct((2 * F.col("node") + 1).alias("node"), F.transform("parts", lambda p, i: half(p, i, False)).alias("parts")),
        )
        nodes = drawn.select(F.explode(F.array(*halves)).alias("h")).select("h.*")
    leaves = nodes.select((F.col("node") - (1 << depth)).alias("shard"), F.explode("parts").alias("p"))
    return leaves.select("shard", "p.*").where("n > 0")


# --- the mix --------------------------------------------------------------------


def place_documents(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """Each document's place in the stream of its source, and the source's target."""
    sized = pick(docs, "doc_id", "source", "text").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), text_key(F.col("text")).alias("tkey")
    )
    rows = saved(sized.withColumn("key", F.xxhash64("doc_id", "tkey", F.lit(seed))), "mix-rows")
    buckets = 1 + rows.count() // BUCKET_DOCS
    rows = rows.withColumn("bucket", F.pmod("key", _long(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    base = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), _long(0))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = recipe(sizes, weights, max_repeats).withColumnRenamed("source", "s")
    bases = sums.select("source", "bucket", base.alias("base"))
    bases = bases.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnsRenamed({"source": "s", "bucket": "b"})
    before = F.sum("size").over(W.partitionBy("src", "bucket").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return placed.select(
        "doc_id", "tkey", "source", "size", "src", "source_size", "target", (F.col("base") + F.coalesce(before, _long(0))).alias("start")
    )


def mix_sources(
    placed: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED
) -> DataFrame:
    """The mix of placed documents as slices of them.

    shard, place: where a slice goes; src, start, doc_id, tkey: the document;
    pass: which reading of the source; first_word, n_words: the slice.
    """
    sources = placed.groupBy("src").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, total / shard_words))))
    wanted = F.round("target").cast("long")
    size, blocks = F.col("source_size"), F.col("blocks")
    partial = wanted - F.col("whole") * size
    plan = (
        sources.where(size > 0)
        .withColumn("blocks", F.ceil(size / block_words))
        .withColumn("whole", F.call_function("div", wanted, size))
        .withColumn("rest", partial)
        .withColumn("n", F.col("whole") * blocks + F.ceil(F.col("rest") / block_words))
    )
    draws = split_quotas(plan.select("src", "n"), depth, seed)
    # full blocks change places; the one short block stays last
    i, full = F.col("draw") % blocks, F.greatest(blocks - 1, _long(1))
    moved = (i * (_long(_PRIME) % full) + F.pmod(F.xxhash64("src", "pass", F.lit(seed)), full)) % full
    block = F.when(i == blocks - 1, i).otherwise(moved)
    words = F.when(F.col("pass") < F.col("whole"), _long(block_words)).otherwise(F.least(_long(block_words), F.col("rest") - i * block_words))
    taken = (
        draws.join(plan.withColumnRenamed("n", "quota"), "src")
        .select("*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
        .withColumn("pass", F.call_function("div", F.col("draw"), blocks))
        .select("shard", "src", "pass", block.alias("block"), words.alias("words"))
    )
    end = F.col("start") + F.col("size")
    touched = F.sequence(F.call_function("div", F.col("start"), _long(block_words)), F.call_function("div", end - 1, _long(block_words)))
    pieces = placed.where("size > 0").select("doc_id", "tkey", "src", "start", "size", F.explode(touched).alias("block"))
    at = F.col("block") * block_words
    first, last = F.greatest(F.col("start"), at), F.least(end, at + F.col("words"))
    return (
        pieces.join(taken, ["src", "block"])
        .withColumn("first_word", first - F.col("start"))
        .withColumn("n_words", last - first)
        .where("n_words > 0")
        .withColumn("place", F.xxhash64("shard", "src", "start", "pass", "first_word", F.lit(seed)))
        .select("shard", "place", "src", "start", "doc_id", "tkey", "pass", "first_word", "n_words")
    )


def shuffled(slices: DataFrame) -> DataFrame:
    """The slices shard by shard, each in its random order."""
    return slices.repartition("shard").sortWithinPartitions("shard", "place")


def taken_words(placed: DataFrame, slices: DataFrame) -> DataFrame:
    """Each placed document with the words the mix takes of it, repeats counted."""
    taken = slices.groupBy("src", "start").agg(F.sum("n_words").alias("taken"))
    joined = placed.join(taken, ["src", "start"], "left")
    return joined.withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", _long(0))).otherwise(_long(0)))


def mixed_documents(docs: DataFrame, slices: DataFrame) -> DataFrame:
    """The mix as rows with the columns doc_id, text, lang, source and n_chars.

    One row per pass and stretch of a document: a document that is read three times
    comes three times, one at the end of the quota in part. White space stays as it is.
    Texts are shuffled once, as they are, and cut in words only where they meet their runs.
    """
    parts = F.sort_array(F.collect_list(F.struct("pass", "first_word", "n_words"))).alias("parts")
    stretches = slices.groupBy("doc_id", "tkey", "start").agg(parts)

    def follows(before: Column, part: Column) -> Column:
        end = before["first_word"] + before["n_words"]
        return before["pass"].eqNullSafe(part["pass"]) & end.eqNullSafe(part["first_word"])

    opens = F.filter("parts", lambda p, i: ~follows(F.get("parts", i - 1), p))
    ends = F.filter("parts", lambda p, i: ~follows(p, F.get("parts", i + 1)))
    # equal rows are dropped and joined by the same columns, none of them null, so one shuffle does for both
    key = ["id", "no_id", "tkey"]
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    named = (F.coalesce(F.col("doc_id"), zero).alias("id"), F.col("doc_id").isNull().alias("no_id"))
    runs = stretches.select(*named, "tkey", F.arrays_zip(opens.alias("a"), ends.alias("z")).alias("runs"))
    known = pick(docs, "doc_id", "text", "lang", "source").withColumn("tkey", text_key(F.col("text")))
    known = known.select(*named, "tkey", "text", "lang", "source").dropDuplicates(key)
    # each word with the white space after it; what stands before the first word goes with it
    worded = known.join(runs, key).withColumn("w", F.split("text", "(?<=[ \\t-\\r])(?=[^ \\t-\\r])"))
    cut = worded.select("id", "no_id", "text", "lang", "source", "w", F.explode("runs").alias("run"))
    a, z = F.col("run.a.first_word"), F.col("run.z.first_word") + F.col("run.z.n_words")
    lead = F.when(F.col("text").rlike("^[ \\t-\\r]"), 1).otherwise(0)
    n = F.size("w") - lead
    some = F.array_join(F.slice("w", (a + 1 + lead).cast("int"), (z - a).cast("int")), "")
    text = F.when((a == 0) & (z >= n), F.col("text")).otherwise(some)
    mixed = cut.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), text.alias("text"), "lang", "source")
    return mixed.withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = saved(place_documents(table(spark, sf_dir, "documents")), "mix-placed")
    return taken_words(placed, mix_sources(placed)).select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = None  # the order of the streams is a hash that SQL engines do not share
