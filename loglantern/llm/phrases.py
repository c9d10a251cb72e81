"""Operator 13: phrase collocations by SON partitioning.

Phrases are two to four words that follow each other inside a piece of text. Those standing
``MIN_COUNT`` times in their language are found in two phases:

1. The documents are dealt by content to ``SHARDS`` shards. Each shard is mined completely,
   level by level, with the support lowered in proportion to its words: a phrase is frequent
   in shard i of language L if f_i * n >= MIN_COUNT * n_i. The shares add up to MIN_COUNT, so
   a phrase frequent in all is frequent in one shard at least. A level only counts phrases
   whose parts were frequent in the same shard.
2. The union of what any shard found is counted over all documents exactly, by its words.

A shard is no task: its rows are spread over all tasks, which count what they read, add up
equal phrases, and let Spark group by (phrase, shard). What earlier levels found goes to the
tasks as a bit table of fixed size (``FILTER_BITS``): it may let a phrase too many pass,
which costs work and changes no result, and never loses one. Phase one counts 64-bit
hashes: two phrases under one hash only raise a count, which also just lets more pass. All
numbers that come out are counted by the words themselves.

Defined cases: a null text is empty; a null language is ``und``, together with rows that say
so; ids play no part beyond dealing rows to shards; repeated rows count each; of no rows come
none; other columns do not matter. One text is held whole by a task, a batch of them is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglantern.llm.common import pick, saved, table
from loglantern.llm.wordhash import mix, text_bytes

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
COVERED = 80  # per cent of a phrase that, inside one longer phrase, make it part of that
SCALE = 2_000_000
SHARDS = 8
UNKNOWN = "und"
FILTER_BITS = 27  # 16 MB
SLICE_BYTES = 1 << 20
SALTS = 64

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)

#: What parts words, and what parts pieces.
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_WORD_ENDS = b" \t" + _PIECE_ENDS

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(_WORD_ENDS)] = False
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[list(_PIECE_ENDS)] = True
_BYTE_VALUES = np.random.Generator(np.random.PCG64(13)).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)


# --- phrases of a slice of texts -----------------------------------------------------------


@dataclass
class Grams:
    """Distinct phrases of one length in a slice: where each first stands, how often, its
    hash, and for every word the number of the phrase that begins there (-1: none)."""

    first: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray
    of_word: np.ndarray


@dataclass
class Slice:
    """The words of some texts: each one's number in ``vocabulary``, its row, and its piece."""

    vocabulary: pa.Array
    words: np.ndarray
    rows: np.ndarray
    pieces: np.ndarray

    def singles(self, groups: np.ndarray) -> Grams:
        """Words, told apart by the group (shard or language) of their row."""
        _, group = np.unique(groups, return_inverse=True)
        keys = self.words * (group.max(initial=0) + 1) + group[self.rows]
        return self._count(keys, np.arange(len(keys)), _word_hashes(self.vocabulary)[self.words])

    def longer(self, head: Grams, tail: Grams, shift: int, at: np.ndarray) -> Grams:
        """Phrases that begin at the words ``at``: those of ``head`` there, then those of
        ``tail`` ``shift`` words on."""
        keys = head.of_word[at] * (len(tail.first) + 1) + tail.of_word[at + shift]
        with np.errstate(over="ignore"):
            hashes = mix(head.hashes[head.of_word[at]] * _BASE + tail.hashes[tail.of_word[at + shift]] + _U(shift))
        return self._count(keys, at, hashes)

    def _count(self, keys: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> Grams:
        _, first, number, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        of_word = np.full(len(self.words), -1, np.int64)
        of_word[at] = number
        return Grams(at[first], counts, hashes[first], of_word)

    def starts(self, k: int) -> np.ndarray:
        """Words with k - 1 more words after them in the same piece."""
        n = len(self.words) - k + 1
        return np.flatnonzero(self.pieces[:n] == self.pieces[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def texts(self, grams: Grams, k: int) -> pa.Array:
        parts = [self.vocabulary.take(pa.array(self.words[grams.first + i])) for i in range(k)]
        return pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]


def _word_hashes(words: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(words)
    data, begins = data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0]
    lengths = np.diff(offsets)
    if not len(words):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(begins, lengths)
    with np.errstate(over="ignore"):
        values = mix(_BYTE_VALUES[data] * (_U(2) * place.astype(np.uint64) + _U(1)))
        return mix(np.add.reduceat(values, begins) + lengths.astype(np.uint64))


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int, Slice]]:
    """Rows first to last of a batch, about a megabyte at a time, and their words."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(column))
        yield first, last, _slice(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def _slice(data: np.ndarray, offsets: np.ndarray) -> Slice:
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] |= inside[heads]  # a text begins anew
    starts = np.flatnonzero(begins)
    place = np.cumsum(inside)[starts] - 1 if len(starts) else starts
    values = _LOWER[data[inside]]
    bounds = np.append(place, len(values)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(values))])
    coded = words.dictionary_encode()
    rows = np.searchsorted(offsets, starts, "right") - 1
    ends = np.cumsum(_ENDS_PIECE[data])
    pieces = (ends[starts] if len(starts) else starts) + rows
    return Slice(coded.dictionary, coded.indices.to_numpy().astype(np.int64), rows, pieces)


# --- bit tables ----------------------------------------------------------------------------


def _positions(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = _U(size - 1)  # a power of two
    return keys & mask, (keys >> _U(32)) & mask


def _keys(hashes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(groups.astype(np.int64).view(np.uint64)))


def bit_table(found: DataFrame, group: str) -> np.ndarray:
    """A table with the bits of all (h, group) of the frame set, as 64-bit numbers; its size
    is fixed. It is put together in Spark, word by word."""
    size = 1 << FILTER_BITS

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column("h").to_numpy().view(np.uint64), batch.column(group).to_numpy())
            places = np.unique(np.concatenate(_positions(keys, size)))
            if len(places):
                slots, at = np.unique(places >> _U(6), return_index=True)
                values = np.bitwise_or.reduceat(_U(1) << (places & _U(63)), at)
                yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(values.view(np.int64))], names=["slot", "bits"])

    rows = found.select("h", group).mapInArrow(bits, "slot long, bits long")
    rows = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _known(bits: np.ndarray, hashes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    one, two = _positions(_keys(hashes, groups), 64 * len(bits))

    def set_at(p: np.ndarray) -> np.ndarray:
        return (bits[p >> _U(6)] >> (p & _U(63))) & _U(1) == 1

    return set_at(one) & set_at(two)


def _frequent_words(piece: Slice, groups: np.ndarray, grams: Grams, bits: np.ndarray) -> np.ndarray:
    """For every word of the slice, whether the phrase that begins there passes the table."""
    passes = np.append(_known(bits, grams.hashes, groups[piece.rows[grams.first]]), False)
    return passes[grams.of_word]


def _all_of(at: np.ndarray, good: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    for i in offsets:
        at = at[good[at + i]]
    return at


def _level(piece: Slice, groups: np.ndarray, bits: np.ndarray | None, level: int) -> list[tuple[int, Grams]]:
    """The phrases a level counts: words (1), pairs of frequent words (2), and three and
    four words all of whose pairs are frequent (3)."""
    one = piece.singles(groups)
    if level == 1:
        return [(1, one)]
    if level == 2:
        return [(2, piece.longer(one, one, 1, _all_of(piece.starts(2), _frequent_words(piece, groups, one, bits), (0, 1))))]
    two = piece.longer(one, one, 1, piece.starts(2))
    good = _frequent_words(piece, groups, two, bits)
    three, four = (_all_of(piece.starts(k), good, tuple(range(k - 1))) for k in (3, 4))
    return [(3, piece.longer(two, one, 2, three)), (4, piece.longer(two, two, 2, four))]


# --- Spark ---------------------------------------------------------------------------------


def _dealt(docs: DataFrame, shards: int) -> DataFrame:
    """text, lang, lang_key and part: the shard of a language a row is dealt to."""
    rows = pick(docs, "doc_id", "text", "lang")
    lang = F.coalesce("lang", F.lit(UNKNOWN))
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))
    return rows.select("text", lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.xxhash64(lang, shard).alias("part"))


def _counted(rows: DataFrame, level: int, bits: np.ndarray | None) -> DataFrame:
    """h, part, n: the phrases of a level by shard; at the first level also lang."""
    known, size = rows.sparkSession.sparkContext.broadcast(bits), SLICE_BYTES
    with_lang = level == 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for first, last, piece in slices(batch.column("text"), size):
                for _, grams in _level(piece, parts[first:last], known.value, level):
                    row = first + piece.rows[grams.first]
                    columns = {"h": pa.array(grams.hashes.view(np.int64)), "part": pa.array(parts[row]), "n": pa.array(grams.counts.astype(np.int64))}
                    if with_lang:
                        columns["lang"] = batch.column("lang").take(pa.array(row))
                    yield pa.RecordBatch.from_pydict(columns)

    keys = ["h", "part", *(["lang"] if with_lang else [])]
    found = rows.select("text", *keys[1:]).mapInArrow(count, "h long, part long, n long" + (", lang string" if with_lang else ""))
    return found.groupBy(*keys).agg(F.sum("n").alias("n"))


def _frequent(counted: DataFrame, parts: DataFrame, min_count: int) -> DataFrame:
    """What the counts of a level make frequent in its shard: f_i * n >= min_count * n_i."""
    whole = F.col("n").cast("decimal(20,0)") * F.col("all_words") >= F.col("words").cast("decimal(20,0)") * F.lit(min_count)
    return counted.select("h", "part", "n").join(parts, "part").where(whole).select("h", "part", "lang_key")


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k, f of all phrases of one to four words that stand ``min_count`` times
    or more in their language; and lang, n, the number of its words."""
    rows = _dealt(docs, shards)
    words = saved(_counted(rows, 1, None), "phrases-words")
    parts = words.groupBy("lang", "part").agg(F.sum("n").alias("words"))
    sizes = saved(parts.groupBy("lang").agg(F.sum("words").alias("n")), "phrases-sizes")
    parts = parts.join(sizes.withColumnRenamed("n", "all_words"), "lang")
    parts = saved(parts.select("part", F.xxhash64("lang").alias("lang_key"), "words", "all_words"), "phrases-parts")
    one = saved(_frequent(words, parts, min_count), "phrases-one")
    two = saved(_frequent(_counted(rows, 2, bit_table(one, "part")), parts, min_count), "phrases-two")
    more = saved(_frequent(_counted(rows, 3, bit_table(two, "part")), parts, min_count), "phrases-more")
    union = one.unionByName(two).unionByName(more)
    return _exact(rows, bit_table(union, "lang_key"), min_count), sizes


def _exact(rows: DataFrame, bits: np.ndarray, min_count: int) -> DataFrame:
    known, size = rows.sparkSession.sparkContext.broadcast(bits), SLICE_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, langs = batch.column("lang_key").to_numpy(), batch.column("lang")
            for first, last, piece in slices(batch.column("text"), size):
                groups = keys[first:last]
                one = piece.singles(groups)
                two = piece.longer(one, one, 1, piece.starts(2))
                good = _frequent_words(piece, groups, two, known.value)
                # parts of a frequent phrase are frequent, so its pairs are candidates too
                three, four = (_all_of(piece.starts(k), good, tuple(range(k - 1))) for k in (3, 4))
                for k, grams in ((1, one), (2, two), (3, piece.longer(two, one, 2, three)), (4, piece.longer(two, two, 2, four))):
                    passes = _known(known.value, grams.hashes, groups[piece.rows[grams.first]])
                    grams = Grams(grams.first[passes], grams.counts[passes], grams.hashes[passes], grams.of_word)
                    at = pa.array(first + piece.rows[grams.first])
                    columns = [langs.take(at), piece.texts(grams, k), pa.array(grams.counts.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])

    found = rows.select("text", "lang", "lang_key").mapInArrow(count, "lang string, phrase string, n long")
    counted = found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    return counted.withColumn("k", F.size(F.split("phrase", " ")))


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, score: every candidate at its lowest-scoring cut."""
    cuts = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', cut)"), "tail": F.expr("substring_index(phrase, ' ', cut - k)")})
    left = frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)").cast("long")
    met = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).withColumn("score", score)
    best = met.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "best.k", "best.a", "best.l", "best.r", "best.score")


def without_parts(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """The candidates that no longer one has inside it nearly wherever they stand."""
    inner = candidates.where("k > 2").select(
        "lang",
        F.col("a").alias("longer"),
        F.explode(
            F.expr(
                "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1),"
                " i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
            )
        ).alias("phrase"),
    )
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    joined = candidates.join(most, ["lang", "phrase"], "left")
    inside = F.lit(100).cast("decimal(20,0)") * F.col("longer") >= F.lit(covered).cast("decimal(20,0)") * F.col("a")
    return joined.where(F.col("longer").isNull() | ~inside).drop("longer")


def ranked(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language; a language is cut in salted lots first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    lots = candidates.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    lots = lots.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return lots.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).drop("lot")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    frequent, sizes = frequent_phrases(docs, min_count, shards)
    frequent = saved(frequent, "phrases-frequent")
    candidates = saved(scored(frequent), "phrases-scored")
    best = ranked(without_parts(candidates), top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[.,;:!?\\x0A-\\x0D]') AS pieces
  FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)
), s AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM s, (VALUES (1), (2), (3), (4)) AS o(k) WHERE i + k - 1 <= len(w)
), n AS (
  SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= {MIN_COUNT}
), c AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), u AS (
  SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS cut FROM c
), h AS (
  SELECT u.lang, u.phrase, u.k, u.a, cut, l.f AS l, r.f AS r,
         CAST(({SCALE}::HUGEINT * a) // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(w[1:cut], ' ')
         JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')
), b AS (
  SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), i AS (
  SELECT lang, a AS longer, array_to_string(w[j:j + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, k, m, unnest(range(1, k - m + 2)) AS j
        FROM c, (VALUES (2), (3)) AS o(m) WHERE m < k)
), t AS (
  SELECT lang, phrase, max(longer) AS longer FROM i GROUP BY lang, phrase
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank,
       b.phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN t ON t.lang = b.lang AND t.phrase = b.phrase
WHERE longer IS NULL OR 100::HUGEINT * longer < {COVERED}::HUGEINT * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= {TOP}
"""
