"""Operator 9: byte-pair encoding through a table of distinct words, and decoding.

Texts are split into words by the tokenizer's own pattern in Spark. The distinct words are
counted over all texts, and those of the table are encoded once each. The ids come back to
the words by position: a hash join of the words of a batch with the table, rows and places
kept, so no word is shuffled and no text either. Only the most frequent words are in the
table, as many as ``table_words`` allows, each of at most ``WORD_BYTES``: that bounds what
all executors hold (some 30 MB) whatever the corpus. Other words are rare; a batch encodes
each of its own once. Both ways give the same ids. Decoding takes the piece of every id from
the table of ids and pieces and joins them.

Defined cases: null and empty texts have no ids and decode to the empty text; strings of
special tokens in a text become those tokens, as in the library; rows come out as they come
in, repeated ones too; of no rows come none; other columns do not matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm.common import pick, saved, table

TABLE_WORDS = 1 << 18
WORD_BYTES = 48
SLICE = 200_000  # words or ids that a worker handles at once

#: Fixed value: the pattern of byte-level tokenizers, with white space as in Unicode.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def _specials(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


@lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array:
    """The bytes of each id. Byte-level vocabularies write a byte as a printable character:
    itself where it is one, else the next unused code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    specials = _specials(path)
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = piece.encode() if piece in specials else bytes(byte_of[c] for c in piece)
    return pa.array(pieces, pa.binary())


# --- words ------------------------------------------------------------------------


def split_words(text: Column, specials: list[str]) -> Column:
    """The words of a text in order; together they are the text."""
    text = F.coalesce(text, F.lit(""))

    def plain(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))

    words = plain(text)
    for special in specials:
        quoted = "\\Q" + special + "\\E"
        parts = F.transform(F.split(text, quoted), lambda t, i: F.when(i == 0, plain(t)).otherwise(F.concat(F.array(F.lit(special)), plain(t))))
        words = F.when(F.contains(text, F.lit(special)), F.flatten(parts)).otherwise(words)
    return words


def _encoded(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words after each other, and how many each has."""
    found = _tokenizer(path).encode_batch(words.to_pylist(), add_special_tokens=False)
    ids = [e.ids for e in found]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum())), sizes


def word_table(docs: DataFrame, path: str, table_words: int = TABLE_WORDS) -> DataFrame:
    """word, ids: the most frequent distinct words, at most ``table_words``, encoded once."""
    words = pick(docs, "text").select(F.explode(split_words(F.col("text"), list(_specials(path)))).alias("word"))
    counts = words.where(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = saved(counts.where("n > 1"), "bpe-words")  # a word that stands once gains nothing
    steps = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("words"))
    least, room = None, table_words
    for step, n in sorted(steps.collect(), reverse=True):  # a few hundred steps at most
        room -= n
        if room < 0:
            break
        least = step
    frequent = counts.where(F.floor(F.log2("n") * 8) >= least) if least is not None else counts.limit(0)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = _encoded(batch.column("word"), path)
            ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.ListArray.from_arrays(ends, pa.array(ids))], names=["word", "ids"])

    return frequent.select("word").mapInArrow(encode, "word string, ids array<int>")


def _ragged(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of values one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with some ``SLICE`` elements of a list column, so that
    what a worker holds does not follow the batch. A row is always whole."""
    ends = np.asarray(batch.column(column).offsets).astype(np.int64)
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, "right")) - 1)
        yield batch.slice(first, min(last, len(batch)) - first)
        first = last


def _fill_ids(batches: Iterator[pa.RecordBatch], known, path: str) -> Iterator[pa.RecordBatch]:
    """doc_id, words to doc_id, ids."""
    table_words, table_ids, table_sizes = known.value
    for batch in batches:
        for part in _slices(batch, "words"):
            lists = part.column("words")
            flat, ends = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
            ends = ends - ends[0]
            at = pc.index_in(flat, value_set=table_words)
            rare = pc.unique(flat.filter(pc.is_null(at)))
            ids, sizes = _encoded(rare, path)
            at = pc.coalesce(at, pc.add(pc.index_in(flat, value_set=rare), len(table_words))).to_numpy().astype(np.int64)
            ids, sizes = np.concatenate([table_ids, ids]), np.concatenate([table_sizes, sizes])
            begins = np.cumsum(sizes) - sizes
            got = _ragged(ids, begins[at], sizes[at])
            offsets = np.r_[0, np.cumsum(sizes[at])][ends].astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(got.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), out], names=["doc_id", "ids"])


def _fill_text(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """doc_id, ids to doc_id, ids, text: joins each id with its piece."""
    pieces = _pieces(path)
    for batch in batches:
        for part in _slices(batch, "ids"):
            lists = part.column("ids")
            ends = np.asarray(lists.offsets)
            taken = pieces.take(lists.flatten())
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends - ends[0]), taken), pa.scalar(b"", pa.binary()))
            try:
                text = joined.cast(pa.string())
            except pa.ArrowInvalid:
                text = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, text], names=["doc_id", "ids", "text"])


def _held(docs: DataFrame, path: str, table_words: int):
    """The table of words on every executor; bounded, see above."""
    held = word_table(docs, path, table_words).toArrow().combine_chunks()
    words = held.column("word").combine_chunks() if held.num_rows else pa.array([], pa.string())
    lists = held.column("ids").combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.int32()))
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    return docs.sparkSession.sparkContext.broadcast((words, lists.values.to_numpy(), sizes))


def _split(docs: DataFrame, path: str) -> DataFrame:
    return pick(docs, "doc_id", "text").select("doc_id", split_words(F.col("text"), list(_specials(path))).alias("words"))


def encode(docs: DataFrame, path: str | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, ids of each row's whole text."""
    path = path or tokenizer_path()
    known = _held(docs, path, table_words)
    return _split(docs, path).mapInArrow(lambda batches: _fill_ids(batches, known, path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, text of rows with ids; broken UTF-8 gives replacement characters."""
    path = path or tokenizer_path()
    return pick(encoded, "doc_id", "ids").mapInArrow(lambda batches: _fill_text(batches, path), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, ids, text decoded from them: both steps in one worker."""
    path = path or tokenizer_path()
    known = _held(docs, path, table_words)
    both = lambda batches: _fill_text(_fill_ids(batches, known, path), path)
    return _split(docs, path).mapInArrow(both, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return round_trip(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL = None  # merges have no SQL
