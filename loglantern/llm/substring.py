"""Operator 7: removing repeated passages by factoring against reference blocks.

A window is 20 consecutive words. Every window has an anchor: the least hash of its
five-word groups. Equal windows have equal anchors, and windows in a row mostly share
theirs, so each text falls into short segments of one anchor. The corpus is indexed in
reference blocks by anchor, all of it; a text is factored, segment by segment, against the
one block that can hold its windows, in the order of documents. A factor is the longest
stretch whose windows all stand earlier in the block. As every window is looked up, also
those across the border of two factors, no repeat is missed. Factors become spans of words
to remove, and the spans of a document are laid over its words once, on the input.

Windows are compared by 64 bits of anchor and 48 of their own hash. Inside a batch of
documents, equal segments are folded before the shuffle: the earliest is indexed, the
others are repeats at once and are dealt out by document, so a passage that stands in a
third of all documents does not meet in one block. A block is read in sorted order as a
stream; memory holds one batch and the distinct windows of one anchor.

Defined cases: null and empty texts have no words; texts under 20 words lose none; ties of
doc_id are ordered by a hash of the text, and rows equal in both are one document, removed
or kept alike; a null doc_id comes first; of no rows come none; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm.common import pick, table, text_key
from loglantern.llm.wordhash import chunks, mix

WINDOW = 20
GROUP = 5  # words under an anchor; the 16 groups of a window make a power of two

_WORD = re.compile("[^ \t-\r]+")
_BLOCK_BITS = 48
_SEGMENTS = "block long, doc_id long, tkey long, start int, windows binary"
_SPANS = "doc_id long, tkey long, first int, past int"


def _anchors(groups: np.ndarray) -> np.ndarray:
    """The least of each 16 groups in a row."""
    least, width = groups, 1
    while width < WINDOW - GROUP + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return least


def _segments(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of all texts of a batch: row, first window, length and anchor of each segment, and
    the hashes of all windows in order."""
    rows, firsts, sizes, anchors, windows = [], [], [], [], []
    for chunk in chunks(batch.column("text")):
        hashes, whole = chunk.shingles(WINDOW)
        if not whole.any():
            continue
        at = np.flatnonzero(whole)
        anchor = _anchors(chunk.shingles(GROUP)[0])[at]
        row = np.repeat(np.arange(len(chunk.counts)), chunk.counts)[at]
        opens = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
        rows.append(row[opens] + chunk.first)
        firsts.append(at[opens] - chunk.begins[row[opens]])
        sizes.append(np.diff(np.r_[opens, len(at)]))
        anchors.append(anchor[opens])
        windows.append(hashes[at])
    if not rows:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    return tuple(map(np.concatenate, (rows, firsts, sizes, anchors, windows)))


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """48 bits of each value, so many values to a row."""
    packed = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    ends = np.r_[0, np.cumsum(sizes) * 6].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(packed)])


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    packed = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = packed.reshape(-1, 6)
    return wide.view("<u8").ravel(), np.diff(ends) // 6


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to segments. One that an earlier document of the batch has too goes on
    without windows, under a block of its document's own: it is a repeat whatever the rest."""
    for batch in batches:
        row, first, size, anchor, window = _segments(batch)
        if not len(row):
            continue
        ids, keys = np.asarray(batch.column("doc_id")), np.asarray(batch.column("tkey"))
        begins = np.cumsum(size) - size
        with np.errstate(over="ignore"):
            place = np.arange(len(window), dtype=np.uint64) - np.repeat(begins, size).astype(np.uint64)
            content = np.add.reduceat(mix(window + place * np.uint64(0x632BE59BD9B4E019)), begins)
        order = np.lexsort((first, keys[row], ids[row], size, content, anchor))
        same = np.ones(len(order) - 1, bool)
        for x in (anchor, content, size):
            same &= x[order][1:] == x[order][:-1]
        folded = np.zeros(len(row), bool)
        folded[order[1:][same]] = True
        # one document may come twice in a batch; copies of the earliest row itself stay
        head = order[np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0))]
        twin = np.zeros(len(row), bool)
        twin[order] = (ids[row][order] == ids[row][head]) & (keys[row][order] == keys[row][head]) & (first[order] == first[head])
        folded &= ~twin
        with np.errstate(over="ignore"):
            own = mix(keys[row].view(np.uint64) + first.astype(np.uint64))
        block = np.where(folded, own, anchor).view(np.int64)
        # a folded segment has no windows: its length goes where they would, as a count below zero
        kept = np.repeat(~folded, size)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(block),
                pa.array(ids[row]),
                pa.array(keys[row]),
                pa.array(np.where(folded, -first - 1, first).astype(np.int32)),
                _mixed(window[kept], size, folded),
            ],
            names=["block", "doc_id", "tkey", "start", "windows"],
        )


def _mixed(windows: np.ndarray, size: np.ndarray, folded: np.ndarray) -> pa.Array:
    """The windows of kept segments and, for folded ones, their number in one value."""
    sizes = np.where(folded, 1, size)
    values = np.zeros(sizes.sum(), np.uint64)
    lone = (np.cumsum(sizes) - sizes)[folded]
    where = np.ones(len(values), bool)
    where[lone] = False
    values[lone] = size[folded].astype(np.uint64)
    values[where] = windows
    return _binaries(values, sizes)


def _spans(ids, keys, firsts, pasts) -> pa.RecordBatch:
    arrays = [pa.array(ids), pa.array(keys), pa.array(firsts.astype(np.int32)), pa.array(pasts.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tkey", "first", "past"])


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments, sorted by block and document, to the spans that stand earlier.

    ``index`` has the windows seen of the anchor that the batches before ended with.
    """
    open_block, index, last = None, np.zeros(0, np.uint64), (None, None, None)
    for batch in batches:
        for at in range(0, len(batch), 10_000):
            part = batch.slice(at, 10_000)
            block, ids, keys = (np.asarray(part.column(c)) for c in ("block", "doc_id", "tkey"))
            start = np.asarray(part.column("start")).astype(np.int64)
            windows, size = _values(part.column("windows"))
            folded = start < 0
            lone = (np.cumsum(size) - size)[folded]
            if folded.any():
                first = -start[folded] - 1
                yield _spans(ids[folded], keys[folded], first, first + windows[lone].astype(np.int64) + WINDOW - 1)
            owner = np.repeat(np.arange(len(block)), size)
            group = np.cumsum(np.r_[0, block[1:] != block[:-1]])
            window_group = group[owner]
            asked = ~folded[owner]
            begins = np.cumsum(size) - size
            place = start[owner] + np.arange(len(owner)) - begins[owner]
            # rows equal in id, text and place are one document: the first stands for all
            again = (block == np.r_[block[:1], block[:-1]]) & (ids == np.r_[ids[:1], ids[:-1]])
            again &= (keys == np.r_[keys[:1], keys[:-1]]) & (start == np.r_[start[:1], start[:-1]])
            again[0] = (open_block, *last) == (block[0], ids[0], keys[0], start[0])
            asked &= ~again[owner]
            known = index if open_block is not None and block[0] == open_block else np.zeros(0, np.uint64)
            key = np.concatenate([known, (window_group[asked].astype(np.uint64) << np.uint64(_BLOCK_BITS)) | windows[asked]])
            order = np.argsort(key, kind="stable")
            repeat = np.zeros(len(key), bool)
            repeat[order[1:]] = key[order][1:] == key[order][:-1]
            repeat = repeat[len(known) :]
            who, where = owner[asked][repeat], place[asked][repeat]
            if len(who):
                opens = np.r_[True, (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1)]
                closes = np.r_[opens[1:], True]
                of = who[opens]
                yield _spans(ids[of], keys[of], where[opens], where[closes] + WINDOW)
            tail = (window_group == group[-1]) & asked
            seen = windows[tail]
            index = np.unique(np.concatenate([known, seen]) if group[-1] == 0 else seen)
            open_block, last = block[-1], (ids[-1], keys[-1], start[-1])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, first, past: words [first, past) of a document stand earlier too."""
    keyed = docs.select(_known_id().alias("doc_id"), text_key(F.col("text")).alias("tkey"), "text")
    segments = keyed.mapInArrow(_cut, _SEGMENTS).repartition("block").sortWithinPartitions("block", "doc_id", "tkey", "start")
    return segments.mapInArrow(_factor, _SPANS)


def _known_id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans (array of (first, past)) and kept_text, the kept
    words joined by one space, of each row."""
    docs = pick(docs, "doc_id", "text")
    spans = repeated_spans(docs).groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("first", "past")).alias("spans"))
    keyed = docs.select(F.col("doc_id").alias("id"), _known_id().alias("doc_id"), text_key(F.col("text")).alias("tkey"), "text")
    joined = keyed.join(spans, ["doc_id", "tkey"], "left").select(F.col("id").alias("doc_id"), "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<first: int, past: int>>, kept_text string"
    return joined.mapInArrow(_lay, schema)


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
    for batch in batches:
        texts, lists = batch.column("text"), batch.column("spans")
        counts, removed, spans, kept = [], [], [], []
        for text, marks in zip(texts, lists):
            words = _WORD.findall(text.as_py() or "")
            gone = np.zeros(len(words) + 1, np.int64)
            if marks.is_valid:
                flat = marks.values
                np.add.at(gone, np.asarray(flat.field("first")), 1)
                np.add.at(gone, np.asarray(flat.field("past")), -1)
            gone = np.cumsum(gone)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            counts.append(len(words))
            removed.append(int(gone.sum()))
            spans.append([{"first": int(a), "past": int(b)} for a, b in zip(edges[::2], edges[1::2])])
            kept.append(" ".join([w for w, g in zip(words, gone) if not g]) if len(edges) else " ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') ORDER BY doc_id, i) AS n FROM s
), g AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, {WINDOW})) AS i FROM r WHERE n > 1
), x AS (
  SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id
), k AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
         list_aggregate(list_filter(w, lambda v, j: gone IS NULL OR NOT list_contains(gone, j)), 'string_agg', ' ') AS kept
  FROM d LEFT JOIN x USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
