"""Operator 8: language identification, family first, then the languages within it.

A text becomes the square roots of the shares of its letter groups (one to three bytes
of lower-case letters, hashed). Linear support vector machines, one against the rest, tell
the family; in the family, one machine for each two languages votes. All machines are
trained on the driver from a bounded sample: about ``PER_LANGUAGE`` labelled documents of
each language, picked by a hash, so it is the same for the same table. Everything is
predicted from the whole text of every row.

Defined cases: a text that is null or has no letter gives ``und`` with score 0; so does
everything where nothing is labelled; a null doc_id is held out, never learnt from;
ties go to the language first in the alphabet; equal rows get equal predictions; of no rows
come none; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm.common import pick, table, text_key
from loglantern.llm.wordhash import text_bytes

PER_LANGUAGE = 1000
MAX_LANGUAGES = 200
FEATURES = 2048
UNKNOWN = "und"

#: Families of languages. A language that is not listed is its own family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "pl", "cs", "sk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "cjk": ["zh", "ja", "ko"],
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_LETTER = np.zeros(256, np.uint64)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_ROWS, _BYTES = 256, 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)) == 0


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row and features of a few hundred rows at a time. A group of letters counts
    to its text only if it lies in it whole."""
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, first + _ROWS, max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BYTES, "right")) - 1))
        letters = _LETTER[data[offsets[first] : offsets[last]]]
        sizes = np.diff(offsets[first : last + 1])
        row = np.repeat(np.arange(last - first), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(row))
        counts = np.zeros((last - first) * FEATURES)
        group = np.zeros(len(letters), np.uint64)
        for width in (1, 2, 3):
            size = max(0, len(letters) - width + 1)
            group = (group[:size] << np.uint64(8)) | letters[width - 1 :][:size]
            with np.errstate(over="ignore"):
                slot = ((group + np.uint64(width << 24)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)
            fits = (left[:size] >= width) & (group > 0)
            counts += np.bincount(row[:size][fits] * FEATURES + slot[fits].astype(np.int64), minlength=len(counts))
        counts = counts.reshape(-1, FEATURES)
        yield first, np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)
        first = last


# --- training ------------------------------------------------------------------------


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, both sides weighing
    the same, by Newton steps with conjugate gradients."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost * len(y)
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return 0.5 * w @ w + weight @ np.maximum(0, 1 - y * (x @ w)) ** 2

    for _ in range(20):
        slack = 1 - y * (x @ w)
        active = slack > 0
        xa, wa = x[active], weight[active]
        gradient = w - 2 * xa.T @ (wa * y[active] * slack[active])
        if np.linalg.norm(gradient) < 1e-3 * len(y):
            break
        step, r = np.zeros_like(w), -gradient
        p, rr = r.copy(), r @ r
        goal = 0.01 * rr
        for _ in range(50):
            hp = p + 2 * xa.T @ (wa * (xa @ p))
            a = rr / (p @ hp)
            step, r = step + a * p, r - a * hp
            rr, before = r @ r, rr
            if rr < goal:
                break
            p = r + rr / before * p
        now, scale = loss(w), 1.0
        while scale > 1e-3 and loss(w + scale * step) > now:
            scale /= 2
        w = w + scale * step
    return w


@dataclass
class Model:
    """Machines as columns of one matrix: families against the rest, then pairs."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # features + 1 by machines

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margins = x @ self.weights[:-1] + self.weights[-1]
        sure = 1 / (1 + np.exp(-2 * np.clip(margins, -30, 30)))
        languages = [lang for family in self.families for lang in family]
        n = len(self.families)
        family = np.argmax(margins[:, :n], axis=1) if n > 1 else np.zeros(len(x), int)
        family_sure = sure[np.arange(len(x)), family] if n > 1 else np.ones(len(x))
        names, scores = np.empty(len(x), object), np.zeros(len(x))
        for f, members in enumerate(self.families):
            at = np.flatnonzero(family == f)
            votes, low = np.zeros((len(at), len(members))), np.ones((len(at), len(members)))
            for j, (a, b) in enumerate(self.pairs, start=n):
                if a in members:
                    p, ia, ib = sure[at, j], members.index(a), members.index(b)
                    votes[:, ia] += p >= 0.5
                    votes[:, ib] += p < 0.5
                    low[:, ia] = np.minimum(low[:, ia], p)
                    low[:, ib] = np.minimum(low[:, ib], 1 - p)
            best = np.argmax(votes + 0.5 * low, axis=1)
            names[at] = np.array(members, object)[best]
            scores[at] = family_sure[at] * low[np.arange(len(at)), best]
        assert set(names) <= set(languages)
        return names, scores


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from rows with text and lang; None if there are none."""
    rows = labelled.where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is lang the right column?")
    if not found:
        return None
    rate = F.lit(0.0)
    for r in found:
        rate = F.when(F.col("lang") == r.lang, min(1.0, per_language / r.n)).otherwise(rate)
    draw = F.pmod(F.xxhash64("doc_id", text_key(F.col("text"))), F.lit(1 << 30)) / (1 << 30)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in _features(batch.column("text")):
                packed = pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(first, len(x)), packed], names=["lang", "x"])

    sample = rows.where(draw < rate).select("lang", F.lower("text").alias("text")).mapInArrow(vectors, "lang string, x binary").toPandas()
    sample = sample.sort_values(["lang", "x"])
    x = np.frombuffer(b"".join(sample.x), np.float16).reshape(-1, FEATURES).astype(np.float32)
    lang = sample.lang.to_numpy()
    by_family: dict[str, list[str]] = {}
    for name in sorted(set(lang)):
        by_family.setdefault(_FAMILY.get(name.lower()[:2] if name.lower() not in _FAMILY else name.lower(), name), []).append(name)
    families = sorted(by_family.values())
    columns, pairs = [], []
    for members in families:
        columns.append(_machine(x, np.where(np.isin(lang, members), 1.0, -1.0)) if len(families) > 1 else np.zeros(FEATURES + 1))
    for members in families:
        for a, b in combinations(members, 2):
            at = (lang == a) | (lang == b)
            pairs.append((a, b))
            columns.append(_machine(x[at], np.where(lang[at] == a, 1.0, -1.0)))
    return Model(families, pairs, np.array(columns).T.astype(np.float32))


# --- prediction ------------------------------------------------------------------------


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The frame's rows with lang_pred and score in place of its text."""
    names = [c for c in docs.columns if c != "text"]
    known = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES languages

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            lettered = np.asarray(batch.column("_letters").to_numpy(zero_copy_only=False), bool)
            langs, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            for first, x in _features(batch.column("_text")) if m else ():
                langs[first : first + len(x)], scores[first : first + len(x)] = m.predict(x)
            langs[~lettered], scores[~lettered] = UNKNOWN, 0.0
            out = [batch.column(c) for c in names] + [pa.array(langs, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_letters")
    ready = docs.select(*names, F.lower(F.coalesce("text", F.lit(""))).alias("_text"), lettered)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return ready.mapInArrow(fill, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; learns from the rows not held out."""
    rows = pick(docs, "doc_id", "text", "lang")
    model = fit(rows.where(~held_out(F.col("doc_id"))), per_language)
    return predict(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


SQL = None  # machines are trained; held-out accuracy is the test
