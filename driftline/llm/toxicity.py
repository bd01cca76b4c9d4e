"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters, digits and all other characters beyond ASCII, A-Z in lower case.
A text's features are its distinct words, the beginnings of longer words (of ``BEGINNINGS``
letters, so that unseen forms of a word count), word pairs, and pairs with one word between,
hashed to ``2 ** BITS`` places, each with the value 1, so a few telling words count the same in
a long text as in a short one.  L1 leaves few weights, which are broadcast: at most ``2 ** BITS``.

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hash
of their id, as far as their features fill ``SAMPLE_BYTES``; scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import table

BITS = 22
BEGINNINGS = (3, 4, 5, 6)
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 256 << 20
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.1, 1.0, 3.0, 1.0
THRESHOLD = 0.3
#: As if so many rows more had been seen, one of them toxic: a few labels don't condemn every text.
PRIOR_ROWS = 20
#: The score where there is nothing to learn from.
NO_PRIOR = 1e-6

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SKIP = np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def hashed(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, feature) for every occurrence in ``texts``, in no order."""
    found = W.split(texts, W.LETTERS_AND_DIGITS)
    letters = [w.decode() for w in found.distinct]
    each = _hashes(found.distinct)
    h = each[found.codes] if len(found.codes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(found.offsets) - 1), np.diff(found.offsets))
    owners, places = [owner], [h >> np.uint64(64 - bits)]
    lengths = np.fromiter(map(len, letters), np.int64, len(letters))
    for n in BEGINNINGS:
        longer = (lengths > n)[found.codes] if len(letters) else np.zeros(0, bool)
        begun = _hashes([f"{n}<{w[:n]}".encode() for w in letters])
        owners.append(owner[longer])
        places.append(begun[found.codes[longer]] >> np.uint64(64 - bits))
    with np.errstate(over="ignore"):
        for gap, factor in ((1, _ODD), (2, _SKIP)):
            same = owner[gap:] == owner[:-gap]
            mixed = (h[:-gap] * factor ^ h[gap:]) * _ODD
            places.append((mixed >> np.uint64(64 - bits))[same])
            owners.append(owner[gap:][same])
    return np.concatenate(owners), np.concatenate(places).astype(np.int64)


@dataclass
class Weights:
    places: np.ndarray
    values: np.ndarray
    bias: float


def fit(rows: Iterator[tuple[np.ndarray, int]], bits: int = BITS) -> Iterator[tuple[int, float]]:
    """FTRL-proximal with a rate of its own for each coordinate; yields (place, weight), and (-1, bias) first.

    Rows are held for the second epoch, so they are taken until their places fill ``SAMPLE_BYTES``.
    """
    rows, offered, size = [], rows, 0
    for places, y in offered:
        size += places.nbytes
        if rows and size > SAMPLE_BYTES:
            break
        rows.append((places, y))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    share = (sum(y for _, y in rows) + 1) / (len(rows) + PRIOR_ROWS) if rows else NO_PRIOR
    bias, seen = float(np.log(min(share, 0.5) / (1 - min(share, 0.5)))), 1.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for places, y in rows:
            zi, ni = z[places], n[places]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            z[places] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[places] = ni + g * g
            seen += g * g
            bias -= ALPHA / np.sqrt(seen) * g
    yield -1, bias
    w = weights(z, n)
    for place in np.flatnonzero(w).tolist():
        yield place, float(w[place])


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Weights:
    """Fit on labelled rows that aren't held out.  A document with several labels has the largest; null labels are none."""
    marked = labels.filter(F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 2)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    chosen = marked.withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(sample_rows)
    body = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = T.StructType([T.StructField("order", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("places", T.BinaryType())])

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.chunks(whole, 0):
                owner, place = hashed(batch.column(0))
                one = np.unique((owner << BITS) | place)
                ends = np.searchsorted(one, np.arange(batch.num_rows + 1) << BITS)
                raw = (one & ((1 << BITS) - 1)).astype("<i4")
                sets = [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2).cast(pa.int32()), pa.array(sets, pa.binary())], names=["order", "toxic", "places"])

    out = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((np.frombuffer(p, "<i4"), int(y > 0)) for b in batches for y, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        found = list(fit(rows))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([w for _, w in found], pa.float64())], names=["place", "weight"])

    sets = body.select("_text", "_order", "_toxic").mapInArrow(featurise, rows)
    fitted = sets.repartition(1).sortWithinPartitions("order", "toxic", "places").mapInArrow(learn, out).collect()
    kept = [r for r in fitted if r["place"] >= 0]
    return Weights(np.array([r["place"] for r in kept], np.int64), np.array([r["weight"] for r in kept]), next((r["weight"] for r in fitted if r["place"] < 0), float(np.log(NO_PRIOR))))


class Scorer:
    """Scores of a batch's texts under sparse weights."""

    def __init__(self, weights: Weights):
        self.dense = np.zeros(1 << BITS, np.float32)
        self.dense[weights.places] = weights.values
        self.bias = weights.bias

    def __call__(self, texts: pa.Array) -> np.ndarray:
        owner, place = hashed(texts)
        hit = self.dense[place] != 0
        one = np.unique((owner[hit] << BITS) | place[hit])
        total = np.bincount(one >> BITS, self.dense[one & ((1 << BITS) - 1)], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, weights: Weights, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and a score from 0 to 1 for every row; a null text scores as an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    out = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = Scorer(sent.value)
        for whole in batches:
            for batch in W.chunks(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rate(batch.column(1)))], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, out)


def predict(docs: DataFrame, weights: Weights, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score and predicted for every row.  A null key is held out of nothing."""
    rated = score(docs, weights, text, key)
    return rated.select(key, F.coalesce(remainder(F.col(key)) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose whole text scores under the threshold; columns as they are.

    Null and empty texts score as the prior does and stay; without labels all rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = Scorer(sent.value)
        for whole in batches:
            for batch in W.chunks(whole, at):
                yield batch.filter(pa.array(rate(batch.column(at)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; ``train`` and ``predict`` state null labels, texts and keys, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, table(spark, sf_dir, "labels")))
