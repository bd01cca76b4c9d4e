"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case, so
punctuation, case and layout don't hide a copy.  Every n-gram of a test item is a seed.  One
pass over the training texts finds the seeds; a seed that few items hold leads to them directly.
A common seed leads to the items of which the text also holds enough rare words: an alignment that
scores the threshold misses no more than the rest of the item's words, so of any more words than
that it holds the excess.  This is exact, so common phrases cost no pairs of texts and items.

Around its seeds lies the window of words that an alignment through them can reach.  An alignment
matches no more words than window and item have in common, so windows that can't score the
threshold by that bound go.  What stays is aligned at once in the same pass, a match counting 2, a
mismatch or a gap -1; the score is the share of the score of a full copy.

The items are sent to the workers in blocks of bounded size, one pass for each block.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import batches_out, table

SEED = 4
MATCH, MISS, GAP = 2, -1, -1
THRESHOLD = 0.45
#: Bytes of item text in a block that is broadcast; a worker's index takes some fifty times as many.
BLOCK_BYTES = 4 << 20
#: A seed that more items hold is common.
RARE_ITEMS = 8
#: Distinct windows whose alignment a worker remembers.
KNOWN_WINDOWS = 1 << 14

_ODD = np.uint64(0x9E3779B97F4A7C15)

Item = tuple[int | None, str]

_FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("start_word", T.LongType()),
        T.StructField("end_word", T.LongType()),
    ]
)


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    out = np.full(max(len(h) - n + 1, 0), n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n if len(out) else 0):
            out = (out ^ h[k : len(h) - n + 1 + k]) * _ODD
            out ^= out >> np.uint64(29)
    return out


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes and the offsets of the texts."""
    found = W.split(pc.utf8_lower(texts.cast(pa.large_string())), W.LETTERS_AND_DIGITS)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found.distinct), np.uint64, len(found.distinct))
    return (each[found.codes] if len(found.codes) else np.zeros(0, np.uint64)), found.offsets


class Seeds:
    """The seeds of a block of items, for lookup by hash.  Items are known by their place in the block."""

    def __init__(self, items: list[Item], n: int = SEED, threshold: float = THRESHOLD, rare_items: int = RARE_ITEMS):
        h, offsets = hashed_words(pa.array([t for _, t in items], pa.large_string()))
        self.ids = [i for i, _ in items]
        self.threshold = threshold
        self.words: dict[int, np.ndarray] = {}
        self.places: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.sizes: set[int] = set()
        for item, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            if b > a:
                self.words[item] = h[a:b]
                size = int(min(n, b - a))
                self.sizes.add(size)
                for at, seed in enumerate(_rolled(h[a:b], size).tolist()):
                    self.places[seed][item].append(at)
        self.common = {s for s, p in self.places.items() if len(p) > rare_items}
        self.counts = {item: np.unique(words, return_counts=True) for item, words in self.words.items()}
        self.known = np.sort(np.array(list(self.places), np.uint64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.rare: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.least_rare: dict[int, int] = {}
        if self.common:
            held = Counter(w for distinct, _ in self.counts.values() for w in distinct.tolist())
            for item, words in self.words.items():
                spare = len(words) - math.ceil(threshold * len(words) - 1e-9)
                ordered = sorted(words.tolist(), key=lambda w: (held[w], w))
                least = max(1, sum(held[w] <= rare_items for w in ordered) - spare)
                self.least_rare[item] = least
                for w, n in Counter(ordered[: spare + least]).items():
                    self.rare[w].append((item, n))
        self.rare_words = np.sort(np.array(list(self.rare), np.uint64))

    def met(self, h: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(text's place, item) with its seeds (position in the text, place in the item)."""
        out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size in self.sizes:
            at, seeds = self.find(h, size)
            owner = np.searchsorted(offsets, at, "right") - 1
            inside = at + size <= offsets[owner + 1]
            for p, o, s in zip((at - offsets[owner])[inside].tolist(), owner[inside].tolist(), seeds[inside].tolist(), strict=True):
                if s in self.common:
                    waiting[o].append((p, s))
                else:
                    for item, places in self.places[s].items():
                        out[o, item].extend((p, place) for place in places)
        for o, hits in waiting.items():
            words = np.unique(h[offsets[o] : offsets[o + 1]])
            near = np.minimum(np.searchsorted(self.rare_words, words), len(self.rare_words) - 1)
            count: Counter[int] = Counter()
            for w in words[self.rare_words[near] == words].tolist():
                for item, n in self.rare[w]:
                    count[item] += n
            may = {item for item, n in count.items() if n >= self.least_rare[item]}
            for p, s in hits:
                held = self.places[s]
                for item in may if len(may) < len(held) else held:
                    if item in held and item in may:
                        out[o, item].extend((p, place) for place in held[item])
        return out

    def find(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and seeds in ``h``; across texts too, which the caller leaves out."""
        rolled = _rolled(h, size)
        at = np.flatnonzero(self.maybe[(rolled >> np.uint64(44)).astype(np.int64)])
        sure = self.known[np.minimum(np.searchsorted(self.known, rolled[at]), len(self.known) - 1)] == rolled[at]
        return at[sure], rolled[at[sure]]

    def in_common(self, item: int, words: np.ndarray) -> int:
        """How many words an alignment of the item with ``words`` can match at most."""
        distinct, counts = self.counts[item]
        at = np.minimum(np.searchsorted(distinct, words), len(distinct) - 1)
        return int(np.minimum(np.bincount(at[distinct[at] == words], minlength=len(distinct)), counts).sum())


def _windows(hits: list[tuple[int, int]], length: int, n_words: int, spare: int) -> Iterator[tuple[int, int]]:
    """Merged (start, end) windows that an item of ``length`` words, with ``spare`` words put between them, can fill around its hits (position, place in the item)."""
    start = end = -1
    for position, place in sorted(hits):
        a, b = max(0, position - place - spare), min(n_words, position - place + length + spare)
        if end >= 0 and a > end:
            yield start, end
            end = -1
        start, end = (a, b) if end < 0 else (min(start, a), max(end, b))
    if end >= 0:
        yield start, end


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and the end of its last word in ``words``."""
    index = np.arange(len(words) + 1)
    above = np.zeros(len(words) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(words == w, MATCH, MISS))
        row = np.maximum.accumulate(row - GAP * index) + GAP * index
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


class Aligner:
    """The alignments of texts with a block of items that score the threshold."""

    def __init__(self, items: list[Item], threshold: float = THRESHOLD):
        self.index = Seeds(items, threshold=threshold)
        self.known: dict[tuple[int, bytes], tuple[float, int, int]] = {}

    def _aligned(self, item: int, words: np.ndarray) -> tuple[float, int, int]:
        """(score, start, end) within the window; equal windows are aligned once."""
        window = item, xxhash.xxh3_128_digest(words.tobytes())
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= KNOWN_WINDOWS:
                self.known.clear()
            own = self.index.words[item]
            best, end = align(own, words)
            share = best / (MATCH * len(own))
            back = align(own[::-1], words[:end][::-1])[1] if share >= self.index.threshold else 0
            found = self.known[window] = share, end - back, end
        return found

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(text's place, item's place, score, start word, end word)."""
        h, offsets = hashed_words(texts)
        for (o, item), hits in sorted(self.index.met(h, offsets).items()):
            a, b = offsets[o], offsets[o + 1]
            length = len(self.index.words[item])
            # each word put in costs one, and no more than all words of the item match
            spare = math.floor(MATCH * length * (1 - self.index.threshold) + 1e-9)
            for start, end in _windows(hits, length, int(b - a), spare):
                words = h[a + start : a + end]
                if self.index.in_common(item, words) / length >= self.index.threshold:
                    score, first, last = self._aligned(item, words)
                    if score >= self.index.threshold:
                        yield o, item, score, start + first, start + last


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(name: str, items: Broadcast, threshold: float) -> Aligner:
    """The block's aligner, built once in a worker; the one of another block goes."""
    if name not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[name] = Aligner(items.value, threshold)
    return _ALIGNERS[name]


def blocks(items: DataFrame, text: str = "text", key: str = "item_id") -> Iterator[list[Item]]:
    """The items with a text, in blocks of at most ``BLOCK_BYTES`` of text (or one item).  Null ids stay."""
    block, size = [], 0
    for row in items.filter(F.col(text).isNotNull()).select(F.col(key).cast("long"), text).distinct().orderBy(key, text).toLocalIterator():
        if block and size + len(row[1].encode()) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1].encode())
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item whose best alignment scores the threshold or more: doc_id, item_id, score, start_word, end_word.

    Null and empty texts and items without a word take part in nothing; an empty table gives no
    rows.  Items shorter than a seed are one seed as a whole.  Every different text under an
    item's id is searched for, and the best one counts; items without an id share the null one.
    Rows with a null id give rows with a null doc_id; rows of one id give one row.  Other columns
    of either table are left.
    """
    spark = docs.sparkSession
    found = None
    for block in blocks(items):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def rows(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent, name: str = name) -> Iterator[tuple]:
            search = _aligner(name, sent, threshold)
            for whole in batches:
                for batch in W.chunks(whole):
                    ids = batch.column(0)
                    for o, item, score, start, end in search(batch.column(1)):
                        yield ids[o].as_py(), search.index.ids[item], score, start, end

        def run(batches: Iterator[pa.RecordBatch], rows: Callable = rows) -> Iterator[pa.RecordBatch]:
            return batches_out(rows(batches), _FOUND)

        part = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, _FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], _FOUND)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("first"), "end_word"))
    out = found.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return out.select("doc_id", "item_id", F.col("best.score").alias("score"), (-F.col("best.first")).alias("start_word"), F.col("best.end_word").alias("end_word"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` in which no item is found, each judged by its own text in one pass for each block.

    Ids play no part, so null and repeated ones cost no other row; null texts stay, columns are
    as they were.
    """
    spark, at, schema = docs.sparkSession, docs.columns.index(text), docs.schema
    for block in blocks(items):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent, name: str = name) -> Iterator[pa.RecordBatch]:
            search = _aligner(name, sent, threshold)
            for whole in batches:
                for batch in W.chunks(whole, at):
                    clean = np.ones(batch.num_rows, bool)
                    clean[[o for o, *_ in search(batch.column(at))]] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item whose best alignment scores the threshold; ``contaminated`` states nulls, repeats and empty tables."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
