"""Edit-aware token counts: segment trees over a document's pre-tokens.

A pre-token's tokens don't depend on its neighbours, and where the pattern stands at a boundary
only the text from there on decides what follows.  So after an edit, the pattern is run again
from the last boundary that ends two characters before it, to the first boundary behind it that
the old text had too; only the pre-tokens between these are encoded again, and the sums on the
path to their block are updated.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pii
from . import words as W
from .shared import batches_out, cut, table

#: Pre-tokens in a leaf when a tree is built.
LEAF = 32
#: Distinct pre-tokens whose counts a worker keeps.
CACHE_PIECES = 400_000
#: Longer pre-tokens are counted but not kept.
CACHE_CHARS = 64

Edit = tuple[int, int, str]

_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_UNUSUAL = re.compile("[^\t\n\r -~¡-¬®-ɏ]")
#: The vocabulary's own pattern, for texts of usual characters, without Unicode tables.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+")


class Counter:
    """Tokens of pre-tokens, each distinct one encoded once."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def pattern(self, text: str) -> re.Pattern[str]:
        return self.whole if _UNUSUAL.search(text) else _PIECES

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > CACHE_PIECES:
            known.clear()
        passing = {}
        for p in set(pieces).difference(known):
            n = len(self.coding.encode_ordinary(p))
            if len(p) <= CACHE_CHARS:
                known[p] = n
            else:
                passing[p] = n
        return [passing[p] if p in passing else known[p] for p in pieces]


@dataclass
class Leaf:
    """Sums of a run of pre-tokens, and the pre-tokens where they have been needed; ``start`` is their place in the text as it was kept."""

    tokens: int
    chars: int
    pieces: list[str] | None = None
    counts: list[int] | None = None
    start: int = 0


def leaf_sums(values: list[int]) -> np.ndarray:
    """Sums over runs of ``LEAF``."""
    return np.add.reduceat(np.array(values, np.int64), np.arange(0, len(values), LEAF)) if values else np.zeros(0, np.int64)


class Tree:
    """A document's pre-tokens in leaves, under sums of their tokens and characters."""

    def __init__(self, text: str, counter: Counter, kept: tuple[list[int], list[int]] | None = None):
        """From a text; ``kept`` are its leaves' (tokens, characters), whose pre-tokens are then read only where an edit comes near."""
        self.counter, self.kept_text = counter, text
        #: pre-tokens read from kept leaves, and by how many edits have made them more
        self.loaded = self.grown = 0
        if kept is None:
            pieces = counter.pattern(text).findall(text)
            self.leaves = self._cut(pieces, counter.counts(pieces))
        else:
            starts = np.cumsum([0, *kept[1]]).tolist()
            self.leaves = [Leaf(t, c, start=at) for t, c, at in zip(*kept, starts, strict=False)] or [Leaf(0, 0, [], [])]
        self._sum()

    @staticmethod
    def _cut(pieces: list[str], counts: list[int]) -> list[Leaf]:
        parts = [(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        return [Leaf(sum(c), sum(map(len, p)), p, c) for p, c in parts]

    def _sum(self) -> None:
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.tokens = [0] * (2 * self.width)
        self.chars = [0] * (2 * self.width)
        for i, leaf in enumerate(self.leaves):
            self.tokens[self.width + i], self.chars[self.width + i] = leaf.tokens, leaf.chars
        for i in range(self.width - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def _at(self, i: int) -> tuple[list[str], list[int]]:
        """A leaf's pre-tokens and their counts.  The pattern runs on in the kept text, as what follows decides where white space is cut."""
        leaf = self.leaves[i]
        if leaf.pieces is None:
            leaf.pieces, end = [], leaf.start + leaf.chars
            for m in self.counter.pattern(self.kept_text[leaf.start : end + 1]).finditer(self.kept_text, leaf.start):
                leaf.pieces.append(m[0])
                if m.end() >= end:
                    break
            leaf.counts = self.counter.counts(leaf.pieces)
            self.loaded += len(leaf.pieces)
        return leaf.pieces, leaf.counts or []

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for i in range(len(self.leaves)) for p in self._at(i)[0])

    def sums(self) -> tuple[list[int], list[int]]:
        """(tokens, characters) of the leaves that hold any: what is kept of the tree."""
        held = [leaf for leaf in self.leaves if leaf.chars]
        return [leaf.tokens for leaf in held], [leaf.chars for leaf in held]

    def _set(self, i: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[i] = Leaf(sum(counts), sum(map(len, pieces)), pieces, counts)
        at = self.width + i
        self.tokens[at], self.chars[at] = self.leaves[i].tokens, self.leaves[i].chars
        while at > 1:
            at //= 2
            self.tokens[at] = self.tokens[2 * at] + self.tokens[2 * at + 1]
            self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last one, and the characters before the leaf."""
        at, before = 1, 0
        while at < self.width:
            at *= 2
            if place - before >= self.chars[at] and self.chars[at + 1]:
                before += self.chars[at]
                at += 1
        return at - self.width, before

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters [start, end); returns how many pre-tokens were encoded again."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError("the edit is outside the text")
        first, before = self._leaf_at(max(0, start - 2))
        leaf, pieces = first, []
        kept, at = 0, before
        own, own_counts = self._at(first)
        while kept < len(own) and at + len(own[kept]) <= start - 2:
            at += len(own[kept])
            kept += 1
        shift = len(new) - (end - start)
        origin = at
        old: list[str] = own[kept:]
        old_counts: list[int] = own_counts[kept:]
        while True:
            more = leaf + 1 < len(self.leaves)
            window = "".join(old)
            changed = window[: start - origin] + new + window[end - origin :] if origin + len(window) >= end else None
            if changed is not None:
                ends_old, total = {}, origin
                for i, p in enumerate(old):
                    total += len(p)
                    ends_old[total] = i + 1
                if end == origin:
                    ends_old[origin] = 0
                pieces, joined = [], None
                pattern = self.counter.pattern(changed)
                sure = origin + len(changed) - (2 if more else 0)
                for m in pattern.finditer(changed):
                    here = origin + m.end()
                    if more and here > sure:
                        break
                    pieces.append(m[0])
                    if here >= start + len(new) and here - shift >= end and here - shift in ends_old:
                        joined = ends_old[here - shift]
                        break
                if joined is not None:
                    break
                if not more:
                    joined = len(old)
                    break
            leaf += 1
            old = old + self._at(leaf)[0]
            old_counts = old_counts + self._at(leaf)[1]
        counts = self.counter.counts(pieces)
        self.grown += len(pieces) - joined
        self._set(first, own[:kept] + pieces + old[joined:], own_counts[:kept] + counts + old_counts[joined:])
        for i in range(first + 1, leaf + 1):
            self._set(i, [], [])
        if len(self.leaves[first].pieces or []) > 8 * LEAF:
            self.leaves[first : first + 1] = self._cut(*self._at(first))
            self._sum()
        return len(pieces)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def redactions(text: str) -> list[Edit]:
    """The edits that put the kind's name for every validated personal value."""
    return [(a, b, f"[{kind}]") for a, b, kind, _ in pii.found(_SIGNS, text)]


_SIGNS = pii.Feistel(pii.DEMO_KEY)


_TREE = (T.StructField("checksum", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType())), T.StructField("leaf_chars", T.ArrayType(T.IntegerType())))
_EDIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())])


def checksum(text: str) -> int:
    """64 bits that tell the texts of one id apart."""
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def trees(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """The trees of all rows as a table: key, checksum of the text, n_pieces, n_tokens, and tokens and characters of the leaves.

    A null text counts as empty, with no tokens.  Repeated rows and null keys are rows like others.
    """
    where = path or vocabulary_path()
    out = T.StructType([docs.schema[key], *_TREE])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        counter = Counter(where)
        for whole in batches:
            for batch in W.chunks(whole):
                for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    body = body or ""
                    pieces = counter.pattern(body).findall(body)
                    tokens = leaf_sums(counter.counts(pieces))
                    yield k, checksum(body), len(pieces), int(tokens.sum()), tokens, leaf_sums(list(map(len, pieces)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), out, lambda r: 8 * len(r[4]))

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, out)


def edits_of(docs: DataFrame, edits: Callable[[str], list[Edit]] = redactions, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A table of edits: key, text and edits (start, end, text) of the rows that have any."""
    out = T.StructType([docs.schema[key], T.StructField("text", T.StringType()), T.StructField("edits", T.ArrayType(_EDIT))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for batch in W.chunks(whole):
                may = pc.match_substring_regex(W.plain(batch.column(1)), pii.MAY_HOLD).to_numpy(zero_copy_only=False) if edits is redactions else np.ones(batch.num_rows, bool)
                for i in np.flatnonzero(may).tolist():
                    body = batch.column(1)[i].as_py()
                    if body and (found := edits(body)):
                        yield batch.column(0)[i].as_py(), body, [{"start": a, "end": b, "text": t} for a, b, t in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), out, lambda r: len(r[1]))

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, out)


def _with_checksum(rows: DataFrame) -> DataFrame:
    """``rows`` with the checksum of ``text``."""
    out = T.StructType([*rows.schema.fields, T.StructField("checksum", T.LongType())])
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([checksum(t or "") for t in batch.column(at).to_pylist()], pa.int64())], names=out.names)

    return rows.mapInArrow(run, out)


def edited(edits: DataFrame, kept: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """The kept trees of edited documents after their edits: key, the old checksum as ``was``, the new text, its tree's columns, n_edits and n_reencoded.

    ``edits`` has key, text and edits: (start, end, replacement) in the old text, sorted and
    without overlap, made from the last to the first.  ``kept`` is a table of ``trees``; only rows
    that edits name, by key and checksum, are read into trees.  Rows that repeat key and text give
    one row.
    """
    where = path or vocabulary_path()
    out = T.StructType([edits.schema[key], T.StructField("was", T.LongType()), T.StructField("text", T.StringType()), *_TREE, T.StructField("n_edits", T.LongType()), T.StructField("n_reencoded", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        counter = Counter(where)
        for batch in batches:
            for k, body, wanted, was, pieces, tokens, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = Tree(body, counter, (tokens, chars))
                parts, at = [], 0
                for e in wanted:
                    parts += [body[at : e["start"]], e["text"]]
                    at = e["end"]
                now = "".join([*parts, body[at:]])
                new = sum(tree.edit(e["start"], e["end"], e["text"]) for e in reversed(wanted))
                yield k, was, now, checksum(now), pieces + tree.grown, tree.total, *tree.sums(), len(wanted), new + tree.loaded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), out, lambda r: len(r[2]))

    named = _with_checksum(edits.select(key, "text", "edits")).dropDuplicates([key, "checksum"])
    once = kept.select(F.col(key).alias("_key"), F.col("checksum").alias("_checksum"), "n_pieces", "leaf_tokens", "leaf_chars").dropDuplicates(["_key", "_checksum"])
    met = named.join(once, named[key].eqNullSafe(once["_key"]) & (named["checksum"] == once["_checksum"]))
    return met.select(key, "text", "edits", "checksum", "n_pieces", "leaf_tokens", "leaf_chars").mapInArrow(run, out)


def recount(docs: DataFrame, edits: DataFrame | None = None, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """key, n_tokens, n_pieces, n_edits, n_reencoded and n_tokens_edited for every row of ``docs``.

    The trees of all rows are written once; then the edits (those of ``edits_of`` if none are
    given) are made on the trees of the documents they name.  An empty table gives no rows, other
    columns are left.
    """
    kept = cut(trees(docs, text, key, path), "trees")
    wanted = cut(edits_of(docs, text=text, key=key) if edits is None else edits, "edits")
    done = edited(wanted, kept, key, path).select(F.col(key).alias("_key"), "was", "n_edits", "n_reencoded", F.col("n_tokens").alias("n_tokens_edited"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    met = kept.join(done, kept[key].eqNullSafe(done["_key"]) & (kept["checksum"] == done["was"]), "left")
    return met.select(key, "n_tokens", "n_pieces", zero("n_edits"), zero("n_reencoded"), F.coalesce("n_tokens_edited", "n_tokens").alias("n_tokens_edited"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens before and after its personal values are named; ``trees`` and ``recount`` state nulls, repeats and empty tables."""
    return recount(table(spark, sf_dir, "documents"))
