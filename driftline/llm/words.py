"""Words of many texts at once: split and numbered by Arrow, so that Python sees only distinct words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on together.
CHUNK_BYTES = 4 << 20

#: A byte's image; a space ends a word.  Only A-Z are lower-cased; bytes of multi-byte characters stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTERS_AND_DIGITS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Split:
    """codes[offsets[i]:offsets[i + 1]] are the i-th text's words, as places in ``distinct``."""

    codes: np.ndarray
    offsets: np.ndarray
    distinct: list[bytes]


def chunks(batch: pa.RecordBatch, column: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, or one row where a text is longer."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def plain(texts: pa.Array) -> pa.Array:
    """Strings without nulls or a slice's offset."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    return pa.concat_arrays([texts]) if texts.offset else texts


def mapped(texts: pa.Array, image: bytes | None) -> pa.Array:
    """``plain`` texts with every byte replaced by its image."""
    if image is None or not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    raw = (data.to_pybytes() if data else b"").translate(image)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(raw)])


def split(texts: pa.Array, image: bytes | None = LOWER) -> Split:
    """Words between ASCII white space, after mapping bytes."""
    lists = pc.ascii_split_whitespace(mapped(plain(texts), image))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.cast(pa.large_binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary.to_pylist()
    if b"" in distinct:
        real = codes != distinct.index(b"")
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    return Split(codes, offsets, distinct)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s + n] for each (s, n), end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
