"""Whole-text encoding with a word-level BPE vocabulary, one distinct word at a time.

A pre-token's ids don't depend on its neighbours, so each distinct one is encoded once
in a worker and then looked up.  Texts whose characters could be normalised or split
differently by the library's own Unicode tables, and texts that hold the vocabulary's
special strings, go through the library whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words as W

#: Distinct pre-tokens kept in a worker; beyond it the table starts anew.
CACHE_WORDS = 300_000

#: Characters for which lower-casing, NFC and the classes below are the same in every Unicode version.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_UNUSUAL = "[^\t\n\r -~¡-¬®-įı-ɏ]|<\\|"
_PIECES = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest for letters from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordBpe:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        """A lower-cased word's ids: its pre-tokens', each looked up or encoded once."""
        whole = self.pieces.get(word)
        if whole is not None:
            return whole
        out = []
        for piece in _PIECES.findall(word):
            ids = self.pieces.get(piece)
            if ids is None:
                spelled = piece.encode().decode("latin-1").translate(self.letters)
                ids = self.pieces[piece] = np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], "<u4").tobytes()
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The texts' ids; a null text has none."""
        texts = W.plain(texts)
        odd = pc.match_substring_regex(texts, _UNUSUAL)
        usual = pc.if_else(odd, "", texts)
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = {}
        found = W.split(pc.utf8_lower(usual), None)
        each = [self._ids(w.decode()) for w in found.distinct]
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        counts = lengths[found.codes]
        ids = W.gather(flat, (np.cumsum(lengths) - lengths)[found.codes], counts)
        at = (4 * np.concatenate([[0], np.cumsum(counts)])[found.offsets]).tolist()
        raw = ids.tobytes()
        out = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out
