"""Secret scans: fixed patterns, and a linear-chain conditional random field over words.

Words stand between white space.  Each is tagged outside, begin or inside from its shape, the
shapes of its two neighbours, whether a telling name stands up to ``REACH`` words before or after
it, and features of the whole text, and the tags are decoded by Viterbi.  The field is trained on generated lines and on at most ``SAMPLE_ROWS`` texts whose
words the fixed patterns label.

A word whose tag scores stay so far below "outside" that no choice of neighbours can make up
for it is outside in the best path; Viterbi therefore runs over the stretches between such words
only, with the same result as over the whole text.
"""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import batches_out, table

KINDS = ("assign", "access", "hex", "crf")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MAY_HOLD = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"

SAMPLE_ROWS = 300
GENERATED = 1000
#: Of a sampled text: stretches, and characters of a stretch.
MOST_STRETCHES, MOST_CHARS = 20, 4000
#: Words between which a telling name counts.
REACH = 3
ROUNDS, RATE, DECAY = 100, 0.1, 1e-3
#: Distinct words whose scores a worker keeps.
CACHE_WORDS = 200_000

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CORE = re.compile(r"[A-Za-z0-9+/_.~-]+")
_KEY = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|api_?key|credential|private|access", re.IGNORECASE)
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}")
_TURNS = re.compile(r"[a-z][A-Z]")
_SYMBOLS = re.compile(r"[!@#$%^&*+=~?_]")
_PLAIN = r"^[\pL'’]{1,24}[.,;:!?]{0,3}$"
#: Final punctuation that says nothing of a word's shape.
_STOPS = ".,;!?"
#: Words, but for those of _KEY and "www.", whose features are bias and plain alone.
_BARE = r"^(?:[A-Za-z]{2,15}[.,;!?]{0,3}|[A-Za-zÀ-ÖØ-öø-ɏ]{1,15}|[A-Za-zÀ-ÖØ-öø-ɏ]{0,6}[A-Za-z]{2}[A-Za-zÀ-ÖØ-öø-ɏ]{0,6}[.,;!?])$"
#: Letters of a word from which on their order counts, and the share of all pairs of letters that makes a pair usual.
LONG, USUAL = 16, 4e-4
_VOWELS = set("aeiouyAEIOUY")
_SELDOM = set("jqvwxzkJQVWXZK")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost without overlap in each kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return out


def ordered(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


FEATURES = (
    "bias plain plain_long key key_ends assign_inside sign_only sign_ends core_8 core_16 core_24 core_40 digits_only mixed switches "
    "hex upper_lower entropy_3 entropy_35 entropy_4 few_vowels at_sign url dots_only_number long_prefix quoted "
    "consonants seldom case_turns odd_pairs odder_pairs short_mixed symbols_inside uuid"
).split()
_AT = {f: i for i, f in enumerate(FEATURES)}
FILE_FEATURES = ("mostly_plain", "odd_words")


def core(word: str) -> tuple[int, int]:
    """Where the longest run of secret letters stands in a word, after any sign of assignment."""
    at = max(word.rfind("="), word.rfind(":")) if not word.endswith(("=", ":")) else -1
    runs = [(m.start(), m.end()) for m in _CORE.finditer(word) if m.start() > at] or [(m.start(), m.end()) for m in _CORE.finditer(word)]
    return max(runs, key=lambda r: (r[1] - r[0], -r[0])) if runs else (0, len(word))


_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def secret_part(word: str) -> tuple[int, int]:
    """Where the value stands in a word: behind a sign of assignment, within quotes, brackets and final punctuation."""
    inner = word.rstrip("\"'`)]}>.,;:!?")
    at = max(inner.rfind("="), inner.rfind(":"))
    at = 0 if at < 0 or at + 1 >= len(inner) or not inner[:at].replace("_", "").replace("-", "").strip("\"'").isalpha() else at + 1
    start = at + len(inner[at:]) - len(inner[at:].lstrip("\"'`([{<"))
    return (start, len(inner)) if len(inner) > start else core(word)


def usual_pairs(words: Iterable[str]) -> frozenset[str]:
    """Pairs of letters that words of letters have often."""
    seen = Counter(x for w in words if w.isalpha() and len(w) < LONG for x in map(str.__add__, w.lower(), w.lower()[1:]))
    return frozenset(x for x, n in seen.items() if n >= USUAL * seen.total())


def features(word: str, usual: frozenset[str] = frozenset()) -> list[int]:
    """The features of a word's shape; ``usual`` pairs of letters are those of ordinary words."""
    out = ["bias"]
    if _KEY.search(word):
        out.append("key")
        if word.rstrip("\"'").endswith(("=", ":")):
            out.append("key_ends")
    if re.search(r"[=:][\"']?[^\s\"']{8,}", word):
        out.append("assign_inside")
    if not any(c.isalnum() for c in word):
        out.append("sign_only")
    elif word.endswith(("=", ":")):
        out.append("sign_ends")
    if word[:1] in "\"'`" and len(word) > 8:
        out.append("quoted")
    a, b = core(word)
    body = word[a:b].strip(".")
    n, letters_alone = len(body), word.rstrip(_STOPS).isalpha()
    if n and body.isalpha():
        out.append("plain_long" if n >= LONG else "plain")
        if n >= LONG:
            if sum(c in _VOWELS for c in body) * 5 < n:
                out.append("few_vowels")
            if _CONSONANTS.search(body.lower()):
                out.append("consonants")
            if sum(c in _SELDOM for c in body) * 6 >= n:
                out.append("seldom")
            if len(_TURNS.findall(body)) >= 3:
                out.append("case_turns")
            low = body.lower()
            odd = sum(x not in usual for x in map(str.__add__, low, low[1:])) / (n - 1) if usual else 0
            if odd >= 0.15:
                out.append("odd_pairs" if odd < 0.3 else "odder_pairs")
    if "@" in word:
        out.append("at_sign")
    if "://" in word or word.startswith("www."):
        out.append("url")
    if n >= 8 and not letters_alone:
        out.append("core_40" if n >= 40 else "core_24" if n >= 24 else "core_16" if n >= 16 else "core_8")
        digits = sum(c.isdigit() for c in body)
        letters = sum(c.isalpha() for c in body)
        if not letters:
            out.append("dots_only_number" if "." in body else "digits_only")
        elif digits:
            out.append("mixed")
            if sum(x.isdigit() != y.isdigit() for x, y in zip(body, body[1:], strict=False)) >= 4:
                out.append("switches")
            if all(c in string.hexdigits for c in body):
                out.append("hex")
            if _UUID.search(word):
                out.append("uuid")
        if letters and body != body.lower() and body != body.upper() and body[1:] != body[1:].lower():
            out.append("upper_lower")
        bits = -sum(c / n * math.log2(c / n) for c in Counter(body).values())
        out.append("entropy_4" if bits >= 4 else "entropy_35" if bits >= 3.5 else "entropy_3")
        if letters and digits and sum(c in _VOWELS for c in body) * 5 < letters:
            out.append("few_vowels")
        if re.match(r"[A-Za-z]{2,8}[_-]", body) and digits:
            out.append("long_prefix")
    if not letters_alone:
        a, b = secret_part(word)
        value = word[a:b]
        kinds = (value != value.upper()) + (value != value.lower()) + any(c.isdigit() for c in value)
        if len(value) >= 6 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            if kinds == 3 and len(value) < 16:
                out.append("short_mixed")
            if _SYMBOLS.search(value[:-1]) and "@" not in value[1:]:
                out.append("symbols_inside")
    return [_AT[f] for f in out]


def file_features(n_words: int, n_odd: int) -> tuple[float, float]:
    return (1.0, 0.0) if n_odd * 20 <= n_words else (0.0, 1.0)


@dataclass
class Field:
    """Tag weights: own, previous and next word's features, a telling name's distance, the file's, and between tags."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    near: np.ndarray
    file: np.ndarray
    between: np.ndarray
    usual: frozenset[str]

    def margin(self) -> float:
        return 2 * float(self.between.max() - self.between.min())


#: Places before and after a word where a telling name counts; the next ones are features of the neighbours.
SHIFTS = (*range(2, REACH + 1), *range(-REACH, -1))


def name_near(named: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word, whether a telling name stands at each of ``SHIFTS`` places before it, in the same text."""
    out = np.zeros((len(named), len(SHIFTS)), bool)
    for i, k in enumerate(SHIFTS):
        there, here = (slice(None, -k), slice(k, None)) if k > 0 else (slice(-k, None), slice(None, k))
        out[here, i] = named[there] & (owner[there] == owner[here])
    return out


def viterbi(scores: np.ndarray, between: np.ndarray) -> list[int]:
    """The best tags of a stretch whose neighbours are outside."""
    best = scores[0] + between[OUTSIDE]
    back = []
    for row in scores[1:]:
        ways = best[:, None] + between
        back.append(ways.argmax(0))
        best = ways.max(0) + row
    tags = [int((best + between[:, OUTSIDE]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(lines: list[tuple[list[str], list[int]]]) -> Field:
    """Maximum likelihood by gradient ascent over all lines at once, forward-backward in log space."""
    lines = [(w, t) for w, t in lines if w]
    usual = usual_pairs(w.strip(".,") for words, tags in lines for w, t in zip(words, tags, strict=True) if t == OUTSIDE)
    count, longest, k = len(lines), max(len(w) for w, _ in lines), len(FEATURES)
    x = np.zeros((count, longest, k), np.float32)
    y = np.zeros((count, longest), np.int64)
    live = np.zeros((count, longest), bool)
    near = np.zeros((count, longest, len(SHIFTS)), np.float32)
    file = np.zeros((count, len(FILE_FEATURES)), np.float32)
    for i, (words, tags) in enumerate(lines):
        for j, (w, t) in enumerate(zip(words, tags, strict=True)):
            x[i, j, features(w, usual)] = 1
            y[i, j] = t
            live[i, j] = True
        near[i, : len(words)] = name_near(np.array([bool(_KEY.search(w)) for w in words]), np.zeros(len(words), int))
        file[i] = file_features(len(words), sum(not re.fullmatch(r"[^\W\d_]+[.,;:!?]*", w) for w in words))
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[:, 1:], after[:, :-1] = x[:, :-1], x[:, 1:]
    parts = [p.reshape(-1, k) for p in (x, before, after)] + [near.reshape(-1, len(SHIFTS)), np.repeat(file, longest, 0)]
    stacked = np.concatenate(parts, 1)
    weights, between = np.zeros((stacked.shape[1], 3)), np.zeros((3, 3))
    gold = np.eye(3)[y] * live[..., None]
    gold_between = np.zeros((3, 3))
    np.add.at(gold_between, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(between), np.zeros_like(between)]
    for step in range(1, ROUNDS + 1):
        scores = (stacked @ weights).reshape(count, longest, 3)
        forward = [scores[:, 0]]
        for j in range(1, longest):
            ahead = _log_sum(forward[-1][:, :, None] + between, 1) + scores[:, j]
            forward.append(np.where(live[:, j, None], ahead, forward[-1]))
        total = _log_sum(forward[-1], 1)
        backward = np.zeros((count, 3))
        marginal, expected = np.zeros((count, longest, 3)), np.zeros((3, 3))
        for j in range(longest - 1, -1, -1):
            marginal[:, j] = np.exp(forward[j] + backward - total[:, None]) * live[:, j, None]
            if j:
                into = backward + scores[:, j]
                pair = np.exp(forward[j - 1][:, :, None] + between + into[:, None, :] - total[:, None, None])
                expected += (pair * live[:, j, None, None]).sum(0)
                backward = np.where(live[:, j, None], _log_sum(between + into[:, None, :], 2), backward)
        slopes = stacked.T @ (gold - marginal).reshape(-1, 3) / count - DECAY * weights, (gold_between - expected) / count - DECAY * between
        for at, (value, slope) in enumerate(zip((weights, between), slopes, strict=True)):
            m, v = moments[2 * at], moments[2 * at + 1]
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(*np.split(weights, [k, 2 * k, 3 * k, 3 * k + len(SHIFTS)]), between, usual)


def generated(n: int = GENERATED, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Lines with and without secrets, for training: invented words, numbers, addresses, and keys of usual forms."""
    r = random.Random(seed)
    pick = lambda letters, a, b: "".join(r.choices(letters, k=r.randint(a, b)))
    syllables = ("b c d f g h l m n p r s t v w z ch sch st tr pl".split(), "a e i o u ei au ie ou".split(), ["", "", "", "n", "r", "s", "l", "t", "nd", "rt", "ng", "cht", "lts"])
    stem = lambda a, b: "".join("".join(r.choice(part) for part in syllables) for _ in range(r.randint(a, b)))
    text = lambda: r.choice([stem, stem, lambda a, b: stem(a, b).capitalize()])(1, 4) + r.choice(["", "", "", "", ",", "."])
    mixed = string.ascii_letters + string.digits
    other = [
        lambda: pick(string.digits, 1, 16),
        lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 255)}" + r.choice(["", "", ".", "!!"]),
        lambda: f"{stem(1, 3)}.{r.randint(1, 99)}@{stem(1, 3)}{r.choice(['', str(r.randint(1, 9))])}.example.{r.choice(['org', 'com'])}" + r.choice(["", ",", "."]),
        lambda: f"https://{stem(1, 3)}.org/{stem(1, 2)}/{r.randint(1, 999)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: f"({r.randint(200, 999)})",
        lambda: f"555-{r.randint(1000, 9999)}",
        lambda: stem(1, 4) + r.choice(["", "", ",", "."]) + r.choice(["###", "&&&", "***", "%%%", "$$$", "!!"]),
        lambda: stem(4, 8),
        lambda: stem(5, 8).capitalize(),
        lambda: f"{stem(1, 2)}_{stem(1, 3)}",
        lambda: f"{stem(1, 2)}-{stem(1, 3)}",
        lambda: stem(1, 2) + "".join(stem(1, 2).capitalize() for _ in range(r.randint(1, 3))),
        lambda: f"{stem(1, 2)}_{stem(1, 2)}".upper(),
        lambda: f"{stem(1, 2).capitalize()}{r.randint(1, 99)}",
        lambda: r.choice(["GB", "DE", "FR"]) + pick(string.digits, 2, 2),
        lambda: pick(string.digits, 4, 4),
        lambda: f"{r.randint(100, 899)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
        lambda: f"{r.randint(1, 99)}.{r.randint(0, 99)}.{r.randint(0, 9)}",
        lambda: f"{r.randint(1, 9)},{pick(string.digits, 3, 3)}.{pick(string.digits, 2, 2)}",
        lambda: "|",
        lambda: pick(string.ascii_uppercase, 2, 6),
    ]
    letters = [lambda: pick(string.ascii_letters, 18, 40), lambda: pick(string.ascii_lowercase, 20, 40), lambda: pick(string.ascii_uppercase, 20, 40)]
    keys = [
        lambda: pick(string.hexdigits[:16], 32, 64),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16),
        lambda: pick(mixed, 20, 48),
        lambda: pick(string.ascii_lowercase + string.digits, 20, 40),
        lambda: pick(mixed + "+/", 40, 44),
        lambda: pick(mixed + "-_", 30, 44),
        lambda: r.choice(["ghp_", "sk-", "xoxb-", "pk_live_"]) + pick(mixed, 24, 40),
        lambda: "-".join(pick("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
        lambda: r.choice(letters)(),
        lambda: r.choice(letters)(),
    ]
    # a short one is told from other words by the name beside it, or by its mixture
    short = [
        lambda: "".join(r.sample(pick(string.ascii_lowercase, 3, 5) + pick(string.ascii_uppercase, 1, 3) + pick(string.digits, 2, 4) + pick("!@#$%^&*+?", 1, 2), k=7)),
        lambda: stem(1, 2).capitalize() + r.choice("!#$%&*?") + pick(string.digits, 2, 4),
        lambda: pick(mixed, 8, 14),
        lambda: stem(2, 3) + pick(string.digits, 2, 4),
    ]
    wrap = [lambda s: s, lambda s: s, lambda s: f'"{s}"', lambda s: f"'{s}'", lambda s: f"{s},", lambda s: f"{s}."]
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_token", "SECRET_KEY", "Token", "credential", "pwd", "passphrase", "passcode"]
    verbs = ["is", "ist", "est", "es", "was", "of", "now", "here", "with"]
    out = []
    for i in range(n):
        words = [r.choice(other)() if r.random() < 0.15 else text() for _ in range(r.randint(3, 24))]
        tags = [OUTSIDE] * len(words)
        if i % 2:
            at, name = r.randint(0, len(words)), r.choice(names)
            alone = r.random() < 0.3
            value = r.choice(wrap)(r.choice(keys if alone or r.random() < 0.5 else short)())
            forms = [[value]] if alone else [[name, "=", value], [f"{name}:", value], [f"{name}={value}"], [name, ":", value], [name, value], [name, r.choice(verbs), value], [name, r.choice(verbs), r.choice(verbs), value], [value, "as", "the", name]]
            new = r.choice(forms)
            place = new.index(value) if value in new else 0
            words[at:at] = new
            tags[at:at] = [BEGIN if j == place else OUTSIDE for j in range(len(new))]
        elif r.random() < 0.4:
            words.insert(r.randint(0, len(words)), r.choice(names) + r.choice(["", "", ".", ","]))
            tags.append(OUTSIDE)
        out.append((words, tags))
    return out


def labelled(texts: list[str], around: int = 24) -> list[tuple[list[str], list[int]]]:
    """Stretches of words of whole texts, labelled by the fixed patterns: those with matches, and one more of each text, chosen by its checksum.

    Of a text's stretches the first ``MOST_STRETCHES`` that hold no more than ``MOST_CHARS`` characters are taken.
    """
    out = []
    for text in texts:
        marks = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] + [(a, b) for k, a, b in base_spans(text) if k != "assign"]
        marks.sort()
        ends = np.maximum.accumulate([b for _, b in marks]).tolist()
        words, tags = [], []
        for m in _WORD.finditer(text):
            words.append(m[0])
            # the last mark that begins before the word's end, and the farthest end up to it
            at = bisect_left(marks, (m.end(), 0))
            hit = at > 0 and ends[at - 1] > m.start()
            tags.append((INSIDE if tags and tags[-1] != OUTSIDE else BEGIN) if hit else OUTSIDE)
        more = around * (zlib.crc32(text.encode()) % max(1, -(-len(words) // around)))
        taken = 0
        for at in range(0, len(words), around):
            part = words[at : at + around]
            if taken < MOST_STRETCHES and (any(tags[at : at + around]) or at == more) and sum(map(len, part)) <= MOST_CHARS:
                out.append((part, tags[at : at + around]))
                taken += 1
    return out


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Field:
    """A field from generated lines and the ``sample_rows`` texts with the smallest hash of their id.

    The texts are cut into stretches on the workers; a bounded number of bounded size reaches the driver.
    """
    order = F.xxhash64("k")
    ids = docs.select(F.col(key).alias("k")).filter("k is not null").distinct().orderBy(order, "k").limit(sample_rows)
    # at most sample_rows ids
    chosen = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").join(F.broadcast(ids), "k").groupBy("k").agg(F.min("t").alias("t"))
    out = T.StructType([chosen.schema["k"], T.StructField("nth", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.IntegerType()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for nth, (words, tags) in enumerate(labelled([body])):
                    yield k, nth, words, tags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), out)

    lines = chosen.mapInArrow(run, out).orderBy(order, "k", "nth").collect()
    return train(generated() + [(list(r["words"]), list(r["tags"])) for r in lines])


class Scanner:
    """Spans of whole texts."""

    def __init__(self, field: Field):
        self.field = field
        self.margin = field.margin()
        self.rows: dict[bytes, np.ndarray] = {}
        bare = [_AT["bias"], _AT["plain"]]
        self.plain = np.concatenate([w[bare].sum(0) for w in (field.own, field.before, field.after)])

    def _row(self, word: bytes) -> np.ndarray:
        row = self.rows.get(word)
        if row is None:
            f = features(word.decode(), self.field.usual)
            row = self.rows[word] = np.concatenate([w[f].sum(0) for w in (self.field.own, self.field.before, self.field.after)])
        return row

    def tagged(self, texts: pa.Array) -> dict[int, list[tuple[int, int]]]:
        """For each text with tagged words, (place, tag) of these."""
        found = W.split(texts, None)
        if len(self.rows) > CACHE_WORDS:
            self.rows = {}
        if not len(found.codes):
            return {}
        distinct = pa.array(found.distinct, pa.large_binary()).cast(pa.large_string())
        key = pc.match_substring_regex(distinct, f"(?i:{_KEY.pattern})")
        plain = pc.and_not(pc.match_substring_regex(distinct, _PLAIN), key).to_numpy(zero_copy_only=False)
        bare = pc.and_not(pc.match_substring_regex(distinct, _BARE), pc.or_(key, pc.starts_with(distinct, "www."))).to_numpy(zero_copy_only=False)
        rows = np.tile(self.plain, (len(bare), 1))
        other = np.flatnonzero(~bare)
        if len(other):
            rows[other] = [self._row(found.distinct[i]) for i in other.tolist()]
        per_word = rows[found.codes]
        sizes = np.diff(found.offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        n_odd = np.bincount(owner, ~plain[found.codes], len(sizes))
        of_file = np.array([file_features(n, o) for n, o in zip(sizes, n_odd, strict=True)]) @ self.field.file
        scores = per_word[:, :3] + of_file[owner]
        joined = owner[1:] == owner[:-1]
        scores[1:][joined] += per_word[:-1, 3:6][joined]
        scores[:-1][joined] += per_word[1:, 6:][joined]
        named = key.to_numpy(zero_copy_only=False)[found.codes]
        if named.any():
            scores += name_near(named, owner) @ self.field.near
        doubtful = scores[:, 1:].max(1) - scores[:, OUTSIDE] > -self.margin
        at = np.flatnonzero(doubtful)
        if not len(at):
            return {}
        breaks = np.flatnonzero((np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])) + 1
        out: dict[int, list[tuple[int, int]]] = {}
        for stretch in np.split(at, breaks):
            part = scores[stretch]
            if len(stretch) == 1:
                tags = [int((part[0] + self.field.between[OUTSIDE] + self.field.between[:, OUTSIDE]).argmax())]
            else:
                tags = viterbi(part, self.field.between)
            if any(tags):
                o = int(owner[stretch[0]])
                out.setdefault(o, []).extend((int(p - found.offsets[o]), t) for p, t in zip(stretch, tags, strict=True) if t)
        return out

    def spans(self, texts: pa.Array) -> Iterator[list[tuple[str, int, int]]]:
        """Every text's spans, of the fixed patterns and, where none of these overlaps, of the field."""
        texts = W.plain(texts)
        tagged = self.tagged(texts)
        hold = pc.match_substring_regex(texts, MAY_HOLD).to_numpy(zero_copy_only=False)
        for i in range(len(texts)):
            if not hold[i] and i not in tagged:
                yield []
                continue
            text = texts[i].as_py()
            spans = base_spans(text) if hold[i] else []
            if i in tagged:
                taken = sorted((a, b) for _, a, b in spans)
                words = [m.span() for m in _WORD.finditer(text)]
                merged: list[list[int]] = []
                last = -2
                for place, tag in tagged[i]:
                    a, b = words[place]
                    x, y = secret_part(text[a:b])
                    if tag == INSIDE and place == last + 1:
                        merged[-1][1] = a + y
                    else:
                        merged.append([a + x, a + y])
                    last = place
                spans += [("crf", a, b) for a, b in merged if b > a and not any(x < b and a < y for x, y in taken)]
            yield spans


def scan(docs: DataFrame, field: Field, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and an array of (kind, start, end) for every row; a null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([docs.schema[key], T.StructField("spans", T.ArrayType(span))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        scanner = Scanner(sent.value)
        for whole in batches:
            for batch in W.chunks(whole):
                for k, spans in zip(batch.column(0).to_pylist(), scanner.spans(batch.column(1)), strict=True):
                    yield k, [{"kind": a, "start": b, "end": c} for a, b, c in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), out)

    return docs.select(key, text).mapInArrow(run, out)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """A text with each span, overlapping ones merged, replaced by ``[SECRET]``."""
    out, at = [], 0
    end = -1
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a < end:
            if b > end:
                end = at = b
            continue
        out += [text[at:a], "[SECRET]"]
        end = at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with every span of every text replaced; null texts stay null, other columns are as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(field or fit(docs, text))
    at = docs.columns.index(text)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value)
        for whole in batches:
            for batch in W.chunks(whole, at):
                column = batch.column(at)
                changed = {i: redacted(column[i].as_py(), s) for i, s in enumerate(scanner.spans(column)) if s}
                if changed:
                    texts = column.to_pylist()
                    for i, t in changed.items():
                        texts[i] = t
                    column = pa.array(texts, column.type)
                yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, schema)


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("crf").alias("n_crf")
    )


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans: a null text has none, repeated rows are scanned one by one, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return digest(scan(docs, fit(docs)))


