"""Format-preserving Feistel pseudonyms for validated personal data.

A value is found by its form and accepted by its rule (check digits, octets, calendar, ranges).
Its freely chosen part is a number below the count of all valid values of that form; a keyed
Feistel network permutes these numbers, walking on while it leaves the range, and the result is
written in the value's own format with fresh check digits.  The key and the kind of value alone
decide, so equal values have equal pseudonyms in all documents, in any grouping or letter case,
and different values of a form have different ones; ``recover`` undoes it with the key.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import batches_out, table

ROUNDS = 8
DIGITS = frozenset("0123456789")
#: For tests and the registered query only: no function takes it by itself.
DEMO_KEY = b"driftline demonstration key"
#: No value has a form without one of these.  All digits here and in the forms are 0 to 9.
MAY_HOLD = r"@|[0-9][^0-9]{0,3}[0-9][^0-9]{0,3}[0-9]"


class Feistel:
    """A keyed permutation of the numbers below any bound."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, n: int, bound: int, value: int) -> int:
        said = f"{tweak}:{bound}:{n}:{value}".encode()
        wide = hashlib.blake2b(said, key=self.key, digest_size=min(64, 16 + (bound.bit_length() + 7) // 8)).digest()
        return int.from_bytes(wide, "big")

    def _once(self, tweak: str, bound: int, a: int, value: int, back: bool) -> int:
        b = -(-bound // a)
        left, right = divmod(value, b)
        for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if n % 2:
                right = (right + sign * self._round(tweak, n, bound, left)) % b
            else:
                left = (left + sign * self._round(tweak, n, bound, right)) % a
        return left * b + right

    def permute(self, tweak: str, bound: int, value: int, back: bool = False) -> int:
        if not 0 <= value < bound:
            raise ValueError("the value is out of its range")
        if bound == 1:
            return 0
        a = math.isqrt(bound - 1) + 1
        while True:
            value = self._once(tweak, bound, a, value, back)
            if value < bound:
                return value


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _laid(digits: str, form: str) -> str:
    """``digits`` in the places of the form's digits."""
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in form)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _card(f: Feistel, text: str, back: bool) -> str | None:
    d = _digits(text)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = str(f.permute(f"card{len(d)}", 10 ** (len(d) - 1), int(d[:-1]), back)).zfill(len(d) - 1)
    return _laid(body + luhn_digit(body), text)


_AREAS, _MIDDLES = 1000, 1000


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    """Ten digits: an area and an exchange that aren't all zeros, and four more.  A country's code stays."""
    d = _digits(text)
    area, middle, line = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
    if not area or not middle or (len(d) > 10 and d[0] == "0"):
        return None
    value = f.permute("phone", (_AREAS - 1) * (_MIDDLES - 1) * 10_000, ((area - 1) * (_MIDDLES - 1) + middle - 1) * 10_000 + line, back)
    value, line = divmod(value, 10_000)
    area, middle = divmod(value, _MIDDLES - 1)
    return _laid(f"{d[:-10]}{area + 1:03}{middle + 1:03}{line:04}", text)


def _address(f: Feistel, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    value = 0
    for p in parts:
        value = value * 256 + int(p)
    value = f.permute("ip", 1 << 32, value, back)
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    area, group, serial = (int(p) for p in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    at = area - 1 - (area > 666)
    value = f.permute("ssn", 898 * 99 * 9999, (at * 99 + group - 1) * 9999 + serial - 1, back)
    value, serial = divmod(value, 9999)
    at, group = divmod(value, 99)
    return f"{at + 1 + (at >= 665):03}-{group + 1:02}-{serial + 1:04}"


_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY
#: The days up to a month's twelfth, and those after it.
_EARLY, _LATE = ([d for d in range(_DAYS) if (datetime.date.fromordinal(_FIRST_DAY + d).day > 12) == late] for late in (False, True))


def _date(f: Feistel, text: str, back: bool) -> str | None:
    """A day from 1900 to 2099, year first, or day first, or month first where it can't be day first.

    Where day first and month first are both possible a date is read day first.  A pseudonym must
    be read the same way again, so days after the twelfth are permuted among themselves, in every form.
    """
    sign = next(c for c in text if c not in DIGITS)
    parts = [int(p) for p in text.split(sign)]
    if text[4] == sign:
        year, month, day, form = *parts, "{0:04}{s}{1:02}{s}{2:02}"
    elif parts[1] <= 12:
        day, month, year, form = *parts, "{2:02}{s}{1:02}{s}{0:04}"
    else:
        month, day, year, form = *parts, "{1:02}{s}{2:02}{s}{0:04}"
    try:
        at = datetime.date(year, month, day).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= at < _DAYS:
        return None
    days = _LATE if day > 12 else _EARLY
    new = datetime.date.fromordinal(_FIRST_DAY + days[f.permute(f"date{day > 12}", len(days), bisect_left(days, at), back)])
    return form.format(new.year, new.month, new.day, s=sign)


# Letters beyond ASCII that an address may hold and that have capitals of their own, by alphabet.
_LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
#: What an address is written in, by the sign that stands for it in a form.
_ALPHABETS = {"a": "abcdefghijklmnopqrstuvwxyz", "0": "0123456789", "à": _LATIN, "α": _GREEK, "а": _CYRILLIC}
_SIGN = {c: sign for sign, letters in _ALPHABETS.items() for c in letters}


def _email(f: Feistel, text: str, back: bool) -> str | None:
    """Letters and digits of the part before the @ and of the host, each among those of its alphabet; other signs and letters stay."""
    local, _, domain = text.rpartition("@")
    host, _, top = domain.rpartition(".")
    whole = f"{local}@{host}"
    if ".." in whole or whole.startswith(".") or local.endswith(".") or host.startswith("-"):
        return None
    low = "".join(c.lower() if c.lower() in _SIGN else c for c in whole)
    form = "".join(_SIGN.get(c, c) for c in low)
    value, bound = 0, 1
    for c in low:
        if c in _SIGN:
            letters = _ALPHABETS[_SIGN[c]]
            value, bound = value * len(letters) + letters.index(c), bound * len(letters)
    value = f.permute(f"email:{form}", bound, value, back)
    out = []
    for c in reversed(low):
        if c in _SIGN:
            letters = _ALPHABETS[_SIGN[c]]
            value, n = divmod(value, len(letters))
            c = letters[n]
        out.append(c)
    new = "".join(reversed(out))
    return "".join(n.upper() if c != d else n for n, c, d in zip(new, whole, low, strict=True)) + f".{top}"


# The length of an account number by country.
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or _IBAN_LENGTHS.get(plain[:2], len(plain)) != len(plain) or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = plain[4:]
    d = _digits(body)
    if not d:
        return None
    letters = "".join("0" if c.isdigit() else c for c in body)
    new = _laid(str(f.permute(f"iban:{plain[:2]}:{letters}", 10 ** len(d), int(d), back)).zfill(len(d)), body)
    check = 98 - number(new + plain[:2] + "00") % 97
    rest = iter(f"{plain[:2]}{check:02}{new}")
    return "".join(c if c == " " else next(rest) for c in text)


def _shorter(text: str) -> list[str]:
    """An account number of its country's length where a word of capitals or digits follows it."""
    n = _IBAN_LENGTHS.get(text[:2], 0)
    while " " in text:
        text = text.rpartition(" ")[0]
        if len(text) - text.count(" ") == n:
            return [text]
    return []


@dataclass(frozen=True)
class Kind:
    name: str
    form: re.Pattern[str]
    change: Callable[[Feistel, str, bool], str | None]
    #: Shorter values to try where a value of this form fails its rule.
    shorter: Callable[[str], list[str]] = lambda text: []


#: What stands before the @: Latin, Greek and Cyrillic letters, with marks put on them, whole.  Scripts without spaces between words don't belong to it.
_LOCAL = r"A-Za-z0-9._%+\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0300-\u03ff\u0400-\u04ff-"
_BEFORE, _AFTER = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
KINDS = (
    Kind("email", re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,24}}(?![A-Za-z0-9])"), _email),
    Kind("iban", re.compile(rf"{_BEFORE}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?{_AFTER}"), _iban, _shorter),
    Kind("ip", re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])"), _address),
    Kind("date", re.compile(rf"{_BEFORE}(?:[0-9]{{4}}([-/.])[0-9]{{2}}\1[0-9]{{2}}|[0-9]{{2}}([-/.])[0-9]{{2}}\2[0-9]{{4}}){_AFTER}"), _date),
    Kind("ssn", re.compile(rf"(?<![A-Za-z0-9-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![A-Za-z0-9-])"), _ssn),
    Kind("card", re.compile(rf"{_BEFORE}(?:[0-9]{{13,19}}|[0-9]{{4}}([ -])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{1,7}}|[0-9]{{4}}([ -])[0-9]{{6}}\2[0-9]{{5}}){_AFTER}"), _card),
    Kind("phone", re.compile(rf"(?<![A-Za-z0-9+])(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{3}}\)[ .-]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_AFTER}"), _phone),
)


def found(f: Feistel, text: str, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of validated values, leftmost and longest first, without overlap."""
    hits = []
    for rank, kind in enumerate(KINDS):
        for m in kind.form.finditer(text):
            for value in (m[0], *kind.shorter(m[0])):
                new = kind.change(f, value, back)
                if new is not None:
                    hits.append((m.start(), -m.start() - len(value), rank, new))
                    break
    out, end = [], 0
    for start, minus_end, rank, new in sorted(hits):
        if start >= end:
            end = -minus_end
            out.append((start, end, KINDS[rank].name, new))
    return out


def replaced(text: str, hits: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for start, end, _, new in hits:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def recover(text: str, key: bytes) -> str:
    """The text before ``pseudonymise`` with the same key."""
    return replaced(text, found(Feistel(key), text, back=True))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, text with pseudonyms, and the (kind, start, end) of the values in the old text, for every row; a null text stays null.

    The key is the caller's to keep: who has it can undo the pseudonyms.  Repeated rows and null
    ids are rows like others, an empty table gives no rows, other columns are left.
    """
    out = T.StructType([docs.schema[id_column], T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(_SPAN))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        f = Feistel(key)
        for whole in batches:
            for batch in W.chunks(whole):
                may = pc.match_substring_regex(W.plain(batch.column(1)), MAY_HOLD).to_pylist()
                for k, body, look in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), may, strict=True):
                    hits = found(f, body) if look else []
                    yield k, replaced(body, hits) if hits else body, [{"kind": kind, "start": a, "end": b} for a, b, kind, _ in hits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), out, lambda r: len(r[1] or ""))

    return docs.select(id_column, text).mapInArrow(run, out)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms under the session's ``spark.driftline.pii.key``, or the demonstration key where it is unset, and counts by kind."""
    key = spark.conf.get("spark.driftline.pii.key", None)
    done = pseudonymise(table(spark, sf_dir, "documents"), key.encode() if key else DEMO_KEY)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return done.select("doc_id", "text", F.size("spans").cast("long").alias("n_found"), *[count(k.name).alias(f"n_{k.name}") for k in KINDS])
