"""Operator 8: format-preserving pseudonyms.

Numbers and dates in a text are found by their shape and checked (Luhn for cards, mod 97
for account numbers, octets, calendar days, issued ranges). Each valid value is ranked
within its format, the rank is permuted by a keyed Feistel network (cycle-walking keeps
it inside the format), and the permuted rank is written back in the same shape with its
check digits made anew. Equal values thus get equal pseudonyms in every document, and a
card stays a valid card. The key is a parameter; who holds it can invert the mapping.

Local parts of mail addresses and quoted secrets are strings of letters and digits, whose
format is the class of each character. Values that fail their check stay as they are.

Null texts stay null, empty ones empty. Extra columns are kept.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import python_tasks

ROUNDS = 10
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

_NUMBER = re.compile(
    r"""(?=[\d+(])(?<![\w.])(?:
      (?P<iso>\d{4}-\d{2}-\d{2})(?![\w-])
    | (?P<dots>\d{2}\.\d{2}\.\d{4})(?![\w])
    | (?P<slash>\d{2}/\d{2}/\d{4})(?![\w/])
    | (?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\w|\.\d)
    | (?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])
    | (?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[.-])\d{3}[.-]\d{4})(?![\w-])
    | (?P<intl>\+\d{1,3}(?:[ .-]?\d{2,4}){2,4})(?!\w)
    | (?P<card>\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w)
    )""",
    re.X | re.A,
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)", re.A)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_SECRET = re.compile(r"""(?i:token|secret|key|password|passwd)["']?\s*[=:]\s*["']([A-Za-z0-9_\-+/.]{8,})["']""")
_DIGIT = re.compile(r"\d")


class Permuter:
    """Keyed permutations of 0..size-1, one for each format."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.permute = functools.lru_cache(50_000)(self._permute)

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        data = tweak + bytes([i]) + half.to_bytes(64, "big")
        out = b"".join(hashlib.blake2b(data, key=self.key, digest_size=64, salt=bytes([n])).digest() for n in range(bits // 512 + 1))
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _permute(self, value: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return value
        bits = max(2, (size - 1).bit_length())
        low = bits // 2
        while True:  # walks on until it is back inside; the mean number of steps is under two
            left, right = value >> low, value & ((1 << low) - 1)
            for i in range(0, ROUNDS, 2):
                left ^= self._round(tweak, i, right, bits - low)
                right ^= self._round(tweak, i + 1, left, low)
            value = left << low | right
            if value < size:
                return value

    def characters(self, s: str, kind: str) -> str:
        """Permute a string within the class of each of its characters."""
        hexadecimal = kind == "secret" and next((a for a in _HEX if {*s} <= {*a}), None)
        classes = [hexadecimal or _CLASS.get(c) for c in s]
        value, size = 0, 1
        for c, k in zip(s, classes, strict=True):
            if k:
                value, size = value * len(k) + k.index(c), size * len(k)
        if size.bit_length() > 500:  # longer than the rounds' input: in parts
            at = len(s) // 2
            return self.characters(s[:at], kind) + self.characters(s[at:], kind)
        shape = "".join(k[0] if k else c for c, k in zip(s, classes, strict=True))
        value, out = self.permute(value, size, f"{kind}:{shape}".encode()), []
        for c, k in zip(reversed(s), reversed(classes), strict=True):
            if k:
                value, i = divmod(value, len(k))
                c = k[i]
            out.append(c)
        return "".join(reversed(out))


_CLASS = {c: k for k in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in k}
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


def luhn_digit(body: str) -> str:
    """The check digit that makes ``body`` valid."""
    total = sum(int(c) if i % 2 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _day(p: Permuter, year: str, month: str, day: str) -> dt.date | None:
    try:
        n = dt.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= n <= LAST_DAY:
        return None
    return dt.date.fromordinal(FIRST_DAY + p.permute(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, b"day"))


def _number(p: Permuter, kind: str, s: str) -> str | None:
    """The pseudonym, or None where the value isn't valid."""
    if kind == "iso":
        d = _day(p, s[:4], s[5:7], s[8:])
        return d and f"{d:%Y-%m-%d}"
    if kind == "dots":
        d = _day(p, s[6:], s[3:5], s[:2])
        return d and f"{d:%d.%m.%Y}"
    if kind == "slash":
        d = _day(p, s[6:], s[:2], s[3:5])
        return d and f"{d:%m/%d/%Y}"
    if kind == "ip":
        parts = [*map(int, s.split("."))]
        if max(parts) > 255:
            return None
        n = p.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip")
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "ssn":
        if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000":
            return None
        while True:  # the issued ranges are a subset of the shape: walk on to the next issued one
            s = p.characters(s, "ssn")
            if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000":
                return s
    if kind == "card":
        digits = s.replace(" ", "").replace("-", "")
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = p.characters(digits[:-1], "card")
        new = iter(body + luhn_digit(body))
        return "".join(next(new) if c.isdigit() else c for c in s)
    if not 8 <= sum(c.isdigit() for c in s) <= 15:
        return None
    head = re.match(r"\+\d{1,3}(?=[ .(-])", s)  # the country's code stays
    at = head.end() if head else 0
    return s[:at] + p.characters(s[at:], "phone")


def _account(p: Permuter, s: str) -> str | None:
    if mod97(s) != 1:
        return None
    body = p.characters(s[4:], "account")
    return f"{s[:2]}{98 - mod97(s[:2] + '00' + body):02d}{body}"


def findings(text: str, p: Permuter) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of every valid value, in order, none overlapping."""
    out: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            out.append((local.start(), domain.end(), "mail", p.characters(local.group(), "mail") + "@" + domain.group()))
        at = text.find("@", at + 1)
    out += [(m.start(1), m.end(1), "secret", p.characters(m.group(1), "secret")) for m in _SECRET.finditer(text)]
    if _DIGIT.search(text):
        found = [(m.start(), m.end(), m.lastgroup, _number(p, m.lastgroup, m.group())) for m in _NUMBER.finditer(text)]
        found += [(m.start(), m.end(), "account", _account(p, m.group())) for m in _IBAN.finditer(text)]
        out += [f for f in found if f[3] is not None]
    out.sort(key=lambda f: (f[0], -f[1]))
    kept, end = [], 0
    for f in out:
        if f[0] >= end:
            kept.append(f)
            end = f[1]
    return kept


def replaced(text: str | None, p: Permuter) -> tuple[str | None, list[str]]:
    """The text with its pseudonyms, and the kinds replaced."""
    if not text:
        return text, []
    found, out, at = findings(text, p), [], 0
    if not found:
        return text, []
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [f[2] for f in found]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", kinds: str = "kinds") -> DataFrame:
    """``docs`` with the text's values replaced, and a column of the kinds replaced."""
    python_tasks(docs.sparkSession)
    at = docs.columns.index(text)
    schema = StructType([*docs.schema, StructField(kinds, ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(key)
        for b in batches:
            done = [replaced(t, p) for t in b.column(at).to_pylist()]
            columns = [*b.columns, pa.array([k for _, k in done], pa.list_(pa.string()))]
            columns[at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, kinds])

    return docs.mapInArrow(run, schema)
