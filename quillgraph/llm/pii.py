"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their check (Luhn, ranges, calendar, country sums) are
permuted within their own format by a keyed Feistel network, so a pseudonym is as
valid as the value, and the holder of the key can undo it. What is permuted is the
value, not its notation: equal values have equal pseudonyms in every document, however
a date is written and whether or not a phone number has its country's code. The name of
a mail address is permuted in the same way, letters within their kind; a secret is not
to be undone, and becomes a keyed digest in its own alphabet. Everything else in a text
stays as it is, numbers that fail their check too.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import hashlib
import hmac
import math
import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.shared import slices

ROUNDS = 8
KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "date", "secret")


def _round(key: bytes, tweak: str, i: int, value: int, modulus: int) -> int:
    raw = hmac.digest(key, f"{tweak}|{i}|{value}".encode(), "sha256")
    return int.from_bytes(raw, "big") % modulus


def permute(key: bytes, tweak: str, value: int, size: int, undo: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network over a * b >= size, walked until it is back in range."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        # Alternating halves of sizes a and b; every round adds a keyed value of the other half.
        for i in range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS):
            sign = -1 if undo else 1
            if i % 2:
                right = (right + sign * _round(key, tweak, i, left, b)) % b
            else:
                left = (left + sign * _round(key, tweak, i, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """Check digit of the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 - i % 2)
        total += n - 9 if n > 9 else n
    return -total % 10


def refill(shape: str, digits: str) -> str:
    """The digits in the places that digits have in `shape`."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def card(key: bytes, text: str, undo: bool = False) -> str | None:
    """13 to 19 digits with a right check digit, which the pseudonym has as well."""
    digits = only_digits(text)
    body = digits[:-1]
    if luhn(body) != int(digits[-1]):
        return None
    found = f"{permute(key, f'card{len(digits)}', int(body), 10 ** len(body), undo):0{len(body)}d}"
    return refill(text, found + str(luhn(found)))


def phone(key: bytes, text: str, undo: bool = False) -> str | None:
    """A country's code and the format stay; the digits behind the code are permuted, alike with and without it."""
    digits = only_digits(text)
    if not 7 <= len(digits) <= 15:
        return None
    code = len(only_digits(re.match(r"\+\d{1,3}(?=\D)|", text)[0]))
    n = len(digits) - code
    return refill(text, digits[:code] + f"{permute(key, f'phone{n}', int(digits[code:]), 10**n, undo):0{n}d}")


def ip(key: bytes, text: str, undo: bool = False) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(p != str(int(p)) for p in text.split(".")):
        return None
    n = permute(key, "ip", int.from_bytes(bytes(parts), "big"), 1 << 32, undo)
    return ".".join(map(str, n.to_bytes(4, "big")))


def ssn(key: bytes, text: str, undo: bool = False) -> str | None:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area, group, serial = map(int, text.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    n = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    n, serial = divmod(permute(key, "ssn", n, 898 * 99 * 9999, undo), 9999)
    area, group = divmod(n, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(key: bytes, text: str, undo: bool = False) -> str | None:
    """The country and the places of letters stay; digits are permuted and the check sum is made right again."""
    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
        return None
    body = flat[4:]
    digits = only_digits(body)
    if not digits:
        return None
    body = refill(body, f"{permute(key, f'iban{flat[:2]}{len(digits)}', int(digits), 10 ** len(digits), undo):0{len(digits)}d}")
    found = iter(flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(found) for c in text)


_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST


def date(key: bytes, text: str, undo: bool = False) -> str | None:
    """A calendar date of 1900 to 2099; year first, else day first unless only month first is a date. The order and marks stay.

    Dates are permuted by value in two classes, those whose day can be a month too
    and the others: so a pseudonym is read in the order that its date was, and one
    date has one pseudonym in all notations. A day of one digit may become one of two.
    """
    parts = re.split(r"\D", text)
    y, m, d = (int(parts[k]) for k in ((0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)))
    month_first = len(parts[0]) != 4 and m > 12
    if month_first:
        m, d = d, m
    if not (1900 <= y < 2100 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    days = _days(d > 12)
    n = bisect.bisect_left(days, datetime.date(y, m, d).toordinal())
    found = datetime.date.fromordinal(days[permute(key, f"date{d > 12}", n, len(days), undo)])
    one, two = (found.month, found.day) if month_first else (found.day, found.month)
    values = (found.year, found.month, found.day) if len(parts[0]) == 4 else (one, two, found.year)
    marks = re.findall(r"\D", text)
    return f"{values[0]:0{len(parts[0])}d}{marks[0]}{values[1]:02d}{marks[1]}{values[2]:0{len(parts[2])}d}"


@lru_cache(2)
def _days(over_twelve: bool) -> list[int]:
    """Ordinals of the dates whose day is over 12, or of the others, in order."""
    return [n for n in range(_FIRST, _FIRST + _DAYS) if (datetime.date.fromordinal(n).day > 12) == over_twelve]


@lru_cache(4096)
def _kind(c: str) -> str:
    """All characters of one kind: ASCII digits, ASCII letters of a case, else the word characters of a category within 128 places; empty for marks."""
    if c.isascii():
        return next((k for k in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in k), "")
    if not c.isalnum():
        return ""
    start = ord(c) & ~127
    return "".join(x for x in map(chr, range(start, start + 128)) if x.isalnum() and unicodedata.category(x) == unicodedata.category(c))


def letters(key: bytes, tweak: str, text: str, undo: bool = False) -> str:
    """Letters and digits are permuted within their own kind, all of a text together; other characters stay."""
    kinds = list(map(_kind, text))
    value, size = 0, 1
    for c, k in zip(text, kinds):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    shape = "".join(k[0] if k else "." for k in kinds)
    value = permute(key, f"{tweak}{shape}", value, size, undo)
    out = []
    for c, k in zip(reversed(text), reversed(kinds)):
        if k:
            value, n = divmod(value, len(k))
            c = k[n]
        out.append(c)
    return "".join(reversed(out))


def email(key: bytes, text: str, undo: bool = False) -> str | None:
    """The name before the @ is permuted, one to one in every alphabet. The domain stays."""
    name, _, domain = text.rpartition("@")
    return f"{letters(key, 'mail', name, undo)}@{domain}"


def secret(key: bytes, text: str, undo: bool = False) -> str | None:
    """Hexadecimal digits stay so, other letters and digits keep their kind; can't be undone."""
    if undo:
        return None
    raw = hashlib.shake_256(key + b"secret" + text.encode()).digest(len(text))
    hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
    out = []
    for c, r in zip(text, raw):
        if hexadecimal:
            digit = "0123456789abcdef"[r % 16]
            out.append(digit.upper() if text.isupper() else digit)
        else:
            out.append(str(r % 10) if c.isdigit() else chr(97 + r % 26) if c.islower() else chr(65 + r % 26) if c.isupper() else c)
    return "".join(out)


#: One pattern; a group's name is the kind. The first alternative that fits at a place counts.
PATTERN = re.compile(
    r"(?<![\w.+%-])(?P<email>[\w.+%-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})"
    r"|(?i:(?<![A-Za-z])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)\b[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?)(?P<secret>[A-Za-z0-9+/_=-]{12,})"
    r"|(?<![A-Za-z0-9])(?P<secret2>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![\w+.-])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w-]|\.\d)"
    r"|(?<![\w+-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w.-])(?P<date>\d{4}(?P<m1>[-/.])(?:0[1-9]|1[0-2])(?P=m1)\d{2}|\d{1,2}(?P<m2>[-/.])\d{2}(?P=m2)\d{4})(?![\w-])"
    r"|(?<![\w.+-])(?P<card>\d{4}(?P<m3>[ -]?)\d{4}(?P=m3)\d{4}(?P=m3)\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\w-])"
    r"|(?<![\w.-])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])",
)
#: What a line has if the pattern fits anywhere in it: a digit, or a mark or word that a secret or address has.
_START = re.compile(r"[\d@:=]|AKIA|ASIA|gh[pousr]_|sk-")
METHODS: dict[str, Callable] = {"email": email, "phone": phone, "card": card, "ip": ip, "ssn": ssn, "iban": iban, "date": date, "secret": secret, "secret2": secret}


def pseudonymize(text: str, key: bytes, undo: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in the text given. Values that fail their check stay."""
    found: list[tuple[str, int, int]] = []

    def one(m: re.Match) -> str:
        group = next(g for g in METHODS if m[g] is not None)
        new = METHODS[group](key, m[group], undo)
        if new is None:
            return m[0]
        start, end = m.span(group)
        found.append((group.rstrip("2"), start, end))
        return m[0][: start - m.start()] + new + m[0][end - m.start() :]

    return PATTERN.sub(one, text), found


def _lines(text: str, key: bytes) -> tuple[str, list[str]]:
    """Only lines that hold what `_START` names are searched; no pattern reaches over a line's end."""
    if not _START.search(text):
        return text, []
    lines, kinds = text.split("\n"), []
    for i, line in enumerate(lines):
        if _START.search(line):
            lines[i], found = pseudonymize(line, key)
            kinds += [k for k, _, _ in found]
    return "\n".join(lines), kinds


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """The rows of `docs` with `text` pseudonymized; all columns, whatever their names, stay, and there is no shuffle.

    Defined results: null texts stay null and empty ones empty; repeated rows give
    repeated results; an empty table gives an empty one.
    """
    at, secret_key = docs.columns.index("text"), key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            new = [t if t is None else _lines(t, secret_key)[0] for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def find_pii(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text with pseudonyms, n_found, and a count of each kind.

    Defined results: a null text stays null with counts of 0; an empty text
    stays empty; a null doc_id stays null; repeated rows give repeated results;
    an empty table gives an empty one; other columns are ignored.
    """
    secret_key = key.encode()
    names = ["doc_id", "text", "n_found", *(f"n_{k}" for k in KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            both = [(None, []) if t is None else _lines(t, secret_key) for t in batch.column(1).to_pylist()]
            counts = [[f.count(k) for _, f in both] for k in KINDS]
            yield pa.record_batch([batch.column(0), pa.array([t for t, _ in both], pa.string()), pa.array([len(f) for _, f in both], pa.int64()), *(pa.array(c, pa.int64()) for c in counts)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names[2:]))
