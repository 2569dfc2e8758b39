"""Scalar text functions: bytes, UTF-16 places, escapes, slugs, digests.

Positions are bytes of UTF-8 everywhere; a span is half-open and a null end is open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a text as binary; binary, as a slice may cut a character."""
    return F.substring(utf8(text), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def whole_chars(raw: Column, at_most: int | None = None) -> Column:
    """A slice of UTF-8 bytes as text, without the bytes of a character that its end cuts."""
    if at_most is not None:
        raw = F.substring(raw, 1, at_most)
    # A text's last character has at most four bytes: drop up to three until it is valid.
    out = F.lit(None).cast("string")
    for cut in (3, 2, 1, 0):
        part = F.substring(raw, F.lit(1), F.greatest(F.octet_length(raw) - cut, F.lit(0)))
        out = F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")).otherwise(out)
    return out


def byte_to_utf16(text: Column, offset: Column) -> Column:
    """UTF-16 units before a byte offset."""
    return (F.octet_length(F.encode(whole_chars(byte_slice(text, F.lit(0), offset)), "UTF-16LE")) / 2).cast("long")


def utf16_to_byte(text: Column, offset: Column) -> Column:
    """Byte offset of a place in UTF-16 units; a place within a character counts as its start."""
    # Units are characters, and one more for each character beyond the basic plane.
    chars = F.split(text, "")
    units = lambda c: (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")
    state = lambda left, size: F.struct(left.cast("long").alias("left"), size.cast("long").alias("bytes"))
    # A character that doesn't fit leaves nothing for those behind it.
    step = F.aggregate(chars, state(offset, F.lit(0)), lambda a, c: F.when(a["left"] >= units(c), state(a["left"] - units(c), a["bytes"] + F.octet_length(c))).otherwise(state(F.lit(0), a["bytes"])))
    return step["bytes"]


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_turtle(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def slugify(text: Column) -> Column:
    """Runs of other characters than letters and digits become one dash, none at the ends; only A-Z change case."""
    return F.trim(F.regexp_replace(ascii_lower(text), r"[^\p{IsAlphabetic}\p{N}]+", "-"), F.lit("-"))


def trim_text(text: Column) -> Column:
    """Unicode white space is cut at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def source_hash(text: Column) -> Column:
    """Hexadecimal SHA-256 of the source."""
    return F.sha2(utf8(text), 256)


def sidecar_path(path: Column, extension: str = "sem", keep_suffix: bool = True) -> Column:
    """Where a document's sidecar is: beside it, after its whole name or in place of its suffix."""
    base = path if keep_suffix else F.regexp_replace(path, r"\.md$", "")
    return F.concat(base, F.lit(f".{extension}"))


def block_id(*parts: Column) -> Column:
    """Ten hexadecimal characters that depend on the parts alone, so a task that runs again makes the same id."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(10))


def note_text(kind: Column, span: Column, reason: Column) -> Column:
    return F.format_string("%s — %s (%s)", kind, span, reason)


def confidence_percent(confidence: Column) -> Column:
    return F.concat(F.round(confidence * 100).cast("int").cast("string"), F.lit("%"))
