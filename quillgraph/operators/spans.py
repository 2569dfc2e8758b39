"""Spans of bytes: predicates, snippets, and the interval join.

A span is half-open, a null end is open: it reaches to the end of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import byte_slice, utf8

OPEN = 9223372036854775807
SYNCED, STALE, DETACHED = 0, 1, 2
STATUS_NAMES = ("synced", "stale", "detached")


def end_or_open(end: Column) -> Column:
    return F.coalesce(end, F.lit(OPEN))


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Spans [a, b) and [c, d) share a byte."""
    return (a < end_or_open(d)) & (c < end_or_open(b))


def contains(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a <= c) & (end_or_open(d) <= end_or_open(b))


def effective_end(end: Column, source: Column) -> Column:
    return F.coalesce(end, F.octet_length(source).cast("long"))


def shift(start: Column, end: Column, delta: Column) -> tuple[Column, Column]:
    """Both ends moved, not below 0; an open end stays open."""
    return F.greatest(start + delta, F.lit(0)), F.when(end.isNotNull(), F.greatest(end + delta, F.lit(0)))


def verify_snippet(start: Column, end: Column, snippet: Column, source: Column) -> Column:
    """Whether a span still begins with its snippet, as far as the span reaches. Open spans and empty snippets always do."""
    size = F.octet_length(source)
    text = byte_slice(source, start, F.least(end, size))
    n = F.least(F.octet_length(snippet), F.octet_length(text))
    same = F.substring(text, F.lit(1), n) == F.substring(utf8(snippet), F.lit(1), n)
    return F.when(end.isNull() | (F.coalesce(F.octet_length(snippet), F.lit(0)) == 0), F.lit(True)).when(start >= size, F.lit(False)).otherwise(same)


def status_name(status: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUS_NAMES)), status.cast("int") + 1)


def indexed(entities: DataFrame) -> DataFrame:
    """Entities that an index holds: not detached, and not of an empty span."""
    return entities.where((F.col("status") != DETACHED) & (F.col("span_end").isNull() | (F.col("span_start") < F.col("span_end"))))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int = 4096) -> DataFrame:
    """Pairs of rows of one key whose spans overlap; column names of the two sides must differ but for the key.

    Spans are dealt to bins of `width` bytes, so rows meet by (key, bin) in a plain
    hash or merge join that shuffles evenly even where one document holds most rows,
    and a pair counts only in the first bin that both have. A span of more than 64
    bins, or with an open end, is one row of a second join by key alone.
    """
    a, b = left_span
    c, d = right_span
    longest = 64 * width

    def far(start: str, end: str) -> Column:
        return F.col(end).isNull() | (F.col(end) - F.col(start) > longest)

    def dealt(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        first, last = F.expr(f"`{start}` div {width}"), F.expr(f"greatest(`{start}`, `{end}` - 1) div {width}")
        return df.where(~far(start, end)).withColumn(name, F.explode(F.sequence(first, last)))

    meet = overlaps(F.col(a), F.col(b), F.col(c), F.col(d))
    near = dealt(left, a, b, "__bin").join(dealt(right, c, d, "__other").withColumnRenamed("__other", "__bin"), [key, "__bin"])
    near = near.where(meet & (F.col("__bin") == F.expr(f"greatest(`{a}`, `{c}`) div {width}"))).drop("__bin")
    # Long and open spans are few; they meet all rows of their key.
    long_left = left.where(far(a, b)).join(right, key).where(meet)
    long_right = left.where(~far(a, b)).join(right.where(far(c, d)), key).where(meet)
    columns = near.columns
    return near.unionByName(long_left.select(columns)).unionByName(long_right.select(columns))
