"""Keeping anchors in place when a source changes: edits, the fold over them, verification, cascade.

`semantics="compat"` moves spans operation by operation as they are given, with the
rules listed at `adjust`; `"exact"` maps each end through the edits' positions in the
old source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.spans import DETACHED, STALE, SYNCED, verify_snippet

#: op is I (insert), D (delete) or R (replace); at is a byte of the old source.
OPS = "array<struct<op:string,at:bigint,old_len:bigint,new_len:bigint>>"
#: A diff keeps the trace of so many edits; of more it finds the middle and divides, so memory doesn't grow with their square.
TRACED_EDITS = 1000


def adjust(start: Column, end: Column, status: Column, ops: Column) -> Column:
    """struct(span_start, span_end, status) after all operations, one after another.

    An operation before a span moves it; one inside makes it stale and changes its
    length; a deletion of all of it, or around it, detaches it; one over an edge cuts
    it. Open ends stay open. A replacement that begins within the span or anywhere
    behind it leaves it stale.
    """
    state = F.struct(start.cast("long").alias("s"), end.cast("long").alias("e"), status.cast("int").alias("st"))

    def floor(x: Column, least: Column) -> Column:
        # `greatest` skips nulls: an open end must stay null.
        return F.when(x.isNotNull(), F.greatest(x, least))

    def step(a: Column, o: Column) -> Column:
        s, e, st, at, old, new = a["s"], a["e"], a["st"], o["at"], o["old_len"], o["new_len"]
        is_open, stop, grow = e.isNull(), at + old, new - old
        worse = F.greatest(st, F.lit(STALE))

        def to(s2: Column, e2: Column, st2: Column) -> Column:
            return F.struct(s2.cast("long").alias("s"), e2.cast("long").alias("e"), st2.cast("int").alias("st"))

        insert = F.when(at <= s, to(s + new, e + new, st)).when(~is_open & (at < e), to(s, e + new, worse)).otherwise(a)
        gone = F.lit(DETACHED)
        delete = (
            F.when(stop <= s, to(F.greatest(s - old, F.lit(0)), floor(e - old, F.lit(0)), st))
            .when(~is_open & (at == s) & (stop == e), to(at, at, gone))
            .when(~is_open & (at >= s) & (stop <= e), to(s, e - old, worse))
            .when(~is_open & (at <= s) & (stop >= e), to(at, at, gone))
            .when((at < s) & (stop > s), to(at, floor(e - old - (s - at), at), worse))
            .when(~is_open & (at < e) & (stop > e), to(s, at, worse))
            .otherwise(a)
        )
        replace = (
            F.when(stop <= s, to(F.greatest(s + grow, F.lit(0)), floor(e + grow, F.lit(0)), st))
            .when((at >= s) & is_open, to(s, e, worse))
            .when((at >= s) & (stop <= e), to(s, e + grow, worse))
            .otherwise(to(s, e, worse))
        )
        return F.when(st == DETACHED, a).when(o["op"] == "I", insert).when(o["op"] == "D", delete).otherwise(replace)

    out = F.aggregate(F.coalesce(ops, F.expr(f"cast(array() as {OPS})")), state, step)
    return F.struct(out["s"].alias("span_start"), out["e"].alias("span_end"), out["st"].cast("tinyint").alias("status"))


def adjust_exact(start: Column, end: Column, status: Column, ops: Column) -> Column:
    """The same through positions in the old source: an end moves by all edits before it, and a touched span is stale."""
    ops = F.coalesce(ops, F.expr(f"cast(array() as {OPS})"))

    def moved(p: Column, is_end: bool) -> Column:
        # What lies before p stays before it; of a deletion over p only the part before it counts.
        def step(a: Column, o: Column) -> Column:
            before = (o["at"] < p) if is_end else (o["at"] <= p)
            gone = F.when(o["at"] < p, F.least(o["old_len"], p - o["at"])).otherwise(F.lit(0))
            # New text at an edge belongs to what is outside; new text over a cut edge too.
            inside = F.when(o["op"] == "I", before).otherwise(o["at"] + o["old_len"] <= p if not is_end else (o["at"] < p))
            return a + F.when(inside, o["new_len"]).otherwise(F.lit(0)) - gone

        return p + F.aggregate(ops, F.lit(0).cast("long"), lambda a, o: step(a, o).cast("long"))

    covered = F.exists(ops, lambda o: (o["op"] != "I") & (o["at"] <= start) & (o["at"] + o["old_len"] >= end))
    touched = F.exists(ops, lambda o: F.when(o["op"] == "I", (o["at"] > start) & (o["at"] < end)).otherwise((o["at"] < end) & (o["at"] + o["old_len"] > start)))
    s, e = moved(start, False), moved(end, True)
    st = F.when(status == DETACHED, status).when(covered & end.isNotNull(), F.lit(DETACHED)).when(touched, F.greatest(status, F.lit(STALE))).otherwise(status)
    return F.struct(s.cast("long").alias("span_start"), F.when(end.isNotNull(), F.greatest(s, e)).cast("long").alias("span_end"), st.cast("tinyint").alias("status"))


def merge_ops(ops: Column) -> Column:
    """A deletion and an insertion at one place, next to each other, become a replacement."""

    def step(a: Column, o: Column) -> Column:
        last = F.element_at(a, -1)
        joins = (F.size(a) > 0) & (last["op"] == "D") & (o["op"] == "I") & (last["at"] == o["at"])
        joined = F.struct(F.lit("R").alias("op"), last["at"].alias("at"), last["old_len"].alias("old_len"), o["new_len"].alias("new_len"))
        return F.when(joins, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(a, F.array(o)))

    return F.aggregate(ops, F.expr(f"cast(array() as {OPS})"), lambda a, o: F.when(F.size(a) == 0, F.array(o)).otherwise(step(a, o)).cast(OPS))


def middle_snake(a: str, b: str) -> tuple[int, int, int, int]:
    """Where shortest edit scripts from both ends meet: start and end in both texts of the common run in the middle."""
    n, m = len(a), len(b)
    size, skew = 2 * min(n, m) + 2, n - m
    ahead, back = [0] * size, [0] * size
    for d in range((n + m + 1) // 2 + 1):
        for forward in (True, False):
            mine, other = (ahead, back) if forward else (back, ahead)
            for k in range(-(d - 2 * max(0, d - m)), d - 2 * max(0, d - n) + 1, 2):
                x = mine[(k + 1) % size] if k == -d or (k != d and mine[(k - 1) % size] < mine[(k + 1) % size]) else mine[(k - 1) % size] + 1
                y = x - k
                x0, y0 = x, y
                while x < n and y < m and (a[x] == b[y] if forward else a[-1 - x] == b[-1 - y]):
                    x, y = x + 1, y + 1
                mine[k % size] = x
                z, most = skew - k, d - forward
                if (n + m) % 2 == forward and -most <= z <= most and x + other[z % size] >= n:
                    return (x0, y0, x, y) if forward else (n - x, m - y, n - x0, m - y0)
    raise AssertionError("paths from both ends always meet")


def shortest_edits(old: str, new: str, most: int | None = None, traced: int = TRACED_EDITS) -> list[tuple[str, int, int]]:
    """(kind, first character, characters) of a shortest edit script by the greedy O(ND) algorithm; positions in the old text.

    Common ends are cut off first. Beyond `traced` edits the texts are divided at their middle snake.
    Only if `most` is given the middle is one deletion and one insertion beyond so many edits.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    if not a or not b:
        return [("D", head, len(a))] * bool(a) + [("I", head, len(b))] * bool(b)
    reach, trace = {1: 0}, []
    limit = traced if most is None else most
    for d in range(min(len(a) + len(b), limit) + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    else:
        if most is not None:
            return [("D", head, len(a)), ("I", head + len(a), len(b))]
        del trace
        x, y, x2, y2 = middle_snake(a, b)
        parts = ((0, shortest_edits(a[:x], b[:y], None, traced)), (x2, shortest_edits(a[x2:], b[y2:], None, traced)))
        return [(op, head + at + i, n) for at, part in parts for op, i, n in part]
    steps, x, y = [], len(a), len(b)
    for d in range(len(trace) - 1, 0, -1):
        before, k = trace[d], x - y
        down = k == -d or (k != d and before[k - 1] < before[k + 1])
        k2 = k + 1 if down else k - 1
        x2, y2 = before[k2], before[k2] - k2
        steps.append(("I" if down else "D", x2 + head))
        x, y = x2, y2
    return [(op, at, 1) for op, at in reversed(steps)]


def edit_ops(old: str | None, new: str | None) -> list[tuple[str, int, int, int]]:
    """Operations on bytes of the old source that make it the new one: each deleted character by itself, runs of inserted ones together."""
    if old is None or new is None:
        return []
    starts = [0]
    for c in old:
        starts.append(starts[-1] + len(c.encode("utf-8", "surrogatepass")))
    out: list[tuple[str, int, int, int]] = []
    made = 0  # characters of the new text so far
    at_old = 0
    for op, at, n in shortest_edits(old, new):
        made += at - at_old
        at_old = at
        if op == "D":
            out += [("D", starts[i], starts[i + 1] - starts[i], 0) for i in range(at, at + n)]
            at_old += n
        else:
            size = len(new[made : made + n].encode("utf-8", "surrogatepass"))
            made += n
            if out and out[-1][0] == "I" and out[-1][1] == starts[at]:
                out[-1] = ("I", starts[at], 0, out[-1][3] + size)
            else:
                out.append(("I", starts[at], 0, size))
    return out


def compute_edit_ops(versions: DataFrame, old: str = "old_source", new: str = "new_source") -> DataFrame:
    """Adds `ops` to rows with an old and a new source: one diff for each pair of versions, whatever hangs on it."""

    @F.pandas_udf(OPS)
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"op": o, "at": p, "old_len": x, "new_len": y} for o, p, x, y in edit_ops(i, j)] for i, j in zip(a, b)])

    return versions.withColumn("ops", diff(F.col(old), F.col(new)))


def apply_ops(entities: DataFrame, ops: DataFrame, semantics: str = "compat") -> DataFrame:
    """Entities (doc_id, span_start, span_end, status, ...) moved by their document's `ops`."""
    move = adjust if semantics == "compat" else adjust_exact
    moved = entities.join(ops.select("doc_id", "ops"), "doc_id", "left").withColumn("__to", move(F.col("span_start"), F.col("span_end"), F.col("status"), F.col("ops")))
    return moved.select(*(F.col(f"__to.{c}").alias(c) if c in ("span_start", "span_end", "status") else F.col(c) for c in entities.columns))


def verify_pass(entities: DataFrame, sources: DataFrame, source: str = "new_source") -> DataFrame:
    """Synced entities whose snippet isn't there any more become stale."""
    rows = entities.join(sources.select("doc_id", F.col(source).alias("__source")), "doc_id", "left")
    fine = verify_snippet(F.col("span_start"), F.col("span_end"), F.col("snippet"), F.col("__source"))
    status = F.when((F.col("status") == SYNCED) & ~fine, F.lit(STALE)).otherwise(F.col("status")).cast("tinyint")
    return rows.withColumn("status", status).select(*entities.columns)


def cascade(entities: DataFrame, triples: DataFrame, exact: bool = False) -> DataFrame:
    """A subject is at least as bad as the entities that its triples name; one hop, or where exact until nothing changes."""
    edges = triples.where(F.col("object_kind") == "entity").select("doc_id", "subject", F.col("object_value").alias("object"))
    while True:
        of = entities.select("doc_id", F.col("entity_id").alias("object"), F.col("status").alias("__worst"))
        worst = edges.join(of, ["doc_id", "object"]).groupBy("doc_id", F.col("subject").alias("entity_id")).agg(F.max("__worst").alias("__worst"))
        joined = entities.join(worst, ["doc_id", "entity_id"], "left")
        changed = joined.where(F.coalesce(F.col("__worst") > F.col("status"), F.lit(False))).limit(1)
        out = joined.withColumn("status", F.greatest("status", F.coalesce("__worst", F.col("status"))).cast("tinyint")).select(*entities.columns)
        if not exact:
            return out
        # Each round but the last raises a status, and there are three levels: this ends.
        if not changed.count():
            return out
        entities = out.checkpoint()


def mark_all_stale(entities: DataFrame) -> DataFrame:
    return entities.withColumn("status", F.greatest("status", F.lit(STALE)).cast("tinyint"))


def sync(entities: DataFrame, triples: DataFrame, versions: DataFrame, semantics: str = "compat") -> DataFrame:
    """Entities of a new version: diff, move, verify, cascade. Documents without an old source have all their entities stale."""
    known, unknown = versions.where("old_source is not null"), versions.where("old_source is null").select("doc_id")
    moved = verify_pass(apply_ops(entities.join(known.select("doc_id"), "doc_id", "left_semi"), compute_edit_ops(known), semantics), known)
    return cascade(moved, triples, semantics == "exact").unionByName(mark_all_stale(entities.join(unknown, "doc_id", "left_semi")))
