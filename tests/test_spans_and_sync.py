"""Interval join against a nested loop, the fold's golden vectors, diff by reconstruction."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.operators import blocks, graph, spans, sync
from quillgraph.plans.work import work_dir
from quillgraph.streaming.sessions import SessionStore, debounce_most, fire_times, replay


def test_interval_join_is_the_nested_loop(spark):
    rng = random.Random(3)
    end = lambda s: None if rng.random() < 0.1 else s + rng.choice([0, 1, 5, 40, 5000])
    left = [(str(rng.randint(0, 2)), i, s, end(s)) for i in range(60) for s in [rng.randint(0, 300)]]
    right = [(str(rng.randint(0, 2)), i, s, end(s)) for i in range(60) for s in [rng.randint(0, 300)]]
    a = spark.createDataFrame(left, "doc_id string, l long, a long, b long")
    b = spark.createDataFrame(right, "doc_id string, r long, c long, d long")
    big = float("inf")
    top = lambda e: big if e is None else e
    expected = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < top(y[3]) and y[2] < top(x[3]))
    found = sorted((r["l"], r["r"]) for r in spans.interval_join(a, b, "doc_id", ("a", "b"), ("c", "d"), width=16).collect())
    assert found == expected


CASES = [
    (6, 11, [("I", 0, 0, 1)] * 3, (9, 14, 0)),
    (6, 11, [("I", 6, 0, 3)], (9, 14, 0)),
    (6, 11, [("I", 8, 0, 3)], (6, 14, 1)),
    (6, 11, [("I", 11, 0, 3)], (6, 11, 0)),
    (9, 14, [("D", 0, 1, 0), ("D", 1, 1, 0), ("D", 2, 1, 0)], (6, 11, 0)),
    (6, 11, [("D", 6, 5, 0)], (6, 6, 2)),
    (6, 11, [("D", k, 1, 0) for k in range(6, 11)], (6, 8, 1)),
    (6, 11, [("D", 4, 10, 0)], (4, 4, 2)),
    (6, 11, [("D", 4, 4, 0)], (4, 5, 1)),
    (6, 11, [("D", 9, 6, 0)], (6, 9, 1)),
    (6, 11, [("D", 11, 3, 0)], (6, 11, 0)),
    (6, 11, [("R", 0, 1, 3)], (8, 13, 0)),
    (6, 11, [("R", 7, 2, 5)], (6, 14, 1)),
    (6, 11, [("R", 20, 2, 5)], (6, 11, 1)),
    (6, 11, [("I", 0, 0, 10), ("I", 12, 0, 1)], (17, 22, 0)),
    (6, None, [("I", 0, 0, 3)], (9, None, 0)),
    (6, None, [("I", 8, 0, 3)], (6, None, 0)),
    (6, None, [("D", 8, 3, 0)], (6, None, 0)),
    (6, None, [("R", 8, 3, 1)], (6, None, 1)),
    (6, None, [("D", 4, 4, 0)], (4, None, 1)),
]


def test_fold_golden_vectors(spark):
    rows = [(i, s, e, 0, ops) for i, (s, e, ops, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"i int, s long, e long, st int, ops {sync.OPS}")
    out = {r["i"]: tuple(r["x"]) for r in df.select("i", sync.adjust(F.col("s"), F.col("e"), F.col("st"), F.col("ops")).alias("x")).collect()}
    assert out == {i: c[3] for i, c in enumerate(CASES)}


def test_exact_fold(spark):
    cases = [(6, 11, [("I", 0, 0, 10), ("I", 12, 0, 1)], (16, 21, 0)), (6, 11, [("D", 4, 4, 0)], (4, 7, 1)), (6, 11, [("D", k, 1, 0) for k in range(0, 3)], (3, 8, 0))]
    df = spark.createDataFrame([(i, s, e, 0, o) for i, (s, e, o, _) in enumerate(cases)], f"i int, s long, e long, st int, ops {sync.OPS}")
    out = {r["i"]: tuple(r["x"]) for r in df.select("i", sync.adjust_exact(F.col("s"), F.col("e"), F.col("st"), F.col("ops")).alias("x")).collect()}
    assert out == {i: c[3] for i, c in enumerate(cases)}


def apply(old: str, new: str, ops) -> bytes:
    """The new source from the old one and the operations' positions; inserted bytes are taken from the new source."""
    a, b, out, at = old.encode(), new.encode(), b"", 0
    for op, p, n, m in ops:
        out += a[at:p]
        at = p
        if op == "D":
            at += n
        else:
            out += b[len(out) : len(out) + m]
    return out + a[at:]


@settings(max_examples=200, deadline=None)
@given(st.text("abé\n", max_size=12), st.text("abé\n", max_size=12))
def test_diff_reconstructs(old, new):
    assert apply(old, new, sync.edit_ops(old, new)) == new.encode()


def test_long_diff_falls_back():
    assert sync.shortest_edits("a" * 50, "b" * 50, most=10) == [("D", 0, 50), ("I", 50, 50)]


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=1, max_size=14), st.text("abé", min_size=1, max_size=14))
def test_divided_diff_is_as_short(old, new):
    whole, divided = sync.shortest_edits(old, new), sync.shortest_edits(old, new, traced=1)
    assert sum(n for *_, n in divided) == sum(n for *_, n in whole)


def test_diff_beyond_four_thousand_edits():
    """What lies unchanged between changes at both ends isn't deleted."""
    middle = "".join(f"line {i} stays;" for i in range(300))
    old, new = "a" * 2100 + middle + "b" * 2100, "c" * 2100 + middle + "d" * 2100
    ops = sync.edit_ops(old, new)
    assert apply(old, new, ops) == new.encode()
    assert sum(n for op, _, n, _ in ops if op == "D") == 4200
    assert not [p for op, p, *_ in ops if op == "D" and 2100 <= p < 2100 + len(middle)]


def test_every_triple_of_a_hot_subject_is_labelled(spark):
    t = spark.createDataFrame([("d", i, "p", "http://x/of", "entity", f"o{i}") for i in range(30)], "doc_id string, ord long, subject string, predicate string, object_kind string, object_value string")
    e = spark.createDataFrame([("d", f"o{i}", i, f"name {i}") for i in range(0, 30, 2)], "doc_id string, entity_id string, ord long, snippet string")
    found = {r["target_id"]: r["target_label"] for r in graph.relation_labels(t, e).collect()}
    assert found == {f"o{i}": f"name {i}" if i % 2 == 0 else f"o{i}" for i in range(30)}


def test_exact_cascade_goes_to_the_end_of_a_chain(spark):
    n = 42
    e = spark.createDataFrame([("d", f"e{i}", 2 if i == n - 1 else 0) for i in range(n)], "doc_id string, entity_id string, status tinyint").coalesce(1)
    t = spark.createDataFrame([("d", f"e{i}", "entity", f"e{i + 1}") for i in range(n - 1)], "doc_id string, subject string, object_kind string, object_value string").coalesce(1)
    assert {r["status"] for r in sync.cascade(e, t, exact=True).collect()} == {2}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 8000), min_size=1, max_size=30).map(sorted))
def test_callbacks_wait_no_longer(times):
    fired = fire_times(times, 500, 2000)
    at = 0
    for last, when in fired:
        assert when <= times[at] + 2000 and when <= times[last] + 500 and all(b - a < 500 for a, b in zip(times[at:last], times[at + 1 : last + 1]))
        at = last + 1
    assert at == len(times)


def test_failing_agent_leaves_the_others(spark):
    def broken(texts):
        raise RuntimeError

    rows = [("d", "p", 0, "affine:note", None, ["b"]), ("d", "b", 1, "affine:paragraph", "Barbara Liskovians spoke", [])]
    b = spark.createDataFrame(rows, "doc_id string, block_id string, ord long, flavour string, text string, children array<string>")
    notes = blocks.run_agents(b, {"entity": broken, "summary": blocks.summary_agent})
    assert [r["note_type"] for r in notes.collect()] == ["summary"]
    found = blocks.run_agents(b)
    after = blocks.insert_notes(b, found.select("doc_id", "note_id", "after_block_id", "content"))
    page = after.where("block_id = 'p'").first()["children"]
    assert page[0] == "b" and len(page) == 1 + found.count()
    cleared = blocks.clear_notes(after)
    assert sorted(map(str, cleared.collect())) == sorted(map(str, b.select(cleared.columns).collect()))
    assert blocks.clear_notes(cleared).count() == 2
    assert pytest.approx(1.0) == notes.first()["confidence"]


def test_sessions_rewrite_only_the_buckets_of_a_batch(spark):
    def batch(*rows):
        return spark.createDataFrame(rows, "doc_id string, seq long, kind string, source string, sidecar string")

    store = SessionStore(spark, buckets=8)
    store.process(batch(*((d, 1, "open", f"text {d}", None) for d in ("a", "b", "c", None))), 0)
    before = store._held(1)
    for _ in range(2):  # a batch that runs again gives the same
        store.process(batch(("a", 2, "update", None, None), ("a", 3, "update", "new a", None), ("b", 2, "update", None, None)), 1)
        assert sorted(map(tuple, store.table("docs").collect())) == [("a", "new a"), ("b", "text b"), ("c", "text c")]
    after = store._held(2)
    assert 1 <= sum(after[b] != before[b] for b in after) <= 2
    errors = store.events().where("event = 'parse-error'").select("doc_id", "seq").collect()
    assert sorted(map(tuple, errors)) == [("a", 2), ("b", 2)]


def test_last_callback_fires_by_the_watermark(spark):
    """Updates at 1, 9 and 30 seconds of two keys, a batch each: the last wait stays open, the others fire."""
    folder = work_dir(spark, "callback-updates")
    for rows in ([("x", 1, 10), ("y", 1, 20)], [("x", 9, 11)], [("z", 30, 30)]):
        spark.createDataFrame(rows, "k string, s long, v long").select("k", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("k string, ts timestamp, v long").option("maxFilesPerTrigger", 1).parquet(folder)
    found = replay(debounce_most(stream, "k", "v", "ts", 500, 2000), "callbacks")
    assert sorted(map(tuple, found.collect())) == [("x", 1500, 10), ("x", 9500, 11), ("y", 1500, 20)]


def test_gutter_of_even_lines_is_that_of_its_lines(spark):
    """Documents of any shape, and lines that are made in blocks; far lines of an open span cost no row before the end."""
    rng = random.Random(5)
    kinds = ([], ["http://schema.org/Person"], ["http://schema.org/Place"], ["http://schema.org/Event"])
    rows = [(str(rng.randint(0, 3)), i, s, rng.choice([None, s, s + 7, s + 50, s + 400]), rng.choice(kinds)) for i in rng.sample(range(500), 60) for s in [rng.choice([0, 49, 50, 100, rng.randint(0, 3000)])]]
    e = spark.createDataFrame(rows, "doc_id string, ord long, span_start long, span_end long, types array<string>")
    far = {d: max(max(s, t or 0) for x, _, s, t, _ in rows if x == d) // 50 for d in {r[0] for r in rows}}
    lines = spark.createDataFrame([(d, n, 50 * n, 50 * n + 50) for d, last in far.items() for n in range(last + 1)], "doc_id string, line_no long, line_start long, line_end long")
    assert sorted(graph.gutter_of_even_lines(e, block=8).collect()) == sorted(graph.gutter(e, lines).collect())
    marks = [("d", 1, 0, None, []), ("d", 2, 200_000_000, None, kinds[1])]
    found = graph.gutter_of_even_lines(spark.createDataFrame(marks, e.schema))
    assert found.groupBy("colors").count().orderBy("count").collect() == [("#6B7280,#F59E0B", 1), ("#6B7280", 4_000_000)]
