"""Near-duplicates, top-k, URL filter, mixing and the pipeline: brute force and odd rows."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import mixing, neardup, queries, topk, urls
from quillgraph.llm.shared import smallest_hashes

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(docs, threshold):
    sets = {i: shingles(t) for i, t in docs.items()}
    up = {i: i for i in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(n_groups=4, size=25):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    docs, i = {}, 0
    for _ in range(n_groups):
        base = [word() for _ in range(rng.randint(40, 150))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 6])):
                copy[rng.randrange(len(copy))] = word()
            docs[i] = " ".join(copy)
            i += 1
    docs |= {i: "", i + 1: "one two", i + 2: "One  two", i + 3: None, i + 4: " \t\n", i + 5: "x" * 5000}
    return docs


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_duplicates(spark, threshold):
    docs = near_copies()
    df = spark.createDataFrame([(i, t, 3) for i, t in docs.items()], "doc_id long, text string, component_id int")
    rows = neardup.near_duplicates(df, threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(docs, threshold)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "A b c"), (9, None)], "doc_id long, text string")
    rows = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(None, 1, None, True), (4, 1, 2, False), (4, 1, 2, False), (2, 1, 2, True), (9, 0, 9, True)], key=str)
    assert neardup.near_duplicates(df.where("1 = 0")).count() == 0


def alike(n=500, words=400, changed=45, seed=9):
    """Many texts of one base: a third are changed in a few places and linked, the others in so many that they aren't, but alike enough to share bands."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    docs = {}
    for i in range(n):
        copy = list(base)
        for k in rng.sample(range(words), rng.randint(6, changed) if i % 3 else 3):
            copy[k] = f"x{rng.randrange(1 << 30)}"
        docs[i] = " ".join(copy)
    return docs


def test_large_bucket_of_alike_texts(spark, monkeypatch):
    """Buckets of hundreds of texts that are mostly not linked, in blocks of a few rows: the same as each with each."""
    monkeypatch.setattr(neardup, "BLOCK", 32)
    docs = alike()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = neardup.near_duplicates(df, 80).collect()
    expected = brute_components(docs, 80)
    assert 50 < len({c for _, c in expected.values()}) < 500
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected


def test_near_duplicates_of_documents(spark):
    """All documents of sf0.01 against brute force, which compares each with each: no link is lost."""
    df = queries.table(spark, "/root/testdata/sf0.01", "documents")
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = neardup.near_duplicates(df, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(docs, 85)


def test_one_id_on_different_texts(spark):
    """Rows of one doc_id are one document: links of any of its texts join them all. A very long text is like any other."""
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(5, "a b c d e f"), (1, "a b c d e f"), (5, "q r s t u v"), (9, "q r s t u v"), (7, "other words are here now"), (3, long), (4, long + " end"), (4, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).collect())
    assert found == [(1, 1), (3, 3), (4, 3), (4, 3), (5, 1), (5, 1), (7, 7), (9, 1)]


def test_components_of_chains(spark):
    rng = random.Random(2)
    edges = [(a, a + 1) for a in range(0, 60) if a % 20 != 19] + [(100, k) for k in range(101, 130)]
    rng.shuffle(edges)
    found = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: i // 20 * 20 for i in range(60) if i % 20} | {k: 100 for k in range(101, 130)}
    assert {i: found.get(i, i) for i in expected} == expected


def test_word_hashes_of_blocks():
    text = "alpha beta\tgamma\n" * 50 + "é" * 300
    assert neardup.word_hashes(text, block=64).tolist() == neardup.word_hashes(text).tolist()
    assert len(neardup.word_hashes(text)) == 151


def brute_top(rows, every, k):
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in fine:
        if q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v)))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 230)]  # one vector many times: ties
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, []), (None, rows[0][1]), (350, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    found = {tuple(r) for r in topk.top_k(df, every=50, k=5).select("query_id", "rank", "vec_id", "score").collect()}
    assert found == brute_top(rows, 50, 5)
    assert topk.top_k(df.where("1 = 0")).count() == 0
    few = df.where("vec_id in (50, 51, 52)")
    assert {tuple(r) for r in topk.top_k(few).select("query_id", "rank", "vec_id", "score").collect()} == brute_top([r for r in rows if r[0] in (50, 51, 52)], 50, 5)


def test_inner_products_are_exact():
    rng = np.random.default_rng(3)
    for size in (2**20, 2**30, 2**62):
        v, m = (rng.integers(-size, size, (6, 5)).astype(float) for _ in range(2))
        v[0], m[0] = size, size
        expected = [[max(-topk.LONG, min(topk.LONG, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in m] for x in v]
        assert topk.inner(v, m).tolist() == expected


def test_top_k_of_large_components(spark):
    """Squared norms far beyond 2 ** 53, up to the end of a long, and beyond it."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 4e5).tolist()) for i in range(60)] + [(i, (rng.normal(size=4) * 3e6).tolist()) for i in range(60, 80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {tuple(r) for r in topk.top_k(df, every=10, k=3).select("query_id", "rank", "vec_id", "score").collect()}
    assert found == brute_top(rows, 10, 3) and max(abs(s) for *_, s in found) > 2**53
    far = [(0, [1e300, 0.0]), (1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1.0, 1.0])]
    rows = topk.top_k(spark.createDataFrame(far, "vec_id long, embedding array<double>"), every=10).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, topk.LONG), (3, topk.LONG), (2, -topk.LONG)]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(t), t, v) for v, t in urls.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_urls(spark):
    given = ["http://a.Example.COM/en/7x?q#f", "https://com/en/", "http://xcom/en/", "http://b.net/de/8", "http://x.example.net/de/81", "ftp://org/es/#a", "nothing", None, "", "a://", "http://h?x=/en/", "http://h\n/p\nq?z", "x://y://z/en/", "https://www.cheap-pills.example.com/fr/1", "https://weather.example.com/fr/1", "http://h/" + "é" * 3000]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(given)], "page_id long, url string, verdict string")
    labelled = urls.weak_labels(queries.table(spark, "/root/testdata/sf0.01", "pages"))
    rows = urls.judge(df, labelled=labelled).collect()
    for r in rows:
        host, path, rule, verdict = brute_rule(given[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    by = {given[r["page_id"]]: r["verdict"] for r in rows}
    assert by[given[13]] == "block" and by[given[14]] == "allow"
    assert urls.judge(df.where("1 = 0")).count() == 0
    plan = urls.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.fixture(scope="module")
def labelled_urls(spark):
    """Weak labels of the pages of sf0.1; a fifth of the hosts is held out."""
    pages = queries.table(spark, "/root/testdata/sf0.1", "pages")
    rows = urls.weak_labels(pages).withColumn("held", F.pmod(F.xxhash64(urls.host_of(F.col("url"))), F.lit(5)) == 0).collect()
    df = spark.createDataFrame(rows, "url string, label int, held boolean")
    return df.where(~F.col("held")), df.where("held")


def tree_columns(model, df):
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    columns = model.columns(F.col("url"), host, path)
    return df.select("label", *(c.alias(k) for k, c in columns.items()), model.value(columns).alias("value")).collect()


def test_trees_are_what_they_say(labelled_urls):
    """The expression's value is that of walking the trees."""
    model = urls.fit(labelled_urls[0])
    for r in tree_columns(model, labelled_urls[1]):
        total = model.start
        for f, cut, low, high in model.trees:
            g, c, a, b = low if r[f] <= cut else high
            total += a if r[g] <= c else b
        assert r["value"] == pytest.approx(total)


def test_trees_use_many_features(labelled_urls):
    """Several features decide, suffix statistics among them, and URLs of hosts that weren't fitted are told apart."""
    fitted, held = labelled_urls
    model = urls.fit(fitted)
    used = {f for f, *_ in model.trees} | {side[0] for t in model.trees for side in t[2:]}
    assert len(used) >= 5 and any(f.startswith("suffix_") for f in used) and {"depth", "digit_ratio", "parameters"} <= used
    rows = tree_columns(model, held)
    ones, zeros = (np.array([r["value"] for r in rows if r["label"] == y]) for y in (1, 0))
    auc = ((ones[:, None] > zeros).mean() + (ones[:, None] >= zeros).mean()) / 2
    accuracy = np.mean([(r["value"] >= 0) == (r["label"] == 1) for r in rows])
    assert len(ones) > 100 and auc > 0.93 and accuracy > 0.9


def test_no_cause_is_the_label(labelled_urls):
    """In the labelled URLs each cause occurs with either label."""
    df = labelled_urls[0]
    causes = {"parameters": F.col("parameters") >= 4, "depth": F.col("depth") >= 6, "digits": F.col("host_digits") >= 4}
    columns = urls.features(F.col("url"), urls.host_of(F.col("url")), urls.path_of(F.col("url")))
    rows = df.select("label", *(c.alias(k) for k, c in columns.items()))
    for cause in causes.values():
        assert 0.02 < rows.where(cause).agg(F.avg("label")).first()[0] < 0.98
    assert not urls.weak_labels(spark_frame(df), most=10).where("url is null").count()


def spark_frame(df):
    return df.limit(3).select(F.lit(1).alias("page_id"), "url").unionByName(df.limit(1).select(F.lit(None).cast("int").alias("page_id"), F.lit(None).cast("string").alias("url")))


def brute_share(budget, children):
    """Water filling: children (name, weight, room)."""
    out, left, open_ = {}, budget, list(children)
    while open_:
        weight = sum(w for _, w, _ in open_)
        full = [c for c in open_ if c[2] * weight <= c[1] * left]
        if not full:
            return out | {n: left * w // weight for n, w, _ in open_}
        # One at a time, the least room for its weight first.
        n, _, room = min(full, key=lambda c: (c[2] / c[1], c[0]))
        out[n] = room
        left -= room
        open_ = [c for c in open_ if c[0] != n]
    return out


def test_share_out(spark):
    rng = random.Random(8)
    for _ in range(4):
        children = [(f"c{i}", rng.randint(1, 9), rng.choice([0, rng.randint(1, 100), 10_000])) for i in range(7)]
        budget = rng.randint(0, 1500)
        df = spark.createDataFrame([(*c, budget) for c in children], "source string, weight long, room long, budget long")
        assert {r["source"]: r["budget"] for r in mixing.share_out(df, [], "source").collect()} == brute_share(budget, children)


def test_mixing_odd_rows(spark):
    rows = [(i, "w " * (i % 7), ["en", "de", None][i % 3], ["src0", "src1", None, "x"][i % 4], 1) for i in range(60)] + [(None, None, None, None, 1), (3, "a b", "en", "src0", 1), (3, "a b", "en", "src0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget int")
    out = mixing.mix_sources(df).collect()
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    assert 0 < sum(r["n_tokens"] for r in out) <= total * 60 // 100
    assert {r["epoch"] for r in out} <= {0, 1}
    assert mixing.mix_sources(df.where("1 = 0")).count() == 0
    assert mixing.keep_mixed(df, mixing.Mix(share=50)).columns == df.columns


def test_weights_of_nothing(spark):
    """A language, domain or source of weight 0 gives nothing, and its siblings share the budget."""
    rows = [(i, "w " * 10, ["en", "de"][i % 2], ["src0", "src1", "src2"][i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for mix, gone in ((mixing.Mix(langs={"en": 0, "de": 3}), "lang = 'en'"), (mixing.Mix(domains={"web": 0, "books": 2, "code": 1}), "domain = 'web'"), (mixing.Mix(sources={"src1": 0}), "source = 'src1'")):
        out = mixing.mix_sources(df, mix)
        assert out.where(gone).count() == 0
        assert 1200 * mix.share // 100 - 60 <= out.agg(F.sum("n_tokens")).first()[0] <= 1200 * mix.share // 100
    nothing = mixing.Mix(domains=dict.fromkeys(("web", "books", "code", "other"), 0))
    assert mixing.mix_sources(df, nothing).count() == 0


def test_keep_mixed_by_row(spark):
    """Of rows of one doc_id as many stay as are taken; kept tokens are those of the mix."""
    rows = [(i % 20, f"w{i} " * (1 + i % 4), "en", "src0", i) for i in range(200)] + [(None, "a b", "en", "src0", 7)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget int")
    mix = mixing.Mix(share=50, max_epochs=1)
    taken = collections.Counter((r["doc_id"], r["n_tokens"]) for r in mixing.mix_sources(df, mix).collect())
    kept = mixing.keep_mixed(df, mix)
    assert kept.columns == df.columns
    assert collections.Counter((r["doc_id"], len(r["text"].split())) for r in kept.collect()) == taken and taken


def test_ranges_of_two_levels(spark, monkeypatch):
    """Many ranges a leaf give what one range does."""
    rows = [(i, "w " * (i % 9), "en", f"src{i % 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    expected = sorted(map(tuple, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    assert sorted(map(tuple, mixing.mix_sources(df).collect())) == expected


PIPELINE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows; and no rows at all."""
    import corpus_pipeline

    words = " ".join(f"word{i}" for i in range(40))
    rows = [(None, words, None, None, None), (1, None, "en", "src0", 0), (2, "", "en", "src0", 0), (3, words, "en", "src1", 1), (3, words, "en", "src1", 1), (4, words + " x", None, "src1", 1), (5, "long " * 60_000, "de", None, 5), (6, "call (212) 555-0123 now", "fr", "src2", 9)]
    docs = spark.createDataFrame(rows, PIPELINE_COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() <= docs.count()
        assert stage(spark, docs.where("1 = 0"), SF).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("1 = 0"), SF).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = after.collect()
        assert 0 < len(rows) <= before
        if name == "near_duplicates":
            kept = {i for i, (_, c) in brute_components({r["doc_id"]: r["text"] for r in docs.collect()}, 80).items() if i == c}
            assert {r["doc_id"] for r in rows} == kept
        docs, before = spark.createDataFrame(rows, after.schema), len(rows)
    assert collections.Counter(r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()).keys() == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_smallest_hashes_are_those_of_a_whole_sort(spark):
    """The bound on hashes changes no row: small tables, large ones, repeated rows and nulls."""
    for n in (0, 5, 5000):
        rows = spark.range(n).select(F.when(F.col("id") % 50 != 0, F.col("id") % 3000).alias("k"), F.lit("x").alias("text")).repartition(7)
        whole = rows.orderBy(F.xxhash64("k"), "k").limit(40).collect()
        assert sorted(map(str, smallest_hashes(rows, ["k"], ["k"], 40).collect())) == sorted(map(str, whole))
