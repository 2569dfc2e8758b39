"""URL filter: host and path rules first, gradient-boosted trees on lexical features for all other URLs.

Everything that touches a row is a column expression: host, path, the longest fitting
rule, the features, and the trees, which become nested CASE expressions in one
generated stage. Trees are fitted on the driver to a bounded number of labelled URLs
whose features the same expressions compute.

Labels come from the caller, or from `weak_labels`: a bounded sample of the pages' own
URLs, each as it is and once changed, labelled by points for several lexical causes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.shared import smallest_hashes, written

#: (verdict, host and path) of the rules that the query uses.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

#: Labelled rows that are fitted, at most: those with the smallest hash.
MOST_LABELLED = 20_000
#: Suffixes of each number of labels whose share of blocked URLs is kept, at most, and the labels that a suffix has.
MOST_SUFFIXES, SUFFIX_LABELS = 128, (1, 2, 3)
#: A suffix without labelled URLs, or with few, is drawn to the average as if it had so many average ones more.
PRIOR_URLS = 4

# What the labels of `weak_labels` go by.
#: Words of a host, between dots and hyphens, that count two points.
UNSAFE_WORDS = ("ads", "adult", "bet", "bets", "casino", "cheap", "loans", "pills", "poker", "porn", "spam", "track", "xxx")
RARE_SUFFIXES = ("click", "top", "xyz")
#: A URL with so many points is labelled 1.
BLOCK_POINTS = 2


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or where there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. A rule fits its host and all below it."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Later expressions win, so the longest rule is last; rules of one length can't both be given with different verdicts.
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a URL; a null URL has those of an empty one."""
    text = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    # Entropy over ASCII characters and one class for all others: at most 129 kinds, however long the URL is.
    ascii_text = F.regexp_replace(text, r"[^\x00-\x7F]", "ÿ")
    kinds = F.array_distinct(F.split(ascii_text, ""))
    share = lambda c: (F.length(ascii_text) - F.length(F.replace(ascii_text, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(kinds, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return {
        "url_length": F.length(text).cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": depth_of(path),
        "labels": F.regexp_count(host, F.lit("[^.]+")).cast("double"),
        "digit_ratio": digit_ratio(text),
        "host_digits": F.regexp_count(host, F.lit("[0-9]")).cast("double"),
        "entropy": entropy,
        "parameters": parameters_of(text),
    }


def depth_of(path: Column) -> Column:
    return F.regexp_count(path, F.lit("[^/]+")).cast("double")


def digit_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[0-9]")) / F.greatest(F.length(text), F.lit(1))


def parameters_of(text: Column) -> Column:
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return F.when(query == "", 0.0).otherwise((F.regexp_count(query, F.lit("&")) + 1).cast("double"))


def suffix_of(host: Column, labels: int = 1) -> Column:
    return F.substring_index(host, ".", -labels)


def points(url: Column) -> Column:
    """Points for lexical causes: two for an unsafe word in the host, one each for the others."""
    host, path = host_of(url), path_of(url)
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    unsafe = F.exists(F.split(host, r"[.-]"), lambda w: w.isin(*UNSAFE_WORDS))
    return (
        2 * one(unsafe)
        + one(parameters_of(url) >= 4)
        + one(depth_of(path) >= 6)
        + one(F.regexp_count(host, F.lit("[0-9]")) >= 4)
        + one(F.rlike(path, F.lit("[0-9a-f]{24}")))
        + one(suffix_of(host).isin(*RARE_SUFFIXES))
        + one(digit_ratio(url) >= 0.3)
        + one(F.length(url) >= 120)
    )


def changed(url: Column, kind: Column) -> Column:
    """The URL with one change of eight kinds, from harmless ones to those that cost a point."""
    digest = F.md5(url)
    number = F.conv(F.left(digest, F.lit(7)), 16, 10)
    more = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    start, rest = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_replace(url, r"(?s)^.*?://[^/?#]*", "")
    tail = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return (
        F.when(kind == 1, F.concat(url, more, F.lit("utm_source=feed&utm_medium=mail")))
        .when(kind == 2, F.concat(url, more, F.lit("aff="), number, F.lit("&clk="), number, F.lit("&sub=a9&src=x&sid="), F.left(digest, F.lit(10))))
        .when(kind == 3, F.concat(start, F.lit("/archive/2019"), tail))
        .when(kind == 4, F.concat(start, F.lit("/a/b/c/d/e"), tail))
        .when(kind == 5, F.concat(start, F.lit("/"), digest, tail))
        .when(kind == 6, F.concat(F.regexp_replace(start, r"^([^.]*)", F.concat(F.lit("$1"), F.right(number, F.lit(5)))), tail))
        .when(kind == 7, F.concat(F.regexp_replace(start, r"\.[a-zA-Z]+$", F.concat(F.lit("."), F.element_at(F.array(*map(F.lit, RARE_SUFFIXES)), F.pmod(F.crc32(url), F.lit(len(RARE_SUFFIXES))).cast("int") + 1))), tail))
        .otherwise(url)
    )


def weak_labels(pages: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(url, label) of at most `most` rows: URLs of `pages` (page_id, url) with the smallest hashes, as they are and changed twice.

    A URL is labelled 1 from BLOCK_POINTS `points` on. The changes, picked by the
    URL's hash, make each cause occur with and without others, on all hosts, so
    that none is the label by itself. URLs that are null or have no `://` aren't used.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url")).where(F.contains("url", F.lit("://")))
    rows = written(smallest_hashes(rows, ["url", "page_id"], ["url", "page_id"], most // 2).select("url"), "urls")
    kind = lambda shift: F.pmod(F.shiftright(F.xxhash64("url"), shift), F.lit(8))
    # One change a projection: nested, the expression would be too long for one generated method.
    rows = rows.select("url", kind(3).alias("one"), kind(23).alias("two"))
    rows = rows.select("url", "two", changed(F.col("url"), F.col("one")).alias("new")).select("url", changed(F.col("new"), F.col("two")).alias("new"))
    both = rows.select(F.explode(F.array("url", "new")).alias("url"))
    return both.select("url", (points(F.col("url")) >= BLOCK_POINTS).cast("int").alias("label"))


@dataclass
class Trees:
    """Boosted trees of depth two: (feature, cut, (feature, cut, value, value), ...) and the share of blocked URLs by suffix."""

    start: float
    trees: list = field(default_factory=list)
    share: float = 0.0
    #: {labels of a suffix: {suffix: smoothed share of blocked URLs}}
    suffixes: dict[int, dict[str, float]] = field(default_factory=dict)

    def columns(self, url: Column, host: Column, path: Column) -> dict[str, Column]:
        """All features by name, those of suffixes too."""
        out = features(url, host, path)
        for n, shares in self.suffixes.items():
            known = F.create_map(*(F.lit(x) for pair in sorted(shares.items()) for x in pair)) if shares else None
            out[f"suffix_{n}"] = F.lit(self.share) if known is None else F.coalesce(F.try_element_at(known, suffix_of(host, n)), F.lit(self.share))
        return out

    def value(self, columns: dict[str, Column]) -> Column:
        """The sum of all trees' values, as a log odds."""
        out = F.lit(self.start)
        for f, cut, low, high in self.trees:
            side = [F.when(columns[g] <= c, F.lit(a)).otherwise(F.lit(b)) for g, c, a, b in (low, high)]
            out = out + F.when(columns[f] <= cut, side[0]).otherwise(side[1])
        return out


def suffix_shares(suffixes: np.ndarray, y: np.ndarray, share: float) -> dict[str, float]:
    """Smoothed share of label 1 for each suffix, as given."""
    names, at = np.unique(suffixes, return_inverse=True)
    n, ones = np.bincount(at), np.bincount(at, y)
    return dict(zip(names.tolist(), ((ones + PRIOR_URLS * share) / (n + PRIOR_URLS)).tolist()))


def boost(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, cuts: int) -> tuple[float, list]:
    """(start, trees) of gradient boosting on the log loss; features are binned once, splits are read off histograms of gradients."""
    share = y.mean()
    start = float(np.log((share + 0.01) / (1.01 - share)))
    edges = []
    for column in x.T:
        values = np.unique(column)
        middles = (values[1:] + values[:-1]) / 2
        edges.append(middles if len(middles) <= cuts else np.unique(np.quantile(middles, np.linspace(0, 1, cuts), method="nearest")))
    bins = [np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)]  # value <= edge i: bin <= i
    score, trees = np.full(len(y), start), []

    def split(at: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int] | None:
        total_g, total_h, top, found = grad[at].sum(), hess[at].sum(), 1e-9, None
        for k, e in enumerate(edges):
            if not len(e):
                continue
            g = np.cumsum(np.bincount(bins[k][at], grad[at], len(e) + 1))[:-1]
            h = np.cumsum(np.bincount(bins[k][at], hess[at], len(e) + 1))[:-1]
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            i = int(gain.argmax())
            if gain[i] > top:
                top, found = gain[i], (k, i)
        return found

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        root = split(np.arange(len(y)), grad, hess)
        if root is None:
            break
        below, sides = bins[root[0]] <= root[1], []
        for side in (below, ~below):
            at = np.flatnonzero(side)
            k, i = split(at, grad, hess) or root
            values = []
            for part in (at[bins[k][at] <= i], at[bins[k][at] > i]):
                values.append(float(rate * grad[part].sum() / (hess[part].sum() + 1)))
                score[part] += values[-1]
            sides.append((k, float(edges[k][i]), *values))
        trees.append((root[0], float(edges[root[0]][root[1]]), *sides))
    return start, trees


def fit(labelled: DataFrame, rounds: int = 40, rate: float = 0.3, cuts: int = 32, most: int = MOST_LABELLED, suffixes: int = MOST_SUFFIXES) -> Trees:
    """Fit trees to labelled URLs (url, label of 0 or 1), `most` rows at most; without any, every URL is allowed.

    A row's suffix statistics are those of the other half of the rows, so its own
    label isn't among its features; what is kept are the statistics of all rows.
    """
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    found = features(url, host, path)
    rows = smallest_hashes(labelled.where("label in (0, 1)"), ["url"], ["url", "label"], most)
    # At most `most` rows of a dozen values.
    rows = rows.select(F.col("label").cast("double"), F.pmod(F.xxhash64("url"), F.lit(2)).alias("half"), *(suffix_of(host, n).alias(f"suffix_{n}") for n in SUFFIX_LABELS), *(c.alias(k) for k, c in found.items())).toPandas()
    if not len(rows):
        return Trees(-1.0)
    y, half = rows["label"].to_numpy(float), rows["half"].to_numpy()
    share = float(y.mean())
    x = [rows[k].to_numpy(float) for k in found]
    kept = {}
    for n in SUFFIX_LABELS:
        suffix = rows[f"suffix_{n}"].to_numpy(str)
        of_others = np.full(len(y), share)
        for side in (0, 1):
            known = suffix_shares(suffix[half != side], y[half != side], share)
            of_others[half == side] = [known.get(s, share) for s in suffix[half == side]]
        x.append(of_others)
        shares, counts = suffix_shares(suffix, y, share), dict(zip(*np.unique(suffix, return_counts=True)))
        # Those that tell most: how far from the average, for how many URLs.
        kept[n] = {s: shares[s] for s in sorted(shares, key=lambda s: (-abs(shares[s] - share) * counts[s], s))[:suffixes]}
    names = [*found, *(f"suffix_{n}" for n in SUFFIX_LABELS)]
    start, trees = boost(np.column_stack(x), y, rounds, rate, cuts)
    return Trees(start, [(names[f], cut, *((names[g], c, a, b) for g, c, a, b in sides)) for f, cut, *sides in trees], share, kept)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """One row per row of `pages` (page_id, url): host, path, rule, verdict (allow or block), score.

    The longest rule that fits gives the verdict, else the trees do: blocked from
    even odds on. score is the trees' probability. The trees are fitted to
    `labelled` (url, label), or to `weak_labels` of the pages themselves.

    Defined results: a null URL,
    or one without `://`, has an empty host and path, fits no rule and is judged
    by the trees as it is; an empty table gives an empty one; repeated rows give
    repeated results; other columns are ignored.
    """
    model = fit(weak_labels(pages) if labelled is None else labelled)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    found = model.columns(F.col("url"), F.col("host"), F.col("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), F.struct(*(c.alias(k) for k, c in found.items())).alias("f"))
    value = model.value({k: F.col(f"f.{k}") for k in found})
    rows = rows.withColumn("score", 1 / (1 + F.exp(-value)))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
