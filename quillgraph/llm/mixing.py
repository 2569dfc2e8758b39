"""Mixing sources to target weights by hierarchical budgeting.

The token budget flows down a tree of domains, languages and sources in proportion to
weights. A child can take at most what its documents give in `max_epochs` epochs; what
it can't take goes to its siblings, and only what a whole family can't take goes to the
families beside it, as a parent's room is the sum of its children's. A leaf's stream is
its documents in a keyed random order, anew in each epoch; it gives the longest prefix
that its budget holds.

No leaf is sorted as a whole: the order is by a digest, so sums over ranges of digests
show the one range in which a prefix ends, and only that range is summed row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.shared import sized_join, written

LEAF = ["domain", "lang", "source"]
MIXED = ["doc_id", *LEAF, "epoch", "n_tokens"]
#: Documents of the corpus for each range of digests, about.
RANGE_ROWS = 1024


@dataclass
class Mix:
    """Weights are whole numbers from 0; `share` percent of all tokens are the budget. A name that isn't listed has weight `other`.

    A child of weight 0 has no room, so it gets no budget, whatever its siblings lack.
    """

    domains: dict[str, int] = field(default_factory=lambda: {"web": 50, "books": 30, "code": 15})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 60, "de": 15, "fr": 15, "es": 10})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 5
    share: int = 60
    max_epochs: int = 2
    seed: int = 7

    def weight(self, name: str, column: Column) -> Column:
        known = {"domain": self.domains, "lang": self.langs, "source": self.sources}[name]
        out = F.lit(self.other)
        for k, w in known.items():
            out = F.when(column == k, F.lit(w)).otherwise(out)
        return out.cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source by its last digit; sources without one are `other`."""
    last = F.right(source, F.lit(1))
    return F.when(last.isin("0", "3", "6", "9"), "web").when(last.isin("1", "4", "7"), "books").when(last.isin("2", "5", "8"), "code").otherwise("other")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budgets of children (columns of parent, name, weight, room, and `budget` of the parent).

    Children are taken from the least room for their weight on: one whose part of
    what is left is more than its room takes its room; the others share the rest.
    """
    # A weight of 0 leaves no room; as 1 with no room it is full from the start and takes nothing.
    children = children.withColumn("room", F.when(F.col("weight") > 0, F.col("room")).otherwise(0)).withColumn("weight", F.greatest("weight", F.lit(1)))
    order = [(F.col("room") / F.col("weight")), F.col(name)]
    w = Window.partitionBy(*parent).orderBy(*order) if parent else Window.partitionBy(F.lit(0)).orderBy(*order)
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    full = children.withColumn("full", F.col("room") * F.sum("weight").over(rest) <= F.col("weight") * (F.col("budget") - F.coalesce(F.sum("room").over(so_far), F.lit(0))))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(whole), F.lit(0))
    weights = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    out = full.withColumn("left", left).withColumn("weights", weights)
    return out.withColumn("budget", F.when(F.col("full"), F.col("room")).otherwise(F.expr("(left * weight) div weights"))).drop("full", "left", "weights", "weight", "room")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """The budget of each leaf (domain, lang, source, tokens)."""
    room = lambda name: F.when(mix.weight(name, F.col(name)) > 0, F.col("room")).otherwise(0)
    leaves = leaves.withColumn("room", F.col("tokens") * mix.max_epochs).withColumn("room", room("source"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("room").alias("room")).withColumn("room", room("lang"))
    domains = langs.groupBy("domain").agg(F.sum("room").alias("room")).withColumn("room", room("domain"))
    # One number goes to the driver: the budget of the tree's root.
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {mix.share} div 100")).first()[0]
    top = share_out(domains.withColumn("weight", mix.weight("domain", F.col("domain"))).withColumn("budget", F.lit(total).cast("long")), [], "domain")
    mid = share_out(langs.withColumn("weight", mix.weight("lang", F.col("lang"))).join(top, "domain"), ["domain"], "lang")
    return share_out(leaves.withColumn("weight", mix.weight("source", F.col("source"))).join(mid, ["domain", "lang"]), ["domain", "lang"], "source")


def leaf_rows(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and a hash of the text of each document; null names are empty."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    return docs.select(F.col("doc_id").cast("long"), domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"), (count_words(F.col("text")) if tokens is None else tokens).alias("n_tokens"), F.xxhash64("text").alias("text_hash"))


def mix_sources(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """One row for each document and epoch taken: doc_id, domain, lang, source, epoch (from 0), n_tokens.

    Tokens are words `[^\\x20\\x09-\\x0D]+`. Within a leaf, documents of an epoch are
    ordered by md5 of "seed|epoch|doc_id", then doc_id, then n_tokens; whole
    documents are taken from the start as long as their sum is within the budget.

    Defined results: a null text has no tokens; a null lang or source is the
    empty name; a null doc_id is ordered as the text "null" and returned as
    null; repeated rows are documents of their own; an empty table gives an
    empty one; other columns are ignored.
    """
    both = taken_rows(docs, mix or Mix())
    # Exploded by whole epochs: at most max_epochs rows a document.
    return both.select("doc_id", *LEAF, F.explode(F.expr("sequence(0, cast(copies as int) - 1)")).alias("epoch"), "n_tokens")


def taken_rows(docs: DataFrame, mix: Mix) -> DataFrame:
    """The documents that `mix_sources` takes and in how many epochs: doc_id, domain, lang, source, n_tokens, text_hash, copies."""
    rows = written(leaf_rows(docs), "leaves")
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, mix).select(*LEAF, "tokens", "budget")
    # A leaf without tokens gives its documents in the first epoch: they cost nothing.
    plan = written(plan.withColumn("full", F.expr("if(tokens = 0, 1, budget div tokens)")).withColumn("rest", F.expr("if(tokens = 0, -1, budget % tokens)")), "budgets")
    digits = 1
    n = rows.count()
    while n > RANGE_ROWS * 16**digits:
        digits += 1
    key = F.md5(F.concat_ws("|", F.lit(str(mix.seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = sized_join(rows, plan, LEAF, "inner").withColumn("digest", key).withColumn("bucket", F.left("digest", F.lit(digits)))
    # Sums of each range of digests. A leaf has 16 ** digits ranges, about one for RANGE_ROWS documents of the corpus.
    sums = written(rows.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("inside")), "sums")
    # Sums before each range in two levels: over groups of at most 4096 ranges, and within each group.
    coarse = max(0, digits - 3)
    sums = sums.withColumn("group", F.left("bucket", F.lit(coarse)))
    by_bucket = Window.partitionBy(*LEAF, "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_group = Window.partitionBy(*LEAF).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy(*LEAF, "group").agg(F.sum("inside").alias("all")).select(*LEAF, "group", F.coalesce(F.sum("all").over(by_group), F.lit(0)).alias("start"))
    sums = sums.withColumn("within", F.coalesce(F.sum("inside").over(by_bucket), F.lit(0))).join(groups, [*LEAF, "group"])
    sums = written(sums.select(*LEAF, "bucket", "inside", (F.col("start") + F.col("within")).alias("before")), "ranges")
    rows = sized_join(rows, sums, [*LEAF, "bucket"], "inner")
    # Only the range in which the prefix ends is summed row by row.
    end = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("inside") > F.col("rest"))
    row = Window.partitionBy(*LEAF, "bucket").orderBy("digest", "doc_id", "n_tokens", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    ending = rows.where(end).withColumn("taken", (F.col("before") + F.sum("n_tokens").over(row) <= F.col("rest")).cast("int"))
    others = rows.where(~end).withColumn("taken", (F.col("before") + F.col("inside") <= F.col("rest")).cast("int"))
    both = ending.unionByName(others).withColumn("copies", F.col("full") + F.col("taken")).where("copies > 0")
    return both.select("doc_id", *LEAF, "n_tokens", "text_hash", "copies")


def keep_mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of `docs` that one epoch of the mix takes, with all columns.

    Rows are told apart by doc_id, leaf and a hash of their text, so a doc_id that
    occurs with several texts is kept with those that are taken, and a null doc_id
    is taken or not like any other. Rows alike in all of these are interchangeable:
    where a budget ends among them, as many stay as it takes, which happens once a
    leaf at most. Columns may have any names; an empty table gives an empty one.
    """
    one = Mix(**{**mix.__dict__, "max_epochs": 1})
    on = ["__id", *(f"__{c}" for c in LEAF), "__hash"]
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    names = dict(zip(on, [ident, *map(F.col, LEAF), F.col("text_hash")]))
    taken = written(taken_rows(docs, one).groupBy(*(c.alias(n) for n, c in names.items())).agg(F.count("*").alias("__times")), "taken")
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    keyed = docs.select("*", *(c.alias(n) for n, c in zip(on, [ident, domain_of(source), lang, source, F.xxhash64("text")])))
    counts = keyed.groupBy(*on).agg(F.count("*").alias("__rows"))
    # Keys of which some rows are taken and some aren't: one a leaf at most.
    part = written(counts.where("__rows > 1").join(taken, on).where("__times < __rows").drop("__rows"), "parted")
    found = sized_join(keyed, taken.drop("__times"), on, "left_semi")
    if part.isEmpty():
        return found.select(*docs.columns)
    rank = Window.partitionBy(*on).orderBy("__hash")
    some = sized_join(found, part, on, "inner").withColumn("__rank", F.row_number().over(rank)).where("__rank <= __times")
    return sized_join(found, part.drop("__times"), on, "left_anti").select(*docs.columns).unionByName(some.select(*docs.columns))


def oracle(mix: Mix, docs: str = "documents") -> str:
    """The same in DuckDB SQL: leaves are sorted and summed whole."""
    case = lambda known, c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in known.items()) + f" ELSE {mix.other} END" if known else str(mix.other)

    def level(name: str, rows: str, parent: str, by: str, weight: str) -> str:
        part = f"PARTITION BY {by} " if by else ""
        return f"""
 {name}_w AS (SELECT r.*, ({weight})::HUGEINT AS weight, p.budget AS up FROM {rows} r, {parent} p {f"WHERE {' AND '.join(f'r.{c} = p.{c}' for c in by.split(', '))}" if by else ''}),
 {name}_f AS (SELECT *, room * sum(weight) OVER ({part}ORDER BY room / weight::DOUBLE, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
     <= weight * (up - coalesce(sum(room) OVER ({part}ORDER BY room / weight::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM {name}_w),
 {name}_b AS (SELECT *, CASE WHEN is_full THEN room ELSE ((up - coalesce(sum(CASE WHEN is_full THEN room END) OVER ({part}), 0)) * weight) // sum(CASE WHEN NOT is_full THEN weight END) OVER ({part}) END AS budget FROM {name}_f),"""

    by_digit = "CASE WHEN right(source, 1) IN ('0','3','6','9') THEN 'web' WHEN right(source, 1) IN ('1','4','7') THEN 'books' WHEN right(source, 1) IN ('2','5','8') THEN 'code' ELSE 'other' END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM {docs}),
 rows_ AS (SELECT *, {by_digit} AS domain FROM d),
 leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {mix.max_epochs} AS room FROM rows_ GROUP BY ALL),
 langs AS (SELECT domain, lang, sum(room) AS room FROM leaves GROUP BY ALL),
 domains AS (SELECT domain, sum(room) AS room FROM langs GROUP BY ALL),
 total AS (SELECT sum(tokens) * {mix.share} // 100 AS budget FROM leaves),{level('domain', 'domains', 'total', '', case(mix.domains, 'r.domain'))}{level('lang', 'langs', 'domain_b', 'domain', case(mix.langs, 'r.lang'))}{level('source', 'leaves', 'lang_b', 'domain, lang', case(mix.sources, 'r.source'))}
 plan AS (SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 1 ELSE budget // tokens END AS whole, CASE WHEN tokens = 0 THEN -1 ELSE budget % tokens END AS rest FROM source_b),
 keyed AS (SELECT r.*, p.whole, p.rest, md5('{mix.seed}|' || p.whole::VARCHAR || '|' || coalesce(r.doc_id::VARCHAR, 'null')) AS digest FROM rows_ r JOIN plan p USING (domain, lang, source)),
 summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY digest, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS reached FROM keyed),
 copied AS (SELECT *, whole::INT + (reached <= rest)::INT AS copies FROM summed)
SELECT doc_id, domain, lang, source, unnest(range(copies))::INTEGER AS epoch, n_tokens FROM copied
"""
