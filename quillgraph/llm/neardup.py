"""Near-duplicates by min-max hashing, banding and exact confirmation.

1. A narrow stage turns each text into its set of word shingles and the set into a
   digest, and hashes the set under each permutation once, keeping both the least
   and the greatest value: twice the signature of minwise hashing for the same work.
   Bands of five values give the keys that candidates share.
2. Texts with equal sets become one class by their digest, with partial sums before
   the shuffle, so thousands of copies cost one row each and no pair.
3. In each bucket of a band all members are compared with one pivot, never each with
   each; linked members are one component. Where a bucket still has several, its
   members are compared with the bucket's middle, and a bitmap keeps what each has of
   the middle. Two members of different components can be linked only if the bitmaps
   leave room for it, so of a large group that is alike, but not enough, hardly any
   pair is made, and no link between candidates is lost.
   No task has more than a few blocks of a bucket, however large it is: its rows are
   dealt to blocks for every join by bucket, and where members meet each other, those
   of one size class and its neighbour meet block by block.
4. A candidate pair is linked only if the whole sets say so.
5. Components are found by alternating large and small stars, all in DataFrames.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.shared import lean, sized_join, slices, written

#: Values in a band, and with what probability a pair right at the threshold may share no band.
ROWS = 5
MISS = 1e-6
#: Rows of one key that are dealt to one block.
BLOCK = 256

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_PERMUTE = _RANDOM.integers(1, 1 << 63, 8192, np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        found = np.multiply.accumulate(out)
        if n > 1 << 21:
            return found
        _POWERS[base] = found
    return _POWERS[base][:n]


def _block_hashes(raw: np.ndarray) -> np.ndarray:
    inside = ~_WHITE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)), out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw))[starts])


def word_hashes(text: str, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of every word `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if len(raw) <= block:
        return _block_hashes(raw)
    cuts = np.flatnonzero(_WHITE[raw])
    out, at = [], 0
    while at < len(raw):
        k = int(np.searchsorted(cuts, min(at + block, len(raw))))
        stop = len(raw) if at + block >= len(raw) or k == len(cuts) else int(cuts[k]) + 1
        out.append(_block_hashes(raw[at:stop]))
        at = stop
    return np.concatenate(out)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than `width` make one shingle, no words none."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    n = min(width, len(words))
    sums = np.full(len(words) - n + 1, n, np.uint64) * _TERMS[15]
    for k in range(n):
        sums += words[k : len(words) - n + 1 + k] * _TERMS[k]
    return np.unique(_mix(sums))


def min_max(shingles: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value under each permutation (multiplication by an odd number, a bijection of 64-bit numbers)."""
    factors = _PERMUTE[:permutations]
    least, most = np.full(permutations, _MASK, np.uint64), np.zeros(permutations, np.uint64)
    for at in range(0, len(shingles), 2048):
        values = shingles[at : at + 2048, None] * factors
        np.minimum(least, values.min(0), out=least)
        np.maximum(most, values.max(0), out=most)
    return least, most


def permutations_for(threshold: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Permutations that find a pair at the threshold (in percent) with probability 1 - miss; each gives two values."""
    bands = math.log(miss) / math.log1p(-((threshold / 100) ** rows)) if threshold < 100 else 1
    return rows * math.ceil(bands / 2)


def band_keys(shingles: np.ndarray, permutations: int, rows: int = ROWS) -> np.ndarray:
    """One key for each band of the signature; bands of least values first, then of greatest."""
    bands = np.concatenate(min_max(shingles, permutations)).reshape(-1, rows)
    keys = np.arange(len(bands), dtype=np.uint64) * _TERMS[14]
    for k in range(rows):
        keys = _mix(keys + bands[:, k] * _TERMS[k])
    return keys.view(np.int64)


def features(docs: DataFrame, width: int, permutations: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, width)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(band_keys(found, permutations, rows) if len(found) else None)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_shingles long, digest binary, bands array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles): the whole sets of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.record_batch([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])

    wanted = sized_join(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")), ids, ["id"], "left_semi")
    return wanted.mapInArrow(lean(run), "id long, shingles binary")


def hot_keys(counts: DataFrame, on: list[str], name: str) -> DataFrame:
    """(on, blocks), written: keys of counts (on, n) with more than one block of rows. They are rows / BLOCK at most."""
    return written(counts.where(F.col("n") > BLOCK).select(*on, F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")), name)


def dealt(rows: DataFrame, hot: DataFrame, on: list[str], by: str) -> DataFrame:
    """Rows with the `block` of their key that the hash of `by` deals them to; `blocks` is how many the key has."""
    rows = sized_join(rows, hot, on, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return rows.withColumn("block", F.pmod(F.xxhash64(F.col(by), F.lit(3)), "blocks"))


def copied(keyed: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """A row for each block of its key: the other side of a join with rows that were dealt."""
    found = sized_join(keyed, hot, on, "left")
    return found.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")


def with_sets(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b, ...), written, with the sets x of a and y of b. One a may have very many pairs; a b has as many as it has bands."""
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), ["a"], name)
    left = dealt(pairs, hot, ["a"], "b").drop("blocks").join(copied(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), hot, ["a"]), ["a", "block"])
    return left.drop("block").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b, linked): 100 * intersection >= threshold * union of the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, last, left = [], None, None
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if x is not last:
                    last, left = x, np.frombuffer(x, np.uint64)
                right = np.frombuffer(y, np.uint64)
                both = 0
                if threshold * max(len(left), len(right)) <= 100 * min(len(left), len(right)):
                    at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                    both = int((left[at] == right).sum())
                linked.append(100 * both >= threshold * (len(left) + len(right) - both))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return with_sets(pairs, sets, "hotpairs").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long, linked boolean")


def compare(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b, linked, of, bits, extra) of pairs (a, b, common): `confirm`, and how b looks from a.

    A bit for each shingle of a says whether b has it; `of` is a checksum of a's set;
    extra is how many of b's shingles that others have are none of a's. Two documents
    b and b' then share at most the bits that both have, and min(extra) more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, of, bits, extra, last, mine = [], [], [], [], None, None
            for x, y, common in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if x is not last:
                    last, mine = x, np.frombuffer(x, np.uint64)
                other = np.frombuffer(y, np.uint64)
                has = np.isin(mine, other, assume_unique=True)
                both = int(has.sum())
                linked.append(100 * both >= threshold * (len(mine) + len(other) - both))
                of.append(zlib.crc32(x))
                bits.append(np.packbits(np.pad(has, (0, -len(has) % 64)), bitorder="little").view(np.int64))
                extra.append(max(0, common - both))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(of, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(extra, pa.int64())], names=["a", "b", "linked", "of", "bits", "extra"])

    rows = with_sets(pairs, sets, "hotviews").select("a", "b", "x", "y", "common")
    return rows.mapInArrow(lean(run), "a long, b long, linked boolean, of long, bits array<long>, extra long")


def still_mixed(rows: DataFrame, hot: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """(key, block, rep, component) of members (key, block, rep) of the buckets that have more than one component."""
    at = rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "block", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = at.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("key")
    return written(at.join(copied(mixed, hot, ["key"]), ["key", "block"]), name)


def meetings(left: DataFrame, threshold: int) -> DataFrame:
    """Pairs of rows (key, rep, n, ...) of one bucket and of like size, block by block; the other row's columns begin with p_.

    Sets whose sizes differ by more than the threshold allows can't be linked, so
    members are put to classes by the logarithm of their size: linked ones are of
    one class or of neighbours. A row is in the group of its class and of the one
    below; a pair counts in the group of its smaller class.
    """
    wide = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / threshold) + 1e-9) if threshold < 100 else F.col("n")
    rows = left.withColumn("size_class", wide.cast("long")).withColumn("group", F.explode(F.array(F.col("size_class"), F.col("size_class") - 1)))
    on = ["key", "group"]
    hot = hot_keys(rows.groupBy(*on).agg(F.count("*").alias("n")), on, "hotgroups")
    rows = dealt(rows.drop("block"), hot, on, "rep")
    first = rows.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).drop("blocks")
    second = rows.withColumn("lower", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block")))).drop("blocks")
    second = second.select(*on, F.col("lower").alias("block"), F.col("block").alias("other"), *(F.col(c).alias(f"p_{c}") for c in rows.columns if c not in (*on, "block", "blocks")))
    met = first.join(second, [*on, "block", "other"])
    return met.where(((F.col("block") < F.col("other")) | (F.col("rep") < F.col("p_rep"))) & (F.least("size_class", "p_size_class") == F.col("group")))


def shared_counts(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, common): the size of a document's set, and how many of its shingles another of `ids` has as well.

    A document shares at most `common` shingles with any other, so two documents
    have at most min(common) in both and n + n' - min(common) in all. Pairs that
    this bound rules out need no comparison, which is what keeps a large group of
    texts that are alike, but not enough, from being compared each with each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles"):
            found = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            sizes = [len(x) for x in found]
            yield pa.record_batch([pa.array(np.concatenate(found)), pa.array(np.repeat(batch.column(0).to_numpy(), sizes))], names=["shingle", "id"])

    open_sets = sized_join(sets, ids, ["id"], "left_semi")
    # A shingle with one id has least = most; repeated rows of one id don't make it common.
    each = open_sets.mapInArrow(lean(run), "shingle long, id long").groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    alone = each.where("id = other").groupBy("id").agg(F.count("*").alias("alone"))
    sizes = open_sets.groupBy("id").agg(F.expr("min(octet_length(shingles)) div 8").alias("n"), F.expr("max(octet_length(shingles)) div 8").alias("most"), F.countDistinct("shingles").alias("sets"))
    # An id with several texts may share as much as its longest one has.
    common = F.when(F.col("sets") == 1, F.col("n") - F.coalesce("alone", F.lit(0))).otherwise(F.col("most"))
    return sizes.join(alone, "id", "left").select("id", "n", common.alias("common"))


def first_meeting(bands: Column, other: Column, key: Column) -> Column:
    """Whether two documents have no key in common before this one."""
    before = F.slice(bands, F.lit(1), F.greatest(F.array_position(bands, key).cast("int") - 1, F.lit(0)))
    return ~F.arrays_overlap(before, other)


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(id, component): the smallest id reachable, for every id of `edges` (a, b).

    Alternates large and small stars until every edge leads to a smallest id; the
    number of rounds grows with the logarithm of the graph, and each is written.
    """
    stars = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    while True:
        # Small star has been reached when every u has one v, and no v is a u.
        open_u = stars.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not open_u and not stars.join(stars.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        stars = written(small.where("u <> v").distinct(), name)


def mixed_buckets(wide: DataFrame, hot: DataFrame, classes: DataFrame, sets: DataFrame, tested: DataFrame, threshold: int) -> DataFrame:
    """`components` of all links, with those between members of buckets (key, block, rep, component) that pivots left apart."""
    room = written(shared_counts(sets, wide.select(F.col("rep").alias("id")).distinct()), "room")
    at = wide.join(room.withColumnRenamed("id", "rep"), "rep")
    # The middle of a bucket is the member with the fewest shingles of its own.
    middle = at.groupBy("key").agg(F.max(F.struct(F.col("common") / F.col("n"), F.xxhash64("rep"), "rep")).alias("m")).select("key", F.col("m.rep").alias("middle"))
    at = written(at.join(copied(middle, hot, ["key"]), ["key", "block"]), "middles")
    views = written(at.select(F.col("middle").alias("a"), F.col("rep").alias("b"), "common").distinct(), "looks")
    views = written(compare(views, sets, threshold), "views")
    tested = tested.union(views.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "linked"))
    labels = components(tested.where("linked"))
    left = still_mixed(at.select("key", "block", "rep"), hot, labels, "left")
    if left.isEmpty():
        return labels
    left = left.join(at.select("key", "rep", "middle", "n", "common"), ["key", "rep"]).join(views.select(F.col("a").alias("middle"), F.col("b").alias("rep"), "of", "bits", "extra"), ["middle", "rep"])
    # Members carry their keys, so that a pair is made in the first bucket that both are in, and in no other; an id with several texts in all of them.
    once = F.when(F.count("*") == 1, F.any_value("bands")).otherwise(F.expr("cast(array() as array<bigint>)"))
    left = written(left.join(classes.groupBy("rep").agg(once.alias("bands")), "rep"), "open")
    met = meetings(left, threshold)
    rough = F.least("common", "p_common")
    seen = F.aggregate(F.zip_with("bits", "p_bits", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda x, y: x + y) + F.least("extra", "p_extra")
    exact = F.when(F.col("of") == F.col("p_of"), F.least(rough, seen)).otherwise(rough)
    enough = lambda both: 100 * both >= threshold * (F.col("n") + F.col("p_n") - both)
    more = met.where((F.col("component") != F.col("p_component")) & enough(rough) & first_meeting(F.col("bands"), F.col("p_bands"), F.col("key")) & enough(exact))
    more = more.select(F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    more = confirm(written(more, "more"), sets, threshold)
    return components(tested.union(more).where("linked"))


def near_duplicates(docs: DataFrame, threshold: int = 80, width: int = 5, permutations: int | None = None, rows: int = ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= threshold * union of their
    shingle sets; component_id is the smallest doc_id that links reach, itself
    included, and kept says that it is the document's own.

    Defined results: a null or empty text, or one without words, has no shingles
    and is linked with nothing; a document with fewer words than `width` has its
    whole word sequence as its one shingle; a row with a null doc_id counts its
    shingles but is linked with nothing, has a null component_id and is kept;
    rows with one doc_id are one document: repeated ones count once, and where
    their texts differ, what any of them is linked with is linked with all; an
    empty table gives an empty one; other columns are ignored.
    """
    feat = written(features(docs, width, permutations or permutations_for(threshold, rows), rows), "shingles")
    known = feat.where("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("first"), F.count("*").alias("n"))
    classes = written(classes.select("digest", F.col("first.doc_id").alias("rep"), F.col("first.bands").alias("bands"), "n"), "classes")

    keys = classes.select(F.explode("bands").alias("key"), "rep")
    buckets = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.count("*").alias("n")).where("pivot <> last").select("key", "pivot", "n")
    buckets = written(buckets, "buckets")
    hot = hot_keys(buckets.select("key", "n"), ["key"], "hotbuckets")
    members = dealt(keys, hot, ["key"], "rep").drop("blocks").join(copied(buckets, hot, ["key"]), ["key", "block"])
    members = written(members.select("key", "block", "rep", "pivot", "n"), "members")
    sets = written(whole_sets(docs, members.select(F.col("rep").alias("id")).distinct(), width), "sets")

    pairs = written(members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    tested = written(confirm(pairs, sets, threshold), "tested")
    # Texts of one doc_id are one document, though they are of different classes.
    several = known.groupBy("doc_id").agg(F.min("digest").alias("p"), F.max("digest").alias("q")).where("p <> q").select("doc_id")
    several = known.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(classes.select("digest", "rep"), "digest")
    tested = written(tested.unionByName(several.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(True).alias("linked")).distinct()), "tested")
    labels = components(tested.where("linked"))
    # A bucket of two has been compared in full; so has one whose members are all of one component.
    wide = still_mixed(members.where("n > 2").select("key", "block", "rep"), hot, labels, "mixed")
    if not wide.isEmpty():
        labels = mixed_buckets(wide, hot, classes, sets, tested, threshold)

    copies = written(classes.where("n > 1").select("digest", "rep", "n"), "copies")
    hot = hot_keys(copies.select("digest", "n"), ["digest"], "hotcopies")
    named = dealt(feat.select("doc_id", "n_shingles", "digest"), hot, ["digest"], "doc_id").drop("blocks").join(copied(copies.drop("n"), hot, ["digest"]), ["digest", "block"], "left")
    named = named.withColumn("rep", F.coalesce("rep", "doc_id"))
    found = named.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
