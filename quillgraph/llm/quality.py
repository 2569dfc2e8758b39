"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

1. The labelled documents that training may use, a bounded number, are written once.
2. Units are counted in them: words and the marks at their ends, as they are written; a
   word like the one before it is the unit "again". The most frequent ones are the
   vocabulary; any other is the unit of its shape (case, digits, length, end).
3. Every unit has an index vector, sparse and random. A unit's vector is the sum of
   the index vectors of its neighbours, wherever it occurs in those documents, less
   what an average unit's neighbours are. Each task sums over its documents, whole
   numbers, so the result doesn't depend on how they are dealt.
4. A document's vector is the mean over its units. The network (one hidden layer) is
   trained in numpy; a temperature is fitted on a part that training leaves out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.shared import lean, sized_join, slices, smallest_hashes, written

#: Dimensions of vectors, entries of an index vector that aren't zero, and neighbours on either side.
DIMENSIONS, NONZERO, WINDOW = 128, 4, 2
#: Units by shape, then "again", then at most so many units by name.
SHAPES, VOCABULARY = 1024, 16_384
AGAIN = SHAPES
HIDDEN = 32
PRIOR_WORDS = 8
#: Occurrences of an average unit that a unit's vector is drawn to.
PRIOR_UNITS = 4
#: Labelled documents that vectors and network are trained on, at most: those with the smallest hash of their id.
MOST_LABELLED = 12_000
#: Tasks of training, and rows of vectors that they send together.
TRAINERS, ROWS_SENT = 12, 1024

_MARKS = ".,;:!?\"'()[]{}#*$%&|<>=+-_/\\~^@"
#: Words in a worker's cache before it is emptied.
_KEPT = 60_000
SCORES = "doc_id long, held_out boolean, score double, predicted int"


def split_word(word: str) -> tuple[str, str]:
    """(what is between marks, marks at its end); a word of marks alone is all of itself."""
    core = word.strip(_MARKS)
    return (core, word[len(word.rstrip(_MARKS)) :]) if core else (word, "")


def shape(unit: str) -> int:
    """Number of a unit's shape: case, digits, length and last character, or the marks that it begins with."""
    core = unit.strip(_MARKS)
    case = 0 if not core else 1 if core.islower() else 2 if core.isupper() and len(core) > 1 else 3 if core[0].isupper() else 4
    text = f"{case} {min(sum(c.isdigit() for c in core), 3)} {min(len(core), 24) // 4} {core[-1].isalpha()}" if core else f"{unit[:2]} {min(len(unit), 8)}"
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % SHAPES


def index_vectors(units: int, dimensions: int = DIMENSIONS, nonzero: int = NONZERO, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the entries of each unit's index vector that aren't zero. Places may repeat."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, dimensions, (units, nonzero)), rng.choice([-1, 1], (units, nonzero))


@dataclass
class Units:
    """Numbers of units; a worker's cache has those of words that it has seen."""

    names: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.cache: dict[str, int] = {}

    def __reduce__(self):
        return Units, (self.names,)

    @property
    def size(self) -> int:
        return SHAPES + 1 + len(self.names)

    def _number(self, unit: str) -> int:
        found = self.names.get(unit)
        return shape(unit) if found is None else found

    def _pack(self, word: str) -> int:
        """A word's hash (32 bits), unit (16) and the unit of its marks plus one (16)."""
        found = self.cache.get(word)
        if found is None:
            core, tail = split_word(word)
            found = zlib.crc32(word.encode("utf-8", "surrogatepass")) << 32 | self._number(core) << 16 | (self._number(tail) + 1 if tail else 0)
            if len(word) < 64:
                self.cache[word] = found
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, int]:
        """(a text's units in order, its number of words)."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64), 0
        packed = np.fromiter(map(self._pack, words), np.uint64, len(words))
        if len(self.cache) > _KEPT:
            self.cache.clear()
        units = np.zeros((len(words), 2), np.int64)
        units[:, 0] = (packed >> np.uint64(16)) & np.uint64(0xFFFF)
        units[:, 1] = (packed & np.uint64(0xFFFF)).astype(np.int64) - 1
        word = packed >> np.uint64(32)
        units[1:, 0][word[1:] == word[:-1]] = AGAIN
        flat = units.ravel()
        return flat[flat >= 0], len(words)


def neighbour_sums(units: list[np.ndarray], size: int) -> np.ndarray:
    """Sums of the index vectors of each unit's neighbours, and in a last column how many there were."""
    places, signs = index_vectors(size)
    out = np.zeros((size, DIMENSIONS + 1), np.int64)
    for ids in units:
        for at in range(0, len(ids), 1 << 16):
            part = ids[max(0, at - WINDOW) : at + (1 << 16)]
            first = at - max(0, at - WINDOW)  # pairs that lie before it were counted with the part before
            for step in range(1, WINDOW + 1):
                a, b = part[max(0, first - step) : -step], part[max(0, first - step) + step :]
                for unit, near in ((a, b), (b, a)):
                    np.add.at(out, (unit[:, None], places[near]), signs[near])
                    np.add.at(out, (unit, DIMENSIONS), 1)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors from sums: the mean neighbour less the mean of all, drawn to nothing for rare units, of length 1 at most."""
    n = sums[:, -1:].astype(np.float64)
    average = sums[:, :-1].sum(0) / max(n.sum(), 1)
    mean = (sums[:, :-1] - n * average) / (n + PRIOR_UNITS)
    return (mean / (np.linalg.norm(mean, axis=1, keepdims=True) + 0.05)).astype(np.float32)


def pool(texts: list[str | None], units: Units, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean of its units' vectors, and the logarithm of its number of words. Empty texts have zeros."""
    out = np.zeros((len(texts), DIMENSIONS + 1), np.float32)
    for row, text in zip(out, texts):
        ids, n = units.of(text)
        if n:
            kinds, counts = np.unique(ids, return_counts=True)
            row[:-1] = counts.astype(np.float32) @ vectors[kinds] / len(ids)
            row[-1] = np.log1p(n) / 10
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardized rows; those of few words are drawn to the mean, as if they had PRIOR_WORDS average words more."""
    words = np.expm1(10 * x[:, -1:])
    return ((x - mean) / scale * (words / (words + PRIOR_WORDS))).astype(np.float32)


@dataclass
class Network:
    """Two layers and a temperature; `constant` instead where there was nothing to learn from."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(standard(x, self.mean, self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self.logits(x).astype(float) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, seed: int = 5) -> Network:
    """Adam on cross entropy with weight decay, then the temperature that fits every fifth row, which training leaves out.

    No rows: every score is 1, as nothing can be rejected without a reason. One
    class only: every score is its smoothed share.
    """
    if not len(y):
        return Network(constant=1.0)
    if y.min() == y.max():
        return Network(constant=float((y.sum() + 1) / (len(y) + 2)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = (order[::5], np.delete(order, np.s_[::5])) if len(y) >= 50 else (order, order)
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-3
    z, t = standard(x[used], mean, scale), y[used].astype(np.float32)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, hidden**-0.5, hidden).astype(np.float32), np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for rows in np.array_split(rng.permutation(len(t)), max(1, len(t) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            d = (sigmoid(h @ p[2] + p[3]) - t[rows]) / len(rows)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
            step += 1
            for a, g, i, j in zip(p, grads, m, v):
                i += 0.1 * (g - i)
                j += 0.001 * (g * g - j)
                a -= rate * (i / (1 - 0.9**step)) / (np.sqrt(j / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    out, truth = net.logits(x[held]).astype(float), y[held]
    loss = lambda temp: -np.mean(np.log(np.where(truth == 1, sigmoid(out / temp), 1 - sigmoid(out / temp)) + 1e-12))
    net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return net


def held_out(doc_id):
    """crc32 of the id as text, modulo 4, is 2: such rows are never learned from. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    units: Units
    vectors: np.ndarray
    net: Network

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.net.scores(pool(texts, self.units, self.vectors)) if self.net.constant is None else self.net.scores(texts)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(id, label, text), written: documents that are labelled and not held out, `most` rows at most even where ids repeat."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out("id"))
    chosen = smallest_hashes(known, ["id"], ["id", "label"], most)
    # At most `most` rows of two numbers.
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), "id long, label int")
    rows = sized_join(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")), chosen, ["id"], "inner", most)
    rows = rows.select("id", "label", "text").orderBy(F.xxhash64("id", "text"), "id", "label", "text").limit(most)
    return written(rows.repartition(TRAINERS, F.xxhash64("id", "text")), "labelled")


def vocabulary(rows: DataFrame, most: int = VOCABULARY) -> Units:
    """The most frequent units of texts, counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word, n in Counter((text or "").split()).items():
                    for unit in split_word(word):
                        if unit and len(unit) <= 64:
                            seen[unit] += n
        if seen:
            yield pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["unit", "n"])

    counts = rows.select("text").mapInArrow(lean(run), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1")
    # At most `most` short words.
    top = [r["unit"] for r in counts.orderBy(F.desc("n"), "unit").limit(most).collect()]
    return Units({u: SHAPES + 1 + i for i, u in enumerate(sorted(top))})


def train_vectors(rows: DataFrame, units: Units) -> np.ndarray:
    """Word vectors of the units, from sums that tasks make over their texts."""
    shared = rows.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, sums = shared.value, None
        for batch in batches:
            found = neighbour_sums([units.of(t)[0] for t in batch.column(0).to_pylist()], units.size)
            sums = found if sums is None else sums + found
        if sums is not None:
            at = range(0, len(sums), ROWS_SENT)
            yield pa.record_batch([pa.array(list(at), pa.int32()), pa.array([sums[i : i + ROWS_SENT].astype("<i4").tobytes() for i in at], pa.binary())], names=["first", "sums"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i4").astype(np.int64) for x in part["sums"])
        return pd.DataFrame({"first": part["first"].iloc[:1], "sums": [total.astype("<i8").tobytes()]})

    parts = rows.select("text").mapInArrow(lean(run), "first int, sums binary").groupBy("first").applyInPandas(add, "first int, sums binary")
    # A row for 1024 units: under 20 MB in all.
    got = sorted((r["first"], r["sums"]) for r in parts.collect())
    sums = np.frombuffer(b"".join(x for _, x in got), "<i8").reshape(-1, DIMENSIONS + 1) if got else np.zeros((units.size, DIMENSIONS + 1), np.int64)
    return word_vectors(sums)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Train on labelled documents that aren't held out, `most` rows at most; all labelled rows where there are fewer."""
    rows = training_rows(docs, labels, label, most)
    units = vocabulary(rows)
    vectors = train_vectors(rows, units)
    shared = docs.sparkSession.sparkContext.broadcast((units, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, vectors = shared.value
        for batch in slices(batches, "text", 1 << 20):
            x = pool(batch.column(2).to_pylist(), units, vectors)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "x"])

    got = rows.select("id", "label", "text").mapInArrow(lean(run), "id long, label int, x binary").toPandas().sort_values(["id", "label", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), DIMENSIONS + 1)
    return Model(units, vectors, train(x, got["label"].to_numpy()))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, most: int = MOST_LABELLED) -> DataFrame:
    """One row per row of `docs` (doc_id, text): held_out, score (0 to 1), predicted (1 if score >= threshold).

    `labels` (doc_id, label of 0 or 1) is learned from only where doc_id isn't
    held out. Defined results: null and empty texts are scored as a document
    without words; a null doc_id stays null; repeated rows have equal scores;
    labels that are null or not 0 or 1 are ignored, repeated labels count each;
    without labels every score is 1; an empty table gives an empty one; other
    columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            score = model.value.scores(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(run), SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with all their columns and no shuffle.

    Defined results are those of `classify`: a null or empty text is kept or not
    by its score, repeated rows alike, an empty table gives an empty one, and
    other columns, whatever their names, pass through.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, most))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield batch.filter(pa.array(model.value.scores(batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
