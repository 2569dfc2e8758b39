"""Best-fit packing of tokenized documents into fixed-length training sequences.

1. One narrow stage cuts documents into pieces (no text or ids are shuffled) and
   numbers the pieces of each length within its task.
2. The length histogram, at most `capacity` numbers, goes to the driver. There a
   configuration linear program (how many sequences to fill in which way) is solved
   by multiplicative weights until every length is covered: knapsack dynamic programming
   prices fillings, rounding makes the solution whole, what that leaves is solved and
   rounded again, and only the last few hundredths are filled best-fit decreasing.
   Both work on the histogram, so their cost depends on `capacity`, not on the corpus.
3. The k-th piece of a length gets the k-th slot of that length. Ranks are the number
   within the task plus a prefix sum over tasks, so no length is ever in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.shared import slices, written
from quillgraph.llm.tokens import worker_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: Rounds of multiplicative weights, each of which brings all lengths an equal part further, and the step of the exponent.
ROUNDS = 10
STEP = 0.02
#: A round is priced anew until a pricing brings less than this part of the round, or so many times.
LEAST_GAIN, MOST_PRICINGS = 0.02, 8
#: The LP is solved and rounded again for what rounding left, until less than this part of all pieces is left, or so many times.
LEFT, MOST_SOLVED = 0.08, 5
#: A length is covered when so much of one slot is missing.
NEAR = 1e-6


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: documents longer than `capacity` tokens are cut so that only the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = end_id.to_bytes(4, "little")
        for batch in slices(batches, "text"):
            out: tuple[list, ...] = tuple([] for _ in range(7))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids += end
                total = len(ids) // 4
                start, length = 0, total % capacity or capacity
                for piece in range(-(-total // capacity)):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    for column, value in zip(out, (doc_id, piece, start, length, crc, part, int(seen[length]))):
                        column.append(value)
                    seen[length] += 1
                    start, length = start + length, capacity
            yield pa.record_batch([pa.array(c, pa.int32() if k in (1, 5) else pa.int64()) for k, c in enumerate(out)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most value in each room, and the index of a length it takes (-1: none)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for c in range(int(lengths[0]), capacity + 1):
        n = fits[c]
        gain = best[c - lengths[:n]]
        gain += value[:n]
        k = int(gain.argmax())
        best[c], took[c] = (gain[k], k) if gain[k] > best[c - 1] else (best[c - 1], -1)
    return best, took


def filling_with(first: int, took: list[int], sizes: list[int], capacity: int) -> dict[int, int]:
    """The length with index `first` and the most valuable filling of the room beside it. {index of a length: copies}"""
    out, c = {first: 1}, capacity - sizes[first]
    while c > 0:
        if (k := took[c]) < 0:
            c -= 1
        else:
            out[k] = out.get(k, 0) + 1
            c -= sizes[k]
    return out


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Fractional solution of the configuration LP, and a lower bound of its value: fillings and how many sequences of each.

    Covering program: every length l needs counts[l] slots. In round r of R each
    length is brought to r/R of its slots, and no further, by the filling that is
    worth most beside it at the weights of the round: so what is left to the next
    rounds is always mixed as all pieces are, and short pieces stay for the gaps of
    the last rounds. A length that is ahead of its share weighs less by a factor for
    each round ahead. The longest lengths come first; a round is priced again
    without the lengths that have reached its share. What a round could not bring
    so far is left to the next; after the last they go on until every length is
    covered, with no tolerance but that of the sums. Each of those passes completes
    a length at least, so they end.

    Weights are dual prices: their sum over all pieces, divided by the worth of the
    best filling, bounds the LP from below.
    """
    sizes, need = lengths.tolist(), counts.astype(float)
    covered = [0.0] * len(sizes)
    chosen: dict[tuple, float] = {}
    bound = volume = float((lengths * counts).sum()) / capacity
    r = 0
    while (need - covered > NEAR).any():
        r += 1
        share = need * min(r / rounds, 1)
        for _ in range(MOST_PRICINGS):
            open_ = np.flatnonzero(share - covered > NEAR)
            if not open_.size:
                break
            ahead = np.maximum(np.array(covered)[open_] / need[open_] * rounds - (r - 1), 0)
            # Slightly more than in proportion to the length: of fillings without a gap, those of long lengths come first and short ones stay for gaps.
            value = np.exp(-STEP * ahead) * lengths[open_] * (1 + 1e-3 * lengths[open_] / capacity)
            best, took = price(lengths[open_], value, capacity)
            bound = max(bound, float((value * need[open_]).sum() / best[capacity]))
            gained = _take(open_.tolist(), took.tolist(), sizes, share.tolist(), covered, chosen, capacity)
            if gained < LEAST_GAIN * volume / rounds:
                break
    return [(dict(k), x) for k, x in chosen.items()], bound


def _take(open_: list[int], took: list[int], sizes: list[int], share: list[float], covered: list[float], chosen: dict[tuple, float], capacity: int) -> float:
    """Take the best filling beside each open length, as often as none of its lengths gets more than its share. Returns how many sequences."""
    gained, room = 0.0, [sizes[i] for i in open_]
    for at in range(len(open_) - 1, -1, -1):
        if share[open_[at]] - covered[open_[at]] <= NEAR:
            continue
        filling = {open_[k]: n for k, n in filling_with(at, took, room, capacity).items()}
        if any(share[i] - covered[i] <= NEAR for i in filling):
            continue
        amount = min((share[i] - covered[i]) / n for i, n in filling.items())
        for i, n in filling.items():
            covered[i] += n * amount
        key = tuple(sorted(filling.items()))
        chosen[key] = chosen.get(key, 0.0) + amount
        gained += amount
    return gained


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings for what is left: the longest first, then always the longest that still fits, as often as all of them last."""
    out = []
    left = left.copy()
    while (there := np.flatnonzero(left)).size:
        room, filling, k = capacity, {}, there.size - 1
        while k >= 0:
            i = int(there[k])
            n = min(int(left[i]) - filling.get(i, 0), room // int(lengths[i]))
            if n > 0:
                filling[i] = filling.get(i, 0) + n
                room -= n * int(lengths[i])
            k = min(k - 1, int(np.searchsorted(lengths[there], room, side="right")) - 1)
        times = min(int(left[i]) // n for i, n in filling.items())
        for i, n in filling.items():
            left[i] -= n * times
        out.append((filling, times))
    return out


def rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], np.ndarray, float, float]:
    """(whole fillings of the LP's solution, pieces left of each length, the solution's value, the LP's lower bound).

    In order of amounts, a filling is taken as often as the running sum of amounts
    passes a whole number, if its pieces are there and its gap is no greater than
    the mean gap of the solution, rounded up: others are left to the next solution.
    """
    solution, bound = configurations(lengths, counts, capacity, rounds)
    left, kept, total = counts.tolist(), [], 0.0
    sizes, value = lengths.tolist(), sum(x for _, x in solution)
    gap = math.ceil(round(capacity - float((lengths * counts).sum()) / value, 3))
    for filling, x in sorted(solution, key=lambda f: (-f[1], sorted(f[0].items()))):
        if capacity - sum(sizes[i] * n for i, n in filling.items()) > gap:
            continue
        times, total = int(total + x + 0.5) - int(total + 0.5), total + x
        times = min([times, *(left[i] // n for i, n in filling.items())])
        if times > 0:
            for i, n in filling.items():
                left[i] -= n * times
            kept.append((filling, times))
    return kept, np.array(left, np.int64), value, bound


@dataclass
class Plan:
    """Whole fillings ({length: copies}, sequences) that hold exactly the pieces of a histogram, and how they came about."""

    fillings: list[tuple[dict[int, int], int]]
    #: Pieces shorter than a sequence, and those of them that rounded solutions of the LP place.
    pieces: int = 0
    placed: int = 0
    #: Value and lower bound of the first LP.
    value: float = 0.0
    bound: float = 0.0


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> Plan:
    """Solve the LP and round it, then again for the pieces that rounding left; best-fit decreasing for the last of them."""
    out = Plan([({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else [])
    short = sorted((l, n) for l, n in histogram.items() if l < capacity and n > 0)
    if not short:
        return out
    lengths, left = (np.array(x, np.int64) for x in zip(*short))
    named = lambda fillings: [({int(lengths[i]): n for i, n in filling.items()}, times) for filling, times in fillings]
    out.pieces = int(left.sum())
    for k in range(MOST_SOLVED):
        there = np.flatnonzero(left)
        kept, rest, value, bound = rounded(lengths[there], left[there], capacity, rounds)
        out.fillings += named([({int(there[i]): n for i, n in filling.items()}, times) for filling, times in kept])
        left[there] = rest
        if not k:
            out.value, out.bound = value, bound
        if not kept or left.sum() < LEFT * out.pieces:
            break
    out.placed = out.pieces - int(left.sum())
    out.fillings += named(best_fit(lengths, left, capacity))
    return out


def plan(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Whole fillings ({length: copies}, sequences) that hold exactly the pieces of the histogram."""
    return solve(histogram, capacity, rounds).fillings


def slots(fillings: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: the ranks from there on take one sequence each."""
    rows, sequence, taken = [], 0, {}
    for filling, times in fillings:
        offset = 0
        for length, copies in sorted(filling.items(), reverse=True):
            for _ in range(copies):
                rows.append((length, taken.get(length, 0), sequence, offset))
                taken[length] = taken.get(length, 0) + times
                offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most `capacity` tokens; one row per piece.

    Columns: doc_id, piece (from 0), start (the document's ids before the piece),
    length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    sequence_id, offset (place in the sequence; offsets of a sequence have no gaps).

    Defined results: null text counts as empty, so it is the end id alone; null
    doc_ids and repeated rows are packed like any others; documents of equal
    length are interchangeable; an empty table gives an empty one; other columns
    are ignored. The histogram sent to the driver has `capacity` rows at most.
    """
    pieces = written(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(histogram, capacity, rounds))
    # Slots are at most a few for each length and filling: bounded by capacity and rounds, not by rows.
    shared = docs.sparkSession.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select(F.col("length").alias("b_length"), F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, (F.col("length") == F.col("b_length")) & (F.col("part") == F.col("b_part"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        width = int(table[:, 1].max(initial=0)) + 1
        starts = table[:, 0] * width + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(starts, length * width + np.minimum(rank, width - 1), side="right") - 1
            slot = table[at]
            yield pa.record_batch([*batch.columns[:5], pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PACKED)
