"""Exact top-k search by distributed histogram selection.

All scores are whole numbers. Every task scores its vectors against every block of
queries and counts scores in equal intervals; the counts of all tasks show in which
interval each query's k-th score lies, and that interval is divided anew until it holds
one value. A last pass keeps what is above the k-th score, and of those equal to it the
smallest ids.

A task holds a chunk of its vectors and one block of queries. As nothing below a
chunk's own k-th score can be the k-th of all, it sends at most k counts a query; the
last pass sends at most k rows a query and chunk, however many vectors are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.shared import open_fs, work_dir, written

QUERY_BLOCK, VECTOR_BLOCK, INTERVALS = 2048, 1024, 1024
#: Bytes of vectors that a task holds at a time.
CHUNK_BYTES = 128 << 20
LONG = 2**63 - 1


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component. Rows that are null or hold null or non-finite components go."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.expr("vec_id is not null and x is not null and size(x) > 0 and forall(x, c -> c is not null and abs(c) < double('Infinity'))")
    return rows.where(fine).select("vec_id", F.expr(f"transform(x, c -> cast(floor({scale}D * c) as double))").alias("v"))


def matrix(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column without a copy of each value in Python."""
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:])]


def by_length(ids: list[int], rows: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    found: dict[int, tuple[list, list]] = {}
    for i, r in zip(ids, rows):
        a, b = found.setdefault(len(r), ([], []))
        a.append(i)
        b.append(r)
    return {n: (np.array(a, np.int64), np.vstack(b)) for n, (a, b) in found.items()}


def chunks(batches: Iterator[pa.RecordBatch], most_bytes: int = CHUNK_BYTES) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(ids, vectors) by length, of about so many bytes at a time."""
    ids, found, held = [], [], 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        rows = matrix(batch.column(1))
        found += rows
        held += sum(r.nbytes for r in rows)
        if held >= most_bytes:
            yield by_length(ids, found)
            ids, found, held = [], [], 0
    if ids:
        yield by_length(ids, found)


def inner(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in floating point while no sum reaches 2 ** 53, else in whole numbers.

    Products beyond a long count as the nearest long.
    """
    reach = float(np.sqrt((v * v).sum(1).max()) * np.sqrt((m * m).sum(1).max())) * (1 + 1e-9)
    if reach < 2**53:
        return (v @ m.T).astype(np.int64)
    if reach < 2**63 and max(np.abs(v).max(), np.abs(m).max()) < 2**63:
        # Sums may wrap around on the way, which doesn't change a result that fits.
        return v.astype(np.int64) @ m.T.astype(np.int64)
    whole = lambda a: np.array([[int(x) for x in r] for r in a], object)
    return np.clip(whole(v) @ whole(m).T, -LONG, LONG).astype(np.int64)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with all other vectors.

    Queries are the rows whose vec_id is divisible by `every`; ties go to the
    smaller vec_id. Defined results: vectors that are null, empty, or hold null
    or non-finite components, and rows without vec_id take no part; vectors of
    different length have no score; repeated rows of a query's vec_id are one
    query (the greatest vector) and no candidates of it, other repeated rows are
    candidates each; an empty table gives an empty one; other columns are
    ignored. Scores are exact in the range of a long; components and scores
    beyond it count as its nearest end.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale)
    most = rows.agg(F.max(F.expr("aggregate(v, 0D, (a, c) -> a + c * c)"))).first()[0]
    # No score is beyond the greatest squared norm; the margin is for its sum's own rounding.
    reach = min(int((most or 0) * (1 + 1e-9)) + 1, LONG)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    folder = work_dir(spark, "queries")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                for n, (ids, m) in by_length(part.column(0).to_pylist(), matrix(part.column(1))).items():
                    yield pa.record_batch([pa.array([f"{ids[0]}-{n}"]), pa.array([n], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["block", "length", "ids", "m"])

    # One row a block, in a file for each block: a task reads one at a time.
    blocks = queries.mapInArrow(pack, "block string, length int, ids binary, m binary")
    blocks.write.partitionBy("block").parquet(f"{folder}/vectors")
    # A line for each block of 2048 queries; a block's name is short.
    names = sorted(r[0] for r in spark.read.parquet(f"{folder}/vectors").select("block").distinct().collect()) if _any(spark, f"{folder}/vectors") else []
    if not names:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def scored(batches: Iterator[pa.RecordBatch], state: str | None):
        """(block, ids of queries, low ends, parts (ids, vectors), query vectors) of each chunk and block of queries."""
        import pyarrow.parquet as pq

        fs, path = open_fs(folder)
        sfs, spath = open_fs(state) if state else (None, None)
        for mine in chunks(batches):
            for name in names:
                length = int(name.rpartition("-")[2])
                if length not in mine:
                    continue
                block = pq.read_table(f"{path}/vectors/block={name}", filesystem=fs, columns=["ids", "m"], partitioning=None)
                q = np.frombuffer(block["ids"][0].as_py(), np.int64)
                m = np.frombuffer(block["m"][0].as_py()).reshape(len(q), length)
                low = np.full(len(q), -reach, np.int64)
                if state and sfs.get_file_info(f"{spath}/block={name}").type.name == "Directory":
                    t = pq.read_table(f"{spath}/block={name}", filesystem=sfs, columns=["query_id", "low"], partitioning=None)
                    at = {i: n for n, i in enumerate(q.tolist())}
                    low[[at[i] for i in t["query_id"].to_pylist()]] = t["low"].to_numpy()
                c, v = mine[length]
                yield name, q, low, [(c[i : i + VECTOR_BLOCK], v[i : i + VECTOR_BLOCK]) for i in range(0, len(c), VECTOR_BLOCK)], m

    def histogram(width: int, span: int, state: str | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, q, low, parts, m in scored(batches, state):
                counts = np.zeros((len(q), INTERVALS), np.int64)
                for c, v in parts:
                    scores = inner(v, m)
                    # Scores beyond the interval that is divided were counted in passes before. The distance from a low end may need all 64 bits.
                    at = scores.view(np.uint64) - low.view(np.uint64)
                    where, which = np.nonzero((scores >= low) & (at < np.uint64(span)) & (c[:, None] != q))
                    interval = (at[where, which] // np.uint64(width)).astype(np.int64)
                    counts += np.bincount(which * INTERVALS + interval, minlength=counts.size).reshape(counts.shape)
                # Only the highest intervals, until they hold k.
                above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
                row, interval = np.nonzero((counts > 0) & (above < k))
                if len(row):
                    start = (low[row].view(np.uint64) + interval.astype(np.uint64) * np.uint64(width)).view(np.int64)
                    yield pa.record_batch([pa.array([name] * len(row)), pa.array(q[row]), pa.array(start), pa.array(counts[row, interval])], names=["block", "query_id", "low", "n"])

        return run

    state, above, span, width = None, None, 2 * reach + 1, -(-(2 * reach + 1) // INTERVALS)
    while True:
        counts = rows.mapInArrow(histogram(width, span, state), "block string, query_id long, low long, n long")
        counts = counts.groupBy("block", "query_id", "low").agg(F.sum("n").alias("n"))
        if above is not None:
            counts = counts.join(above, "query_id")
        else:
            counts = counts.withColumn("above", F.lit(0).cast("long"))
        down = Window.partitionBy("query_id").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.col("above") + F.coalesce(F.sum("n").over(down), F.lit(0)))
        # The interval of the k-th score; a query with fewer scores than k has none and keeps all.
        found = counts.where((F.col("before") < k) & (F.col("before") + F.col("n") >= k))
        state = work_dir(spark, "kth")
        found.select("block", "query_id", "low", F.col("before").alias("above")).write.partitionBy("block").parquet(state)
        if width == 1:
            break
        above = spark.read.parquet(state).select("query_id", "above") if _any(spark, state) else None
        if above is None:
            break
        span, width = width, -(-width // INTERVALS)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, low, parts, m in scored(batches, state):
            for c, v in parts:
                scores = inner(v, m)
                keep = scores >= low
                keep[c[:, None] == q] = False
                where, which = np.nonzero(keep)
                s, i = scores[where, which], c[where]
                # Of scores equal to the k-th, the k smallest ids here are enough.
                order = np.lexsort((i, -s, which))
                where, which, s, i = where[order], which[order], s[order], i[order]
                nth = np.arange(len(which)) - np.searchsorted(which, which)
                few = nth < k
                if few.any():
                    yield pa.record_batch([pa.array(q[which[few]]), pa.array(i[few]), pa.array(s[few])], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(select, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _any(spark, path: str) -> bool:
    """Whether a folder written by block has any."""
    fs, where = open_fs(path)
    from pyarrow.fs import FileSelector

    return any(f.base_name.startswith("block=") for f in fs.get_file_info(FileSelector(where)))


ORACLE = """
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
 x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS c FROM v),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.c * c.c)::BIGINT AS score FROM x q JOIN x c ON q.i = c.i AND q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
