"""Token-id files of directly addressable codes: any token can be read without decoding a block.

A file holds blocks and a footer. Within a block, an id is split into chunks of
8 bits. Level 0 has the lowest chunk of every id, level 1 the next chunk of those
ids that have one, and so on; a bitmap of each level says which ids continue, and
a directory with the count of set bits before every 512th bit gives an id's place
in the next level by one directory entry and at most eight words of bits.

    file    = "DAC1" block* footer footer_length:u64 "DAC1"
    block   = level*        level = chunks:u8[n] bits:u64[ceil(n/64)] ranks:u32[ceil(n/512)]
    footer  = zlib JSON: blocks [[offset, [n of each level]]], and doc_ids, sizes as base64 i64
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.shared import open_fs, slices, work_dir
from quillgraph.llm.tokens import worker_encoder

MAGIC = b"DAC1"
BLOCK_TOKENS = 1 << 19
WORD, RANK = 64, 512

CHECKED = "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, last_id long"


def encode_block(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """A block's bytes and the number of entries in each level."""
    out, sizes, rest = [], [], ids.astype(np.uint32)
    while True:
        n = len(rest)
        more = rest > 255
        bits = np.packbits(np.pad(more, (0, -n % WORD)), bitorder="little")
        ones = np.cumsum(np.pad(more, (0, -n % RANK)).reshape(-1, RANK).sum(1, dtype=np.int64))
        ranks = np.concatenate([[0], ones[:-1]]).astype("<u4") if len(ones) else ones.astype("<u4")
        out += [(rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        sizes.append(n)
        rest = rest[more] >> 8
        if not len(rest):
            return b"".join(out), sizes


def level_places(sizes: list[int]) -> list[tuple[int, int, int]]:
    """Offsets of chunks, bits and ranks of each level in its block."""
    out, at = [], 0
    for n in sizes:
        bits = at + n
        ranks = bits + -(-n // WORD) * 8
        out.append((at, bits, ranks))
        at = ranks + -(-n // RANK) * 4
    return out


def decode_block(raw: bytes, sizes: list[int]) -> np.ndarray:
    """All ids of a block."""
    ids, among = np.zeros(sizes[0], np.uint32), np.arange(sizes[0])
    for level, (n, (chunks, bits, _)) in enumerate(zip(sizes, level_places(sizes))):
        ids[among] |= np.frombuffer(raw, np.uint8, n, chunks).astype(np.uint32) << np.uint32(8 * level)
        more = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // WORD) * 8, bits), bitorder="little")[:n].astype(bool)
        among = among[more]
    return ids


class Writer:
    """Streams documents into one file; holds one block of ids at a time."""

    def __init__(self, out, block_tokens: int = BLOCK_TOKENS):
        self.out, self.block_tokens = out, block_tokens
        self.at, self.held, self.n_held = len(MAGIC), [], 0
        self.blocks: list = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids))
        while len(ids):
            part, ids = ids[: self.block_tokens - self.n_held], ids[self.block_tokens - self.n_held :]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == self.block_tokens:
                self._flush()

    def _flush(self) -> None:
        if self.n_held:
            raw, sizes = encode_block(np.concatenate(self.held))
            self.out.write(raw)
            self.blocks.append([self.at, sizes])
            self.at, self.held, self.n_held = self.at + len(raw), [], 0

    def close(self) -> None:
        self._flush()
        b64 = lambda x: base64.b64encode(np.array(x, "<i8").tobytes()).decode()
        footer = zlib.compress(json.dumps({"blocks": self.blocks, "null": [i for i, d in enumerate(self.doc_ids) if d is None], "doc_ids": b64([d or 0 for d in self.doc_ids]), "sizes": b64(self.sizes)}).encode())
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


@dataclass
class Reader:
    """Reads a file of Writer: whole documents in order, or single tokens."""

    source: object  # a seekable file with read, seek and size

    def __post_init__(self):
        size = self.source.size()
        tail = self._read(size - 12, 12)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(tail[:8], "little")
        footer = json.loads(zlib.decompress(self._read(size - 12 - n, n)))
        arr = lambda x: np.frombuffer(base64.b64decode(x), "<i8")
        self.blocks, self.sizes = footer["blocks"], arr(footer["sizes"])
        null = set(footer["null"])
        self.doc_ids = [None if i in null else int(d) for i, d in enumerate(arr(footer["doc_ids"]))]
        self.firsts = np.cumsum([0, *(b[1][0] for b in self.blocks)])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def token(self, i: int) -> int:
        """The i-th id of the file, by a few small reads: no block is decoded."""
        b = int(np.searchsorted(self.firsts, i, side="right")) - 1
        offset, sizes = self.blocks[b]
        i -= int(self.firsts[b])
        value = 0
        for level, (chunks, bits, ranks) in enumerate(level_places(sizes)):
            value |= self._read(offset + chunks + i, 1)[0] << (8 * level)
            first = i // RANK * RANK
            raw = self._read(offset + bits + first // 8, i // 8 - first // 8 + 1)
            word = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: i - first + 1]
            if not word[-1]:
                break
            i = int.from_bytes(self._read(offset + ranks + i // RANK * 4, 4), "little") + int(word[:-1].sum())
        return value

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """Ids at many places of the file, each found as `token` does, level by level; no block is decoded.

        Of a level only what the places touch is looked at: a chunk, the bits from
        a directory entry to the place, and that entry.
        """
        out, block_of = np.zeros(len(at), np.uint32), np.searchsorted(self.firsts, at, side="right") - 1
        for b in np.unique(block_of).tolist():
            mine = np.flatnonzero(block_of == b)
            offset, sizes = self.blocks[b]
            raw = np.frombuffer(self._read(offset, level_places(sizes)[-1][2] + -(-sizes[-1] // RANK) * 4), np.uint8)
            i, value = at[mine] - self.firsts[b], np.zeros(len(mine), np.uint32)
            live = np.arange(len(mine))
            for level, (n, (chunks, bits, ranks)) in enumerate(zip(sizes, level_places(sizes))):
                value[live] |= raw[chunks + i].astype(np.uint32) << np.uint32(8 * level)
                more = (raw[bits + i // 8] >> (i % 8).astype(np.uint8)) & 1 == 1
                live, i = live[more], i[more]
                if not len(live):
                    break
                # Rank: the directory's count, and the set bits from its place on.
                first = i // RANK * RANK
                span = np.arange(RANK // 8)
                bytes_ = raw[np.minimum(bits + first[:, None] // 8 + span, len(raw) - 1)]
                keep = np.clip(i[:, None] - first[:, None] - 8 * span, 0, 8)
                before = np.bitwise_count(bytes_ & ((1 << keep) - 1).astype(np.uint8)).sum(1, dtype=np.int64)
                i = raw[(ranks + i // RANK * 4)[:, None] + np.arange(4)].view("<u4")[:, 0].astype(np.int64) + before
            out[mine] = value
        return out

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order; holds a block, or one document where that is longer."""
        blocks, held, have = iter(self.blocks), [], 0
        for doc_id, n in zip(self.doc_ids, self.sizes.tolist()):
            while have < n:
                offset, sizes = next(blocks)
                end = level_places(sizes)[-1][2] + -(-sizes[-1] // RANK) * 4
                held.append(decode_block(self._read(offset, end), sizes))
                have += sizes[0]
            ids = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, np.uint32)
            yield doc_id, ids[:n]
            held, have = [ids[n:]], have - n


def write_files(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, rows_per_file: int = 8192, most_files: int = 100_000) -> list[tuple[int, str, int, int]]:
    """Write ids in ascending doc_id order; returns (part, file, documents, tokens) of each file in that order.

    Texts are dealt by ranges of doc_id and, where one id has very many rows, of
    their hash, and sorted, so each task streams one file. A file gets its name only when it is whole, and a task that is run again
    writes a new one: the list has the files of the tasks that counted.
    """
    rows = docs.count()
    n = max(1, min(most_files, -(-rows // rows_per_file)))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("hash"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first()).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        part, encoder, end = TaskContext.get().partitionId(), worker_encoder(tokenizer), end_id.to_bytes(4, "little")
        name = f"part-{part:06d}-{uuid.uuid4().hex}.dac"
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/.{name}") as out:
            writer = Writer(out)
            for batch in slices(batches, "text"):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                    writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
            writer.close()
        fs.move(f"{path}/.{name}", f"{path}/{name}")
        yield pa.record_batch([pa.array([part], pa.int32()), [name], pa.array([len(writer.sizes)], pa.int64()), pa.array([sum(writer.sizes)], pa.int64())], names=["part", "file", "n_docs", "n_tokens"])

    # One row a file, at most most_files.
    return sorted(tuple(r) for r in ordered.mapInArrow(run, "part int, file string, n_docs long, n_tokens long").collect())


def read_files(spark, folder: str, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, first_id, last_id, read back from the files.

    The first and the last id of each document are read by their places alone,
    and must be those of the documents as they are decoded.
    """
    starts = np.cumsum([0, *(f[3] for f in files)]).tolist()
    todo = spark.sparkContext.broadcast([(f[1], s) for f, s in zip(files, starts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, start = todo.value[k]
                with fs.open_input_file(f"{path}/{name}") as source:
                    rows: list = []
                    reader = Reader(source)
                    ends = np.cumsum(reader.sizes)
                    first, last = reader.tokens(ends - reader.sizes).tolist(), reader.tokens(ends - 1).tolist()
                    for n, (doc_id, ids) in enumerate(reader.documents()):
                        if (ids[0], ids[-1]) != (first[n], last[n]):
                            raise ValueError(f"{name}: document {n} differs by place")
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), first[n], last[n]))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32", "first_id", "last_id"])

    n = len(files)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, CHECKED)


def tokenize_to_files(docs: DataFrame, folder: str | None = None, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, rows_per_file: int = 8192) -> DataFrame:
    """Write the token ids of documents (doc_id, text) to files and return what reading them back gives.

    Defined results: null text counts as empty, so it is the end id alone; null
    doc_ids come first; rows of equal doc_id are ordered by a hash of their text,
    then by the text, and may be in several files; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "tokens")
    return read_files(spark, folder, write_files(docs, folder, tokenizer, end_id, rows_per_file))
