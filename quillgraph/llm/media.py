"""Media columns: members of archives on shared storage, read by a Spark data source.

`write_archives` stores media as members of ZIP archives, one streamed by each task.
`MediaSource` reads a folder of archives: it plans byte ranges over them from their
sizes alone, a task reads the directories at the end of its archives, takes the members
that begin in its range and streams them as Arrow batches of bounded size. Each member is
read by its offset, checked, and read again by itself where that fails.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import wave
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillgraph.llm.shared import open_fs, slices, work_dir

MEMBERS = "archive string, offset long, name string, media binary"
MANIFEST = "archives.txt"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
SAMPLE_RATE, UNIT = 8000, 64


def to_wave(payload: bytes) -> bytes:
    """8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(SAMPLE_RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wave(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    """Bytes 0 are added up to a positive multiple of the unit."""
    return raw + bytes(-len(raw) % unit if raw else unit)


def write_archives(docs: DataFrame, folder: str) -> list[str]:
    """Store each text's UTF-8 bytes as a wave member named `doc_id-n_bytes.wav`; returns the archives' names.

    A task that runs again writes a new archive; the manifest lists the archives
    of the tasks that counted, one line each, and readers see no others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip", 0
        with fs.open_output_stream(f"{path}/.{name}") as out, zipfile.ZipFile(Stream(out), "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
            for batch in slices(batches, "text"):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    # The first part makes members of one archive differ in name where ids repeat.
                    archive.writestr(zipfile.ZipInfo(f"{n}/{'' if doc_id is None else doc_id}-{len(raw)}.wav"), to_wave(padded(raw)), zipfile.ZIP_DEFLATED, 1)
                    n += 1
        fs.move(f"{path}/.{name}", f"{path}/{name}")
        if n:
            yield pa.record_batch([pa.array([name])], names=["archive"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # One short name for each task of the write.
    names = sorted(r[0] for r in rows.mapInArrow(run, "archive string").collect())
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{MANIFEST}") as out:
        out.write("\n".join(names).encode())
    return names


class Stream(io.RawIOBase):
    """An output stream of pyarrow as zipfile wants one: it can't seek."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def writable(self) -> bool:
        return True


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[ByteRange]:
        """Ranges over the archives that the manifest lists; no archive is opened."""
        fs, path = open_fs(self.folder)
        with fs.open_input_stream(f"{path}/{MANIFEST}") as source:
            names = source.read().decode().split()
        sizes = [i.size for i in fs.get_file_info([f"{path}/{n}" for n in names])] if names else []
        return [ByteRange(n, a, min(a + self.range_bytes, s)) for n, s in zip(names, sizes) for a in range(0, s, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, path = open_fs(self.folder)
        where = f"{path}/{partition.archive}"
        with fs.open_input_file(where) as source, zipfile.ZipFile(source) as archive:
            members = sorted((m.header_offset, m.compress_size, m.file_size, m.CRC, m.compress_type, m.filename) for m in archive.infolist() if partition.start <= m.header_offset < partition.end)
        rows, held = [], 0
        source = fs.open_input_file(where)
        try:
            for offset, packed, size, crc, method, name in members:
                for left in range(self.tries - 1, -1, -1):
                    try:
                        media = read_member(source, offset, packed, size, crc, method)
                        break
                    except (OSError, zlib.error, ValueError):
                        if not left:
                            raise
                        source.close()
                        source = fs.open_input_file(where)
                rows.append((partition.archive, offset, name, media))
                held += len(media)
                if held >= self.batch_bytes:
                    yield member_batch(rows)
                    rows, held = [], 0
            if rows:
                yield member_batch(rows)
        finally:
            source.close()


def member_batch(rows: list) -> pa.RecordBatch:
    archive, offset, name, media = zip(*rows)
    return pa.record_batch([pa.array(archive), pa.array(offset, pa.int64()), pa.array(name), pa.array(media, pa.binary())], names=["archive", "offset", "name", "media"])


def read_member(source, offset: int, packed: int, size: int, crc: int, method: int) -> bytes:
    """One member by its offset; raises ValueError if its size or checksum is wrong."""
    source.seek(offset)
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member begins here")
    source.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
    raw = source.read(packed)
    media = zlib.decompress(raw, -15) if method == zipfile.ZIP_DEFLATED else raw
    if len(media) != size or zlib.crc32(media) != crc:
        raise ValueError("a member is damaged")
    return media


class MediaSource(DataSource):
    """`spark.read.format("quill_media").load(folder)`; options rangeBytes, batchBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "quill_media"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def feature(samples: np.ndarray) -> str:
    """Mean level, root mean square and zero crossings of centred samples, and the mean level of 8 equal parts; whole numbers only."""
    x = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    # A payload is a positive multiple of 64 samples, so it has 8 equal parts.
    parts = x.reshape(8, -1).sum(1) * 100 // (len(x) // 8)
    return f"n={len(x)};mean={int(x.sum()) * 100 // len(x)};power={int((x * x).sum()) // len(x)};crossings={crossings};parts={','.join(map(str, parts.tolist()))}"


def media_features(members: DataFrame) -> DataFrame:
    """Digests and a feature of each member that `write_archives` stored, from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_id, n = name.rpartition("/")[2].removesuffix(".wav").rsplit("-", 1)
                payload = from_wave(media)
                out.append((int(doc_id) if doc_id else None, int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(payload, np.uint8))))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in FEATURES.split(", ")])

    return members.select("name", "media").mapInArrow(run, FEATURES)


def texts_as_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store documents (doc_id, text) as media, read them back and describe them; one row a document.

    Defined results: a null text is stored as an empty one, 64 bytes of 0; a null
    doc_id stays null; repeated rows are members of their own with equal values;
    an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "media")
    write_archives(docs, folder)
    spark.dataSource.register(MediaSource)
    return media_features(spark.read.format("quill_media").load(folder))
