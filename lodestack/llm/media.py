"""Media columns: payloads kept as images in archives, read through a Spark data source.

A payload is a text's UTF-8 bytes, padded with 255 to a positive multiple of 576, stored
losslessly as the 8-bit samples of a greyscale PNG of 576 columns. Members are stored (not
compressed again) in ZIP archives. The data source plans byte ranges over an archive directory;
a range owns the members whose offset falls into it. Members are read one by one by offset,
checked by CRC, and each is retried on its own; batches of bounded bytes go through Arrow.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import bound_batches, new_path

#: Samples of a row of the image; payloads are padded to a multiple of it.
WIDTH, PAD = 576, b"\xff"
LEVEL = 6
#: An archive is closed at so many bytes or members, which bounds its directory.
ARCHIVE_BYTES, ARCHIVE_MEMBERS = 128 << 20, 50_000
#: Bytes of a range, bytes of a batch, tries for a member, seconds before another try.
RANGE_BYTES, BATCH_BYTES, TRIES, PAUSE = 16 << 20, 4 << 20, 3, 0.2
FORMAT = "lodestack_archive"
#: What a manifest's name starts with; one a job.
MANIFEST = "_members-"


# ---- payloads and images


def payload_of(text: bytes) -> bytes:
    return text + PAD * ((-len(text)) % WIDTH or (0 if text else WIDTH))


def encode_image(payload: bytes) -> bytes:
    """A greyscale PNG with one sample per byte."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    data = zlib.compress(lines.tobytes(), LEVEL)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    most = (1 << 31) - 1
    parts = b"".join(chunk(b"IDAT", data[i : i + most]) for i in range(0, len(data), most))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + parts + chunk(b"IEND", b"")


def decode_image(png: bytes) -> np.ndarray:
    """The samples, row by row, of an image made by :func:`encode_image`."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, width, height, data = 8, 0, 0, []
    while at < len(png):
        (size,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            if (depth, colour) != (8, 0):
                raise ValueError("8-bit greyscale only")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("row filters are not used here")
    return lines[:, 1:].ravel()


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy, mean step between neighbours, and shares of 8 sample ranges."""
    n = len(samples)
    freq = np.bincount(samples, minlength=256)
    level = np.arange(256)
    mean = float((freq * level).sum()) / n
    dev = max(0.0, float((freq * level * level).sum()) / n - mean * mean) ** 0.5
    p = freq[freq > 0] / n
    step = float(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64)) / max(1, n - 1)
    shares = freq.reshape(8, 32).sum(1) * 1000 // n
    return f"mean={mean:.4f};dev={dev:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f};hist=" + ",".join(map(str, shares.tolist()))


# ---- the data source


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes archives of its own; only those of committed tasks enter the job's
    manifest. The table is what all manifests list: a job adds its own, and where it overwrites,
    the ones before go with their archives. Archives of a job that none of its manifest lists (of
    attempts that failed) are deleted at its end."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        zf = sink = None
        name, members = "", 0

        def close():
            zf.close()
            sink.close()
            done.append((name, fs.get_file_info(f"{root}/{name}").size))

        for batch in iterator:
            for key, body in zip(batch.column(0), batch.column(1), strict=True):
                if zf is None or members >= ARCHIVE_MEMBERS or sink.tell() >= ARCHIVE_BYTES:
                    if zf is not None:
                        close()
                    name, members = f"part-{self.job}-{uuid.uuid4().hex}.zip", 0
                    sink = fs.open_output_stream(f"{root}/{name}")
                    zf = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                info = zipfile.ZipInfo(f"{key.as_py() if key.is_valid else 'null'}/{members}.png")
                zf.writestr(info, body.as_buffer().to_pybytes())
                members += 1
        if zf is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        before = manifests(fs, root) if self.overwrite else {}
        found = sorted(a for m in messages if m for a in m.archives)
        with fs.open_output_stream(f"{root}/{MANIFEST}{self.job}.json") as f:
            f.write(json.dumps(found).encode())
        for name, archives in before.items():
            fs.delete_file(f"{root}/{name}")
            for archive, _ in archives:
                fs.delete_file(f"{root}/{archive}")
        self._clear(fs, root, {name for name, _ in found})

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        self._clear(fs, root, set())

    def _clear(self, fs: pafs.FileSystem, root: str, but: set[str]) -> None:
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f"part-{self.job}-") and info.base_name not in but:
                fs.delete_file(f"{root}/{info.base_name}")


def manifests(fs: pafs.FileSystem, root: str) -> dict[str, list[tuple[str, int]]]:
    """Archives and their sizes by manifest."""
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.base_name.startswith(MANIFEST):
            with fs.open_input_stream(f"{root}/{info.base_name}") as f:
                out[info.base_name] = json.loads(f.read())
    return out


class Members:
    """Members of one archive, read by offset, each retried on its own."""

    def __init__(self, path: str, tries: int = TRIES, opener=_open):
        self.path, self.tries, self.opener = path, tries, opener
        self.file = None
        self._reopen()

    def _reopen(self):
        fs, name = self.opener(self.path)
        self.file = fs.open_input_file(name)

    def directory(self, start: int, end: int) -> list[zipfile.ZipInfo]:
        for k in range(self.tries):
            try:
                infos = zipfile.ZipFile(self.file).infolist()
                break
            except (OSError, zipfile.BadZipFile):
                if k == self.tries - 1:
                    raise
                time.sleep(PAUSE)
                self._reopen()
        return sorted((i for i in infos if start <= i.header_offset < end), key=lambda i: i.header_offset)

    def _once(self, info: zipfile.ZipInfo) -> bytes:
        self.file.seek(info.header_offset)
        head = self.file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise OSError("no member at this offset")
        name, extra = struct.unpack_from("<HH", head, 26)
        self.file.seek(info.header_offset + 30 + name + extra)
        body = self.file.read(info.compress_size)
        if len(body) != info.compress_size or zlib.crc32(body) != info.CRC:
            raise OSError("damaged member")
        return body

    def read(self, info: zipfile.ZipInfo) -> tuple[bytes | None, int, str | None]:
        """Body or None, tries, error."""
        for k in range(1, self.tries + 1):
            try:
                return self._once(info), k, None
            except OSError as e:
                if k == self.tries:
                    return None, k, f"{self.path}@{info.header_offset}: {e}"
                time.sleep(PAUSE)
                self._reopen()
        raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        fs, root = _open(self.path)
        found = sorted(a for archives in manifests(fs, root).values() for a in archives)
        return [Range(f"{self.path}/{name}", a, min(a + self.range_bytes, size)) for name, size in found for a in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        members = Members(partition.path)
        rows: list[tuple] = []
        size = 0
        for info in members.directory(partition.start, partition.end):
            body, tries, error = members.read(info)
            key = info.filename.split("/")[0]
            rows.append((None if key == "null" else int(key), info.header_offset, body, tries, error))
            size += len(body or b"")
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


SCHEMA = "id long, offset long, media binary, tries int, error string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "offset", "media", "tries", "error"])


class ArchiveSource(DataSource):
    """``spark.read/write.format("lodestack_archive")``; option ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"].rstrip("/"), int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"].rstrip("/"), overwrite)


# ---- the operator


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "append") -> None:
    """Write every row's payload as an image into archives under ``path``; ``mode`` append keeps
    what is there, overwrite replaces it."""

    @F.arrow_udf("binary")
    def image(texts: pa.Array) -> pa.Array:
        return pa.array([encode_image(payload_of(x.as_buffer().to_pybytes() if x.is_valid else b"")) for x in texts.cast(pa.binary())], pa.binary())

    bound_batches(docs.sparkSession)
    docs.sparkSession.dataSource.register(ArchiveSource)
    docs.select(F.col(id_col).cast("long").alias("id"), image(F.col(text_col).cast("string")).alias("media")).write.format(FORMAT).mode(mode).save(path)


def load(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The stored members: id, offset, media, tries, error (of members that no try could read)."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(FORMAT).option("range_bytes", range_bytes).load(path)


def describe(media: Column) -> Column:
    """Read-back values of every stored image."""

    @F.arrow_udf("struct<n_bytes: bigint, payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, feature: string>")
    def of(bodies: pa.Array) -> pa.Array:
        rows = []
        for x in bodies:
            if not x.is_valid:
                rows.append(None)
                continue
            png = x.as_buffer().to_pybytes()
            samples = decode_image(png)
            payload = samples.tobytes()
            rows.append({"n_bytes": len(payload.rstrip(PAD)), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(png), "media_sha256": hashlib.sha256(png).hexdigest(), "feature": feature(samples)})
        text, long = pa.string(), pa.int64()
        return pa.array(rows, pa.struct([("n_bytes", long), ("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("feature", text)]))

    return of(media)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every row's payload, read the archives back and describe what was read.

    A null text counts as empty (a payload of 576 times 255); a null id is kept; repeated rows
    are members of their own with equal values; an empty table gives an empty result; other
    columns are ignored; a very long text is one member. A member that no try could read fails
    the query with its archive and offset.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "archives")
    store(docs, path, id_col, text_col)
    got = load(spark, path)
    body = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("binary")).otherwise(F.col("media"))
    return got.select(F.col("id").alias(id_col), describe(body).alias("x")).select(id_col, "x.*")
