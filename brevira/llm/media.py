"""Media columns: content-addressed payloads in tar shards.

A payload is stored as the 8-bit samples of a lossless grey PNG, 64 samples a row. Each writing task packs its images
into its own tar shards in the shared folder, one member per distinct image, named by its SHA-256; rows carry
digest, shard, offset and length. A task writes an image once however often it occurs there; copies that
several tasks write are as many members of the same name, and every row points to one that holds its bytes. Shards have
names of their own per attempt, so that a repeated task never overwrites what another row points to; the index table
is written before it is read, and only names shards of committed tasks.

Metadata columns (width, height, bit depth) are filled by range reads of the 33 header bytes alone.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, add_columns, shared_dir, small_batches, stash

UNIT, HEADER = 64, 33
#: A shard is closed beyond so many bytes; digests that a writing task remembers.
SHARD_BYTES, REMEMBERED = 256 << 20, 200_000
#: Bytes of images that one reading task gets, about.
READ_BYTES = 24 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, filled up with bytes 0 to a positive multiple of 64."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b.ljust(max(UNIT, -(-len(b) // UNIT) * UNIT), b"\0")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    raw = np.zeros((len(rows), UNIT + 1), np.uint8)  # filter type 0 before each row
    raw[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode(image: bytes) -> bytes:
    """The payload of an image made by :func:`encode`; checks every CRC."""
    width, height, _ = header(image)
    at, data = 8, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


class _Writer:
    """Tar shards of one task."""

    def __init__(self, folder: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.seen: OrderedDict[bytes, tuple[str, str, int, int]] = OrderedDict()
        self.out, self.at, self.shard, self.part = None, 0, "", 0

    def put(self, payload: bytes) -> tuple[str, str, int, int]:
        """(digest, shard, offset, length) of a payload's image; known payloads are not made into images again."""
        key = hashlib.sha256(payload).digest()
        if key in self.seen:
            self.seen.move_to_end(key)
            return self.seen[key]
        image = encode(payload)
        digest = hashlib.sha256(image).hexdigest()
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            c = TaskContext.get()
            self.shard = f"shard-{c.partitionId() if c else 0:06d}-{self.part:04d}-{uuid.uuid4().hex}.tar"
            self.out, self.at, self.part = self.fs.open_output_stream(f"{self.folder}/{self.shard}"), 0, self.part + 1
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(image)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
        place = (digest, self.shard, self.at + 512, len(image))
        self.out.write(image + bytes(-len(image) % 512))
        self.at += 512 + len(image) + -len(image) % 512
        self.seen[key] = place
        if len(self.seen) > REMEMBERED:
            self.seen.popitem(last=False)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


class _Reader:
    """Range reads of shards, a few of them open."""

    def __init__(self, folder: str, most: int = 4):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.open_: OrderedDict[str, object] = OrderedDict()
        self.most = most

    def read(self, shard: str, offset: int, n: int) -> bytes:
        if shard not in self.open_:
            self.open_[shard] = self.fs.open_input_file(f"{self.folder}/{shard}")
            if len(self.open_) > self.most:
                self.open_.popitem(last=False)[1].close()
        return self.open_[shard].read_at(n, offset)


def stored(docs: DataFrame, text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, str]:
    """(index, folder): ``docs`` without the text, with n_bytes, digest, shard, offset and length.

    Null texts are stored as empty ones; texts of any length are one image each; equal texts have equal digests; every row gets
    a place, repeated rows too; an empty table gives no rows. Columns of ``docs`` that are called as the five new ones are not
    returned; rename them before.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"

    small_batches(spark)

    def run(batches):
        w = _Writer(folder)
        try:
            for b in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
                texts = b.column(text_col).to_pylist()
                places = [w.put(payload_of(t)) for t in texts]
                new = [
                    pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array([p[0] for p in places], pa.string()),
                    pa.array([p[1] for p in places], pa.string()),
                    pa.array([p[2] for p in places], pa.int64()),
                    pa.array([p[3] for p in places], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], names=[*kept, *names])
        finally:
            w.close()

    names = ["n_bytes", "digest", "shard", "offset", "length"]
    kept = [c for c in docs.columns if c not in names and c != text_col]
    src = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col))
    schema = src.drop(text_col).withColumns({"n_bytes": F.lit(0).cast("long"), "digest": F.lit("").cast("string"), "shard": F.lit(""), "offset": F.lit(0).cast("long"), "length": F.lit(0).cast("long")}).schema
    return stash(spark, src.mapInArrow(run, schema), "media-index"), folder


def _near(index: DataFrame) -> DataFrame:
    """Rows dealt so that a task reads a stretch of a shard in order."""
    total = index.agg(F.sum("length")).first()[0] or 0
    n = max(2 * index.sparkSession.sparkContext.defaultParallelism, int(total) // READ_BYTES)
    return index.repartition(n, "shard", F.floor(F.col("offset") / (READ_BYTES // 16))).sortWithinPartitions("shard", "offset")


def described(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with width, height and bit_depth, from the header bytes alone."""

    def make():
        r = _Reader(folder)

        def read(shards, offsets):
            rows = [header(r.read(s, o, HEADER)) for s, o in zip(shards, offsets, strict=True)]
            return [x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows]

        return read

    return add_columns(index, ["shard", "offset"], "width int, height int, bit_depth int", make)


def measured(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with what its stored bytes hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (size from the header, then mean and entropy of the samples)."""

    def make():
        r = _Reader(folder)
        last: list = [None, None]

        def one(shard, offset, length):
            if last[0] == (shard, offset):
                return last[1]
            image = r.read(shard, offset, length)
            payload = decode(image)
            count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            p = count[count > 0] / len(payload)
            feature = f"mean={(count @ np.arange(256)) / len(payload):.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f}"
            last[:] = (shard, offset), (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(image), hashlib.sha256(image).hexdigest(), feature)
            return last[1]

        return lambda *cols: list(zip(*[one(*row) for row in zip(*cols, strict=True)], strict=True)) or [[]] * 6

    return add_columns(index, ["shard", "offset", "length"], "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)


def columns(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    index, folder = stored(docs.select("doc_id", "text"))
    out = measured(described(_near(index), folder), folder)
    feature = F.concat_ws(";", F.concat("width", F.lit("x"), "height", F.lit("x"), "bit_depth"), "feature")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "digest")


def members(tar: bytes) -> dict[str, bytes]:
    """Members of a shard by digest, read by an ordinary tar reader (for tests)."""
    with tarfile.open(fileobj=io.BytesIO(tar)) as t:
        return {m.name.removesuffix(".png"): t.extractfile(m).read() for m in t.getmembers()}


