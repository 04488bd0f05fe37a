"""Content-addressed media: payloads in tar shards, rows with digest, shard, offset and length.

Storing: each task appends the media of its rows to tar shards of its own, each content once, and emits a row per
document.  A content with a large share of all rows (`hot_keys`) is stored only by the row with its smallest key; any
other may be stored once by each task that meets it.  A shard's name holds the task's attempt, and only rows of attempts
that ended reach the index table, so a lost executor leaves an orphan file, never a wrong row.  The index then names one
place for each digest.  Reading: a range read of the first HEAD bytes of a member fills the metadata columns; bodies are
read only where asked for.

The media format here is an 8-bit grey PNG, WIDTH samples a row, lossless; the unpadded size stands in a private chunk
right behind the image header, so that header reads give it.

Edge cases: null and empty texts are one row of padding; equal texts, and so repeated rows, share one place and all
values, and each row has its own index row, keys repeated or null included; of several places of a content the first in
order of name is taken; a text of any length is one member; an empty table gives an empty index; other columns are left
out, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, enter, hot_keys, join_hot

__all__ = ["Stored", "features", "from_png", "png_header", "read_bodies", "read_headers", "store", "to_payload", "to_png"]

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, image header (25 bytes), private chunk of 8 bytes (20 bytes).
HEAD = len(SIGNATURE) + 25 + 20
#: A shard is closed at the first member past this size.
SHARD_BYTES = 256 << 20
#: Contents whose place a task remembers; past that it begins anew, and may store one again.
PLACES = 200_000
INDEX = "digest string, shard string, offset long, length long"


def to_payload(raw: bytes) -> bytes:
    short = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)
    return raw + b"\xff" * short


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"teSz", struct.pack(">Q", n_bytes))
    return SIGNATURE + head + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits of a sample, unpadded size, from the first HEAD bytes."""
    if head[:8] != SIGNATURE:
        raise ValueError("not a stored image")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits, struct.unpack(">Q", head[41:49])[0]


def from_png(media: bytes) -> bytes:
    width, height, _, _ = png_header(media[:HEAD])
    at, packed = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            packed.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Whole-number statistics of the samples, so that they are the same everywhere."""
    a = np.frombuffer(payload, np.uint8)
    count = np.bincount(a, minlength=256)
    total = int(count @ np.arange(256))
    square = int(count @ np.arange(256) ** 2)
    steps = int(np.abs(np.diff(a.astype(np.int16))).sum())
    coarse = "-".join(map(str, count.reshape(16, 16).sum(1).tolist()))
    return f"{WIDTH}x{len(a) // WIDTH};sum={total};sq={square};tv={steps};distinct={int((count > 0).sum())};hist={coarse}"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _qualified(spark, path: str) -> str:
    """A URI that names its file system, as the session understands the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(at)
    uri = system.makeQualified(at).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file:///") else uri


@dataclass
class Stored:
    rows: DataFrame  # key, digest: a row per document
    places: DataFrame  # digest, shard, offset, length: a row per content
    hot: DataFrame  # digests of many rows

    def index(self) -> DataFrame:
        """key, digest, shard, offset, length of every document."""
        return join_hot(self.rows, self.places, "digest", self.hot)

    def with_bodies(self) -> DataFrame:
        """key, digest and what read_bodies gives, of every document; each content is read once."""
        return join_hot(self.rows, self.places, "digest", self.hot, read_bodies)


def store(df: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> Stored:
    """Writes the media."""
    folder = _qualified(df.sparkSession, scratch.path("tar"))
    per = df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("digest")).agg(F.count("*").alias("count"), F.min(key).alias("owner"))
    per = scratch.save(per.where("count > 200"), "repeated")
    hot = hot_keys(per, "digest", df.count(), scratch)
    owners = df.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in per.join(F.broadcast(hot), "digest", "left_semi").select("digest", "owner").collect()})
    scratch.drop(per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("media")
        system, base = _file_system(folder)
        out, name, at, places = None, "", 0, {}

        def end():
            out.write(bytes(1024))
            out.close()

        for b in batches:
            rows = []
            for k, t in zip(b.column(0), b.column(1), strict=True):
                raw = (t.as_py() or "").encode()
                digest = hashlib.sha256(raw).hexdigest()
                if digest in owners.value and owners.value[digest] != k.as_py():
                    rows.append((digest, None, None, None))
                    continue
                if digest not in places:
                    if out is not None and at >= SHARD_BYTES:
                        end()
                        out = None
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.tar", 0
                        out = system.open_output_stream(f"{base}/{name}")
                    media = to_png(to_payload(raw), len(raw))
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(media)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % 512))
                    if len(places) >= PLACES:
                        places.clear()
                    places[digest] = (name, at + 512, len(media))
                    at += 512 + len(media) + -len(media) % 512
                rows.append((digest, *places[digest]))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], [key, "digest", "shard", "offset", "length"])
        if out is not None:
            end()

    rows = scratch.save(df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {INDEX}"), "index")
    place = F.when(F.col("shard").isNotNull(), F.struct(F.concat(F.lit(folder + "/"), "shard").alias("shard"), "offset", "length"))
    places = scratch.save(rows.groupBy("digest").agg(F.min(place).alias("place")).select("digest", "place.*"), "places")
    return Stored(rows.select(key, "digest"), places, hot)


def _read(places: DataFrame, fields: str, names: list[str], row) -> DataFrame:
    """row(read) of each place, where read(n) gives the first n bytes of a member, all without n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("media")
        system, handle, is_open = None, None, ""
        for b in batches:
            rows = []
            for digest, shard, offset, length in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if system is None:
                    system = _file_system(shard)[0]
                if shard != is_open:
                    handle, is_open = system.open_input_file(_file_system(shard)[1]), shard

                def read(n=None, offset=offset, length=length):
                    return handle.read_at(length if n is None else min(n, length), offset)

                rows.append((digest, *row(read)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["digest", *names])

    return places.select("digest", "shard", "offset", "length").sortWithinPartitions("shard", "offset").mapInArrow(run, f"digest string, {fields}")


def read_headers(places: DataFrame) -> DataFrame:
    """digest, width, height, bits, n_bytes by range reads of HEAD bytes."""
    return _read(places, "width long, height long, bits long, n_bytes long", ["width", "height", "bits", "n_bytes"], lambda read: png_header(read(HEAD)))


def read_bodies(places: DataFrame) -> DataFrame:
    """Header columns and digests, tail checksum and features of each stored content, all from the bytes read back."""

    def row(read):
        width, height, bits, n_bytes = png_header(read(HEAD))
        media = read()
        payload = from_png(media)
        return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = ["long", "long", "string", "long", "long", "string", "string"]
    return _read(places, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), names, row)
