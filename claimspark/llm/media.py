"""Media columns: archives of image members behind a custom Spark data source.

The sink writes one archive for each task that has rows: members one after another, each with a header of its own, then
an index of offsets. The source plans byte ranges over a directory of archives, so that a large archive is read by many
tasks; a range reads the members that begin in it, streams them as Arrow batches, and retries a member that fails on its
own, by its offset, without reading its neighbours again. Only archives named in a committed manifest are read, so what
a lost or repeated task leaves behind is never seen.

A payload is stored losslessly as an 8-bit grayscale PNG of 192 samples a row.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from claimspark.llm.common import shared_dir, small_batches, table

WIDTH = 192
MAGIC = b"MEMBER01"
#: magic, name bytes, member bytes, crc32 of the member
HEAD = struct.Struct("<8sIQI")
TAIL = struct.Struct("<QQ8s")
#: Bytes of a range, at least; so many ranges are planned at most, and of more bytes ranges are larger.
RANGE_BYTES, RANGES = 16 << 20, 50_000
BATCH_BYTES = 8 << 20
TRIES = 3
SCHEMA = "name string, media binary"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 3) -> bytes:
    """8-bit grayscale, no row filter; equal payloads give equal bytes. The payload is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    image = np.zeros((len(rows), WIDTH + 1), np.uint8)
    image[:, 1:] = rows
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(image.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples of an image that ``encode_png`` wrote; checksums are verified."""
    at, width, data = 8, 0, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"damaged {kind!r}")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:]


def _fs(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class ArchiveRange(InputPartition):
    def __init__(self, file: str, start: int, stop: int) -> None:
        super().__init__((file, start, stop))
        self.file, self.start, self.stop = file, start, stop


class Committed(WriterCommitMessage):
    def __init__(self, file: str | None, size: int, members: int) -> None:
        self.file, self.size, self.members = file, size, members


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        """Batches of (name, media), to a file that no other attempt writes."""
        fs, root = _fs(self.path)
        file, stream, at, offsets = f"part-{uuid.uuid4().hex}.arc", None, 0, []
        for name, media in ((n.as_py(), m.as_buffer()) for b in iterator for n, m in zip(b.column(0), b.column(1), strict=True)):
            if stream is None:
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(f"{root}/{file}")
            label = b"" if name is None else name.encode()
            head = HEAD.pack(MAGIC, 0xFFFFFFFF if name is None else len(label), media.size, zlib.crc32(media))
            offsets.append(at)
            for x in (head, label, media):
                stream.write(x)
            at += len(head) + len(label) + media.size
        if stream is None:
            return Committed(None, 0, 0)
        index = zlib.compress(np.array(offsets, np.int64).tobytes())
        stream.write(index)
        stream.write(TAIL.pack(at, len(index), MAGIC))
        stream.close()
        return Committed(file, at, len(offsets))

    def commit(self, messages: list) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([[m.file, m.size, m.members] for m in messages if m is not None and m.file]).encode())

    def abort(self, messages: list) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{root}/{m.file}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, opener: Callable | None = None) -> None:
        self.path, self.range_bytes, self.opener = path, range_bytes, opener

    def partitions(self) -> list[ArchiveRange]:
        """Byte ranges over the members of all committed archives; no archive is opened."""
        import pyarrow.fs as pafs

        fs, root = _fs(self.path)
        archives = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)), key=lambda i: i.path):
            if info.base_name.startswith("manifest-"):
                with fs.open_input_stream(info.path) as f:
                    archives += [(file, size) for file, size, _ in json.loads(f.read())]
        step = max(self.range_bytes, sum(size for _, size in archives) // RANGES)
        ranges = [ArchiveRange(file, a, min(size, a + step)) for file, size in archives for a in range(0, size, step)]
        return ranges or [ArchiveRange("", 0, 0)]

    def _open(self, file: str):
        if self.opener:
            return self.opener(file)
        fs, root = _fs(self.path)
        return fs.open_input_file(f"{root}/{file}")

    def member(self, file: str, offset: int, source=None) -> tuple[str | None, bytes]:
        """One member by its offset; what fails is tried again with a new stream, and the last failure is raised."""
        for attempt in range(TRIES):
            try:
                if source is None or attempt:
                    source = self._open(file)
                magic, n, size, crc = HEAD.unpack(source.read_at(HEAD.size, offset))
                if magic != MAGIC:
                    raise OSError(f"no member begins at {offset} of {file}")
                named = n != 0xFFFFFFFF
                n = n if named else 0
                body = source.read_at(n + size, offset + HEAD.size)
                if len(body) != n + size or zlib.crc32(body[n:]) != crc:
                    raise OSError(f"damaged member at {offset} of {file}")
                return (body[:n].decode() if named else None), body[n:]
            except (OSError, struct.error):
                if attempt + 1 == TRIES:
                    raise
                time.sleep(0.05 * 2**attempt)
        raise AssertionError

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        source = self._open(partition.file)
        end = source.size()
        at, n, magic = TAIL.unpack(source.read_at(TAIL.size, end - TAIL.size))
        if magic != MAGIC:
            raise OSError(f"{partition.file} has no index")
        offsets = np.frombuffer(zlib.decompress(source.read_at(n, at)), np.int64)
        names, media, held = [], [], 0
        first, last = np.searchsorted(offsets, [partition.start, partition.stop])
        for offset in offsets[first:last]:
            name, body = self.member(partition.file, int(offset), source)
            names.append(name)
            media.append(body)
            held += len(body)
            if held >= BATCH_BYTES:
                yield _batch(names, media)
                names, media, held = [], [], 0
        if names:
            yield _batch(names, media)


def _batch(names: list, media: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], ["name", "media"])


class MediaArchives(DataSource):
    """format("media_archives"): name string, media binary. Options: path, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def store_payloads(rows: DataFrame, path: str) -> None:
    """Rows of (name string, payload binary) as PNG members of new archives under path. Any number of rows; none gives an empty archive directory."""
    rows.sparkSession.dataSource.register(MediaArchives)

    @F.arrow_udf("binary")
    def png(payloads: pa.Array) -> pa.Array:
        return pa.array([encode_png(p.as_py()) for p in payloads], pa.binary())

    rows.select("name", png("payload").alias("media")).write.format("media_archives").mode("append").option("path", path).save()


def read_media(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Members of all committed archives under path: name and media."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("path", path).option("range_bytes", range_bytes).load()


def image_features(samples: np.ndarray) -> str:
    """Size, mean, deviation, range and mean step from row to row of an image's samples."""
    flat = samples.reshape(-1)
    mean = flat.mean(dtype=np.float64)
    low, high = int(flat.min()), int(flat.max())
    counts = np.bincount(flat, minlength=256)
    share = counts[counts > 0] / flat.size
    deviation = float(np.sqrt(max(0.0, (counts * (np.arange(256) - mean) ** 2).sum() / flat.size)))
    step = float(np.abs(samples[1:].view(np.uint8).astype(np.int16) - samples[:-1]).mean()) if len(samples) > 1 else 0.0
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} sd={deviation:.4f} min={low} max={high} entropy={-(share * np.log2(share)).sum():.4f} step={step:.4f}"


MEASURED = {"payload_bytes": LongType(), "payload_sha256": StringType(), "tail_crc32": LongType(), "media_bytes": LongType(), "media_sha256": StringType(), "feature": StringType()}


@F.arrow_udf(StructType([StructField(k, kind) for k, kind in MEASURED.items()]))
def measured(media: pa.Array) -> pa.Array:
    """What is read back from stored images."""
    out = []
    for m in media:
        body = m.as_py()
        samples = decode_png(body)
        payload = samples.tobytes()
        out.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(body), "media_sha256": hashlib.sha256(body).hexdigest(), "feature": image_features(samples)})
    return pa.array(out, pa.struct([(k, pa.int64() if kind == LongType() else pa.string()) for k, kind in MEASURED.items()]))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored image, read back. Null texts are empty, repeated rows are stored as often as they occur; a null doc_id stays null."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    pad = F.when(size == 0, WIDTH).otherwise(F.pmod(-size, F.lit(WIDTH)))
    payload = F.concat(raw, F.encode(F.repeat(F.lit(" "), pad.cast("int")), "UTF-8"))
    # the name carries the id and the unpadded size
    name = F.concat_ws(" ", size.cast("string"), F.col("doc_id").cast("string"))
    path = shared_dir(spark) + "-media"
    store_payloads(docs.select(name.alias("name"), payload.alias("payload")), path)
    small_batches(spark)
    got = read_media(spark, path).withColumn("m", measured("media"))
    parts = F.split("name", " ")
    return got.select(F.try_element_at(parts, F.lit(2)).cast("long").alias("doc_id"), F.element_at(parts, 1).cast("long").alias("n_bytes"), "m.*")

