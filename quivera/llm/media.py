"""Media columns: payloads as lossless images in tar shards, addressed by content.

A text's UTF-8 bytes, padded with blanks to a positive multiple of 192, are the samples of an 8-bit greyscale
PNG, 192 samples wide. Each task appends its images to tar shards in the shared folder, one member per
distinct content of a shard, named by the SHA-256 of the stored form. A second pass over the digests alone points all
rows of a content at one member, the least (shard, offset) that holds it, so a digest has one address everywhere;
no payload is exchanged between executors, and a copy that another task wrote first is left unread. Rows carry
digest, offset and length. ``describe`` reads each distinct member once, in tasks of a bounded number of stored bytes:
the header bytes alone for the metadata columns (``read_headers``), the stored bytes for samples and features
(``read_media``).

A shard's name holds the task's partition and is written under an attempt's own name before it is moved into
place, so a task that runs again leaves the same bytes under the same name.

Defined results: a null text is stored as an empty one; empty texts are one row of blanks; a very long text is one
member, however large; equal texts and rows repeated have equal digests, addresses and features; an empty table gives
an empty one; input columns named like a new one are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT, ensure_importable, give_back, shared_path, write_table, written

#: Samples in an image row, the padding byte, the PNG signature.
WIDTH = 192
PAD = b" "
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, length and type of the first chunk, its 13 bytes and its CRC.
HEADER_BYTES = 33
TAR_BLOCK = 512
#: A new shard is begun beyond this size, and beyond so many members (of which a writer remembers the places).
SHARD_BYTES = 512 << 20
SHARD_MEMBERS = 100_000
#: Stored bytes that a task reads, about; neighbours in a shard of this part of it are read together.
READ_BYTES = 32 << 20
COMPRESSION = 6
#: Places of digests are broadcast up to this number (about 40 MB); beyond it the join is an exchange with salts.
BROADCAST_PLACES = 200_000
SALTS = 16

ADDRESS = {"n_bytes": T.LongType(), "media_sha256": T.StringType(), "shard": T.StringType(), "offset": T.LongType(), "media_bytes": T.LongType()}
MEMBER = ("media_sha256", "shard", "offset", "media_bytes")
HEADER = {"width": T.IntegerType(), "height": T.IntegerType(), "bit_depth": T.IntegerType(), "color_type": T.IntegerType()}
CONTENT = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "feature": T.StringType()}


def to_payload(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, PAD)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """The samples as an 8-bit greyscale PNG; no row filter."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)
    rows[:, 1:] = samples
    header = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), COMPRESSION)) + _chunk(b"IEND", b"")


def parse_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first ``HEADER_BYTES`` of a PNG."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not the header of a PNG")
    return struct.unpack(">IIBB", head[16:26])


def from_png(media: bytes) -> np.ndarray:
    """Samples (height x width) of an image made by ``to_png``."""
    width, height, depth, kind = parse_header(media[:HEADER_BYTES])
    if (depth, kind) != (8, 0):
        raise ValueError("only 8-bit greyscale is stored here")
    data, at = b"", HEADER_BYTES
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not stored here")
    return rows[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean, standard deviation, and an 8 x 8 average hash (a bit for each cell brighter than the mean)."""
    mean = float(samples.mean())
    rows = np.linspace(0, samples.shape[0], 9).astype(int)
    cells = samples.astype(np.float64)
    by_row = np.stack([cells[a : max(b, a + 1)].mean(axis=0) for a, b in zip(np.minimum(rows[:-1], samples.shape[0] - 1), rows[1:])])
    grid = by_row.reshape(8, 8, WIDTH // 8).mean(axis=2)
    bits = int("".join("1" if x > mean else "0" for x in grid.ravel()), 2)
    return f"mean={mean:.3f};std={float(samples.std()):.3f};ahash={bits:016x}"


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _tar_header(name: str, size: int) -> bytes:
    """A ustar header: fixed owner, mode and time, so that equal contents give equal shards."""
    head = struct.pack(
        "100s8s8s8s12s12s8s1s100s6s2s32s32s8s8s155s12x",
        name.encode(), b"0000644\0", b"0000000\0", b"0000000\0", b"%011o\0" % size, b"%011o\0" % 0, b" " * 8, b"0", b"",
        b"ustar\0", b"00", b"", b"", b"0000000\0", b"0000000\0", b"",
    )
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


class ShardWriter:
    """Tar shards of one task; a member per distinct content of a shard."""

    def __init__(self, store: str, partition: int, attempt: int, shard_bytes: int = SHARD_BYTES):
        self.fs, self.root = _file_system(store)
        self.store, self.partition, self.attempt, self.shard_bytes = store, partition, attempt, shard_bytes
        self.number, self.out, self.at, self.members = 0, None, 0, {}

    @property
    def name(self) -> str:
        return f"shard-{self.partition:06d}-{self.number:04d}.tar"

    def add(self, key: bytes, media_of) -> tuple[str, str, int, int]:
        """(digest, shard, offset, length) of the content under ``key``; ``media_of()`` makes it if it is new here."""
        if key in self.members:
            return self.members[key]
        media = media_of()
        if self.out is not None and (self.at + len(media) > self.shard_bytes or len(self.members) >= SHARD_MEMBERS):
            self.close()
            self.number += 1
        if self.out is None:
            self.fs.create_dir(self.root, recursive=True)
            self.out, self.at = self.fs.open_output_stream(f"{self.root}/_{self.attempt}-{self.name}"), 0
        digest = hashlib.sha256(media).hexdigest()
        self.out.write(_tar_header(f"{digest}.png", len(media)))
        self.out.write(media)
        self.out.write(bytes(-len(media) % TAR_BLOCK))
        self.members[key] = place = (digest, self.name, self.at + TAR_BLOCK, len(media))
        self.at += TAR_BLOCK + len(media) + -len(media) % TAR_BLOCK
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * TAR_BLOCK))
            self.out.close()
            self.fs.move(f"{self.root}/_{self.attempt}-{self.name}", f"{self.root}/{self.name}")
            self.out, self.members = None, {}


def store_media(docs: DataFrame, text: str = "text", store: str | None = None, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write the shards; return (rows with ``ADDRESS`` in place of the text, folder of the shards).

    ``store``: a URI that all executors share; a new folder under the cluster's shared one when None.
    """
    if store is None:
        store = shared_path(docs.sparkSession, "media")
        written.append(store)
    ensure_importable(docs.sparkSession)
    kept = [f for f in docs.schema.fields if (keep is None or f.name in keep) and f.name not in ADDRESS and f.name != text]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in ADDRESS.items()])
    names = [f.name for f in kept]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = ShardWriter(store, task.partitionId(), task.taskAttemptId())
        for batch in batches:
            rows = []
            for value in batch.column(batch.schema.get_field_index(TEXT)).cast(pa.binary()):
                body = value.as_py() or b""
                payload = to_payload(body)
                rows.append((len(body), *writer.add(hashlib.sha256(payload).digest(), lambda p=payload: to_png(p))))
            made = zip(*rows) if rows else [[]] * len(kinds)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(v, k) for v, k in zip(made, kinds)], names=[*names, *ADDRESS])
        writer.close()
        give_back()

    source = docs.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").cast("string").alias(TEXT))
    rows = write_table(source.mapInArrow(run, schema), "media-rows")
    return _at_one_place(rows), store


def _at_one_place(rows: DataFrame) -> DataFrame:
    """``rows`` with the least place of each digest. Only digests with several places are joined: salted, as one may have
    most rows, and broadcast where they are few."""
    place = F.struct("shard", "offset")
    several = rows.groupBy("media_sha256").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most")
    several = write_table(several.select(F.col("media_sha256").alias("__q_digest"), "least"), "media-places")
    if several.count() <= BROADCAST_PLACES:
        joined = rows.join(F.broadcast(several), F.col("media_sha256") == F.col("__q_digest"), "left")
    else:
        salted = several.withColumn("__q_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("shard", "offset"), F.lit(SALTS)).cast("int")
        joined = rows.join(salted, (F.col("media_sha256") == F.col("__q_digest")) & (salt == F.col("__q_salt")), "left").drop("__q_salt")
    at = {c: F.coalesce(F.col(f"least.{c}"), F.col(c)).alias(c) for c in ("shard", "offset")}
    return joined.select(*[at.get(c, F.col(f"`{c}`")) for c in rows.columns])


def _read(rows: DataFrame, store: str, columns: dict[str, T.DataType], whole: bool) -> DataFrame:
    """``rows`` with ``columns`` from a range read of each member; neighbouring rows of one member read it once."""
    ensure_importable(rows.sparkSession)
    fields = [f for f in rows.schema.fields if f.name not in columns]
    schema = T.StructType(fields + [T.StructField(n, t) for n, t in columns.items()])
    names = [f.name for f in fields]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(t) for t in columns.values()]

    def content(media: bytes, digest: str) -> tuple:
        if hashlib.sha256(media).hexdigest() != digest:
            raise ValueError("stored bytes differ from their address")
        samples = from_png(media)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature_of(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(store)
        shard, file, last, found = None, None, None, None
        for batch in batches:
            made = []
            address = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("shard", "offset", "media_bytes", "media_sha256")]
            for name, offset, length, digest in zip(*address):
                if name != shard:
                    if file is not None:
                        file.close()
                    shard, file = name, fs.open_input_file(f"{root}/{name}")
                if (name, offset) != last:
                    data = file.read_at(length if whole else min(HEADER_BYTES, length), offset)
                    last, found = (name, offset), content(data, digest) if whole else parse_header(data)
                made.append(found)
            values = zip(*made) if made else [[]] * len(kinds)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(v, k) for v, k in zip(values, kinds)], names=[*names, *columns])
        if file is not None:
            file.close()
        give_back()

    return rows.mapInArrow(run, schema)


def read_headers(rows: DataFrame, store: str) -> DataFrame:
    """``rows`` of ``store_media`` with ``HEADER``: ``HEADER_BYTES`` of each member are read."""
    return _read(rows, store, HEADER, whole=False)


def read_media(rows: DataFrame, store: str) -> DataFrame:
    """``rows`` of ``store_media`` with ``CONTENT``, from the stored bytes, checked against their address."""
    return _read(rows, store, CONTENT, whole=True)


def describe(rows: DataFrame, store: str) -> DataFrame:
    """``rows`` of ``store_media`` with ``HEADER`` and ``CONTENT``; each distinct member is read once."""
    members = rows.select(*MEMBER).distinct()
    size = rows.agg(F.coalesce(F.sum("media_bytes"), F.lit(0))).first()[0]
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // READ_BYTES))
    near = (F.col("offset") / (READ_BYTES // 8)).cast("long")
    members = members.repartition(tasks, F.col("shard"), near).sortWithinPartitions("shard", "offset")
    found = write_table(read_media(read_headers(members, store), store), "media-members")
    found = found.select(F.col("media_sha256").alias("__q_digest"), *HEADER, *CONTENT)
    ours = [F.col(f"`{c}`") for c in rows.columns if c not in HEADER | CONTENT]
    return rows.select(*ours).join(found, F.col("media_sha256") == F.col("__q_digest")).drop("__q_digest")
