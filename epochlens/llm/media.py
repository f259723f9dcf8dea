"""Media columns: payloads stored as images in archives, and a Spark data source that reads them back.

A payload becomes an 8-bit greyscale PNG of 192 samples a row. Members are appended to archive files; every file ends
with an index of blocks (offset, length, members) of some MB, and each commit adds a manifest that lists its files with their indexes, so what is appended later adds to what is there, and files left
by failed tasks are never read; a commit that overwrites deletes the manifests and files of those before. Reading plans one partition per block from the manifest alone, or, in a folder that has none, from the
indexes of its archives, many at a time; tasks
stream their byte range in Arrow batches and read a member again by its offset, after a short wait, when its checksum or a read fails. A member that is still damaged at the third time
ends the job with an error that names the archive and the offset: no member is left out or made up.

Defined cases: null or empty text is stored as one row of blanks; any length is stored whole; equal texts give equal
values; repeated rows each give a member; an empty table gives an archive without members; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import byte_values, scratch_path, slices, small_batches

WIDTH = 192
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
MEMBER = struct.Struct("<4sBqqQI")  # mark, whether the id is null, id, bytes unpadded, bytes of media, checksum of media
BLOCK = struct.Struct("<QQQ")
FOOTER = struct.Struct("<QQ8s")
MARK, END = b"MEMB", b"ARCHEND1"
BLOCK_BYTES, BATCH_BYTES, TRIES = 8 << 20, 4 << 20, 3
ARCHIVE_SCHEMA = "doc_id long, n_bytes long, media binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(data: bytes) -> bytes:
    """Blanks up to a positive multiple of the row width."""
    return data + b" " * (WIDTH - len(data) if not data else -len(data) % WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """Greyscale PNG, 8 bits a sample, no row filter."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples of an image as ``encode_png`` writes it; any damage raises ValueError."""
    if media[:8] != PNG_MAGIC:
        raise ValueError("not an image")
    at, data, shape = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None or shape[0] != WIDTH or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("unknown image kind")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(shape[1], WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("unknown row filter")
    return raw[:, 1:]


class _Commit(WriterCommitMessage):
    def __init__(self, name: str | None, blocks: list[list[int]]) -> None:
        self.name, self.blocks = name, blocks


class _Range(InputPartition):
    def __init__(self, name: str, offset: int, length: int, members: int) -> None:
        self.name, self.offset, self.length, self.members = name, offset, length, members


class ArchiveWriter(DataSourceArrowWriter):
    """Each task appends members to a file of its own name; the manifest makes the files count."""

    def __init__(self, path: str, overwrite: bool = False) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> WriterCommitMessage:
        store, base = pafs.FileSystem.from_uri(self.path)
        name, out, blocks, at, block = None, None, [], 0, [0, 0, 0]
        for batch in iterator:
            for doc, n, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.arc"
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}")
                out.write(MEMBER.pack(MARK, doc is None, doc or 0, n, len(media), zlib.crc32(media)))
                out.write(media)
                size = MEMBER.size + len(media)
                block = [block[0], block[1] + size, block[2] + 1]
                at += size
                if block[1] >= BLOCK_BYTES:
                    blocks.append(block)
                    block = [at, 0, 0]
        if out is not None:
            blocks += [block] if block[2] else []
            for x in blocks:
                out.write(BLOCK.pack(*x))
            out.write(FOOTER.pack(at, len(blocks), END))
            out.close()
        return _Commit(name, blocks)

    def commit(self, messages) -> None:
        store, base = pafs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        before = [x.path for x in store.get_file_info(pafs.FileSelector(base)) if x.is_file and x.base_name.startswith("_manifest-")]
        named = {m.name: m.blocks for m in messages if m is not None and m.name}
        for name, listed in ((f"_manifest-{uuid.uuid4().hex}.json", named), ("_manifest.json", {})):  # the latter only says that this is such a folder
            with store.open_output_stream(f"{base}/.{name}") as out:
                out.write(json.dumps(listed).encode())
            store.move(f"{base}/.{name}", f"{base}/{name}")
        if self.overwrite:
            old = {name for x in before for name in _listed(store, x)}
            for x in [*before, *(f"{base}/{name}" for name in old)]:
                store.delete_file(x)

    def abort(self, messages) -> None:
        store, base = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{base}/{m.name}")


def _listed(store, manifest: str) -> dict[str, list]:
    with store.open_input_stream(manifest) as f:
        return json.loads(f.read())


def _index(store, path: str) -> list[tuple[int, int, int]]:
    """Blocks of an archive, from its end."""
    with store.open_input_file(path) as f:
        index, n, end = FOOTER.unpack(f.read_at(FOOTER.size, f.size() - FOOTER.size))
        if end != END:
            raise ValueError(f"{path} is not an archive")
        raw = f.read_at(n * BLOCK.size, index)
    return [BLOCK.unpack_from(raw, i * BLOCK.size) for i in range(n)]


class ArchiveReader(DataSourceReader):
    """Byte-range partitions over the archives of a folder."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, base = pafs.FileSystem.from_uri(self.path)
        files = [x for x in store.get_file_info(pafs.FileSelector(base)) if x.is_file]
        if any(x.base_name == "_manifest.json" for x in files):
            indexes = {k: v for x in sorted(x.path for x in files if x.base_name.startswith("_manifest-")) for k, v in _listed(store, x).items()}
        else:
            names = sorted(x.base_name for x in files if x.base_name.endswith(".arc"))
            with ThreadPoolExecutor(32) as pool:
                indexes = dict(zip(names, pool.map(lambda name: _index(store, f"{base}/{name}"), names), strict=True))
        return [_Range(name, *block) for name, blocks in indexes.items() for block in blocks] or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range):
        if not partition.members:
            return
        store, base = pafs.FileSystem.from_uri(self.path)
        path = f"{base}/{partition.name}"
        rows, size, at = [], 0, partition.offset
        for _ in range(partition.members):
            row, taken = read_member(store, path, at)
            at += taken
            rows.append(row)
            size += len(row[2])
            if size >= BATCH_BYTES or len(rows) == 512:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


_open: dict = {}


def read_member(store, path: str, offset: int, tries: int = TRIES) -> tuple[tuple, int]:
    """One member by its offset, read again up to ``tries`` times; other members are not touched."""
    for left in range(tries - 1, -1, -1):
        try:
            if path not in _open:
                _open.clear()
                _open[path] = store.open_input_file(path)
            f = _open[path]
            mark, no_id, doc, n, length, checksum = MEMBER.unpack(f.read_at(MEMBER.size, offset))
            media = f.read_at(length, offset + MEMBER.size)
            if mark != MARK or len(media) != length or zlib.crc32(media) != checksum:
                raise ValueError(f"damaged member at {offset} of {path}")
            return (None if no_id else doc, n, media), MEMBER.size + length
        except (OSError, ValueError, struct.error):
            _open.pop(path, None)
            if not left:
                raise
            time.sleep(0.1 * (tries - left))
    raise AssertionError


class MediaArchive(DataSource):
    """Format ``media_archive``; option ``path`` names the folder by its URI."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return ARCHIVE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def feature(samples: np.ndarray) -> str:
    """Height, mean, deviation, entropy of the histogram and mean step between neighbours, as text."""
    counts = np.bincount(samples.ravel(), minlength=256).astype(np.float64)
    p = counts / counts.sum()
    mean = float((p * np.arange(256)).sum())
    deviation = float(np.sqrt(max(0.0, (p * np.arange(256) ** 2).sum() - mean * mean)))
    q = p[p > 0]
    step = float(np.abs(np.diff(samples.astype(np.int16), axis=1)).mean())
    return f"{len(samples)}x{WIDTH};mean={mean:.4f};std={deviation:.4f};entropy={-(q * np.log2(q)).sum() + 0.0:.4f};step={step:.4f}"


def store_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "append") -> None:
    """Write every whole text of ``docs`` as a member of the archives at ``path``, beside those that are there (``append``) or in their place (``overwrite``)."""
    small_batches(docs)

    def encode(batches):
        for batch in slices(batches, rows=512):
            texts = byte_values(batch.column(1))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_png(pad(t)) for t in texts], pa.binary())], schema=ARROW)

    docs.sparkSession.dataSource.register(MediaArchive)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows.mapInArrow(encode, ARCHIVE_SCHEMA).write.format("media_archive").mode(mode).save(path)


def read_media(spark, path: str) -> DataFrame:
    """Members of the archives at ``path``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(path)


def media_features(media: DataFrame) -> DataFrame:
    """Decode each stored image and describe payload and stored form."""

    def run(batches):
        for batch in batches:
            rows = []
            for n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                samples = decode_png(data)
                payload = samples.tobytes()
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts as media in the shared folder, read them back, and return their columns."""
    spark = docs.sparkSession
    path = scratch_path(spark, "media")
    store_media(docs, path, id_col, text_col)
    return media_features(read_media(spark, path))
