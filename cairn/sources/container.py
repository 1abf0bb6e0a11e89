"""Block containers: reading versions 2 and 3, writing both, and a Spark data source over them.

A container is a header, block records (`B`), one manifest record (`M`) and an end mark (`E`). The index
pass seeks past payloads; executors read payload ranges on their own. `scan` instead takes whole
containers from any store that Spark reads, many at a time.
"""

from __future__ import annotations

import hashlib
import io
import json
import lzma
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from cairn import model as M
from cairn.functions import crypto

_BLOCK = struct.Struct("<32sBQQ")
_MANIFEST = struct.Struct("<QQ32s")
_KDF = struct.Struct("<16sIII")
#: Label under which keyed block ids are made; containers of other writers need theirs.
ID_LABEL = b"cairn block id\0"
#: Bytes of payloads that are sealed together.
_TOGETHER = 1 << 20
_AAD_BLOCK, _AAD_MANIFEST = b"SPK3 block", b"SPK3 manifest"


class ContainerError(ValueError):
    """The bytes are not a container that may be read."""


@dataclass
class Block:
    block_id: str
    method: int
    raw_size: int
    stored_size: int
    offset: int


@dataclass
class Index:
    version: int
    encrypted: bool = False
    salt: bytes = b""
    kdf: tuple[int, int, int] = (0, 0, 0)
    key: bytes | None = None
    blocks: list[Block] = field(default_factory=list)
    manifest: dict = field(default_factory=dict)
    manifest_raw: int = 0
    manifest_stored: int = 0
    manifest_digest: bytes = b""


def _exact(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ContainerError("container ends too early")
    return data


def requires_password(path: str) -> bool:
    with open(path, "rb") as f:
        head = f.read(13)
    return len(head) == 13 and head[:8] == M.MAGIC_V3 and bool(head[12] & 1)


def read_index(f: BinaryIO, size: int, password: str | None = None, strict_end: bool | None = None) -> Index:
    """Header, block index and manifest of one container; payloads are skipped. Sizes are checked before reading."""
    magic = _exact(f, 8)
    if magic not in (M.MAGIC_V2, M.MAGIC_V3):
        raise ContainerError("not a block container")
    version = struct.unpack("<I", _exact(f, 4))[0]
    if version != (3 if magic == M.MAGIC_V3 else 2):
        raise ContainerError("unknown container version")
    ix = Index(version)
    if version == 3:
        flags = _exact(f, 1)[0]
        if flags & ~1:
            raise ContainerError("unknown flags")
        salt, *kdf = _KDF.unpack(_exact(f, _KDF.size))
        ix.encrypted, ix.salt, ix.kdf = bool(flags & 1), salt, tuple(kdf)
        if ix.encrypted:
            if not password:
                raise ContainerError("a password is required")
            ix.key = crypto.derive_key(password, salt, *kdf)
        elif any(salt) or any(kdf):
            raise ContainerError("key settings in a container that isn't encrypted")
    seen = set()
    while True:
        tag = _exact(f, 1)
        if tag == b"B":
            raw_id, method, raw, stored = _BLOCK.unpack(_exact(f, _BLOCK.size))
            if raw > M.MAX_BLOCK_BYTES or stored > M.MAX_BLOCK_BYTES + 64:
                raise ContainerError("block is over the size limit")
            at = f.tell()
            if at + stored > size:
                raise ContainerError("block lies beyond the container")
            if raw_id in seen:
                raise ContainerError("block id occurs twice")
            if len(seen) >= M.MAX_BLOCKS:
                raise ContainerError("too many blocks")
            seen.add(raw_id)
            ix.blocks.append(Block(raw_id.hex(), method, raw, stored, at))
            f.seek(stored, io.SEEK_CUR)
        elif tag == b"M":
            ix.manifest_raw, ix.manifest_stored, ix.manifest_digest = _MANIFEST.unpack(_exact(f, _MANIFEST.size))
            if ix.manifest_raw > M.MAX_MANIFEST_BYTES or ix.manifest_stored > M.MAX_MANIFEST_BYTES + 1024:
                raise ContainerError("manifest is over the size limit")
            data = _exact(f, ix.manifest_stored)
            if ix.key is not None:
                data = crypto.unseal(ix.key, data, _AAD_MANIFEST)
            if version == 3:
                with zstandard.ZstdDecompressor().stream_reader(data) as r:
                    plain = r.read(ix.manifest_raw + 1)
            else:
                plain = lzma.LZMADecompressor(memlimit=M.MAX_XZ_MEMORY).decompress(data, ix.manifest_raw + 1)
            if len(plain) != ix.manifest_raw:
                raise ContainerError("manifest has another size")
            if not ix.encrypted and hashlib.sha256(plain).digest() != ix.manifest_digest:
                raise ContainerError("manifest digest differs")
            ix.manifest = json.loads(plain)
            break
        else:
            raise ContainerError("unknown record")
    if _exact(f, 1) != b"E":
        raise ContainerError("end mark is missing")
    if (version == 3 if strict_end is None else strict_end) and f.read(1):
        raise ContainerError("bytes after the end mark")
    if ix.manifest.get("version", version) != version:
        raise ContainerError("manifest and container versions differ")
    return ix


def entry_rows(manifest: dict) -> Iterator[dict]:
    """Manifest entries as rows of model.ENTRY: a missing size is 0, seconds under `modified_unix` become nanoseconds."""
    for e in manifest.get("entries", []):
        ns = e.get("mtime_ns")
        if ns is None and e.get("modified_unix") is not None:
            ns = int(e["modified_unix"]) * 1_000_000_000
        segments = [{"block": s.get("block"), "offset": s.get("offset"), "length": s.get("length"), "zero": s.get("zero")} for s in e.get("segments") or []]
        yield {"path": e["path"], "type": e.get("type", e.get("kind")), "size": int(e.get("size") or 0), "mtime_ns": ns, "mode": e.get("mode"), "uid": e.get("uid"), "gid": e.get("gid"), "target": e.get("target"), "segments": segments}


def block_aad(block_id: bytes, raw_size: int, method: int) -> bytes:
    return _AAD_BLOCK + block_id + struct.pack("<Q", raw_size) + bytes([method])


def open_payload(ix_key: bytes | None, b: Block, data: bytes) -> bytes:
    """A payload as its codec wants it."""
    return data if ix_key is None else crypto.unseal(ix_key, data, block_aad(bytes.fromhex(b.block_id), b.raw_size, b.method))


def publish(temp: str, path: str) -> None:
    """Give the finished file its name; never over a file that is there."""
    try:
        os.link(temp, path)
    finally:
        os.unlink(temp)


def _sealed(blocks: Iterable[tuple[str, int, int, bytes]], key: bytes, label: bytes) -> Iterator[tuple[bytes, int, int, bytes]]:
    """Blocks under keyed ids with sealed payloads, in their order; sealed together in parts of _TOGETHER bytes or a block more."""

    def flushed() -> Iterator[tuple[bytes, int, int, bytes]]:
        made = crypto.seal_many(key, [p for *_, p in held], [block_aad(own, raw, method) for own, method, raw, _ in held])
        yield from ((own, method, raw, p) for (own, method, raw, _), p in zip(held, made, strict=True))

    held: list[tuple[bytes, int, int, bytes]] = []
    size = 0
    for block_id, method, raw, payload in blocks:
        held.append((crypto.keyed_id(key, bytes.fromhex(block_id), label), method, raw, payload))
        size += len(payload) + 128  # a lane of 64 bytes is made for the tag, and the last one is whole
        if size >= _TOGETHER:
            yield from flushed()
            held, size = [], 0
    yield from flushed()


def emit(f: BinaryIO, blocks: Iterable[tuple[str, int, int, bytes]], entries: Iterable[dict], version: int = 3, password: str | None = None, kdf: tuple[int, int, int] = M.KDF_DEFAULT, label: bytes = ID_LABEL) -> None:
    """Write blocks (id, method, raw size, payload) as they come, then the manifest and the end mark.

    With a password (version 3), payloads and manifest are sealed and ids keyed; entries' references follow.
    """
    if password is not None and (not password or version != 3):
        raise ValueError("a password must not be empty, and needs version 3")
    key = None
    f.write((M.MAGIC_V3 if version == 3 else M.MAGIC_V2) + struct.pack("<I", version))
    if version == 3:
        salt = os.urandom(16) if password else bytes(16)
        f.write(bytes([bool(password)]) + _KDF.pack(salt, *(kdf if password else (0, 0, 0))))
        key = crypto.derive_key(password, salt, *kdf) if password else None
    for own, method, raw, payload in _sealed(blocks, key, label) if key else ((bytes.fromhex(b), *rest) for b, *rest in blocks):
        f.write(b"B" + _BLOCK.pack(own, method, raw, len(payload)))
        f.write(payload)
    rows = []
    for e in entries:
        segs = []
        for s in e.pop("segments") or []:
            if s["zero"] is not None:
                segs.append({"zero": s["zero"]})
            else:
                name = crypto.keyed_id(key, bytes.fromhex(s["block"]), label).hex() if key else s["block"]
                segs.append({"block": name, "offset": s["offset"], "length": s["length"]})
        rows.append({k: v for k, v in e.items() if v is not None} | {"segments": segs})
    plain = json.dumps({"format": "cairn", "version": version, "entries": rows}, ensure_ascii=False, separators=(",", ":")).encode()
    if len(plain) > M.MAX_MANIFEST_BYTES:
        raise ValueError("manifest is over the size limit")
    stored = zstandard.ZstdCompressor(level=3).compress(plain) if version == 3 else lzma.compress(plain, preset=6)
    if key:
        stored = crypto.seal(key, stored, _AAD_MANIFEST)
    f.write(b"M" + _MANIFEST.pack(len(plain), len(stored), bytes(32) if key else hashlib.sha256(plain).digest()))
    f.write(stored + b"E")


def write(path: str, blocks: Iterable[tuple[str, int, int, bytes]], entries: Iterable[dict], version: int = 3, password: str | None = None, kdf: tuple[int, int, int] = M.KDF_DEFAULT, label: bytes = ID_LABEL) -> None:
    """`emit` to a file of its own, that gets its name when it is complete."""
    temp = f"{path}.{uuid.uuid4().hex}.partial"
    try:
        with open(temp, "xb") as f:
            emit(f, blocks, entries, version, password, kdf, label)
            f.flush()
            os.fsync(f.fileno())
        publish(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


class _Range(InputPartition):
    def __init__(self, blocks: list[Block], key: bytes | None) -> None:
        self.blocks, self.key = blocks, key


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.table, self.password = options["path"], options.get("table", "entries"), options.get("password")
        self.per = int(options.get("blocksPerPartition", 256))

    def _index(self) -> Index:
        with open(self.path, "rb") as f:
            return read_index(f, os.path.getsize(self.path), self.password)

    def partitions(self) -> list[InputPartition]:
        if self.table != "blocks":
            return [_Range([], None)]
        ix = self._index()
        return [_Range(ix.blocks[k : k + self.per], ix.key) for k in range(0, len(ix.blocks), self.per)] or [_Range([], None)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if self.table == "blocks":
            with open(self.path, "rb") as f:
                for b in partition.blocks:
                    f.seek(b.offset)
                    yield b.block_id, b.method, b.raw_size, b.stored_size, b.offset, open_payload(partition.key, b, _exact(f, b.stored_size))
            return
        ix = self._index()
        if self.table == "block_index":
            yield from ((b.block_id, b.method, b.raw_size, b.stored_size, b.offset) for b in ix.blocks)
        elif self.table == "header":
            yield ix.version, ix.encrypted, ix.salt, *ix.kdf, ix.manifest_raw, ix.manifest_stored, ix.manifest_digest
        else:
            for e in entry_rows(ix.manifest):
                segs = [(s["block"], s["offset"], s["length"], s["zero"]) for s in e["segments"]]
                yield e["path"], e["type"], e["size"], e["mtime_ns"], e["mode"], e["uid"], e["gid"], e["target"], segs


class ContainerSource(DataSource):
    """format("container"): options path, table (entries, blocks, block_index, header), password, blocksPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self):
        return {"entries": M.ENTRY, "blocks": M.BLOCK, "block_index": M.BLOCK_INDEX, "header": M.HEADER}[self.options.get("table", "entries")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)


def _rows_of(data: bytes, table: str, password: str | None) -> Iterator[tuple]:
    ix = read_index(io.BytesIO(data), len(data), password)
    if table == "blocks":
        for b in ix.blocks:
            yield b.block_id, b.method, b.raw_size, b.stored_size, b.offset, open_payload(ix.key, b, data[b.offset : b.offset + b.stored_size])
    elif table == "header":
        yield ix.version, ix.encrypted, ix.salt, *ix.kdf, ix.manifest_raw, ix.manifest_stored, ix.manifest_digest
    else:
        yield from (tuple(e.values()) for e in entry_rows(ix.manifest))


def opened(archives: DataFrame, table: str = "entries", password: str | None = None) -> DataFrame:
    """archive and the rows of ENTRY, BLOCK or HEADER of containers that are rows (archive, content); one task opens many."""
    schema = T.StructType([T.StructField("archive", T.StringType()), *{"entries": M.ENTRY, "blocks": M.BLOCK, "header": M.HEADER}[table]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for b in batches:
            for name, data in zip(b.column("archive").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [dict(zip(schema.names, (name, *r), strict=True)) for r in _rows_of(data, table, password)]
                yield from pa.Table.from_pylist(rows, kinds).to_batches()

    return archives.select("archive", "content").mapInArrow(run, schema)


def scan(spark: SparkSession, paths: str, password: str | None = None) -> DataFrame:
    """archive and ENTRY rows of all containers under paths, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return opened(files.select(F.col("path").alias("archive"), "content"), password=password)
