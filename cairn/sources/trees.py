"""File trees as rows, and archives of other tools (zip, tar and its filters) as rows."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import stat
import tarfile
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.model import FILE, MAX_ENTRIES


class _Dirs(InputPartition):
    def __init__(self, dirs: list[str]) -> None:
        self.dirs = dirs


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.content = options["path"].rstrip("/"), options.get("content", "true") == "true"
        self.skip, self.per = options.get("exclude"), int(options.get("dirsPerPartition", 64))

    def partitions(self) -> list[InputPartition]:
        """Folders are listed here, files are read by tasks; links are not followed."""
        dirs = [d for d, _, _ in os.walk(self.root)] if os.path.isdir(self.root) else [self.root]
        return [_Dirs(dirs[k : k + self.per]) for k in range(0, len(dirs), self.per)]

    def _row(self, full: str) -> tuple:
        st = os.lstat(full)
        top = os.path.dirname(self.root)
        kind = "symlink" if stat.S_ISLNK(st.st_mode) else "directory" if stat.S_ISDIR(st.st_mode) else "file" if stat.S_ISREG(st.st_mode) else "special"
        data = None
        if kind == "file" and self.content:
            with open(full, "rb") as f:
                data = f.read(st.st_size + 1)
            if len(data) != st.st_size:
                raise OSError(f"{full} changed while it was read")
        path = os.path.relpath(full, top).replace(os.sep, "/")
        return path, kind, data, st.st_size if kind == "file" else 0, st.st_mtime_ns, stat.S_IMODE(st.st_mode), st.st_uid, st.st_gid, st.st_dev, st.st_ino, st.st_nlink, os.readlink(full) if kind == "symlink" else None

    def read(self, partition: _Dirs) -> Iterator[tuple]:
        for d in partition.dirs:
            if d == self.root:
                yield self._row(d)
            if not os.path.isdir(d):
                continue
            for name in sorted(os.listdir(d)):
                full = f"{d}/{name}"
                if full != self.skip:
                    yield self._row(full)


class TreeSource(DataSource):
    """format("tree"): rows of model.FILE for a folder and all below it; options path, content, exclude."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self):
        return FILE

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows of model.FILE for the files under root in any store that Spark reads; owners and links are unknown there."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ns = F.unix_micros("modificationTime") * 1000
    none = lambda kind: F.lit(None).cast(kind)
    return f.select("path", F.lit("file").alias("type"), "content", F.col("length").alias("size"), ns.alias("mtime_ns"), none("int").alias("mode"), *[none("long").alias(c) for c in ("uid", "gid", "dev", "inode")], none("int").alias("nlink"), none("string").alias("target"))


def _zip_rows(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i in z.infolist():
            mode = i.external_attr >> 16
            kind = "directory" if i.is_dir() else "symlink" if stat.S_ISLNK(mode) else "file"
            when = int(datetime(*i.date_time, tzinfo=UTC).timestamp()) * 1_000_000_000
            body = z.read(i) if kind != "directory" else b""
            yield i.filename, kind, body if kind == "file" else None, i.file_size if kind == "file" else 0, when, stat.S_IMODE(mode) or None, body.decode() if kind == "symlink" else None


def _tar_rows(data: bytes) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            kind = "file" if m.isreg() else "directory" if m.isdir() else "symlink" if m.issym() else "hardlink" if m.islnk() else "special"
            body = t.extractfile(m).read() if kind == "file" else None
            yield m.name, kind, body, m.size if kind == "file" else 0, max(0, int(m.mtime)) * 1_000_000_000, m.mode & 0o7777, m.linkname or None


def archive_rows(name: str, data: bytes) -> Iterator[tuple]:
    """(path, type, content, size, mtime_ns, mode, target) of each member, by the archive's first bytes."""
    if data.startswith(b"PK"):
        yield from _zip_rows(data)
        return
    if data.startswith((b"7z\xbc\xaf\x27\x1c", b"\x04\x22\x4d\x18")):
        raise ValueError(f"{name}: 7z and lz4 archives can't be read here")
    single = data
    for magic, opened in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ\0", lzma.decompress), (b"\x28\xb5\x2f\xfd", lambda x: zstandard.ZstdDecompressor().stream_reader(x).read())):
        if data.startswith(magic):
            single = opened(data)
    try:
        yield from _tar_rows(single)
    except tarfile.ReadError:
        if single is data:
            raise ValueError(f"{name}: unknown archive format") from None
        base = os.path.basename(name)  # a filter around one file
        yield base.rsplit(".", 1)[0] if "." in base else base, "file", single, len(single), None, None, None


MEMBER = T.StructType([T.StructField("archive", T.StringType()), T.StructField("path", T.StringType()), T.StructField("type", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("mtime_ns", T.LongType()), T.StructField("mode", T.IntegerType()), T.StructField("target", T.StringType())])


def members(archives_: DataFrame, content: bool = True, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Rows of MEMBER of archives that are rows (archive, content); one task opens many. content=False leaves bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for b in batches:
            for name, data in zip(b.column("archive").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows, size = [], 0
                for n, r in enumerate(archive_rows(name, data)):
                    if n >= max_entries:
                        raise ValueError(f"{name}: too many entries")
                    rows.append((name, *r[:2], r[2] if content else None, *r[3:]))
                    size += len(r[2] or b"")
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=MEMBER.names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=MEMBER.names)

    return archives_.select("archive", "content").mapInArrow(run, MEMBER)


def archives(spark: SparkSession, paths: str, content: bool = True, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Rows of MEMBER of all archives under paths, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return members(files.select(F.col("path").alias("archive"), "content"), content, max_entries)
