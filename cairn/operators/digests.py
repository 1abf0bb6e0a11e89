"""One digest over a whole corpus.

SHA-256 over lines in order is sequential by nature. Tasks sort ranges of the order and join their lines to pieces of
about PIECE bytes; one task then only feeds these to the digest, piece by piece, with bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.order import pinned

PIECE = 1 << 20


def corpus_digest(files: DataFrame) -> DataFrame:
    """digest (of the lines `path:digest`, sorted by path, between them line feeds) and files, of files with path and digest; one row."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count, k = [], 0, 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([count], pa.int64()), pa.array(["\n".join(held).encode()], pa.binary())], names=["k", "files", "piece"])

        for b in batches:
            for path, digest in zip(b.column("path").to_pylist(), b.column("digest").to_pylist(), strict=True):
                held.append(f"{path}:{digest}")
                size, count = size + len(path) + len(digest), count + 1
                if size >= PIECE:
                    yield out()
                    held, size, count, k = [], 0, 0, k + 1
        if held:
            yield out()

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, files, any_ = hashlib.sha256(), 0, False
        for b in batches:
            for count, piece in zip(b.column("files").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if piece is not None:
                    h.update(b"\n" * any_ + piece)
                    files, any_ = files + count, True
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest() if any_ else None], pa.string()), pa.array([files], pa.int64())], names=["digest", "files"])

    ranges = files.select("path", "digest").repartitionByRange(n, "path").sortWithinPartitions("path")
    pieces = pinned(ranges.mapInArrow(joined, "k int, files long, piece binary").withColumn("range", F.spark_partition_id()))
    none = files.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("files"), F.lit(None).cast("binary").alias("piece"), F.lit(-1).alias("range"))  # so that no files have a row too
    return pieces.unionByName(none).orderBy("range", "k").select("files", "piece").coalesce(1).mapInArrow(fed, "digest string, files long")
