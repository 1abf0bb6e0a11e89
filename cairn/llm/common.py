"""Shared pieces: Arrow text buffers, byte-level words, shingle hashes, checkpoints, components.

All byte work is done on whole slices of a batch with numpy; a slice holds a bounded number of text
bytes (one row at least), so a task's memory does not grow with the number of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy slice works on.
SLICE_BYTES = 1 << 20

_R = np.uint64(0x9E3779B97F4A7C55)  # odd, so invertible modulo 2**64
_RINV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get("r")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        for name, base in (("r", _R), ("i", _RINV)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _POW[name] = np.multiply.accumulate(full)
    return _POW["r"], _POW["i"]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null counts as the empty string."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows with at most max_bytes of text (one row at least)."""
    for batch in batches:
        raw, offs = text_buffer(batch.column(batch.schema.get_field_index(column)))
        a, n = 0, batch.num_rows
        while a < n:
            b = int(np.searchsorted(offs, offs[a] + max_bytes, "right")) - 1
            b = min(max(b, a + 1), a + max_rows, n)
            yield batch.slice(a, b - a), raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            a = b


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = True
WORD_BYTE[128:] = True


class Words:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of lower-cased (A-Z) texts in one slice.

    start, end: byte positions; hash: uint64, never 0; first: index of each document's first word, plus
    the total. Words never cross documents.
    """

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, raw: np.ndarray, offs: np.ndarray) -> None:
        n = len(raw)
        ok = np.zeros(n + 1, bool)
        np.take(WORD_BYTE, raw, out=ok[:n])
        begin, stop = ok.copy(), ok.copy()
        begin[1:] &= ~ok[:-1]
        stop[:-1] &= ~ok[1:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begin[cut] |= ok[cut]
        stop[cut - 1] |= ok[cut - 1]
        self.start = np.flatnonzero(begin[:n])
        self.end = np.flatnonzero(stop[:n]) + 1
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.multiply(LOWER[raw], power[:n], out=total[1:], casting="unsafe", dtype=np.uint64)
        np.cumsum(total, out=total)
        h = (total[self.end] - total[self.start]) * inverse[self.start]
        self.hash = mix64(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        self.first = np.searchsorted(self.start, offs)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each document's shingles of `size` words; fewer words, but not none, make one shingle."""
    h, first = words.hash, words.first
    count = np.diff(first)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out_first = np.concatenate([[0], np.cumsum(made)])
    doc = np.repeat(np.arange(len(count)), made)
    at = np.arange(out_first[-1]) - out_first[:-1][doc] + first[:-1][doc]
    left = first[1:][doc] - at
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    acc = np.zeros(len(at), np.uint64)
    for k in range(size):
        term = padded[at + k]
        if k:
            term = np.where(left > k, term, np.uint64(0))
        acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + term
    return mix64(acc), out_first


def distinct_per_doc(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of distinct hashes of each document in the slice."""
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    key = np.sort((doc << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(count))


def per_doc_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; only where the setting is missing, one below the warehouse is set."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(place)
    return place


def pinned(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: lost executors don't change or lose it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: columns can be read alone, and files are compressed.

    The table goes when the application ends.
    """
    place = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/cairn-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def unclashing(keep: tuple[str, ...] | list[str], results: tuple[str, ...] | list[str]) -> tuple[str, ...]:
    """Columns to pass through: each once, and none under the name of a result, which stands instead."""
    taken = {c.lower() for c in results}
    return tuple(c for c in dict.fromkeys(keep) if c.lower() not in taken)


def spare(name: str, columns: tuple[str, ...] | list[str]) -> str:
    """A column name that begins with `name` and is none of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id) -> "F.Column":
    """crc32 of doc_id's decimal text is divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected edges; root is the smallest node of its component.

    Large-star and small-star by turns: each round is two aggregations and joins over edges, every
    component's edges end as a star around its smallest node; a hot node's neighbours stay rows, never a list.
    """
    now = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    now = pinned(now)
    last = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = pinned(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # so that joins of a hot node are split
        # large star: each larger neighbour of u is tied to u's smallest neighbour
        now = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        now = pinned(now)
        small = pinned(now.groupBy("b").agg(F.min("a").alias("m")))
        now = now.join(small, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("x")).where("m < x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        now = pinned(now)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last == state:
            break
        last = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
