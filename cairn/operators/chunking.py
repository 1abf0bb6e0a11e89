"""Cutting content into chunks: by content, by size, by runs of zeros.

Content-defined chunking keeps every byte since the last cut in its fingerprint, so one stream is cut in
order; many streams are cut in step, one byte of each at a time, with numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.model import CHUNK_MASK_BITS, CHUNK_MAX, CHUNK_MIN

_M = (1 << 64) - 1
#: Under so many streams at once, plain integers are faster than arrays.
FEW = 24


def gear_value(byte: int) -> int:
    """splitmix64 of the byte: the fingerprint's term for it."""
    z = (byte + 0x9E3779B97F4A7C15) & _M
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M
    return z ^ (z >> 31)


GEAR = [gear_value(b) for b in range(256)]
_GEAR = np.array(GEAR, np.uint64)


def cut_one(data: bytes, least: int = CHUNK_MIN, most: int = CHUNK_MAX, mask_bits: int = CHUNK_MASK_BITS) -> list[int]:
    """Lengths of the chunks of one stream."""
    out, mask, at = [], (1 << mask_bits) - 1, 0
    while len(data) - at > least:  # what is no longer than that is one chunk, whatever it holds
        f = n = 0
        for b in data[at : at + max(least, most)]:
            f = (((f << 1) | (f >> 63)) + GEAR[b]) & _M
            n += 1
            if n >= least and (not f & mask or n >= most):
                break
        out.append(n)
        at += n
    return out + [len(data) - at] if at < len(data) else out


def cut_many(streams: list[bytes], least: int = CHUNK_MIN, most: int = CHUNK_MAX, mask_bits: int = CHUNK_MASK_BITS) -> list[list[int]]:
    """Lengths of the chunks of each stream, all streams in step."""
    out: list[list[int]] = [[] for _ in streams]
    order = sorted(range(len(streams)), key=lambda k: -len(streams[k]))
    if not order:
        return out
    size = np.array([len(streams[k]) for k in order], np.int64)
    mask = np.uint64((1 << mask_bits) - 1)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    raw = np.frombuffer(b"".join(streams[k] for k in order), np.uint8)
    f, n = np.zeros(len(order), np.uint64), np.zeros(len(order), np.int64)
    at = 0
    lanes = int(np.count_nonzero(size > 0))
    while lanes >= FEW:
        upto = int(size[lanes - 1])  # all lanes reach so far
        for k in range(at, upto):
            g = f[:lanes]
            g = ((g << np.uint64(1)) | (g >> np.uint64(63))) + _GEAR[raw[start[:lanes] + k]]
            m = n[:lanes] + 1
            cut = (m >= least) & (((g & mask) == 0) | (m >= most))
            for lane in np.flatnonzero(cut).tolist():
                out[order[lane]].append(int(m[lane]))
            g[cut] = 0
            m[cut] = 0
            f[:lanes], n[:lanes] = g, m
        at = upto
        done = int(np.count_nonzero(size > at))
        for lane in range(done, lanes):
            if n[lane]:
                out[order[lane]].append(int(n[lane]))
        lanes = done
    for lane in range(lanes):
        rest = streams[order[lane]][at:]
        fp, count, m = int(f[lane]), int(n[lane]), (1 << mask_bits) - 1
        for b in rest:
            fp = (((fp << 1) | (fp >> 63)) + GEAR[b]) & _M
            count += 1
            if count >= least and (not fp & m or count >= most):
                out[order[lane]].append(count)
                fp = count = 0
        if count:
            out[order[lane]].append(count)
    return out


CHUNK = T.StructType([T.StructField("chunk_no", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("is_zero", T.BooleanType()), T.StructField("block_id", T.StringType())])


def content_chunks(files: DataFrame, keys: list[str], content: str = "content", least: int = CHUNK_MIN, most: int = CHUNK_MAX, mask_bits: int = CHUNK_MASK_BITS) -> DataFrame:
    """keys and CHUNK: a row per content-defined chunk of each row's bytes; block_id is null for chunks of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x or b"" for x in b.column("x__content").to_pylist()]
            rows, who = [], []
            for k, lengths in enumerate(cut_many(data, least, most, mask_bits)):
                at = 0
                for no, length in enumerate(lengths):
                    piece = data[k][at : at + length]
                    zero = not piece.strip(b"\0")
                    rows.append((no, at, length, zero, None if zero else hashlib.sha256(piece).hexdigest()))
                    who.append(k)
                    at += length
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in keys), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True))], names=[*keys, *CHUNK.names])

    return files.select(*keys, F.col(content).alias("x__content")).mapInArrow(run, T.StructType([*(files.schema[c] for c in keys), *CHUNK]))


def fixed_chunks(files: DataFrame, size: int, content: str = "content") -> DataFrame:
    """All columns, chunk_no, offset, length and chunk (bytes): pieces of `size` bytes, the last may be shorter."""
    n = F.octet_length(content)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    cut = files.select("*", F.posexplode(starts).alias("chunk_no", "offset"))
    chunk = F.substring(F.col(content), F.col("offset") + 1, F.lit(size))
    return cut.withColumn("chunk", chunk).withColumn("length", F.octet_length("chunk").cast("long")).withColumn("offset", F.col("offset").cast("long"))


def zero_extents(data: bytes, least: int = 4096) -> list[tuple[str, int, int]]:
    """(data or hole, offset, length): runs of `least` zero bytes or more are holes."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (raw == 0).view(np.int8), [0]])))
    holes = [(a, b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= least]
    out, at = [], 0
    for a, b in holes:
        if a > at:
            out.append(("data", at, a - at))
        out.append(("hole", a, b - a))
        at = b
    return out + [("data", at, len(raw) - at)] if at < len(raw) else out


@F.udtf(returnType=T.StructType([T.StructField("kind", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))
class ZeroExtents:
    """Table function of zero_extents, for LATERAL."""

    def eval(self, data: bytes, least: int):
        yield from zero_extents(data or b"", least)


@F.udtf(returnType=T.StructType([T.StructField("chunk_no", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))
class ContentChunks:
    """Table function of cut_one, for LATERAL."""

    def eval(self, data: bytes, least: int, most: int, mask_bits: int):
        at = 0
        for k, n in enumerate(cut_one(bytes(data or b""), least, most, mask_bits)):
            yield k, at, n
            at += n


def register(spark) -> None:
    """Make the table functions known to SQL."""
    spark.udtf.register("zero_extents", ZeroExtents)
    spark.udtf.register("content_chunks", ContentChunks)
