"""Recovery data: Reed-Solomon parity over GF(2**16), slice by slice.

Parity slice i is the sum of a[i, j] times data slice j with a Cauchy matrix a, so any lost slices can be
solved for from as many parity slices. Sums are exclusive ors, so tasks make partial ones and a shuffle
of one slice per task and parity adds them. Tables of slices are rows (file, slice_no, data).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.model import MAX_RECOVERY_MEMORY

_POLY = 0x1100B


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(131072, np.uint16), np.zeros(65536, np.int64), 1
    for k in range(65535):
        exp[k] = x
        log[x] = k
        x <<= 1
        if x & 0x10000:
            x ^= _POLY
    exp[65535:131070] = exp[:65535]
    return exp, log


EXP, LOG = _tables()


def multiply(a: int, v: np.ndarray) -> np.ndarray:
    """a times each 16-bit word of v."""
    if a == 0:
        return np.zeros_like(v)
    out = EXP[LOG[v] + LOG[a]]
    out[v == 0] = 0
    return out


def inverse(a: int) -> int:
    return int(EXP[(65535 - LOG[a]) % 65535])


def coefficient(i: int, j: int, data_slices: int) -> int:
    """Cauchy: 1 / (x_i + y_j) with x_i after all y_j."""
    return inverse((data_slices + i) ^ j)


def parity_count(data_slices: int, percent: int) -> int:
    if not 1 <= percent <= 100:
        raise ValueError("recovery percentage must be 1 to 100")
    return max(1, -(-data_slices * percent // 100))


def slices(files: DataFrame, size: int) -> DataFrame:
    """file, slice_no, data, length, sha256 of (path, content) rows; the last slice of a file is padded with zeros."""
    n = F.octet_length("content")
    cut = files.select("path", "content", F.posexplode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))).alias("slice_no", "at"))
    part = F.substring(F.col("content"), F.col("at") + 1, F.lit(size))
    return cut.select(F.col("path").alias("file"), "slice_no", F.rpad(part, size, F.expr("X'00'")).alias("data"), F.octet_length(part).cast("long").alias("length"), F.sha2(F.rpad(part, size, F.expr("X'00'")), 256).alias("sha256"))


def _order(table: DataFrame) -> DataFrame:
    """slices with j, their number among all slices, by file and slice_no: counts per file, then offsets of files."""
    from pyspark.sql import Window

    counts = table.groupBy("file").agg((F.max("slice_no") + 1).alias("n"))
    base = counts.select("file", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return table.join(base, "file").withColumn("j", F.col("base") + F.col("slice_no")).drop("base")


def parity(table: DataFrame, percent: int, size: int) -> DataFrame:
    """i, data of the parity slices, and the number of data slices in column k."""
    numbered = _order(table)
    k = numbered.count()
    m = parity_count(k, percent) if k else 0
    if k + m > 65535:
        raise ValueError("too many slices for this field; use larger ones")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((m, size // 2), np.uint16)
        for b in batches:
            for j, d in zip(b.column("j").to_pylist(), b.column("data").to_pylist(), strict=True):
                v = np.frombuffer(d, "<u2")
                for i in range(m):
                    acc[i] ^= multiply(coefficient(i, j, k), v)
        yield pa.RecordBatch.from_arrays([pa.array(range(m), pa.int32()), pa.array([a.astype("<u2").tobytes() for a in acc], pa.binary())], names=["i", "data"])

    def add(t: pa.Table) -> pa.Table:
        out = np.bitwise_xor.reduce([np.frombuffer(x, "<u2") for x in t.column("data").to_pylist()])
        return pa.table([t.column("i").slice(0, 1), pa.array([out.tobytes()], pa.binary())], names=["i", "data"])

    return numbered.select("j", "data").mapInArrow(partial, "i int, data binary").groupBy("i").applyInArrow(add, "i int, data binary").withColumn("k", F.lit(k))


def solve(lost: list[int], have: dict[int, bytes], parity_rows: dict[int, bytes], k: int) -> dict[int, bytes]:
    """Contents of the lost data slices, from all others and as many parity slices."""
    if not lost:
        return {}
    if len(parity_rows) < len(lost):
        raise ValueError("too few parity slices to repair")
    size = len(next(iter(parity_rows.values())))
    if len(lost) * size > MAX_RECOVERY_MEMORY:
        raise ValueError("repair would need too much memory")
    rows = sorted(parity_rows)[: len(lost)]
    right = []
    for i in rows:
        acc = np.frombuffer(parity_rows[i], "<u2").copy()
        for j, d in have.items():
            acc ^= multiply(coefficient(i, j, k), np.frombuffer(d, "<u2"))
        right.append(acc)
    a = [[coefficient(i, j, k) for j in lost] for i in rows]
    n = len(lost)
    for c in range(n):  # Gauss-Jordan; submatrices of a Cauchy matrix are regular
        p = next(r for r in range(c, n) if a[r][c])
        a[c], a[p], right[c], right[p] = a[p], a[c], right[p], right[c]
        f = inverse(a[c][c])
        a[c] = [int(multiply(f, np.array([x], np.uint16))[0]) for x in a[c]]
        right[c] = multiply(f, right[c])
        for r in range(n):
            if r != c and a[r][c]:
                g = a[r][c]
                a[r] = [x ^ int(multiply(g, np.array([y], np.uint16))[0]) for x, y in zip(a[r], a[c], strict=True)]
                right[r] = right[r] ^ multiply(g, right[c])
    return {j: right[c].astype("<u2").tobytes() for c, j in enumerate(lost)}


def damaged(index: DataFrame, present: DataFrame) -> DataFrame:
    """file, slice_no of slices in index (with sha256) that present lacks or has otherwise."""
    return index.join(present.select("file", "slice_no", F.col("sha256").alias("now")), ["file", "slice_no"], "left").where("now is null or now <> sha256").select("file", "slice_no")


def preflight(index: DataFrame, present: DataFrame, parity_slices: int) -> DataFrame:
    """R28 (rule, subject, detail), before anything is written: names that could lead elsewhere, slices that the index lacks or has twice, and losses beyond the parity."""
    rule = F.lit("R28").alias("rule")
    of = index.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("slice_no").alias("d"), F.min("slice_no").alias("a"), F.max("slice_no").alias("b"))
    unsafe = F.col("file").isNull() | F.col("file").isin("", ".", "..") | F.col("file").rlike(r"[/\\\x00]")
    gaps = (F.col("a") != 0) | (F.col("b") + 1 != F.col("d"))
    lost = damaged(index.distinct(), present).agg(F.count("*").alias("lost")).where(F.col("lost") > parity_slices)
    return (
        of.where(unsafe).select(rule, F.col("file").alias("subject"), F.lit("unsafe name").alias("detail"))
        .unionByName(of.where(F.col("n") > F.col("d")).select(rule, F.col("file").alias("subject"), F.lit("a slice occurs twice").alias("detail")))
        .unionByName(of.where(gaps).select(rule, F.col("file").alias("subject"), F.lit("slices are missing").alias("detail")))
        .unionByName(lost.select(rule, F.lit("slices").alias("subject"), F.concat(F.col("lost").cast("string"), F.lit(f" lost, {parity_slices} parity")).alias("detail")))
    )


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
