"""A corpus of four cases for benchmarks of archives: text, random bytes, many small files, and copies."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Sizes and numbers of the cases' files, and the seed.
TEXT_BYTES, RANDOM_BYTES, COPY_BYTES, SMALL_TEXT, SMALL_MOST = 512 << 10, 256 << 10, 256 << 10, 4050, 4096
SMALL_FILES, PER_FOLDER, COPIES, SEED = 128, 32, 8, 0x5A17
SENTENCE = b"A line of plain words is copied again and again, so that a codec finds much to leave out here. Other cases have random bytes, small files and copies.\n"


def contents(case: str) -> Iterator[tuple[str, bytes]]:
    """(path, content) of a case's files."""
    text = (SENTENCE * (TEXT_BYTES // len(SENTENCE) + 1))[:TEXT_BYTES]
    if case == "text":
        yield "report.txt", text
    elif case == "incompressible-random":
        yield "random.bin", random.Random(SEED).randbytes(RANDOM_BYTES)
    elif case == "many-small-files":
        for k in range(SMALL_FILES):
            yield f"batch-{k // PER_FOLDER:02d}/item-{k:03d}.txt", (f"record={k:03d}; ".encode() + text[:SMALL_TEXT])[:SMALL_MOST]
    elif case == "duplicate-files":
        for k in range(COPIES):
            yield f"copy-{k:02d}.bin", text[:COPY_BYTES]


CASES = ("text", "incompressible-random", "many-small-files", "duplicate-files")


def suite(spark: SparkSession) -> DataFrame:
    """case, path, content of all cases; a task makes a case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for case in b.column("case").to_pylist():
                rows = list(contents(case))
                yield pa.RecordBatch.from_arrays([pa.array([case] * len(rows)), pa.array([p for p, _ in rows]), pa.array([x for _, x in rows], pa.binary())], names=["case", "path", "content"])

    return spark.createDataFrame([(c,) for c in CASES], "case string").repartition(len(CASES)).mapInArrow(run, "case string, path string, content binary")
