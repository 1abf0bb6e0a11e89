"""Best-fit packing: length patterns fitted by non-negative least squares.

Documents become token ids plus id 0; longer ones than a sequence are cut into pieces of its full length
(the first may be shorter). From the histogram of piece lengths, which has one bin per length however large
the corpus is, patterns of two and three lengths that fill a sequence are enumerated, their repeat counts
fitted to the histogram by projected gradient steps under x >= 0, and rounded down. What is left of the
histogram goes by best fit, longest first, into the room of patterns that are open. The plan says for the
r-th piece of a length where it goes; r comes from counts per task and length, so no task sees all pieces
of a length.

Null text is the empty text: one piece with the single id 0. Repeated rows and ids are pieces of their own, as
are rows without a doc_id. Very long texts are coded whole. An empty table gives no rows. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common as C

SEQUENCE = 2048
#: Beyond these characters the two libraries' character tables could differ by version.
_RARE = r"[^\x00-ɏ‐-‧€]"
_CODERS: dict[str, tuple] = {}


def coder(vocabulary: str | None = None):
    """Function from a text to its ids (uint32) under the byte-level vocabulary.

    vocabulary: path of the .json file; None takes byte_bpe_50k.json of the installed public tokenizers.
    Texts of common characters are coded by the rank file of the same vocabulary, which is several times
    as fast; all others, and those that hold one of its added tokens, by the .json file itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _CODERS:
        slow = Tokenizer.from_file(path)
        added = "|".join(re.escape(t.content.strip()) for t in slow.get_added_tokens_decoder().values())
        odd = re.compile(f"{_RARE}|{added}" if added else _RARE, re.I)
        fast = None
        if path == public_tokenizers.path("byte_bpe_50k.json"):
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _CODERS[path] = slow, fast, odd
    slow, fast, odd = _CODERS[path]

    def code(text: str) -> np.ndarray:
        if fast is not None and not odd.search(text):
            return fast.encode_to_numpy(text, disallowed_special=())
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return code


PIECES = T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()),
])


def pieces(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, column: str = "text") -> DataFrame:
    """doc_id and PIECES; nth counts a task's pieces of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = coder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch, _, _ in C.slices(batches, "x"):
            rows, names = [], []
            ids_of = batch.column("doc_id")
            for d, text in enumerate(batch.column("x")):
                ids = np.append(code(text.as_py() or ""), np.uint32(0)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % size or size, n, size), n]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a])))
                    names.append(d)
                    seen[b - a] += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(PIECES)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(names, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *PIECES.names])

    return docs.select("doc_id", F.col(f"`{column}`").alias("x")).mapInArrow(run, T.StructType([docs.schema["doc_id"], *PIECES]))


def _patterns(lengths: np.ndarray, size: int, per_length: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence, from lengths that occur."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    out = [(a, size - a, 0) for a in lengths.tolist() if 2 * a >= size and size - a > 0 and have[size - a]]
    for a in lengths.tolist():
        rest = size - a
        b = lengths[(lengths <= min(a, rest - 1)) & (2 * lengths >= rest)]
        b = b[have[rest - b]]
        if len(b):
            out += [(a, int(x), rest - int(x)) for x in b[np.unique(np.linspace(0, len(b) - 1, per_length).astype(int))]]
    return np.array(out, np.int64).reshape(-1, 3)


def nnls(patterns: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring patterns' lengths near hist: accelerated projected gradient."""
    if not len(patterns):
        return np.zeros(0)
    used = np.bincount(patterns.ravel(), minlength=len(hist)).astype(float)
    used[0] = 0
    scale = 1.0 / np.maximum(hist, 1.0) ** 0.5  # rare lengths weigh as much as their noise
    pull = lambda r: (scale * r * (np.arange(len(r)) > 0))[patterns].sum(1)
    # Gershgorin: of A'WA, the row of a pattern sums to the uses of its lengths
    step = 1.0 / (2 * (scale * used)[patterns].sum(1))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        made = np.bincount(patterns.ravel(), np.repeat(y, 3), len(hist))
        new = np.maximum(0, y - step * pull(made - hist))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(hist: np.ndarray, size: int = SEQUENCE, per_length: int = 6) -> dict[str, np.ndarray]:
    """Where pieces go: for length and rank, arrays sorted by (length, rank): key, sequence, offset.

    hist[l]: pieces of length l. A segment holds consecutive ranks of one length, that go to consecutive
    sequences at one offset.
    """
    left = hist.astype(np.int64).copy()
    left[0] = 0
    groups: list[tuple[tuple, int]] = [(((size, 1), None), int(left[size]))] if left[size] else []
    left[size] = 0
    lengths = np.flatnonzero(left)
    pats = _patterns(lengths, size, per_length)
    x = np.floor(nnls(pats, left.astype(float)) + 1e-9).astype(np.int64)
    for k in np.argsort(-x, kind="stable").tolist():
        if x[k] <= 0:
            break
        parts = [p for p in pats[k].tolist() if p]
        need = {p: parts.count(p) for p in parts}
        c = min(int(x[k]), *(int(left[p]) // m for p, m in need.items()))
        if c > 0:
            chain = None
            for p, m in need.items():
                chain, left[p] = ((p, m), chain), left[p] - c * m
            groups.append((chain, c))
    # the rest: best fit, longest first; open[r] are groups of sequences with room r
    room: list[list[tuple]] = [[] for _ in range(size + 1)]
    full = np.zeros(size + 1, bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = np.flatnonzero(full[length:])
            r = int(fits[0]) + length if len(fits) else size
            if len(fits):
                chain, c = room[r].pop()
                full[r] = bool(room[r])
            else:
                chain, c = None, -(-n // (size // length))
            each = min(r // length, n)
            use = min(c, n // each)
            if use < c and len(fits):
                room[r].append((chain, c - use))
                full[r] = True
            room[r - each * length].append((((length, each), chain), use))
            full[r - each * length] = True
            n -= use * each
    groups += [g for some in room for g in some]
    used, key, seq, off, base = np.zeros(size + 1, np.int64), [], [], [], 0
    for chain, c in groups:
        at = 0
        while chain is not None:
            (length, m), chain = chain
            for _ in range(m):
                key.append((length << 50) + int(used[length]))
                seq.append(base - int(used[length]))
                off.append(at)
                used[length] += c
                at += length
        base += c
    order = np.argsort(np.array(key, np.int64)) if key else np.zeros(0, np.int64)
    return {"key": np.array(key, np.int64)[order], "sequence": np.array(seq, np.int64)[order], "offset": np.array(off, np.int64)[order]}


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, column: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    got = C.written(pieces(docs, vocabulary, size, column))
    counts = got.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    hist = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row per length at most
        hist[length] = n
    bc = docs.sparkSession.sparkContext.broadcast(plan(hist, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = bc.value
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            at = np.searchsorted(where["key"], (length << 50) + rank, "right") - 1
            cols = {c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": pa.array(where["sequence"][at] + rank), "offset": pa.array(where["offset"][at])}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    ranked = got.join(before.drop("n"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("rank"))
    return ranked.mapInArrow(place, T.StructType([docs.schema["doc_id"], *PIECES[:4], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
