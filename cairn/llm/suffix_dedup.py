"""Exact-substring deduplication by external induced sorting of sampled suffixes.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller doc_id.

The sampled suffixes (anchors) are those at the smallest hash of SEED bytes in any window of LENGTH bytes:
equal windows have equal anchors at the same place. Only anchors of which the SEED bytes occur in two texts can
matter; they are dealt out to shards by these bytes, and a shard finds the repeated strings by external
induced sorting (see induction): disk-backed priority queues carry the suffixes and their common
prefixes, so a shard may be far larger than memory.

Parts (of whole texts) and shards are made by bytes of text, not by a setting, so that a task's share doesn't
grow with the input. A seed that HOT texts hold is dealt out further: windows that begin 8c to 8c + 7 bytes left
of it, which have 43 bytes in common, go by these. Rows with the same text are one text with its smallest
document; a text that very many rows hold is sent by that document only. Equal surroundings of an anchor
in one part are told there, byte by byte, and one goes on.

Null texts are empty. Texts under LENGTH bytes keep everything. Rows with equal doc_id are not smaller than
each other. A null doc_id counts as larger than all others. Repeated rows each get their text's result. An
empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common as C
from cairn.llm.induction import EDGE, LENGTH, NONE, TUPLE, repeats

SEED = 20
#: Places of an anchor in a window.
WIDTH = LENGTH - SEED + 1
#: Bytes of text of a part, of a shard of suffixes, and of a shard of seeds, on average.
PART_BYTES, SHARD_BYTES, SEED_BYTES = 8 << 20, 32 << 20, 128 << 20
#: Bytes of suffix tuples that a shard keeps in memory; what is over goes to disk.
QUEUE_BYTES = 96 << 20
#: Texts that hold a seed, from which on it is dealt out by its windows.
HOT = 4096
#: Rows with one text, in all and as a share of 1 / OFTEN_OF of all rows, from which on only the smallest document sends it.
OFTEN, OFTEN_OF = 1000, 1_000_000
#: Tuples of one row between tasks.
ROW = 8192
assert WIDTH == EDGE + 1


def anchors(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted positions of anchors, hashes of the SEED bytes there); windows never cross documents."""
    got = [(x + offs[a], h) for a, b in _runs(offs) for x, h in [_anchors(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])]]
    return np.concatenate([np.zeros(0, np.int64), *(x for x, _ in got)]), np.concatenate([np.zeros(0, np.uint64), *(h for _, h in got)])


def _runs(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most C.SLICE_BYTES together (one at least)."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = min(max(int(np.searchsorted(offs, offs[a] + C.SLICE_BYTES, "right")) - 1, a + 1), n)
        yield a, b
        a = b


def _anchors(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = C._powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(raw * power[:n], out=total[1:])
    h = C.mix64((total[SEED:] - total[:-SEED]) * inverse[: n - SEED + 1])
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - SEED + 1, dtype=np.uint64)
    span = 1
    while span < WIDTH:  # smallest hash of ever wider windows, the leftmost of equal ones
        step = min(span, WIDTH - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(len(at), bool)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            ok[a : b - LENGTH + 1] = True
    took = np.zeros(n, bool)
    took[at[ok]] = True
    where = np.flatnonzero(took)
    return where, h[where]


class _Part:
    """A part's distinct texts in the order of their keys: bytes, offsets, keys, smallest documents."""

    def __init__(self, table: pa.Table) -> None:
        self.number = int(table.column("part")[0].as_py()) if table.num_rows else 0
        table = table.take(pc.sort_indices(table, sort_keys=[("key", "ascending")]))
        here = table.column("first").is_valid()  # one row of each key with its smallest document, any number with its text
        ids, texts = table.filter(here), table.filter(pc.invert(here))
        keys = texts.column("key").combine_chunks()
        if len(keys) > 1:
            new = pa.concat_arrays([pa.array([True]), pc.not_equal(keys[1:], keys[:-1])])
            texts = texts.filter(new)
        self.keys = texts.column("key").to_pylist()
        if ids.column("key").to_pylist() != self.keys:
            raise ValueError("texts and documents of a part differ")
        self.first = np.asarray(ids.column("first").combine_chunks(), np.int64) if len(self.keys) else np.zeros(0, np.int64)
        self.raw, self.offs = C.text_buffer(texts.column("x")) if len(self.keys) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, "right") - 1


def _seeds(part: _Part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, number of each one's seed, hashes of seeds, in how many texts of the part each seed occurs)."""
    at, h = anchors(part.raw, part.offs)
    own = part.doc(at)
    pairs = np.argsort(h, kind="stable")  # anchors come by document
    hs, ds = h[pairs], own[pairs]
    new, again = np.ones(len(hs), bool), np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    again[1:] = new[1:] | (ds[1:] != ds[:-1])
    head = np.flatnonzero(new)
    seed = np.empty(len(h), np.int64)
    seed[pairs] = np.cumsum(new) - 1
    return at, seed, hs[head], np.add.reduceat(again, head, dtype=np.int64) if len(head) else np.zeros(0, np.int64)


def _squeezed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _opened(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.CompressedInputStream(pa.py_buffer(x), "zstd").read(), kind)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    own, first = np.unique(shard[order], return_index=True)
    yield from zip(own.tolist(), np.split(order, first[1:]), strict=True)


def _send_seeds(shards: int):
    def run(table: pa.Table) -> pa.Table:
        part = _Part(table)
        _, _, keys, count = _seeds(part)
        rows = [(s, part.number, _low(keys[o], shards).tobytes(), np.minimum(count[o], 255).astype("u1").tobytes()) for s, o in _by_shard((keys % np.uint64(shards)).astype(np.int64))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "part", "keys", "count"])

    return run


def _low(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys // np.uint64(shards)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _meet_seeds(hot: int):
    """Which of the parts' seeds occur in two texts (1) and in very many (2); a chance agreement of hashes only sends more to the sort."""

    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(k, "<u4") for k in table.column("keys").to_pylist()]
        flat, count = np.concatenate(lists), np.concatenate([np.frombuffer(c, "u1") for c in table.column("count").to_pylist()])
        order = np.argsort(flat, kind="stable")
        s = flat[order]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(count[order].astype(np.int64), head)
        flag = np.empty(len(flat), np.uint8)
        flag[order] = np.repeat((total > 1).astype(np.uint8) + (total >= hot), np.diff(np.append(head, len(s))))
        cut = np.cumsum([len(k) for k in lists])[:-1]
        return pa.table([table.column("part").combine_chunks(), table.column("shard").combine_chunks(), pa.array([_squeezed(x) for x in np.split(flag, cut)], pa.binary())], names=["part", "shard", "flags"])

    return run


#: Of hot seeds, places of windows that go by the same bytes: (first, last) bytes to the left.
_CLASSES = [(a, min(a + 7, EDGE)) for a in range(0, EDGE + 1, 8)]


def _hashed(rows: np.ndarray) -> np.ndarray:
    """uint64 of each row of bytes."""
    acc = np.zeros(len(rows), np.uint64)
    for k in range(0, rows.shape[1], 8):
        word = np.zeros((len(rows), 8), np.uint8)
        word[:, : rows.shape[1] - k] = rows[:, k : k + 8]
        acc = C.mix64(acc * np.uint64(0x9E3779B97F4A7C15) + word.view("<u8").ravel())
    return acc


def _cleared(t: np.ndarray) -> np.ndarray:
    """t, with zeros where the bytes around are of another document or don't count."""
    odd = np.flatnonzero((t["left"] < EDGE) | (t["right"] < LENGTH))
    at = np.arange(LENGTH + EDGE)
    left, right = t["left"][odd, None].astype(np.int64), t["right"][odd, None].astype(np.int64)
    t["near"][odd] *= (at >= EDGE - left) & (at < EDGE + right)
    return t


def _collapsed(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which tuples go on, bits of those strings that are told): of tuples that agree byte by byte, those of the smallest document go on."""
    h = C.mix64(_hashed(t["near"]) + (t["left"].astype(np.uint64) << np.uint64(8)) + t["right"])
    turn = np.lexsort((t["doc"], h))
    head = np.ones(len(turn), bool)
    head[1:] = h[turn[1:]] != h[turn[:-1]]
    like = np.flatnonzero(~head)
    a, b = t[turn[like]], t[turn[like - 1]]
    head[like] = (a["near"] != b["near"]).any(1) | (a["left"] != b["left"]) | (a["right"] != b["right"])
    least = t["doc"][turn][np.maximum.accumulate(np.where(head, np.arange(len(turn)), 0))]
    told = np.zeros(len(turn), bool)
    told[turn] = t["doc"][turn] > least
    bits, own = np.zeros(len(turn), np.uint32), np.flatnonzero(told)
    for j in range(WIDTH):
        ok = (t["left"][own] >= j) & (t["right"][own] >= LENGTH - j)
        bits[own[ok]] |= np.uint32(1 << j)
    return ~told, bits


def _send_suffixes(seed_shards: int, shards: int):
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["shard", "part", "n", "near", "has", "doc", "at", "known"]

    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        if not texts.num_rows or not flags.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        part = _Part(texts)
        at, seed, keys, _ = _seeds(part)
        flag = np.zeros(len(keys), np.uint8)
        got = dict(zip(flags.column("shard").to_pylist(), flags.column("flags").to_pylist(), strict=True))
        for s, own in _by_shard((keys % np.uint64(seed_shards)).astype(np.int64)):
            flag[own] = _opened(got[s], "u1")
        of = flag[seed]
        far = np.concatenate([np.zeros(EDGE, np.uint8), part.raw, np.zeros(LENGTH, np.uint8)])

        def tuples(own: np.ndarray) -> np.ndarray:
            t = np.zeros(len(own), TUPLE)
            d = part.doc(own)
            t["part"], t["at"], t["doc"] = part.number, own, part.first[d]
            t["left"], t["right"] = np.minimum(own - part.offs[d], EDGE), np.minimum(part.offs[d + 1] - own, LENGTH)
            t["near"] = np.lib.stride_tricks.sliding_window_view(far, EDGE + LENGTH)[own]
            return _cleared(t)

        made = [(tuples(at[of == 1]), (keys[seed[of == 1]] % np.uint64(shards)).astype(np.int64))]
        if (of == 2).any():
            hot = tuples(at[of == 2])
            for a, b in _CLASSES:
                t = hot[(hot["left"] >= a) & (hot["right"] >= LENGTH - b)]
                t["left"], t["right"] = np.minimum(t["left"], b), np.minimum(t["right"], LENGTH - a)
                t = _cleared(t)
                made.append((t, (_hashed(t["near"][:, EDGE - a : EDGE + LENGTH - b]) % np.uint64(shards)).astype(np.int64)))
        rows = []
        for t, shard in made:
            go, known = _collapsed(t)
            if known.any():
                rows.append((part.number % shards, part.number, 0, None, None, None, _squeezed(t["at"][known != 0]), _squeezed(known[known != 0])))
            t, shard = t[go], shard[go]
            for s, every in _by_shard(shard):
                for k in range(0, len(every), ROW):
                    o = t[every[k : k + ROW]]
                    rows.append((s, part.number, len(o), _squeezed(o["near"]), _squeezed(np.stack([o["left"], o["right"]])), _squeezed(o["doc"]), _squeezed(o["at"]), None))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def _sort_suffixes(place: str, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple] = []

        def tuples() -> Iterator[np.ndarray]:
            for b in batches:
                for r in b.to_pylist():
                    if r["known"] is not None:
                        known.append((r["part"], r["at"], r["known"]))
                        continue
                    t = np.empty(r["n"], TUPLE)
                    t["near"] = _opened(r["near"], "u1").reshape(r["n"], -1)
                    t["left"], t["right"] = _opened(r["has"], "u1").reshape(2, -1)
                    t["doc"], t["at"], t["part"] = _opened(r["doc"], "<i8"), _opened(r["at"], "<u4"), r["part"]
                    yield t

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "at", "mask"])

        for part, at, mask in repeats(tuples(), place, budget):
            yield out([(part, _squeezed(at), _squeezed(mask))])
        yield out(known)

    return run


def _removed(part: _Part, masks: pa.Table) -> np.ndarray:
    starts = np.zeros(len(part.raw) + LENGTH, bool)
    for at, mask in zip(masks.column("at").to_pylist(), masks.column("mask").to_pylist(), strict=True):
        at, mask = _opened(at, "<u4"), _opened(mask, "<u4")
        for j in range(WIDTH):
            starts[at[(mask >> np.uint32(j)) & np.uint32(1) != 0].astype(np.int64) - j] = True
    edge = starts.astype(np.int8)
    edge[LENGTH:] -= starts[:-LENGTH]
    return np.cumsum(edge, dtype=np.int32)[: len(part.raw)] > 0


_CUT = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n_cut", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("sha", T.StringType())])


def _finish(with_text: bool):
    def run(texts: pa.Table, masks: pa.Table) -> pa.Table:
        rows = []
        if texts.num_rows and masks.num_rows:
            part = _Part(texts)
            gone = _removed(part, masks)
            count = C.per_doc_sum(gone, part.offs)
            for k in np.flatnonzero(count).tolist():
                a, b = int(part.offs[k]), int(part.offs[k + 1])
                g = gone[a:b]
                kept = part.raw[a:b][~g].tobytes()
                rows.append((part.keys[k], int(count[k]), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        t = pa.table([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=[*_CUT.names, "kept"])
        return t if with_text else t.drop_columns(["kept"])

    return run


def _once(often: dict[bytes, int]):
    """Rows (i, key, x) without texts that the task has sent, and those of `often` but from their smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for b in batches:
            go = []
            for k, (key, i) in enumerate(zip(b.column("key").to_pylist(), b.column("i").to_pylist(), strict=True)):
                if key not in sent and often.get(key, i) == i:
                    sent.add(key)
                    go.append(k)
            yield b.select(["key", "x"]).take(pa.array(go, pa.int64()))

    return run


def dedup(docs: DataFrame, column: str = "text", with_text: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds the kept bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("i"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), F.octet_length(text).cast("long").alias("n"), text.alias("x"))
    rows = C.written(named.select("i", "key", "n"))
    firsts = C.written(rows.groupBy("key").agg(F.min("i").alias("first"), F.first("n").alias("n"), F.count("*").alias("rows")))
    total, every = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    # at most OFTEN_OF texts, and a thousandth of the rows
    often = {bytes(r.key): r.first for r in firsts.where((F.col("rows") >= OFTEN) & (F.col("rows") * OFTEN_OF > every) & (F.col("n") >= LENGTH)).select("key", "first").collect()}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = lambda size: max(1, -(-total // size), min(n, total >> 20))
    parts, shards, seed_shards = made(PART_BYTES), made(SHARD_BYTES), made(SEED_BYTES)
    place = f"{C.checkpoint_dir(spark).rstrip('/')}/cairn-runs-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")
    sent = named.where(F.col("n") >= LENGTH).select("i", "key", "x").mapInArrow(_once(often), "key binary, x string")
    texts = sent.select(part, "key", "x", F.lit(None).cast("long").alias("first")).unionAll(firsts.where(F.col("n") >= LENGTH).select(part, "key", F.lit(None).cast("string"), "first"))
    seeds = texts.groupBy("part").applyInArrow(_send_seeds(seed_shards), "shard int, part int, keys binary, count binary")
    flags = seeds.groupBy("shard").applyInArrow(_meet_seeds(HOT), "part int, shard int, flags binary")
    suffixes = texts.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(_send_suffixes(seed_shards, shards), "shard int, part int, n long, near binary, has binary, doc binary, at binary, known binary")
    masks = suffixes.groupBy("shard").applyInArrow(_sort_suffixes(place, QUEUE_BYTES), "part int, at binary, mask binary")
    cut = T.StructType([*_CUT, T.StructField("kept", T.BinaryType())]) if with_text else _CUT
    found = texts.groupBy("part").cogroup(masks.groupBy("part")).applyInArrow(_finish(with_text), cut)
    info = C.written(firsts.select("key", "first").join(found, "key", "left"))
    own = rows.join(info, "key", "left")
    first = (F.col("i") == F.col("first")) | (F.col("n") < LENGTH)
    empty = hashlib.sha256(b"").hexdigest()
    out = [
        F.nullif("i", F.lit(NONE)).alias("doc_id"), F.col("n").alias("n_bytes"), F.when(first, F.coalesce("n_cut", F.lit(0))).otherwise(F.col("n")).cast("long").alias("n_removed"), F.when(first, F.coalesce("n_spans", F.lit(0))).otherwise(1).cast("long").alias("n_spans"),
        F.when(first, F.coalesce("sha", F.lower(F.hex("key")))).otherwise(empty).alias("kept_sha256"),
    ]
    if not with_text:
        return own.select(*out)
    # whole texts go with the rows that keep them; of the rest the kept bytes are known
    whole = named.select("key", F.col("x").cast("binary").alias("whole")).join(info.where("n_cut is null").select("key"), "key", "left_semi").dropDuplicates(["key"])
    kept = F.when(first, F.coalesce("kept", "whole")).otherwise(F.expr("X''"))
    return own.join(whole, "key", "left").select(*out, kept.alias("kept"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
