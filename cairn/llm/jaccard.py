"""N-gram Jaccard join with Bayesian pruning of candidates.

A document's set is its distinct five-word shingles (fewer words, but not none, make one shingle). Equal
sets form a class at once, so copies are one node from there on.

Candidates are pairs of classes that share a band of MinHash values (BANDS bands of ROWS values, so that a pair at
the threshold escapes with a chance under 2e-6). They are compared where they meet, by their MinHash values
alone, STEP at a time: with a uniform prior, the similarity after m of n agreements has a Beta(m + 1, n - m + 1)
posterior, and a pair goes as soon as its mass at the threshold or above is under TOLERANCE. A bucket returns
no pairs but a forest that connects what is left; classes that are connected already are not compared again, so
a bucket of near copies takes about as many comparisons as it has members. Large buckets are compared in
blocks, two at a time.

Within the components of these forests, which only pairs near the threshold tie, all pairs are compared in
blocks of bounded size, pruned in the same way pair by pair, and the rest is verified by exact counts of shared
shingles. Blocks return numbers of links and a spanning forest, not pairs.

Null texts and texts without words have no set: they are linked to nothing and are a class of their own.
Repeated rows with one doc_id share its class. Rows with a null doc_id count as copies; a class that has only
such rows is linked to nothing, and its ids are null. Very long texts count with all their shingles: block sizes
are bounded by shingles too. A pair of exactly the threshold is a link. Empty tables give no rows. Other columns
are not read by `join`, and pass through `one_of_each`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common as C

SHINGLE = 5
#: Similarity from which pairs are linked, as a fraction of whole numbers.
THRESHOLD = (4, 5)
BANDS, ROWS = 26, 4
HASHES, STEP = 128, 16
TOLERANCE = 1e-9
#: Classes and shingles of a block that is verified; classes of a block of a bucket.
BLOCK_CLASSES, BLOCK_SHINGLES, BUCKET = 512, 400_000, 1024
#: Up to so many members, buckets are compared many at a time.
FEW = 16

_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def sets_of(raw: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    h, first = C.shingles(C.Words(raw, offs), size)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def minhash(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """(sets, hashes) table of 16 bits of each MinHash value; all ones for an empty set.

    Values that differ agree in these bits by chance once in 65,536 times, so that pruning keeps a little more.
    """
    out = np.full((len(sets), hashes), 0xFFFF, np.uint16)
    some = [k for k, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[k] for k in some])
        start = np.concatenate([[0], np.cumsum([len(sets[k]) for k in some])[:-1]])
        for k in range(hashes):
            out[some, k] = np.minimum.reduceat(flat * _A[k] + _B[k], start) >> np.uint64(48)
    return out


def key_of(s: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    return np.array([np.bitwise_xor.reduce(C.mix64(s)), C.mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64).tobytes()


def least_matches(hashes: int = HASHES, step: int = STEP, tolerance: float = TOLERANCE) -> dict[int, int]:
    """n -> fewest agreements of n with which the similarity may still reach the threshold.

    The Beta(m + 1, n - m + 1) mass above t is the chance of at most m successes in n + 1 draws at t.
    """
    t = THRESHOLD[0] / THRESHOLD[1]
    out = {}
    for n in range(step, hashes + 1, step):
        mass, m = 0.0, 0
        while True:
            mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def _signed(docs: DataFrame, column: str, size: int) -> DataFrame:
    """doc_id, digest (of the text), key (null without words), n, bands, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in C.slices(batches, "x"):
            sets = sets_of(raw, offs, size)
            sig = minhash(sets)
            bands = np.zeros((len(sets), BANDS), np.uint64)
            for b in range(BANDS):
                acc = np.full(len(sets), np.uint64(b + 1))
                for r in range(ROWS):
                    acc = C.mix64(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
                bands[:, b] = acc
            none = np.array([len(s) == 0 for s in sets], bool)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("digest"), pa.array([None if z else key_of(s) for s, z in zip(sets, none.tolist(), strict=True)], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel())),
                pa.array([x.tobytes() for x in sig], pa.binary()),
            ], names=["doc_id", "digest", "key", "n", "bands", "sig"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("digest", T.BinaryType()), T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
    return docs.select("doc_id", digest(column).alias("digest"), F.col(f"`{column}`").alias("x")).mapInArrow(run, schema)


def digest(column: str) -> Column:
    """What tells texts apart, null from empty ones too."""
    return F.coalesce(F.unhex(F.md5(F.col(f"`{column}`").cast("binary"))), F.expr("X''"))


def may_reach(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (a[i], b[j]) are left of the MinHash tables a and b: each is compared only until it goes."""
    left, got = np.arange(len(i)), np.zeros(len(i), np.int64)
    for n, least in _LEAST.items():
        own = slice(n - STEP, n)
        got += (a[i[left], own] == b[j[left], own]).sum(1)
        on = got >= least
        left, got = left[on], got[on]
    return left


_LEAST = least_matches()


def forest(sig: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the members of one bucket that pairs which may reach the threshold connect.

    side: 0, or 0 and 1 if only pairs of both sides count. From each member that is reached, only those that aren't are compared.
    """
    out: list[tuple[int, int]] = []
    rest = np.arange(len(sig))
    two = bool(side.any())
    while len(rest):
        wave, rest = [int(rest[0])], rest[1:]
        while wave and len(rest):
            k = wave.pop()
            own = rest[side[rest] != side[k]] if two else rest
            hit = own[may_reach(sig, sig, np.full(len(own), k), own)]
            if len(hit):
                out += [(k, x) for x in hit.tolist()]
                wave += hit.tolist()
                rest = np.setdiff1d(rest, hit, assume_unique=True)
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, side, node, sig) in the order of (band, i, j): forests (a, b) of nodes."""

    def groups() -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("band", "i", "j")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            if held and [held[-1].column(c)[-1].as_py() for c in ("band", "i", "j")] != key[:, 0].tolist():
                yield pa.Table.from_batches(held)
                held = []
            if len(cut):
                at = int(cut[-1]) + 1
                yield pa.Table.from_batches([*held, b.slice(0, at)])
                held, b = [], b.slice(at)
            held.append(b)
        if held:
            yield pa.Table.from_batches(held)

    for t in groups():
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(t.num_rows, HASHES)
        node, side = np.asarray(t.column("node").combine_chunks()), np.asarray(t.column("side").combine_chunks())
        key = np.stack([np.asarray(t.column(c).combine_chunks()).astype(np.int64) for c in ("band", "i", "j")])
        head = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1])
        size = np.diff(np.append(head, len(node)))
        of = np.repeat(np.arange(len(head)), size)
        few = np.repeat(size <= FEW, size)
        edges: list[tuple[int, int]] = []
        for d in range(1, FEW):
            a = np.flatnonzero(few[d:] & (of[d:] == of[:-d]))
            a = a[(key[1, a] == key[2, a]) | (side[a] != side[a + d])]
            on = a[may_reach(sig, sig, a, a + d)]
            edges += zip(on.tolist(), (on + d).tolist(), strict=True)
        for g in np.flatnonzero(size > FEW).tolist():
            own = slice(int(head[g]), int(head[g] + size[g]))
            both = key[1, head[g]] != key[2, head[g]]
            edges += [(head[g] + x, head[g] + y) for x, y in forest(sig[own], side[own] if both else np.zeros(size[g], np.int8))]
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with `own` of `blocks` blocks, dealt out to pairs of blocks: i, j and side."""
    spread = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": F.when(F.col("own") <= F.col("other"), 0).otherwise(1).cast("int")}).drop("own", "other", "blocks")


def _own(blocks: str = "blocks", by: str = "node") -> Column:
    return F.pmod(F.xxhash64(by, F.lit(3)), F.col(blocks)).cast("int")


def _shared(a: list[np.ndarray], b: list[np.ndarray], alive: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a[i] and b[j] where alive[i, j]; elsewhere 0."""
    out = np.zeros(alive.shape, np.int64)
    i, j = np.nonzero(alive)
    if not len(i):
        return out
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    words, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    if (na[i] + nb[j]).sum() * 10 + len(i) * 10_000 < alive.size * len(words) * 0.1:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            out[x, y] = len(np.intersect1d(a[x], b[y], assume_unique=True))
        return out
    rows = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]))
    for lo in range(0, len(words), 4096):
        own = (at >= lo) & (at < lo + 4096)
        dense = np.zeros((len(a) + len(b), 4096), np.float32)
        dense[rows[own], at[own] - lo] = 1
        out += (dense[: len(a)] @ dense[len(a) :].T).astype(np.int64)
    out[~alive] = 0
    return out


def links(a: list[np.ndarray], b: list[np.ndarray], same: bool, sa: np.ndarray | None = None, sb: np.ndarray | None = None) -> np.ndarray:
    """Boolean table: a[i] and b[j] have a similarity of the threshold or more. same: b is a; only i < j is set. sa, sb: their MinHash tables."""
    sa = minhash(a) if sa is None else sa
    sb = (sa if same else minhash(b)) if sb is None else sb
    alive = np.zeros((len(a), len(b)), bool)
    for k in range(0, len(a), 64):  # so many rows' pairs at a time
        i, j = np.nonzero(np.triu(np.ones((min(64, len(a) - k), len(b)), bool), k + 1) if same else np.ones((min(64, len(a) - k), len(b)), bool))
        on = may_reach(sa, sb, i + k, j)
        alive[i[on] + k, j[on]] = True
    up, low = THRESHOLD
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    # shared / (na + nb - shared) >= up / low
    return alive & ((up + low) * _shared(a, b, alive) >= up * (na[:, None] + nb[None, :]))


def _verify(size: int):
    """applyInArrow function for one block, or for two that are compared with each other."""
    kinds = [pa.binary(), pa.binary(), pa.int64()]

    def run(table: pa.Table) -> pa.Table:
        keys, side = table.column("key").to_pylist(), np.asarray(table.column("side"))
        raw, offs = C.text_buffer(table.column("x"))
        step, sets = [], []
        for k in range(0, len(keys), 64):
            step = offs[k : k + 65]
            sets += sets_of(raw[step[0] : step[-1]], step - step[0], size)
        good = [k for k, s in enumerate(sets) if len(s) and key_of(s) == keys[k]]
        uniq = list({(keys[k], int(side[k])): k for k in good}.values())  # repeated rows of one class
        sig = table.column("sig").to_pylist()
        signs = lambda own: np.frombuffer(b"".join(sig[k] for k in own), np.uint16).reshape(len(own), HASHES)
        left = sorted((k for k in uniq if side[k] == 0), key=lambda k: keys[k])
        right = sorted((k for k in uniq if side[k] == 1), key=lambda k: keys[k])
        both = bool(len(keys)) and table.column("i")[0] != table.column("j")[0]
        other = right if both else left
        if not left or not other:
            return pa.table([pa.array([], t) for t in kinds], names=["a", "b", "n"])
        on = links([sets[k] for k in left], [sets[k] for k in other], not both, signs(left), signs(other))
        out: list[tuple] = []
        count = on.sum(1) + (on.sum(0) if not both else 0)
        out += [(keys[k], None, int(c)) for k, c in zip(left, count.tolist(), strict=True) if c]
        if both:
            out += [(keys[k], None, int(c)) for k, c in zip(other, on.sum(0).tolist(), strict=True) if c]
        # spanning forest of the links, as stars
        names = sorted({keys[k] for k in [*left, *other]})
        index = {x: i for i, x in enumerate(names)}
        i, j = np.nonzero(on)
        u = np.array([index[keys[k]] for k in left], np.int64)[i]
        v = np.array([index[keys[k]] for k in other], np.int64)[j]
        label = np.arange(len(names))
        while True:
            new = label.copy()
            np.minimum.at(new, u, label[v])
            np.minimum.at(new, v, label[u])
            new = new[new]
            if (new == label).all():
                break
            label = new
        out += [(names[k], names[r], 0) for k, r in enumerate(label.tolist()) if k != r]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["a", "b", "n"])

    return run


def join(docs: DataFrame, column: str = "text", size: int = SHINGLE) -> DataFrame:
    """A row per row of docs: doc_id, class_id, copy_of, n_links, n_copies.

    class_id: smallest doc_id of the group that links connect; copy_of: smallest doc_id with an equal set;
    n_links: classes of other sets with a similarity of the threshold or more; n_copies: rows with an equal set.
    """
    return _joined(docs, column, size)[0]


def _joined(docs: DataFrame, column: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(what join returns, doc_id, digest, key and top of rows that have a set; top tells groups apart)."""
    signed = C.written(_signed(docs, column, size))
    sets = signed.where("key is not null")
    classes = C.written(sets.groupBy("key").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest"))).alias("r"), F.count("*").alias("n_copies")).select("key", F.col("r.doc_id").alias("rep"), F.col("r.digest").alias("digest"), "n_copies"))
    # nodes of the candidate graph are hashes of keys: if two collide, more is compared, nothing is lost
    one = classes.select("key", F.col("rep").alias("doc_id"), "digest")
    reps = C.written(sets.join(one, ["key", "doc_id", "digest"]).dropDuplicates(["key"]).withColumn("node", F.xxhash64("key")))
    buckets = reps.select("node", F.explode("bands").alias("band"))
    # tables that aggregations made are pinned before joins: a join of two plain exchanges is split where a key is hot
    heads = C.written(buckets.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band", F.ceil(F.col("m") / BUCKET).cast("int").alias("blocks")))
    met = _in_blocks(buckets.join(heads, "band").withColumn("own", _own())).join(reps.select("node", "sig"), "node")
    ties = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").select("band", "i", "j", "side", "node", "sig").mapInArrow(_compared, "a long, b long").distinct()
    part = C.connected_components(ties)
    members = C.written(reps.select("key", "doc_id", "digest", "n", "sig", "node").join(part, "node").drop("node"))
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s")).select("root", F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(C.pinned(sizes), "root").withColumn("own", _own(by="key")).drop("n")
    texts = docs.select("doc_id", digest(column).alias("digest"), F.col(f"`{column}`").alias("x")).where(F.col(f"`{column}`").isNotNull())
    blocks = texts.join(_in_blocks(placed), ["doc_id", "digest"]).select("root", "i", "j", "key", "side", "sig", "x")
    found = C.written(blocks.groupBy("root", "i", "j").applyInArrow(_verify(size), "a binary, b binary, n long"))
    n_links = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    group = C.connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("key"), F.col("root").alias("top"))
    info = C.written(classes.join(group, "key", "left").join(n_links, "key", "left").withColumn("top", F.coalesce("top", "key")))
    tops = C.written(info.groupBy("top").agg(F.min("rep").alias("class_id")))
    grouped = info.select("key", "top")
    info = info.join(tops, "top").select("key", "class_id", F.col("rep").alias("copy_of"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = signed.select("doc_id", "key").join(info, "key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")
    )
    return out, sets.select("doc_id", "digest", "key").join(grouped, "key")


def one_of_each(docs: DataFrame, column: str = "text", size: int = SHINGLE) -> DataFrame:
    """docs with one row of each group, and all rows without words.

    The row with the smallest doc_id stays, null ids last; of equal ids the smallest digest of the text. What else
    the rows of a group hold doesn't matter: rows with one doc_id but texts of other groups stay. Of repeats of a
    row that stays, with the same doc_id and text, one stays.
    """
    rows = C.written(_joined(docs, column, size)[1].select("doc_id", "digest", "top"))
    first = C.written(rows.groupBy("top").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("r")).select("top", F.col("r.doc_id").alias("f_id"), F.col("r.digest").alias("f_digest")))
    told = C.written(rows.join(first, "top").groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest"))).alias("stays")))
    mine, id_ = C.spare("digest", docs.columns), C.spare("id", docs.columns)
    own = docs.withColumn(mine, digest(column))

    def named(t: DataFrame) -> DataFrame:
        return t.select(F.col("doc_id").alias(id_), F.col("digest").alias(mine + "2"))

    def on(t: DataFrame) -> Column:
        return own["doc_id"].eqNullSafe(t[id_]) & (own[mine] == t[mine + "2"])

    gone, again = named(told.where("not stays")), named(told.where("stays and n > 1"))
    kept = own.join(gone.hint("shuffle_hash"), on(gone), "left_anti")  # ids are small; texts need no sort
    if again.isEmpty():
        return kept.drop(mine)
    twice = own.join(again.hint("shuffle_hash"), on(again), "left_semi").dropDuplicates(["doc_id", mine])
    return kept.join(again.hint("shuffle_hash"), kept["doc_id"].eqNullSafe(again[id_]) & (kept[mine] == again[mine + "2"]), "left_anti").unionByName(twice).drop(mine)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
