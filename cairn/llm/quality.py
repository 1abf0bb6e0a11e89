"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed on the executors with numpy. Trees are grown level by level on the
driver from per-bin gradient histograms of a bounded sample of labelled rows (`Spec.max_rows`); they are
complete binary trees, flattened into arrays (feature, threshold, leaf), and are walked for all rows of a
slice at once. Only the text enters a score.

Null and empty texts have all-zero statistics and get a score like any other, very long ones are read whole.
Labels with null quality or id are not learnt from. A doc_id with several labels counts once, with their mean; one
with several texts counts with one of them. Without labels to learn from, every score is 0.5. Repeated rows are
scored each on its own; an empty table gives no rows. Extra columns pass through, but not under the name
of the result, which stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common as C

MARKS = ".,!?;:#$%&*|@/\\<>()[]{}\"'-_=+~^`"
BASIC = ("log_bytes", "chars_per_byte", "upper", "lower", "digit", "space", "newline", "high", "control", "log_words", "word_len", "word_len_sd", "short_words", "long_words", "distinct_words", "distinct_pairs", "distinct_shingles", "repeated_next", "distinct_lines", "log_lines", "words_per_line", "upper_words", "title_words", "marked_words", "doubled_marks")
FEATURES = (*BASIC, *(f"mark_{ord(c)}" for c in MARKS))


@dataclass(frozen=True)
class Spec:
    """max_rows: bound of the sample learnt from (hash of doc_id, the same rows each time)."""

    max_rows: int = 20_000
    trees: int = 80
    depth: int = 4
    bins: int = 48
    rate: float = 0.15
    l2: float = 2.0
    min_rows: int = 12


def _classes() -> np.ndarray:
    t = np.full(256, 0, np.uint8)
    t[:32] = 1
    t[127] = 1
    t[9], t[32], t[13] = 2, 2, 2
    t[10] = 3
    t[48:58], t[65:91], t[97:123], t[128:192], t[192:] = 4, 5, 6, 7, 8
    for k, c in enumerate(MARKS):
        t[ord(c)] = 9 + k
    return t


CLASS = _classes()
N_CLASSES = 9 + len(MARKS)


def statistics(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, len(FEATURES)) table for one slice."""
    n, size = len(offs) - 1, np.diff(offs)
    doc = np.repeat(np.arange(n), size)
    cls = CLASS[raw]
    counts = np.bincount(doc * N_CLASSES + cls, minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    chars = size - counts[:, 7]
    c1 = np.maximum(chars, 1)[:, None]
    w = C.Words(raw, offs)
    nw = np.diff(w.first).astype(float)
    w1 = np.maximum(nw, 1)
    length = (w.end - w.start).astype(float)
    per = lambda v: C.per_doc_sum(v, w.first)
    mean = per(length) / w1
    sd = np.sqrt(np.maximum(per(length**2) / w1 - mean**2, 0))
    wdoc = np.repeat(np.arange(n), np.diff(w.first))
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (wdoc[1:] == wdoc[:-1])
    pairs, pf = C.shingles(w, 2)
    sh, sf = C.shingles(w, 5)
    head_up = cls[w.start] == 5
    tail_up = cls[w.end - 1] == 5
    after = np.append(raw, 32)[w.end]
    marked = CLASS[after] >= 9
    # lines: hashes of the bytes between newlines
    brk = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, offs[:-1][size > 0]])) if len(raw) else np.zeros(0, np.int64)
    brk = brk[brk < len(raw)]
    power, inverse = C._powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * power[: len(raw)], out=total[1:])
    stop = np.append(brk[1:], len(raw))
    lh = C.mix64((total[stop] - total[brk]) * inverse[brk])
    lf = np.searchsorted(brk, offs)
    nl = np.diff(lf)
    doubled = np.zeros(len(raw), bool)
    if len(raw) > 1:
        doubled[1:] = (cls[1:] >= 9) & (raw[1:] == raw[:-1]) & (doc[1:] == doc[:-1])
    share = lambda h, f: C.distinct_per_doc(h, f) / np.maximum(np.diff(f), 1)
    cols = [
        np.log1p(size), chars / np.maximum(size, 1), counts[:, 5] / c1[:, 0], counts[:, 6] / c1[:, 0], counts[:, 4] / c1[:, 0], counts[:, 2] / c1[:, 0], counts[:, 3] / c1[:, 0], counts[:, 8] / c1[:, 0], counts[:, 1] / c1[:, 0],
        np.log1p(nw), mean, sd, per(length <= 3) / w1, per(length >= 12) / w1, share(w.hash, w.first), share(pairs, pf), share(sh, sf), per(same) / w1, share(lh, lf), np.log1p(nl), nw / np.maximum(nl, 1),
        per(head_up & tail_up) / w1, per(head_up & ~tail_up) / w1, per(marked) / w1, np.bincount(doc, doubled, n) / c1[:, 0],
    ]
    return np.column_stack([*cols, counts[:, 9:] / c1])


class Trees:
    """Boosted complete trees as flat arrays."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, depth: int) -> None:
        self.base, self.feature, self.threshold, self.leaf, self.depth = base, feature, threshold, leaf, depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (len(f))]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, spec: Spec) -> Trees:
    """Second-order boosting of the logistic loss with histograms of spec.bins quantile bins."""
    inner, leaves = 2**spec.depth - 1, 2**spec.depth
    if not len(y) or y.min() == y.max():
        p = 0.5 if not len(y) else (y.sum() + 1) / (len(y) + 2)
        return Trees(float(np.log(p / (1 - p))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), spec.depth)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, spec.bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])
    nb, nf = spec.bins + 1, x.shape[1]
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    m = np.full(len(y), base)
    feats, thrs, lvs = [], [], []
    flat = binned + np.arange(nf) * nb
    for _ in range(spec.trees):
        q = 1 / (1 + np.exp(-m))
        g, h = q - y, q * (1 - q)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(spec.depth):
            width, lo = 2**level, 2**level - 1
            key = ((node - lo)[:, None] * (nf * nb) + flat).ravel()
            hist = [np.bincount(key, np.repeat(v, nf), width * nf * nb).reshape(width, nf, nb).cumsum(2) for v in (g, h, np.ones(len(y)))]
            gl, hl, cl = hist
            gt, ht, ct = gl[:, :, -1:], hl[:, :, -1:], cl[:, :, -1:]
            gain = gl**2 / (hl + spec.l2) + (gt - gl) ** 2 / (ht - hl + spec.l2) - gt**2 / (ht + spec.l2)
            gain[(cl < spec.min_rows) | (ct - cl < spec.min_rows)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), nb)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[lo + k], threshold[lo + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_of = node - inner
        leaf = -spec.rate * np.bincount(leaf_of, g, leaves) / (np.bincount(leaf_of, h, leaves) + spec.l2)
        m += leaf[leaf_of]
        feats.append(feature), thrs.append(threshold), lvs.append(leaf)
    return Trees(base, np.array(feats), np.array(thrs), np.array(lvs), spec.depth)


def train(docs: DataFrame, labels: DataFrame, spec: Spec = Spec()) -> Trees:
    """Fit on labelled documents that aren't held out; at most about spec.max_rows of them reach the driver."""
    known = labels.select(F.col("doc_id").alias("i"), F.col("quality").cast("double").alias("y")).where("i is not null and y is not null").where(~C.held_out("i")).groupBy("i").agg(F.avg("y").alias("y"))
    n = known.count()
    keep = min(1.0, spec.max_rows / max(n, 1))
    sample = known.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < int(keep * (1 << 30)))
    # a row for each id: spec.max_rows of them, but for the chance of the hash
    texts = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("x")).join(F.broadcast(sample), "i")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in C.slices(batches, "x"):
            x = statistics(raw, offs).astype(np.float64)
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["i", "y", "f"])

    got = texts.mapInArrow(rows, T.StructType([T.StructField("i", docs.schema["doc_id"].dataType), T.StructField("y", T.DoubleType()), T.StructField("f", T.ArrayType(T.DoubleType()))])).groupBy("i", "y").agg(F.min("f").alias("f")).toArrow().sort_by("i")
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), spec)
    return fit(np.array(got.column("f").to_pylist()), np.asarray(got.column("y")), spec)


def _scored(model, column: str, keep: list[str], threshold: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for part, raw, offs in C.slices(batches, column):
            s = trees.score(statistics(raw, offs))
            if threshold is None:
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s)], names=[*keep, "score"])
            else:
                yield part.select(keep).filter(pa.array(s >= threshold))

    return run


def score(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ("doc_id",), column: str = "text") -> DataFrame:
    """The `keep` columns and score (probability of label 1) of every document."""
    bc = docs.sparkSession.sparkContext.broadcast(model)  # of a size that the spec fixes
    keep = C.unclashing(keep, ("score",))
    need = list(dict.fromkeys([*keep, column]))
    return docs.select(*[F.col(f"`{c}`") for c in need]).mapInArrow(_scored(bc, column, list(keep), None), T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.3, column: str = "text") -> DataFrame:
    """docs with a score of threshold or more, all columns kept."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scored(bc, column, docs.columns, threshold), docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = score(docs, model)
    return got.select("doc_id", C.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
