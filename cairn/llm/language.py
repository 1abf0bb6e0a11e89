"""Language identification with language-bitmask n-gram filters.

Every n-gram (bytes of lower-cased text, runs of non-letters as one blank) is hashed to `probes` positions
of a table whose words hold one bit per language: the bit slices are the Bloom filters of all languages.
The AND of the words at its positions is the set of languages that contain the n-gram. A document's
popcount per language, corrected for the filter's false positives, decides.

Learnt from a bounded, hash-chosen sample of `Spec.docs_per_language` documents per non-null language that
aren't held out, of the `Spec.max_languages` languages with most documents. An n-gram enters a language's filter if
`Spec.min_docs` of its sampled documents have it (all of them, if a language has fewer) and it is not much
more frequent elsewhere. Null texts and texts without a letter are `und` with score 0, as is every text if
nothing could be learnt. Ties go to the first language in order. Very long texts count with all their n-grams.
Repeated rows are judged each on its own; an empty table gives no rows. Extra columns pass through, but not under
the names of results, which stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common as C


@dataclass(frozen=True)
class Spec:
    """docs_per_language and max_languages bound what is learnt from; bits: log2 of the table's words."""

    docs_per_language: int = 600
    max_languages: int = 1024
    sizes: tuple[int, ...] = (3, 5)
    bits: int = 20
    probes: int = 2
    min_docs: int = 3
    ratio: float = 0.25


#: Hashes of n-grams leave these bits free.
DOC_BITS = (1 << 14) - 1
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[:128] = 32
_BLANK[97:123] = np.arange(97, 123)
_BLANK[65:91] = np.arange(97, 123)
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def grams(raw: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, (hashes of the n-grams, first index of each document); n-grams never cross documents."""
    low = _BLANK[raw]
    n = len(low)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    keep = np.ones(n, bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (doc[1:] != doc[:-1])
    low, doc = low[keep].astype(np.uint64), doc[keep]
    for size in sizes:
        m = len(low) - size + 1
        if m <= 0:
            yield np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
            continue
        h = np.zeros(m, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x100000001B3) + low[k : k + m]
        inside = doc[:m] == doc[size - 1 :]
        yield C.mix64(h[inside] + np.uint64(size << 59)) & ~np.uint64(DOC_BITS), np.searchsorted(doc[:m][inside], np.arange(len(offs)))


class Filters:
    """Bit-sliced Bloom filters: table (planes, 2**bits) of uint64, one bit per language."""

    def __init__(self, langs: list[str], spec: Spec) -> None:
        self.langs, self.spec = langs, spec
        self.table = np.zeros((max(1, -(-len(langs) // 64)), 1 << spec.bits), np.uint64)
        self.wrong = np.zeros(len(langs))

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        bits = self.spec.bits
        return [((h >> np.uint64(64 - bits * (k + 1))) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(self.spec.probes)]

    def add(self, lang: int, h: np.ndarray) -> None:
        for at in self.places(h):
            self.table[lang // 64][np.unique(at)] |= np.uint64(1 << (lang % 64))

    def seal(self) -> None:
        for k in range(len(self.langs)):
            filled = np.count_nonzero(self.table[k // 64] & np.uint64(1 << (k % 64))) / self.table.shape[1]
            self.wrong[k] = filled**self.spec.probes

    def counts(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, corrected n-grams per language) of each document."""
        n = len(offs) - 1
        total, got = np.zeros(n), np.zeros((n, len(self.langs)))
        for h, first in grams(raw, offs, self.spec.sizes):
            at = self.places(h)
            total += np.diff(first)
            for plane in range(len(self.table)):
                masks = self.table[plane][at[0]]
                for x in at[1:]:
                    masks &= self.table[plane][x]
                for k in range(64 * plane, min(64 * plane + 64, len(self.langs))):
                    got[:, k] += C.per_doc_sum((masks >> np.uint64(k % 64)) & np.uint64(1) != 0, first)
        return total, np.maximum((got - total[:, None] * self.wrong) / (1 - np.minimum(self.wrong, 0.99)), 0)


def train(docs: DataFrame, spec: Spec = Spec()) -> Filters:
    """Filters from documents with a language that aren't held out. What reaches the driver is bounded by spec."""
    known = docs.select(F.col("doc_id").alias("i"), F.col("lang").cast("string").alias("l"), F.col("text").alias("x")).where("l is not null and x is not null").where(~C.held_out("i"))
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(spec.max_languages).collect()}
    if not counts:
        return Filters([], spec)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, spec.docs_per_language / n) * (1 << 30)))])
    least = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(spec.min_docs, n))])
    sample = known.where(F.pmod(F.xxhash64("i", "x"), F.lit(1 << 30)) < share[F.col("l")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in C.slices(batches, "x", max_rows=DOC_BITS + 1):
            raw, offs = C.text_buffer(pc.utf8_lower(part.column("x")))
            codes, names = pd_codes(part.column("l"))
            for h, first in grams(raw, offs, spec.sizes):
                doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
                keys = np.unique(h | doc)  # a gram once for each document
                lang = codes[(keys & np.uint64(DOC_BITS)).astype(np.int64)]
                for c, name in enumerate(names):
                    g, n = np.unique(keys[lang == c] & ~np.uint64(DOC_BITS), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["l", "g", "n"])

    got = sample.mapInArrow(run, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).where(F.col("n") >= least[F.col("l")]).toArrow()
    langs = sorted(counts)
    out = Filters(langs, spec)
    index = {name: k for k, name in enumerate(langs)}
    lang = np.array([index[x] for x in got.column("l").to_pylist()], np.int64)
    gram, n = np.asarray(got.column("g")).view(np.uint64), np.asarray(got.column("n")).astype(float)
    size = np.array([min(counts[x], spec.docs_per_language) for x in langs], float)
    rate = n / size[lang] if len(lang) else n
    uniq, inv = np.unique(gram, return_inverse=True)
    top = np.zeros(len(uniq))
    np.maximum.at(top, inv, rate)
    for k in range(len(langs)):
        out.add(k, gram[(lang == k) & (rate >= spec.ratio * top[inv])])
    out.seal()
    return out


def pd_codes(col: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Dictionary codes and values of a column."""
    d = col.dictionary_encode()
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    return np.asarray(d.indices), d.dictionary.to_pylist()


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter."""
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def predict(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",), column: str = "text") -> DataFrame:
    """The `keep` columns, lang_pred and score (share of the decided language in all languages' counts)."""
    keep = C.unclashing(keep, ("lang_pred", "score"))
    x = C.spare("text", keep)
    bc = docs.sparkSession.sparkContext.broadcast(filters)  # its size follows from bits and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = bc.value
        for part, _, _ in C.slices(batches, x):
            col = part.column(x)
            raw, offs = C.text_buffer(pc.utf8_lower(col))
            n = part.num_rows
            if f.langs:
                total, got = f.counts(raw, offs)
                best = got.argmax(1)
                score = np.clip(got[np.arange(n), best] / np.maximum(got.sum(1), 1e-9), 0, 1)
            else:
                best, score = np.zeros(n, np.int64), np.zeros(n)
            ok = np.array([bool(f.langs) and has_letter(t) for t in col.to_pylist()], bool)
            pred = [f.langs[b] if o else "und" for b, o in zip(best.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(np.where(ok, score, 0.0))], names=[*keep, "lang_pred", "score"])

    took = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias(x))
    return took.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).select("doc_id", C.held_out("doc_id").alias("held_out"), "lang_pred", "score")
