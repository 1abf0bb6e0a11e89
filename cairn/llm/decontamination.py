"""Benchmark decontamination with training suffix arrays.

Every slice of the corpus is a shard. A shard's suffix array holds, in word order, the suffixes that begin
with two words with which some test window begins (no other suffix can match a window of two words or
more). Each distinct test window is binary-searched in it, a word deeper at a time. So a place of the corpus
is found once for each length of a window, however many items hold it; items are looked up afterwards, once for
each set of windows. From the places that are found, the longest verbatim match with any test suffix is
binary-searched the other way round, in the suffix array of the test items.

Windows: `window` consecutive words of an item; an item of fewer words, but not none, is one window. Words are
compared as 64-bit hashes; those of hits are compared byte by byte too.

Null or wordless texts have no words, no hits and are never contaminated. Very long texts are a shard of
their own. Repeated documents are judged each on its own; items with equal text all count, items without an id
don't. Columns of documents pass through untouched, but not under the names of results, which stand. An
empty benchmark hits nothing, empty documents give no rows. The longest match is one with a window in it; of
equally long ones the first in the document is reported, with the item that is first by its id as a string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common as C

WINDOW = 13
#: Text bytes of test items that are shipped to the executors at once; a larger set goes in several blocks.
BLOCK_BYTES = 16 << 20


class TestBlock:
    """Word hashes of a block of test items, their suffix array, and their distinct windows with the items that hold them."""

    __test__ = False

    def __init__(self, ids: list[str], texts: pa.Array, window: int) -> None:
        raw, offs = C.text_buffer(texts)
        words = C.Words(raw, offs)
        self.ids, self.words = np.array(ids, object), words.hash
        self.vocabulary = {int(h): bytes(raw[a:b]).lower() for h, a, b in zip(words.hash.tolist(), words.start.tolist(), words.end.tolist(), strict=True)}
        count = np.diff(words.first)
        length = np.minimum(count, window)
        made = np.where(count > 0, count - length + 1, 0)
        item = np.repeat(np.arange(len(count)), made)
        first = np.concatenate([[0], np.cumsum(made)])
        at = np.arange(first[-1]) - first[:-1][item] + words.first[:-1][item]
        deep = length[item]
        self.end = np.repeat(words.first[1:], count)
        self.item = np.repeat(np.arange(len(count)), count)
        # distinct windows: a place, a length, and the items in [held_from, held_to) of held
        name = np.zeros(len(at), np.int64)
        for d in np.unique(deep).tolist():
            own = deep == d
            name[own] = self._names(at[own], d) * (window + 1) + d
        order = np.lexsort((item, name))
        new = np.ones(len(order), bool)
        new[1:] = name[order[1:]] != name[order[:-1]]
        one = np.ones(len(order), bool)
        one[1:] = new[1:] | (item[order[1:]] != item[order[:-1]])
        self.at, self.deep = at[order[new]], deep[order[new]]
        self.held = item[order[one]]
        self.held_from = np.flatnonzero(new[one])
        self.held_to = np.append(self.held_from[1:], len(self.held))
        self.sa = self._suffixes()
        self.sums, self.power, self.inverse = _sums(self.words)
        pad = np.concatenate([self.words, np.zeros(1, np.uint64)])
        long = self.deep >= 2
        self.pairs = np.unique(_pair(pad[self.at[long]], pad[self.at[long] + 1]))
        self.singles = np.unique(pad[self.at[~long]])

    def _names(self, at: np.ndarray, size: int) -> np.ndarray:
        """Numbers that are equal for places with the same `size` words."""
        out = np.zeros(len(at), np.int64)
        for d in range(size):
            _, word = np.unique(self.words[at + d], return_inverse=True)
            _, out = np.unique(out * (len(at) + 1) + word, return_inverse=True)
        return out

    def _suffixes(self) -> np.ndarray:
        """Places of all words in the order of the suffixes of their items, by prefix doubling."""
        n = len(self.words)
        _, rank = np.unique(self.words, return_inverse=True)
        rank, at, size = rank.astype(np.int64) + 1, np.arange(n), 1
        while n:
            next_ = at + size
            key = rank * (n + 2) + np.where(next_ < self.end, np.append(rank, 0)[np.minimum(next_, n)], 0)
            order = np.argsort(key, kind="stable")
            new = np.ones(n, bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank[order] = np.cumsum(new)
            size *= 2
            if new.all() or size > int((self.end - at).max()):
                return order
        return at

    def items_of(self, windows: np.ndarray) -> list[str]:
        """Ids, as sorted strings, of the items that hold any of the windows."""
        return sorted(self.ids[np.unique(np.concatenate([self.held[self.held_from[w] : self.held_to[w]] for w in windows.tolist()]))].tolist())


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    power, inverse = C._powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return total, power, inverse


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint64(0x9FB21C651E98DF25) + b


def _isin(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """values in sorted keys, by a bit table first and then exactly."""
    if not len(keys):
        return np.zeros(len(values), bool)
    bits = 22
    table = np.zeros(1 << bits, bool)
    table[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    out = table[(values >> np.uint64(64 - bits)).astype(np.int64)]
    some = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(keys, values[some]), len(keys) - 1)
    out[some] = keys[at] == values[some]
    return out


def suffix_array(w: np.ndarray, stop: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """starts, sorted by their first `depth` words, and those words as a (depth, n) table; 0 is past the end."""
    pad = np.concatenate([w, np.zeros(depth, np.uint64)])
    cols = np.empty((depth, len(starts)), np.uint64)
    for d in range(depth):
        cols[d] = np.where(starts + d < stop, pad[starts + d], np.uint64(0))
    order = np.lexsort(cols[::-1])
    return starts[order], cols[:, order]


def _bound(col: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, right: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while True:
        act = np.flatnonzero(lo < hi)
        if not len(act):
            return lo
        mid = (lo[act] + hi[act]) >> 1
        less = col[mid] <= key[act] if right else col[mid] < key[act]
        lo[act] = np.where(less, mid + 1, lo[act])
        hi[act] = np.where(less, hi[act], mid)


def search(block: TestBlock, w: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word position in the shard, index of the test window) of every occurrence of a window."""
    n = len(w)
    if not n or not len(block.at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop_of = np.repeat(first[1:], np.diff(first))
    pad = np.concatenate([w, np.zeros(1, np.uint64)])
    starts = np.flatnonzero(_isin(_pair(w, pad[1:]), block.pairs) | (_isin(w, block.singles) if len(block.singles) else False))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sa, cols = suffix_array(w, stop_of[starts], starts, window)
    act = np.arange(len(block.at))
    lo, hi = np.zeros(len(act), np.int64), np.full(len(act), len(sa), np.int64)
    found_p, found_t = [], []
    for d in range(window):
        key = block.words[block.at[act] + d]
        lo, hi = _bound(cols[d], lo, hi, key, False), _bound(cols[d], lo, hi, key, True)
        on = lo < hi
        act, lo, hi = act[on], lo[on], hi[on]
        done = block.deep[act] == d + 1
        if done.any():
            reach = (hi - lo)[done]
            base = np.concatenate([[0], np.cumsum(reach)])
            at = np.arange(base[-1]) - np.repeat(base[:-1], reach) + np.repeat(lo[done], reach)
            found_p.append(sa[at])
            found_t.append(np.repeat(act[done], reach))
            act, lo, hi = act[~done], lo[~done], hi[~done]
        if not len(act):
            break
    if not found_p:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_p), np.concatenate(found_t)


def longest(block: TestBlock, w: np.ndarray, stop: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of the longest match of each place with any test suffix, the least place of the test items with it); places are hit."""
    if not len(p):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums, _, inverse = _sums(w)
    pad, tpad = np.append(w, np.uint64(0)), np.append(block.words, np.uint64(0))
    most_p = stop - p

    def same(t: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether `size` words from p and from t on are equal, within the document and the item."""
        ok = (size <= most_p) & (size <= block.end[t] - t)
        a, b = np.where(ok, size, 0) + p, np.where(ok, size, 0) + t
        return ok & ((sums[a] - sums[p]) * inverse[p] == (block.sums[b] - block.sums[t]) * block.inverse[t])

    def common(t: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        step = 1 << max(1, int(most_p.max(initial=1)).bit_length())
        while step:
            out += step * same(t, out + step)
            step >>= 1
        return out

    sa, n = block.sa, len(block.sa)
    lo, hi = np.zeros(len(p), np.int64), np.full(len(p), n, np.int64)  # where the place's suffix would stand
    while (lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, n - 1)
        t = sa[mid]
        size = common(t)
        a = np.where(size < most_p, pad[np.minimum(p + size, len(w))], np.uint64(0))
        b = np.where(size < block.end[t] - t, tpad[np.minimum(t + size, len(block.words))], np.uint64(0))
        less, act = b < a, lo < hi
        lo, hi = np.where(act & less, mid + 1, lo), np.where(act & ~less, mid, hi)
    best = np.zeros(len(p), np.int64)
    for k in (np.maximum(lo - 1, 0), np.minimum(lo, n - 1)):
        best = np.maximum(best, common(sa[k]))
    # all with so many words are neighbours: their first and last place in the suffix array
    left, right = np.zeros(len(p), np.int64), lo.copy()
    while (left < right).any():
        mid = (left + right) >> 1
        on, act = same(sa[np.minimum(mid, n - 1)], best), left < right
        left, right = np.where(act & ~on, mid + 1, left), np.where(act & on, mid, right)
    a, left, right = left, lo.copy(), np.full(len(p), n, np.int64)
    while (left < right).any():
        mid = (left + right) >> 1
        on, act = same(sa[np.minimum(mid, n - 1)], best), left < right
        left, right = np.where(act & on, mid + 1, left), np.where(act & ~on, mid, right)
    return best, np.array([sa[x:y].min(initial=n) for x, y in zip(a.tolist(), left.tolist(), strict=True)], np.int64)


_STATE = [("runs", T.ArrayType(T.LongType())), ("items", T.ArrayType(T.StringType())), ("best", T.ArrayType(T.LongType())), ("best_item", T.StringType())]
REPORT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    T.StructField("longest_words", T.LongType()), T.StructField("longest_at_word", T.LongType()), T.StructField("longest_item", T.StringType()),
])


def _hits(block: TestBlock, words: C.Words, raw: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, places, their windows, whether a word is hit). Words that only share a hash with one of a window get the hash 0."""
    w = words.hash
    while True:
        p, t = search(block, w, words.first, window)
        cover = np.zeros(len(w) + 1, np.int64)
        np.add.at(cover, p, 1)
        np.add.at(cover, p + block.deep[t], -1)
        hit = np.cumsum(cover)[: len(w)] > 0
        other = [k for k in np.flatnonzero(hit).tolist() if bytes(C.LOWER[raw[words.start[k] : words.end[k]]]) != block.vocabulary[int(w[k])]]
        if not other:
            return w, p, t, hit
        w = w.copy()
        w[other] = 0


def _scan(block_of, window: int, column: str, out: list[str], keep_clean: bool, state: list[str], state_in: bool, last: bool, share: int):
    """mapInArrow function; state (runs, items, longest, in columns of these names) is carried over further blocks of test items."""
    arrow_state = dict(zip(state, (pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string()), strict=True))
    s_runs, s_items, s_best, s_best_item = state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_of.value
        for part, raw, offs in C.slices(batches, column):
            words = C.Words(raw, offs)
            first, n = words.first, part.num_rows
            w, p, t, hit = _hits(block, words, raw, window)
            doc = np.searchsorted(first, p, "right") - 1
            got = np.unique(np.stack([doc, t]), axis=1) if len(p) else np.zeros((2, 0), np.int64)
            items: dict[int, list[str]] = {}
            known: dict[bytes, list[str]] = {}
            own, cut = np.unique(got[0], return_index=True)
            for d, ts in zip(own.tolist(), np.split(got[1], cut[1:]), strict=True) if len(own) else ():
                key = ts.tobytes()
                if key not in known:
                    known[key] = block.items_of(ts)
                items[d] = known[key]
            best: dict[int, tuple[int, int, str]] = {}
            if len(p) and not keep_clean:
                whole = block.deep[t] < window  # windows that are whole items can't be longer
                places = np.unique(p[~whole])
                size, where = longest(block, w, first[1:][np.searchsorted(first, places, "right") - 1], places)
                places, size = np.append(places, p[whole]), np.append(size, block.deep[t[whole]])
                who = np.append(block.item[where], block.held[block.held_from[t[whole]]])
                of = np.searchsorted(first, places, "right") - 1
                order = np.lexsort((who, places, -size, of))
                for k in order[np.unique(of[order], return_index=True)[1]].tolist():
                    best[int(of[k])] = (int(size[k]), int(places[k] - first[of[k]]), block.ids[who[k]])
            if state_in:
                old = {k: part.column(k).to_pylist() for k in arrow_state}
                for d in range(n):
                    for a, b in zip(old[s_runs][d][::2], old[s_runs][d][1::2], strict=True):
                        hit[first[d] + a : first[d] + b] = True
                    if old[s_items][d]:
                        items[d] = [*items.get(d, []), *old[s_items][d]]
                    if old[s_best][d]:
                        before = (*old[s_best][d], old[s_best_item][d])
                        best[d] = min(before, best.get(d, before), key=lambda x: (-x[0], x[1], x[2]))
            cols = {f: part.column(f) for f in part.schema.names if f not in arrow_state}
            if not last:
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                up, down = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                runs: list[list[int]] = [[] for _ in range(n)]
                for a, b in zip(up.tolist(), down.tolist(), strict=True):
                    d = int(np.searchsorted(first, a, "right")) - 1
                    while a < b:  # a run may go over the edge of two documents
                        e = min(b, int(first[d + 1]))
                        if e > a:
                            runs[d] += [a - int(first[d]), e - int(first[d])]
                        a, d = max(a, e), d + 1
                cols |= {
                    s_runs: pa.array(runs, arrow_state[s_runs]), s_items: pa.array([items.get(d, []) for d in range(n)], arrow_state[s_items]),
                    s_best: pa.array([list(best[d][:2]) if d in best else [] for d in range(n)], arrow_state[s_best]),
                    s_best_item: pa.array([best[d][2] if d in best else None for d in range(n)], pa.string()),
                }
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
                continue
            n_words, n_hit = np.diff(first), C.per_doc_sum(hit, first)
            bad = (n_hit > 0) & (share * n_hit >= n_words)
            if keep_clean:
                yield part.select(out).filter(pa.array(~bad))
                continue
            names = [sorted(items.get(d, [])) for d in range(n)]
            cols = {f: part.column(f) for f in out} | {
                "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array(list(map(len, names)), pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), "contaminated": pa.array(bad),
                "longest_words": pa.array([best[d][0] if d in best else 0 for d in range(n)], pa.int64()),
                "longest_at_word": pa.array([best[d][1] if d in best else None for d in range(n)], pa.int64()),
                "longest_item": pa.array([best[d][2] if d in best else None for d in range(n)], pa.string()),
            }
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def _blocks(spark: SparkSession, bench: DataFrame, window: int, block_bytes: int):
    """Broadcast blocks of test items; each is collected on its own and holds about block_bytes of text."""
    items = bench.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("x"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).where("i is not null").toArrow().sort_by("i")
        yield spark.sparkContext.broadcast(TestBlock(own.column("i").to_pylist(), own.column("x"), window))


def _apply(docs: DataFrame, bench: DataFrame, out: list[str], keep_clean: bool, column: str, window: int, share: int, block_bytes: int) -> DataFrame:
    blocks = list(_blocks(docs.sparkSession, bench, window, block_bytes))
    need = list(dict.fromkeys([*out, column]))
    now = docs.select(*[F.col(f"`{c}`") for c in need])
    state = [C.spare(f"state_{name}", need) for name, _ in _STATE]
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        fields = [now.schema[c] for c in need] + [T.StructField(c, kind) for c, (_, kind) in zip(state, _STATE, strict=True)] if not last else [docs.schema[c] for c in out] + ([] if keep_clean else list(REPORT))
        now = now.mapInArrow(_scan(block, window, column, out, keep_clean, state, k > 0, last, share), T.StructType(fields))
    return now


def contamination(docs: DataFrame, bench: DataFrame, keep: tuple[str, ...] = ("doc_id",), column: str = "text", window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: the `keep` columns and REPORT. Contaminated: some word is hit and share * n_hit >= n_words."""
    return _apply(docs, bench, list(C.unclashing(keep, REPORT.names)), False, column, window, share, block_bytes)


def decontaminate(docs: DataFrame, bench: DataFrame, column: str = "text", window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated ones, all columns kept."""
    return _apply(docs, bench, docs.columns, True, column, window, share, block_bytes)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
