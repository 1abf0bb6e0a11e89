"""Secret scans: base patterns and a linear-chain conditional random field.

Base patterns find assigned values, access keys and long hexadecimal runs. The field adds spans: it tags
tokens (runs of letters and digits, or single marks) as begin, inside or outside of a secret, from their
shape, the neighbouring words and features of the whole text. Every token of a text is scored, any may begin
a secret, and what the best path tags is a span, whatever its length or alphabet. Its weights are learnt by
maximum likelihood on the driver from a bounded sample of documents (`Spec.max_docs`): windows as they are,
labelled by the base patterns, and windows into which values were planted. Planted values are labelled by what
they are, not by the base patterns: random ones in many alphabets, lengths and groupings are secrets wherever
they stand, short or plain ones only if a word of CUES is assigned them; addresses, dates, names, numbers and
code are none. A tagged span holds no white space.

The best path is found without Viterbi over all tokens: `Field.path` bounds what tagging could gain from each
token on, and decodes only the stretches where that is not below what leaving them outside gives. The texts of a
slice are scored and bounded together; between them lie tokens that no secret crosses.

Null texts are empty and have no spans. Offsets count code points. Very long texts are scanned whole. Repeated
rows are scanned each on its own; an empty table gives no rows. Base spans stay as they are; a tagged span that
meets one is dropped. Extra columns pass through, but not under the names of results, which stand.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common as C

# Fixed by the contract: the base patterns and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "tagged")

#: Runs that are no shorter than hex secrets; cheaper to search for than every run.
_HEX24 = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_ACCESS20 = re.compile(r"AKIA[A-Z0-9]+")
_CUE = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{8,}")
_WORD = re.compile(r"[A-Za-z]+")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
#: Words that go before secrets.
CUES = frozenset("password passwd pwd pass secret secrets token tokens api apikey key keys auth authorization bearer access credential credentials private client signature sig session cookie".split())
#: Characters on either side of what a training window is about, and the most that a window holds.
REACH, WIDEST = 48, 800
#: Distinct words (between white space) and their tokens that a task keeps, and the longest one kept.
_CACHE, _KEPT = 200_000, 64
#: Tokens between texts, and how little they are worth as part of a secret.
_GAP, _BAR = 7, -1e4
QUOTES = "\"'`"
OUT, BEGIN, INSIDE = 0, 1, 2


@dataclass(frozen=True)
class Spec:
    """max_docs bounds the sample of documents learnt from, max_hits its windows about secrets, max_windows those without.

    A window about a secret makes four chains, one without makes three, and all are learnt from, so the two bounds
    hold on their own: however many secrets a corpus has, no window without one gives way.
    """

    max_docs: int = 20_000
    max_windows: int = 1_500
    max_hits: int = 400
    steps: int = 250
    batch: int = 800
    l2: float = 0.002


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, in the order of start, then kind."""
    out = []
    if _CUE.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", m.start(), m.end()) for m in _HEX24.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def windows(text: str, spans: list[tuple[int, int]]) -> list[tuple[bool, int, int]]:
    """Ranges to learn from: (whether it is about one of spans, start, end).

    About each span, and without any: about runs of letters and digits, words of CUES, and one place of the text.
    """

    def about(x: int, y: int) -> tuple[int, int]:
        y = min(y, x + WIDEST - 4 * REACH)
        a, b = max(0, x - REACH), min(len(text), y + REACH)
        while a > 0 and not text[a - 1].isspace() and x - a < 2 * REACH:
            a -= 1
        while b < len(text) and not text[b].isspace() and b - y < 2 * REACH:
            b += 1
        return a, b

    out = [(True, *about(x, y)) for x, y in spans]
    at = zlib.crc32(text.encode("utf-8", "replace")) % max(len(text), 1)
    near = [m.span() for m in _CANDIDATE.finditer(text)] + [m.span() for m in _WORD.finditer(text) if m[0].lower() in CUES] + [(at, at)]
    starts, ends, last = [x for x, _ in sorted(spans)], list(accumulate((y for _, y in sorted(spans)), max)), -1
    for x, y in sorted(near):
        a, b = about(x, y)
        k = bisect.bisect_left(starts, b)
        if a >= last and b > a and (k == 0 or ends[k - 1] <= a):
            out.append((False, a, b))
            last = b
    return out


_MARKS = frozenset("=:\"'`,.;/+-_@()[]{}<>#|&%$*!?\\~^")


def _looks(t: str) -> tuple:
    """What is seen of a token: its mark, or its length and characters, and more of those with letters and digits."""
    if not (t.isascii() and t.isalnum()):
        return (t if t in _MARKS else "other",)
    n = len(t)
    if t.isalpha():
        return "l" if t.islower() else "u" if t.isupper() else "ul", min(n.bit_length(), 7), min(n // 8, 5)
    if t.isdigit():
        return "d", min(n.bit_length(), 7), min(n // 8, 5)
    kinds = "d" + ("u" if not t.islower() else "") + ("l" if not t.isupper() else "")
    if n < 8:
        return kinds, min(n.bit_length(), 7), 0
    count = [t.count(c) for c in set(t)]
    digits = sum(map(t.count, "0123456789"))
    entropy = -sum(c / n * math.log2(c / n) for c in count)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(t, t[1:]))
    return kinds, min(n.bit_length(), 7), min(n // 8, 5), min(4, 8 * turns // n), 8 * len(count) // n, 4 * digits // n, int(entropy), bool(_HEXED.fullmatch(t))


_HEXED = re.compile(r"[0-9a-f]+|[0-9A-F]+")


@lru_cache(20_000)
def _shape(looks: tuple) -> tuple[str, ...]:
    """Names of the features of what is seen of a token; the first is what neighbours see, the second its kind."""
    if len(looks) == 1:
        return f"mark={looks[0]}", f"mark={looks[0]}"
    kinds, size, eighths, *more = looks
    names = [f"len={size}", f"kinds={kinds}", f"long={kinds}{eighths}"]
    if more:
        turns, distinct, digits, entropy, hexed = more
        names += [f"turns={turns}", f"distinct={distinct}", f"digits={digits}", f"entropy={entropy}", *(["hex"] if hexed else [])]
    return tuple(map(sys.intern, names))


def file_features(text: str) -> list[str]:
    """Features of the whole text."""
    n = max(len(text), 1)
    marks = sum(map(text.count, "={}();_"))
    return [f"file_marks={min(4, int(math.log2(1 + 1000 * marks / n)) // 2)}", f"file_long={min(6, len(text).bit_length() // 3)}"]


def _strong(t: str) -> bool:
    """Whether a token is long and of mixed characters."""
    return len(t) >= 16 and t.isascii() and t.isalnum() and not t.isalpha() and not t.isdigit()


def features(tokens: list[str], spaces: list[bool], of_file: list[str]) -> list[list[str]]:
    """Names of the features of each token: its shape, its neighbours' words and shapes, the file's."""
    low = [t.lower() for t in tokens]
    shapes = [_shape(_looks(t)) for t in tokens]
    run = list(accumulate(map(int, spaces)))
    strong = {r for r, t in zip(run, tokens, strict=True) if _strong(t)}
    given: list[bool | None] = []  # whether a cue is assigned the token; None if it isn't assigned to anything
    for k in range(len(tokens)):
        j = k - 1
        j -= j >= 0 and tokens[j] in QUOTES
        if j >= 0 and tokens[j] in "=:":
            j -= 1
            j -= j >= 0 and tokens[j] in QUOTES
            given.append(j >= 0 and low[j] in CUES)
        else:
            given.append(None)
    named = {r for r, g in zip(run, given, strict=True) if g}
    out = []
    for k in range(len(tokens)):
        f = ["bias", *shapes[k][: 1 if len(shapes[k]) == 2 else None], *of_file, sys.intern(f"space={spaces[k]}"), sys.intern(f"run={run[k] in strong}"), sys.intern(f"named={run[k] in named}")]
        cue = next((d for d in range(1, 7) if k - d >= 0 and low[k - d] in CUES), 0)
        f.append(sys.intern(f"cue={cue}"))
        for d in _NEAR:
            j = k + d
            f.append(sys.intern(f"{d}:{shapes[j][0]}" if 0 <= j < len(tokens) else f"{d}:edge"))
        if low[k] in CUES:
            f.append("is_cue")
        if given[k] is not None:
            f.append(f"assigned={given[k]}")
        if given[k]:
            f.append(sys.intern(f"given:{shapes[k][1]}"))
        out.append(f)
    return out


#: Neighbours whose shapes count.
_NEAR = (-2, -1, 1, 2)
_LONGEST_CUE = max(map(len, CUES))


class Field:
    """Weights: emission (features, 3), transition (3, 3), first (3,)."""

    def __init__(self, names: list[str], emission: np.ndarray, transition: np.ndarray, first: np.ndarray) -> None:
        self.index = {n: k for k, n in enumerate(names)}
        self.emission, self.transition, self.first = emission, transition, first
        # kinds of tokens: what one adds to its own score and to those around it; whether it is a cue, a mark, a quote, strong
        self._kinds: dict[tuple, int] = {}
        self._rows = [np.concatenate([[0, _BAR, _BAR], *(self.weight(f"{d}:edge") for d in _NEAR), np.zeros(3 + 4)])]
        self._table = np.array(self._rows)
        self._forget()

    def _forget(self) -> None:
        self._words: dict[str, int] = {}
        self._flat, self._ends = [0] * _GAP, [0, _GAP]  # word 0 lies between texts

    def weight(self, *names: str) -> np.ndarray:
        return self.emission[[k for k in map(self.index.get, names) if k is not None]].sum(0)

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        return np.array([self.weight(*f) for f in feats]).reshape(-1, 3)

    def _kind(self, t: str) -> int:
        looks, cue = _looks(t), len(t) <= _LONGEST_CUE and t.lower() in CUES
        k = self._kinds.get((looks, cue))
        if k is None:
            shape = _shape(looks)
            own = self.weight("bias", *(shape if len(looks) > 1 else shape[:1]), *(["is_cue"] if cue else []))
            k = self._kinds[looks, cue] = len(self._rows)
            flags = cue, looks[0] in ("=", ":") and len(looks) == 1, looks[0] in tuple(QUOTES) and len(looks) == 1, _strong(t)
            self._rows.append(np.concatenate([own, *(self.weight(f"{d}:{shape[0]}") for d in _NEAR), self.weight(f"given:{shape[1]}"), flags]))
        return k

    def _word(self, w: str) -> int:
        k = len(self._ends) - 1
        self._flat += map(self._kind, _TOKEN.findall(w))
        self._ends.append(len(self._flat))
        if len(w) <= _KEPT:
            self._words[w] = k
        return k

    def emissions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores(features(...)) of the texts' tokens, with _GAP tokens around each text; where each text's begin and end)."""
        if len(self._words) > _CACHE or len(self._flat) > 8 * _CACHE:
            self._forget()
        known, new = self._words, self._word
        ids, count = [0], []
        for text in texts:
            words = text.split()
            count.append(len(words))
            ids += [known[w] if w in known else new(w) for w in words]
            ids.append(0)
        if len(self._table) < len(self._rows):
            self._table = np.array(self._rows)
        ids, ends, flat = np.array(ids, np.int64), np.array(self._ends, np.int64), np.array(self._flat, np.int64)
        size = ends[ids + 1] - ends[ids]
        after = np.cumsum(size)
        begin = after - size
        kind = flat[np.arange(after[-1]) + np.repeat(ends[ids] - begin, size)]
        rows, n = self._table, len(kind)
        gaps = np.cumsum(np.array([0, *count]) + 1) - 1  # places of the words between texts
        starts, stops = after[gaps[:-1]], begin[gaps[1:]]
        cue, mark, quote, strong = (rows[:, -4:] > 0)[kind].T
        at = np.arange(n)
        last = np.maximum.accumulate(np.where(cue, at, -7))
        far = at - np.append(-7, last[:-1])
        far[far > 6] = 0
        out = rows[kind, :3]
        out += np.array([self.weight(f"cue={d}") for d in range(7)])[far]
        first = np.zeros(n, np.int64)
        first[begin[size > 0]] = 1
        out += np.array([self.weight("space=False"), self.weight("space=True")])[first]
        runs = begin[size > 0]
        held = np.logical_or.reduceat(strong, runs)
        out += np.array([self.weight("run=False"), self.weight("run=True")])[np.repeat(held, np.diff(np.append(runs, n))).astype(np.int64)]
        for lo, d in enumerate(_NEAR, 1):
            near = rows[:, 3 * lo : 3 * lo + 3][kind]
            if d < 0:
                out[-d:] += near[:d]
            else:
                out[:-d] += near[d:]
        j = at - 1
        j -= quote[j]
        given = mark[j]
        j -= 1
        j -= quote[j]
        named = given & cue[j]
        out += np.where(given[:, None], np.array([self.weight("assigned=False"), self.weight("assigned=True")])[named.astype(np.int64)], 0)
        out[named] += rows[:, -7:-4][kind[named]]
        held = np.logical_or.reduceat(named, runs)
        out += np.array([self.weight("named=False"), self.weight("named=True")])[np.repeat(held, np.diff(np.append(runs, n))).astype(np.int64)]
        of = np.array([self.weight(*file_features(t)) for t in texts]).reshape(-1, 3)
        out += np.repeat(of, np.diff(np.append(starts - _GAP, n)), 0) if len(texts) else 0
        out[kind == 0] = 0, _BAR, _BAR
        # a text begins with `first`, not with a step from outside
        some = starts[starts < stops]
        out[some, BEGIN] += self.first[BEGIN] - self.first[OUT] - self.transition[OUT, BEGIN] + self.transition[OUT, OUT]
        return out, starts, stops

    def paths(self, texts: list[str]) -> list[np.ndarray]:
        """A best path of states of each text's tokens."""
        out, starts, stops = self.emissions(texts)
        path = self.path(out)
        return [path[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]

    def path(self, emit: np.ndarray) -> np.ndarray:
        """A best path of states over a whole text.

        Scores are taken relative to outside throughout. A token of a tagged run adds no more than `most`; `rest`
        is the best sum of these from a token on. In a best path no end of a run may be better left outside, so
        rest is at least `bar` all over it, and what its first token can gain is not below 0. Stretches
        where that holds are apart from each other by tokens outside, so each is decoded on its own.
        """
        n, tr = len(emit), self.transition - self.transition[OUT, OUT]
        begin, inside = emit[:, BEGIN] - emit[:, OUT], emit[:, INSIDE] - emit[:, OUT]
        first = begin + tr[OUT, BEGIN]
        first[0] = begin[0] + self.first[BEGIN] - self.first[OUT]
        most = np.maximum(np.maximum(first, begin + tr[:, BEGIN].max()), inside + tr[BEGIN:, INSIDE].max())
        after = np.append(np.cumsum(most[::-1])[::-1], 0.0)
        least = np.minimum.accumulate(after[::-1])[::-1]
        rest = after[:-1] - least[1:]
        leave = max(tr[BEGIN, OUT], tr[INSIDE, OUT], 0.0)
        bar = min(0.0, tr[BEGIN, OUT], tr[INSIDE, OUT]) - leave - 1e-6
        may = first + np.maximum(np.append(rest[1:], 0.0), 0) + leave >= -1e-6
        out = np.zeros(n, np.int64)
        live = rest >= bar
        if not (live & may).any():
            return out
        turn = np.flatnonzero(np.diff(live.astype(np.int8), prepend=0, append=0))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            starts = np.flatnonzero(may[a:b])
            if len(starts):
                a += int(starts[0])
                out[a:b] = self.decode(emit[a:b], None if a == 0 else self.transition[OUT], None if b == n else self.transition[:, OUT])
        return out

    def decode(self, emit: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> list[int]:
        """Viterbi: the best path of states; inside follows only begin or inside. before and after: scores of entering and of leaving."""
        n = len(emit)
        best, back = (self.first if before is None else before) + emit[0], np.zeros((n, 3), np.int64)
        best[INSIDE] = -1e9
        for k in range(1, n):
            cand = best[:, None] + self.transition
            back[k] = cand.argmax(0)
            best = cand.max(0) + emit[k]
        path = [int((best if after is None else best + after).argmax())]
        for k in range(n - 1, 0, -1):
            path.append(int(back[k, path[-1]]))
        return path[::-1]


def _tokens(text: str) -> tuple[list[str], list[int], list[bool]]:
    """(tokens, where each begins, whether it is the first or has white space before it)."""
    found = [(m[0], m.start()) for m in _TOKEN.finditer(text)]
    return [t for t, _ in found], [a for _, a in found], [not k or a > found[k - 1][1] + len(found[k - 1][0]) for k, (_, a) in enumerate(found)]


def _group(chains: list, index: dict[str, int]) -> dict:
    """Arrays of some chains: places of their features, tokens and labels."""
    size = np.array([len(y) for _, y in chains])
    total, gold = int(size.sum()), np.array([v for _, y in chains for v in y])
    pos = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    seen, inner = np.zeros((3, 3)), np.flatnonzero(pos > 0)
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    return {
        "size": size, "gold": np.eye(3)[gold], "seen": seen, "place": (np.repeat(np.arange(len(chains)), size), pos),
        "rows": np.repeat(np.arange(total), [len(f) for feats, _ in chains for f in feats]), "cols": np.array([index[n] for feats, _ in chains for f in feats for n in f]),
    }


def _gradients(group: dict, w: np.ndarray, move: np.ndarray, start: np.ndarray, gw: np.ndarray, gt: np.ndarray) -> None:
    """Add the gradients of the chains' negative log likelihood, by scaled forward and backward passes over all of them at once."""
    size, place, rows, cols = group["size"], group["place"], group["rows"], group["cols"]
    width, total = int(size.max()), int(size.sum())
    real = np.arange(width)[None] < size[:, None]
    emit = np.zeros((len(size), width, 3))
    emit[place] = np.column_stack([np.bincount(rows, w[cols, s], total) for s in range(3)])
    near = np.exp(emit - emit.max(2, keepdims=True))
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    alpha[:, 0] = near[:, 0] * np.exp(start)
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for k in range(1, width):  # scaled at each step, so that no logarithms are needed
        x = alpha[:, k - 1] @ move * near[:, k]
        alpha[:, k] = np.where(real[:, k, None], x / x.sum(1, keepdims=True), alpha[:, k - 1])
    for k in range(width - 2, -1, -1):
        x = (near[:, k + 1] * beta[:, k + 1]) @ move.T
        beta[:, k] = np.where(real[:, k + 1, None], x / x.sum(1, keepdims=True), 1)
    q = alpha * beta
    err = (q / q.sum(2, keepdims=True))[place] - group["gold"]
    gw += np.column_stack([np.bincount(cols, err[rows, s], len(w)) for s in range(3)])
    pair = alpha[:, :-1, :, None] * move * (near[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    pair[~real[:, 1:]] = 0
    gt += pair.sum((0, 1)) - group["seen"]


def fit(chains: list[tuple[list[list[str]], list[int]]], spec: Spec) -> Field:
    """Maximum likelihood with Adam over batches of about spec.batch chains."""
    names = sorted({n for feats, _ in chains for f in feats for n in f})
    index = {n: k for k, n in enumerate(names)}
    free = np.zeros((3, 3))
    free[OUT, INSIDE] = -1e9
    start = np.array([0.0, 0.0, -1e9])
    if not chains:
        return Field(["bias"], np.array([[10.0, 0, 0]]), free, start)
    chains = sorted(chains, key=lambda c: len(c[1]))  # groups are of like lengths, so that little is padding
    nf = len(names)
    w, tr = np.zeros((nf, 3)), np.zeros((3, 3))
    groups = [_group(chains[k : k + 128], index) for k in range(0, len(chains), 128)]
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    order = np.random.default_rng(3)
    turn: list[int] = []
    for step in range(1, spec.steps + 1):
        gw, gt, n = np.zeros_like(w), np.zeros_like(tr), 0
        move = np.exp(tr + free)
        while n < spec.batch and (n == 0 or n < len(chains)):
            turn = turn or order.permutation(len(groups)).tolist()
            group = groups[turn.pop()]
            _gradients(group, w, move, start, gw, gt)
            n += len(group["size"])
        gw, gt = gw / n + spec.l2 * w / 10, gt / n + spec.l2 * tr / 10
        rate = 0.2 * (1 - step / (spec.steps + 1)) + 0.01
        for x, g, m, v in ((w, gw, state[0], state[1]), (tr, gt, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    if "space=True" in index:
        w[index["space=True"], INSIDE] = _BAR  # a secret has no white space in it
    return Field(names, w, tr + free, start)


_BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_PARTS = "ba con der el fi gor hu in jo ka lem mi nor ou pra qui ros ste tu val wen yor ze".split()
#: Names that are not CUES, and what stands between a name and its value.
_PLAIN = "value id name page count order version size date room title number line total user host color type".split()
_ASSIGNED = (" = ", "=", ": ", ' = "', '="', ': "', ":")


def _make(rng: random.Random, abc: str, n: int) -> str:
    return "".join(rng.choice(abc) for _ in range(n))


def _random(rng: random.Random) -> str:
    """Random values, which are secrets wherever they stand."""
    abc, n = _BASE62, rng.randint
    part = lambda m: "".join(rng.choice(_PARTS) for _ in range(m))
    return rng.choice([
        _make(rng, abc, n(20, 64)), _make(rng, abc, n(20, 44)), _make(rng, abc[26:], n(20, 48)), _make(rng, abc[:26] + abc[52:], n(20, 40)), _make(rng, "0123456789ABCDEF", rng.choice([24, 32, 40, 64])),
        f"{part(1)}_{_make(rng, abc, n(18, 40))}", f"{part(1)}_{part(1)}_{_make(rng, abc, n(18, 40))}", f"{part(1)}-{_make(rng, abc, n(18, 40))}", f"{part(1)}-{n(100, 99999)}-{_make(rng, abc, n(18, 32))}",
        f"{_make(rng, abc, n(12, 30))}.{_make(rng, abc, n(18, 40))}", f"{_make(rng, abc, n(12, 30))}.{_make(rng, abc + '-_', n(18, 40))}.{_make(rng, abc + '-_', n(18, 40))}",
        _make(rng, abc + "+/", n(32, 64)) + "=" * n(0, 2), _make(rng, abc + "+/", n(32, 64)) + "=" * n(0, 2),
    ])


def _weak(rng: random.Random) -> str:
    """Values that only their name makes secrets: short, of letters or digits only, in words or in groups."""
    abc, n = _BASE62, rng.randint
    word = lambda: "".join(rng.choice(_PARTS) for _ in range(rng.randint(1, 3)))
    return rng.choice([
        _make(rng, abc, n(6, 14)), _make(rng, abc[26:], n(6, 14)), word() + str(n(0, 9999)), _make(rng, abc[:52], n(6, 24)), _make(rng, abc[26:52], n(6, 24)), "".join(word() for _ in range(n(1, 4))), word(),
        _make(rng, abc[52:], n(4, 18)), rng.choice("-_.").join(word() for _ in range(n(2, 5))), "-".join(_make(rng, abc, n(3, 4)) for _ in range(n(3, 5))), "-".join(_make(rng, abc[:26] + abc[52:], n(4, 6)) for _ in range(n(2, 5))),
        "-".join(_make(rng, abc[52:] + "abcdef", k) for k in (8, 4, 4, 4, 12)), _make(rng, abc + "!@#$%&*", n(8, 16)),
    ])


def _clean(rng: random.Random) -> str:
    """Addresses, dates, names, numbers and code, which are no secrets."""
    word = lambda: "".join(rng.choice(_PARTS) for _ in range(rng.randint(1, 3)))
    n = lambda m: str(rng.randint(1, m))
    return rng.choice([
        f"http{rng.choice(['', 's'])}://{word()}.{word()}.{rng.choice(['com', 'org', 'net'])}/{word()}/{n(99999)}?{word()}_{word()}={word()}&{word()}={n(999)}", f"www.{word()}{n(99)}.com/{word()}-{word()}-{word()}.html#{word()}", f"{word()}.{word()}{n(99)}@{word()}{n(9)}.{word()}.org",
        f"20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}", f"+{n(99)} {n(999)}-{n(9999)}-{n(9999)}", f"/{word()}/{word()}{n(9)}/{word()}_{n(9999)}.txt", f"v{n(9)}.{n(20)}.{n(99)}-{word()}{n(9)}", f"{rng.choice(['v', ''])}{n(20)}.{n(20)}.{n(99)}", f"https://{rng.choice(_BASE62)}.{word()}.org/{word()}/{n(99999)}?id={n(99)}", f"{word()}_{word()} = {word()}({word()}[{n(99)}], {word()}={n(999)})",
        "".join(word().title() for _ in range(rng.randint(2, 5))) + rng.choice(["", n(99)]), "_".join(word() for _ in range(rng.randint(2, 6))) + rng.choice(["", "_" + n(9999)]), "".join(word() for _ in range(rng.randint(3, 6))), _make(rng, _BASE62[52:], rng.randint(8, 20)), f"{word()}{n(9)}{word()}{n(99)}",
        "-".join(_make(rng, _BASE62[52:] + "abcdef", k) for k in (8, 4, 4, 4, 12)), f"{word()} {rng.choice(sorted(CUES))} {word()} {word()}", f"{rng.choice(sorted(CUES))} {rng.choice(['of', 'is', 'and', 'the'])} {word()}", f"{word()}: {rng.choice(sorted(CUES))}, {word()}",
    ])


def chain(text: str, secret: list[tuple[int, int]], of_file: list[str]) -> tuple[list[list[str]], list[int]]:
    """The features and labels of a text's tokens; those within one of `secret` are of a secret."""
    tokens, at, spaces = _tokens(text)
    y, last = [], None
    for t, p in zip(tokens, at, strict=True):
        own = next((x for x in secret if x[0] <= p and p + len(t) <= x[1]), None)
        y.append(OUT if own is None else INSIDE if own == last else BEGIN)
        last = own
    return features(tokens, spaces, of_file), y


def planted(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """(a made piece of text, where its secret lies, if it has one)."""
    cue, name, given = rng.choice(sorted(CUES)), rng.choice(_PLAIN), rng.choice(_ASSIGNED)
    kind = rng.random()
    before, value, secret = (
        (rng.choice(["", "", f"{name} ", f"{name}{given}", f"{cue} ", f"{cue}{given}", f"{cue.title()}: {rng.choice(['Bearer', 'Basic', 'Token'])} "]), _random(rng), True) if kind < 0.32
        else (rng.choice([cue, cue, f"{name}_{cue}", cue.upper(), cue.title()]) + given, _weak(rng), True) if kind < 0.55
        else (rng.choice(["", f"{name} ", f"{name}{given}"]), _weak(rng), False) if kind < 0.77
        else (rng.choice(["", f"{name} ", f"{cue} ", f"{name}{given}"]), _clean(rng), False)
    )
    after = before[-1:] if before[-1:] in (*QUOTES,) else rng.choice(["", "", ",", ".", ";"])
    return before + value + after, [(len(before), len(before) + len(value))] if secret else []


def chains_of(text: str, spans: list[tuple[int, int]], rng: random.Random, of_file: list[str]) -> list[tuple[list[list[str]], list[int]]]:
    """Labelled chains of a window: itself, and with planted pieces between its words or, if it holds secrets, in the place of one."""
    out = [chain(text, spans, of_file)]
    gaps = [m.start() for m in re.finditer(r"\s", text)] + [0, len(text)]
    for _ in range(3 if spans else 2):
        piece, own = planted(rng)
        if spans and rng.random() < 0.7:
            x, y = rng.choice(spans)
            name = re.search(r"""(?i)(password|passwd|secret|token|api_?key)["']?\s*[:=]\s*["']?\Z""", text[:x])
            x = name.start() if name else x
        else:
            x = y = rng.choice([g for g in gaps if not any(p < g < q for p, q in spans)])
        left, right = text[:x] + " " * (x == y and x > 0), (" " if x == y else "") + text[y:]
        at, moved = len(left), len(left) + len(piece) + (x == y) - y
        rest = [(p, q) for p, q in spans if q <= x] + [(p + moved, q + moved) for p, q in spans if p >= y and q > x]
        out.append(chain(left + piece + right, sorted([*rest, *((p + at, q + at) for p, q in own)]), of_file))
    return [c for c in out if c[1]]


def samples(docs: DataFrame, column: str = "text", spec: Spec = Spec()) -> pa.Table:
    """Windows of a hash-chosen sample of documents, spec.max_hits about secrets and spec.max_windows without: hit, x, at (where secrets begin and end), of_file (of the whole text)."""
    n = docs.count()
    keep = min(1.0, spec.max_docs / max(n, 1))
    sample = docs.select(F.col("doc_id").alias("i"), F.col(column).alias("x")).where("x is not null").where(F.pmod(F.xxhash64("i", F.lit(5)), F.lit(1 << 30)) < int(keep * (1 << 30)))
    schema = pa.schema([("hit", pa.bool_()), ("h", pa.string()), ("x", pa.string()), ("at", pa.list_(pa.int64())), ("of_file", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for x in b.column("x").to_pylist():
                spans, of_file = values(x), file_features(x)
                for hit, lo, hi in windows(x, spans):
                    at = [k for p, q in spans if p < hi and q > lo for k in (max(p, lo) - lo, min(q, hi) - lo)]
                    h = hashlib.sha256(repr((x[lo:hi], at, of_file)).encode()).hexdigest()
                    got.append({"hit": hit, "h": h, "x": x[lo:hi], "at": at, "of_file": of_file})
            yield from pa.Table.from_pylist(got, schema).to_batches()

    seen = sample.select("x").mapInArrow(run, "hit boolean, h string, x string, at array<bigint>, of_file array<string>").dropDuplicates(["hit", "h"])
    return pa.concat_tables([seen.where(F.col("hit") == hit).orderBy("h").limit(most).toArrow() for hit, most in ((True, spec.max_hits), (False, spec.max_windows))])


def train(docs: DataFrame, column: str = "text", spec: Spec = Spec()) -> Field:
    """Learn from the windows of `samples`, which are all that reaches the driver."""
    rng = random.Random(11)
    return fit([c for w in samples(docs, column, spec).to_pylist() for c in chains_of(w["x"], list(zip(w["at"][::2], w["at"][1::2], strict=True)), rng, w["of_file"])], spec)


def values(text: str) -> list[tuple[int, int]]:
    """Where the secrets of base spans lie: of an assignment its value; overlapping ones count as the first."""
    out: list[tuple[int, int]] = []
    for x, y in sorted((a + ASSIGN.match(text, a).start(2) - a if kind == "assign" else a, b) for kind, a, b in base_spans(text)):
        if not out or x >= out[-1][1]:
            out.append((x, y))
    return out


def tagged_spans(text: str, path: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that a path of states adds, apart from base spans."""
    first = np.flatnonzero(path == BEGIN).tolist()
    if not first:
        return []
    tokens, at, _ = _tokens(text)
    out = []
    for k in first:
        e = k + 1
        while e < len(path) and path[e] == INSIDE:
            e += 1
        lo, hi = at[k], at[e - 1] + len(tokens[e - 1])
        if all(hi <= x or y <= lo for _, x, y in base):
            out.append(("tagged", lo, hi))
    return out


def spans_of(texts: list[str], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text, each in the order of start, then kind."""
    out = []
    for text, path in zip(texts, field.paths(texts), strict=True):
        base = base_spans(text)
        out.append((base, sorted([*base, *tagged_spans(text, path, base)], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def scan(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",), column: str = "text") -> DataFrame:
    """The `keep` columns, n_assign, n_access, n_hex, base_sha256, spans, n_tagged."""
    bc = docs.sparkSession.sparkContext.broadcast(field)  # bounded by the number of features
    keep = C.unclashing(keep, _SCAN.names)
    name = C.spare("text", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = bc.value
        for b, _, _ in C.slices(batches, name):
            got = []
            for base, all_ in spans_of([x or "" for x in b.column(name).to_pylist()], f):
                n = {k: sum(s[0] == k for s in all_) for k in KINDS}
                line = lambda spans: ",".join(f"{k}:{a}:{e}" for k, a, e in spans)
                got.append((n["assign"], n["access"], n["hex"], hashlib.sha256(line(base).encode()).hexdigest(), line(all_), n["tagged"]))
            cols = list(zip(*got, strict=True)) if got else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*keep, *_SCAN.names])

    took = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias(name))
    return took.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *_SCAN]))


_SCAN = T.StructType([T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_tagged", T.LongType())])


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """text with the union of spans replaced; of an assignment only the value goes."""
    ranges = sorted((ASSIGN.match(text, a).start(2), b) if k == "assign" else (a, b) for k, a, b in spans)
    out, at = [], 0
    for a, b in ranges:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, field: Field, column: str = "text", mask: str = "[secret]", length: str | None = "n_chars") -> DataFrame:
    """docs with their secrets masked; `length` (if it is a column) then counts the new text's code points."""
    bc = docs.sparkSession.sparkContext.broadcast(field)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = bc.value
        for b, _, _ in C.slices(batches, column):
            texts, sizes = b.column(column).to_pylist(), b.column(length).to_pylist() if length in b.schema.names else None
            for k, (x, (_, spans)) in enumerate(zip(texts, spans_of([x or "" for x in texts], f), strict=True)):
                if spans:
                    texts[k] = masked(x, spans, mask)
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            cols = {c: b.column(c) for c in b.schema.names} | {column: pa.array(texts, b.column(column).type)}
            if sizes is not None:
                cols[length] = pa.array(sizes, b.column(length).type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
