import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.operators import blocks as K
from cairn.operators import chunking as G
from cairn.operators import codecs as D
from cairn.operators import constraints as C
from cairn.operators import recovery as R
from cairn.operators import solid as S


def test_gear():
    assert [f"{G.GEAR[k]:016x}" for k in (0, 1, 255)] == ["e220a8397b1dcdaf", "910a2dec89025cc1", "338c507146283fb4"]


def test_chunk_pins():
    assert G.cut_one(b"hello world " * 200, 64, 1024, 7)[:6] == [104, 137, 272, 143, 137, 272]
    data = b"repeat me" * 20000 + bytes(150_000)
    lengths = G.cut_one(data)
    assert lengths == [166111, 65946, 97943]
    assert hashlib.sha256(data[:166111]).hexdigest().startswith("b7134cccca9f")
    assert G.cut_one(b"\x07" * (4 << 20)) == [550608] * 7 + [340048]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=0, max_size=60))
def test_streams_in_step_are_cut_as_alone(streams):
    streams = streams + [random.Random(3).randbytes(5000)] * 30
    got = G.cut_many(streams, 64, 512, 6)
    assert got == [G.cut_one(s, 64, 512, 6) for s in streams]
    for s, lengths in zip(streams, got, strict=True):
        assert sum(lengths) == len(s) and all(64 <= n <= 512 for n in lengths[:-1])


def test_zero_extents():
    assert G.zero_extents(b"ab" + bytes(5) + b"c" + bytes(2), 3) == [("data", 0, 2), ("hole", 2, 5), ("data", 7, 3)]
    assert G.zero_extents(b"") == []
    assert G.zero_extents(bytes(9), 4) == [("hole", 0, 9)]


def test_solid_vector():
    block, offset = S.assign(np.array([3, 3, 5, 9, 1, 1, 8]), 10)
    assert list(zip(block.tolist(), offset.tolist(), strict=True)) == [(0, 0), (0, 3), (1, 0), (2, 0), (2, 9), (3, 0), (3, 1)]


@given(st.lists(st.integers(0, 20), max_size=50), st.integers(1, 15))
def test_solid_is_the_fold(sizes, limit):
    want, block, used, first = [], 0, 0, True
    for s in sizes:
        if not first and (used + s > limit or used >= limit):
            block, used = block + 1, 0
        want.append((block, used))
        used, first = used + s, False
    got = S.assign(np.array(sizes, np.int64), limit)
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


@pytest.mark.parametrize("data", [b"", b"a", bytes(5000), b"text " * 4000, random.Random(1).randbytes(9000), b"\x1f\x8b" + b"a" * 900])
def test_codecs_round_trip(data):
    for profile in ("fast", "balanced", "smallest", "store"):
        m, p = D.encode(data, profile)
        assert D.decode(m, p, len(data)) == data and len(p) <= len(data)
    for mode in ("fast", "balanced", "max", "auto"):
        for zstd in (False, True):
            m, p = D.encode_adaptive(data, mode, "binary", zstd)
            assert D.decode(m, p, len(data)) == data


def test_decode_refuses():
    with pytest.raises(ValueError):
        D.decode(D.RAW, b"abc", 2)
    with pytest.raises(ValueError):
        D.decode(9, b"", 0)


def test_recovery_solves_any_loss():
    rng = random.Random(5)
    data = {j: rng.randbytes(64) for j in range(12)}
    parity = {}
    for i in range(4):
        acc = np.zeros(32, np.uint16)
        for j, d in data.items():
            acc ^= R.multiply(R.coefficient(i, j, 12), np.frombuffer(d, "<u2"))
        parity[i] = acc.astype("<u2").tobytes()
    for lost in ([0], [3, 7], [1, 2, 11], [0, 4, 5, 9]):
        have = {j: d for j, d in data.items() if j not in lost}
        some = {i: parity[i] for i in sorted(parity)[-len(lost) :]}
        assert R.solve(lost, have, some, 12) == {j: data[j] for j in lost}
    with pytest.raises(ValueError):
        R.solve([0, 1], {}, {0: parity[0]}, 12)


ENTRY = "path string, type string, size long, target string, segments array<struct<block: string, offset: bigint, length: bigint, zero: bigint>>"
BLOCK = "block_id string, method tinyint, raw_size long, stored_size long, offset long"


def rules(spark, entries, blocks=(("b1", 0, 10, 10, 91),), links="allow"):
    e = spark.createDataFrame([tuple(x) for x in entries], ENTRY)
    b = spark.createDataFrame([tuple(x) for x in blocks], BLOCK)
    return sorted((r.rule, r.subject) for r in C.violations(e, b, max_output=1000, links=links).collect())


GOOD = ("a/x.txt", "file", 15, None, [("b1", 0, 10, None), (None, None, None, 5)])


def test_clean_entries(spark):
    assert rules(spark, [GOOD, ("a", "directory", 0, None, [])]) == []
    assert rules(spark, []) == []


@pytest.mark.parametrize(("row", "want"), [
    (("../x", "file", 0, None, []), ("R11", "../x")),
    (("A/X.TXT", "file", 0, None, []), ("R12", "a/x.txt")),
    (("a/x.txt/c", "file", 0, None, []), ("R14", "a/x.txt/c")),
    (("p", "fifo", 0, None, []), ("R18", "p")),
    (("q", "file", 3, None, [("gone", 0, 3, None)]), ("R15", "q#0")),
    (("q", "file", 8, None, [("b1", 5, 8, None)]), ("R16", "q#0")),
    (("q", "file", 4, None, [("b1", 0, 3, None)]), ("R17", "q")),
    (("big", "file", 5000, None, [(None, None, None, 5000)]), ("R13", "entries")),
    (("l", "symlink", 0, "../../x", []), ("R21", "l")),
    (("h", "hardlink", 0, "nowhere", []), ("R21", "h")),
])
def test_one_broken_rule(spark, row, want):
    assert rules(spark, [GOOD, row]) == [want]


def test_broken_blocks(spark):
    assert rules(spark, [GOOD], [("b1", 0, 10, 10, 91), ("b1", 0, 10, 10, 200)])[0][0] == "R5"
    assert ("R3", "b2") in rules(spark, [GOOD], [("b1", 0, 10, 10, 91), ("b2", 0, 33 << 20, 10, 200)])
    assert rules(spark, [("l", "symlink", 0, "x", [])], links="refuse") == [("R20", "l")]


def test_hidden_conflict(spark):
    e = spark.createDataFrame([("t/a", "file"), ("t/a-b", "file"), ("t/a/c", "file")], "path string, type string").withColumn("target", F.lit(None).cast("string"))
    assert C.path_rules(e).where("rule = 'R14'").count() == 1
    assert C.adjacent_conflicts(e).count() == 0


def test_dedup_runs_before_the_codec(spark):
    chunks = spark.createDataFrame([("x", 1, 5), ("x", 2, 5), ("y", 1, 7), (None, 3, 2)], "block_id string, n int, length int")
    assert sorted(tuple(r) for r in K.first_occurrence(chunks, ["n"]).collect()) == [("x", 1), ("y", 1)]
    plan = D.encode_blocks(chunks.dropDuplicates(["block_id"]).select("block_id", F.encode("block_id", "UTF-8").alias("content")))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Aggregate")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 25), st.lists(st.integers(0, 60), max_size=6))
def test_solid_packing_over_ranges_is_the_fold(sizes, limit, cuts):
    """Ranges of any extent, passed through by their tables alone, give the blocks of one fold in order."""
    from cairn.operators import solid

    want, block, held = [], 0, None
    for x in sizes:
        if held is None:
            held = 0
        elif held + x > limit or held >= limit:
            block, held = block + 1, 0
        want.append((block, held))
        held += x
    got, state = [], (-1, 0)
    for part in np.split(np.array(sizes, np.int64), sorted(min(c, len(sizes)) for c in cuts)):
        if len(part):
            b, o = solid.placed(part, limit, *state)
            got += zip(b.tolist(), o.tolist(), strict=True)
            most, begun, last = solid.passage(part, limit)
            assert most[-1] == -1 and all(x <= y for x, y in zip(most[:-1], most[1:-1]))
            state = solid.followed(state, begun, last, most, int(part.sum()), limit)
    assert got == want


def test_corpus_digest(spark):
    import hashlib

    from cairn.operators import digests

    rows = [(f"d{k % 7}/f{k}", f"{k * 7919:064x}") for k in range(500)]
    df = spark.createDataFrame(rows, "path string, digest string").repartition(5)
    text = "\n".join(f"{p}:{d}" for p, d in sorted(rows))
    assert digests.corpus_digest(df).collect() == [(hashlib.sha256(text.encode()).hexdigest(), 500)]
    assert digests.corpus_digest(df.limit(0)).collect() == [(None, 0)]


def test_adaptive_policy_covers_all_probes():
    """In each mode every probe up to the bound has a codec, and over it none."""
    from cairn.operators import codecs

    for mode in ("fast", "balanced", "max", "auto"):
        for zstd in (False, True):
            assert all(codecs.rules(mode, zstd, k / 1000) for k in range(993))
            assert not codecs.rules(mode, zstd, 0.9921) and codecs.rules("odd", zstd, 0.3) == codecs.rules("auto", zstd, 0.3)
    assert codecs.rules("fast", True, 0.98, named=True) == [(codecs.ZSTD, 1)] and codecs.rules("fast", False, 0.98, named=True) == []
