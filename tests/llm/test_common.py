import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import common as C
from tests.llm import brute

TEXTS = st.lists(st.text(alphabet="aB9 é.,-\n\x7fß", max_size=60), max_size=12)


def names(hashes, texts):
    """Hashes and texts tell the same things apart."""
    seen = {}
    for h, t in zip(hashes, texts, strict=True):
        assert seen.setdefault(h, t) == t
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words(texts):
    raw, offs = C.text_buffer(pa.array(texts, pa.string()))
    w = C.Words(raw, offs)
    want = [brute.words(t) for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    flat = [x for y in want for x in y]
    assert [bytes(C.LOWER[raw[a:b]]).decode() for a, b in zip(w.start, w.end, strict=True)] == flat
    names(w.hash.tolist(), flat)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_shingles(texts):
    raw, offs = C.text_buffer(pa.array(texts, pa.string()))
    h, first = C.shingles(C.Words(raw, offs), 3)
    flat = []
    for k, t in enumerate(texts):
        w = brute.words(t)
        own = [tuple(w[j : j + 3]) for j in range(max(len(w) - 2, 1))] if w else []
        assert first[k + 1] - first[k] == len(own)
        flat += own
    names(h.tolist(), flat)


def test_buffers_of_slices_and_nulls():
    batch = pa.record_batch({"text": pa.array(["ab", None, "", "c" * 50, "de"])})
    got = [(p.num_rows, bytes(raw).decode(), offs.tolist()) for p, raw, offs in C.slices(iter([batch.slice(1)]), max_bytes=10)]
    assert got == [(2, "", [0, 0, 0]), (1, "c" * 50, [0, 50]), (1, "de", [0, 2])]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (4, 3), (7, 7), (20, 10), *((100, k) for k in range(101, 400)), *((k, k + 1) for k in range(500, 540))]
    got = {r.node: r.root for r in C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 20: 10} | {k: 100 for k in range(100, 400)} | {k: 500 for k in range(500, 541)}
    assert got == want
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_held_out_is_crc32(spark):
    import zlib

    got = spark.range(50).select("id", C.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
