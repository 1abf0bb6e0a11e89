import hashlib
import hmac
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import binary as B
from cairn.functions import crypto
from cairn.functions import formats as X
from cairn.functions import paths as P
from cairn.sources import bundles, container


def column(spark, values, kind, made):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").select("k", made(F.col("v")).alias("r")).orderBy("k").collect()
    return [r.r for r in rows]


def test_safe_paths(spark):
    bad = ["../escape", "/absolute", "C:/drive", "a/../../escape", "a/./b", "a\\..\\escape", "NUL.txt", "folder/trailing.", "a ", "COM1.txt", "lpt9", "aux.tar.gz", "", "a//b", "a\x7fb", "a\x85b", "a\x01b"]
    good = ["folder/file.txt", "a/", "COM0", "ß.txt"]
    assert column(spark, bad + good, "string", P.safe_path) == [False] * len(bad) + [True] * len(good)
    assert column(spark, ["a/", "C:/outside.txt", "../outside.txt", "folder\\outside.txt", "NUL.txt", "file.txt:stream", "a\x7fb"], "string", lambda c: P.safe_path(c, 2)) == [False] * 6 + [True]


def test_path_keys_collide(spark):
    keys = column(spark, ["folder/\u00e9.txt", "FOLDER/e\u0301.TXT", "Folder/Name.txt", "folder/name.TXT/"], "string", P.path_key)
    assert keys[0] == keys[1] and keys[2] == keys[3]
    assert column(spark, ["stra\u00dfe", "STRASSE"], "string", P.path_key)[0] == "stra\u00dfe"
    folded = column(spark, ["stra\u00dfe", "STRASSE"], "string", lambda c: P.path_key(c, "casefold"))
    assert folded[0] == folded[1] == "strasse"


def test_link_targets(spark):
    assert column(spark, ["../x", "../../x", "/x", "C:x", "a\\b", "", "a/../../b"], "string", lambda t: P.safe_link_target(F.lit("d/l"), t)) == [True, False, False, False, False, False, True]


def test_tree_order(spark):
    want = ["s", "s/B", "s/a", "s/a/b", "s/a/b/c", "s/a-b", "s/a.txt"]
    got = spark.createDataFrame([(x,) for x in reversed(want)], "path string").orderBy(F.split("path", "/")).collect()
    assert [r.path for r in got] == want


def test_extensions_and_categories(spark):
    names = ["a.TXT", ".bashrc", "x.tar.gz", "noext", "d.7z", "e.", ".a.json"]
    assert column(spark, names, "string", P.extension) == [".txt", "", ".gz", "", ".7z", "", ".json"]
    assert column(spark, names, "string", P.category) == ["text", "binary", "compressed", "binary", "compressed", "binary", "text"]


@pytest.mark.parametrize(("f", "pairs"), [
    (X.human_size, {0: "0.00 B", 1023: "1023.00 B", 1024: "1.00 KiB", 1536: "1.50 KiB", 2000 * 1024**5: "2000.00 PiB"}),
    (X.human_size_short, {0: "0.0 B", 1536: "1.5 KB", 5 * 1024**4: "5.0 TB", 2000 * 1024**5: "2048000.0 TB"}),
    (X.pretty_size, {0: "0 B", 5: "5 B", 1024: "1.0 KB", 1280: "1.2 KB"}),
])
def test_sizes(spark, f, pairs):
    assert column(spark, list(pairs), "long", f) == list(pairs.values())


def test_saturating_shift(spark):
    top = (1 << 63) - 1
    pairs = [(n, k) for n in (0, 1, 2, 5, 7, 8, 13, 76039, top) for k in (0, 1, 54, 57, 59, 60, 61, 62, 63, 64, 69)]
    got = spark.createDataFrame(pairs, "n long, k long").select("n", "k", X.saturating_shift(F.col("n"), F.col("k")).alias("x")).collect()
    assert {(r.n, r.k): r.x for r in got} == {(n, k): min(n << k, top) for n, k in pairs}


def test_ratio(spark):
    got = spark.createDataFrame([(1, 8), (3, 2), (1, 0)], "s long, r long").select(X.ratio_text(F.col("s"), F.col("r")).alias("x")).collect()
    assert [r.x for r in got] == ["0.125 (87.5% smaller)", "1.500 (-50.0% smaller)", "n/a"]


def test_text_and_zero(spark):
    text = [b"\x01" + b"a" * 19, b"\x01" + b"a" * 20, b"a\0b" + b"c" * 50, bytes.fromhex("c328"), b"", b"\t\n\r", "é".encode()]
    assert column(spark, text, "binary", B.looks_like_text) == [False, True, False, False, True, True, True]
    assert column(spark, [b"", bytes(9), b"\0\1"], "binary", B.is_zero) == [True, True, False]
    assert column(spark, [b"PK\3\4x", b"\x89PNG\r\n\x1a\n", b"text", b"PK"], "binary", B.looks_compressed) == [True, True, False, False]


def test_keyed_id(spark):
    key, label = bytes(range(32)), b"cairn block id\0"
    want = hmac.new(key, label + hashlib.sha256(b"abc").digest(), "sha256").hexdigest()
    assert column(spark, [b"abc"], "binary", lambda c: B.keyed_id(key, c)) == [want] == [crypto.keyed_id(key, hashlib.sha256(b"abc").digest(), label).hex()]


def test_argon2id_vector():
    out = crypto.argon2id(b"\1" * 32, b"\2" * 16, 32, 3, 4, 32, b"\3" * 8, b"\4" * 12)
    assert out.hex() == "0d640df58d78766c08c037a34a8b53c9d01ef0452d75b65eb52520e96b01e659"


def test_sealing_vectors():
    key, aad = bytes(range(0x80, 0xA0)), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    plain = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    sealed = crypto.seal(key, plain, aad, bytes(range(0x40, 0x58)))
    assert sealed[-16:].hex() == "c0875924c1c7987947deafd8780acf49"
    assert crypto.unseal(key, sealed, aad) == plain
    for broken in (sealed[:-1] + bytes([sealed[-1] ^ 1]), sealed[:30]):
        with pytest.raises(ValueError):
            crypto.unseal(key, broken, aad)
    with pytest.raises(ValueError):
        crypto.derive_key("x", bytes(16), 1, 1, 1)


def test_sealing_many_equals_one_by_one():
    key, r = bytes(range(32)), random.Random(29)
    plains = [r.randbytes(n) for n in (0, 1, 63, 64, 65, 128, 70_000, 5, 0, 200_001)]
    aads, nonces = [r.randbytes(n) for n in range(10)], [r.randbytes(24) for _ in range(10)]
    many = crypto.seal_many(key, plains, aads, nonces)
    assert many == [crypto.seal(key, *x) for x in zip(plains, aads, nonces)]
    assert [crypto.unseal(key, x, a) for x, a in zip(many, aads)] == plains
    assert crypto.seal_many(key, [], []) == []


def test_sealed_container_works_on_many_blocks_at_once(monkeypatch):
    """A thousand short blocks take a few passes of the cipher, not two each."""
    calls, rounds = [], crypto._rounds
    monkeypatch.setattr(crypto, "_rounds", lambda s: calls.append(s.shape) or rounds(s))
    monkeypatch.setattr(crypto, "derive_key", lambda *a: bytes(32))
    texts = [b"text %d" % k * 9 for k in range(1000)]
    out = io.BytesIO()
    entries = [{"path": "p", "type": "file", "size": 1, "segments": []}]
    container.emit(out, ((hashlib.sha256(x).hexdigest(), 0, len(x), x) for x in texts), entries, password="p")
    assert len(calls) <= 10
    ix = container.read_index(io.BytesIO(out.getvalue()), len(out.getvalue()), "p")
    assert [container.open_payload(ix.key, b, out.getvalue()[b.offset : b.offset + b.stored_size]) for b in ix.blocks] == texts


def test_key_derivation_makes_few_arrays(monkeypatch):
    """Blocks are compressed in place: stacking and rolling took most of the time."""
    monkeypatch.setattr(np, "stack", None)
    monkeypatch.setattr(np, "roll", None)
    assert len(crypto.argon2id(b"p", bytes(16), 64, 1, 1)) == 32


def test_occurring_names(monkeypatch):
    r = random.Random(2)
    for step in (1, 2, 5, 1 << 20):
        monkeypatch.setattr(bundles, "_PASS", step)
        for _ in range(50):
            data = bytes(r.choices(b"abc", k=r.randrange(60)))
            names = [bytes(r.choices(b"abc", k=r.randrange(7))) for _ in range(20)]
            assert bundles.occurring(data, names) == [x in data for x in names]


def test_column_sealing(spark):
    row = spark.createDataFrame([(b"secret", bytes(range(32)), bytes(12), b"aad")], "p binary, k binary, n binary, a binary")
    sealed = row.withColumn("s", crypto.seal_column(*map(F.col, "pkna")))
    assert bytes(sealed.select(crypto.unseal_column(F.col("s"), F.col("k"), F.col("a")).alias("x")).first().x) == b"secret"
