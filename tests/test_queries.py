"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from cairn.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_queries_without_sql(spark):
    """Compressed sizes are a library's own: two are held to bounds, two to a plain version."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"x32_probe", "c2_adaptive", "c1_profiles", "a9_ratio"}
    assert all(0 < r.ratio < 2 for r in catalogue.QUERIES["x32_probe"](spark, SF).collect())
    assert all(r.stored_bytes <= r.raw_bytes for r in catalogue.QUERIES["c2_adaptive"](spark, SF).collect())


def test_profiles_equal_plain_version(spark):
    import zstandard

    from cairn.functions.binary import SIGNATURES
    from cairn.plans import vfs

    want = {}
    for r in vfs.blobs(spark, SF).collect():
        b = bytes(r.b)
        z = zstandard.ZstdCompressor(level=3).compress(b)
        raw = b.startswith(SIGNATURES) or len(z) >= len(b)
        want[r.doc_id] = (0, len(b), len(b)) if raw else (4, len(b), len(z))
    got = {r.doc_id: (r.method, r.raw_size, r.stored_size) for r in catalogue.QUERIES["c1_profiles"](spark, SF).collect()}
    assert got == want and {m for m, _, _ in want.values()} == {0, 4}


def test_ratio_equals_plain_version(spark):
    import zlib

    from pyspark.sql import functions as F

    from cairn.functions import paths
    from cairn.plans import archives, scans, vfs

    rows = scans.named(spark, SF).join(vfs.docs(spark, SF).select("doc_id", "text"), "doc_id").select(F.concat_ws("/", F.col("doc_id").cast("string"), "path").alias("path"), "text").withColumn("category", paths.category(F.col("path"))).collect()
    left, packed, taken = archives._ALL, {}, {}
    for r in sorted(rows, key=lambda r: r.path.replace("/", "\0").encode()):
        part = r.text.encode()[: min(archives._EACH, left)]
        left -= len(part)
        if part:
            packed[r.category] = packed.get(r.category, 0) + len(zlib.compress(part, 1))
            taken[r.category] = taken.get(r.category, 0) + len(part)
    got = {r.category: (r.ratio, r.advice) for r in catalogue.QUERIES["a9_ratio"](spark, SF).collect()}
    assert set(got) == {r.category for r in rows}
    for c, (ratio, advice) in got.items():
        want = packed[c] / taken[c] if c in taken else 1.0
        assert abs(ratio - want) < 1e-9 and advice == ("auto or balanced" if want < 0.55 else "balanced" if want < 0.9 else "fast or auto")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equal(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    cur = db.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_verify_reaches_every_block(spark, monkeypatch):
    """A block damaged in a document without a laid fault is found."""
    from pyspark.sql import functions as F

    from cairn.plans import archives

    texts = {r.block_id: r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").where("text <> ''").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("block_id")).collect()}
    target = next(b for b, i in sorted(texts.items()) if i % 53 == 20)
    decode = archives.A.decode
    monkeypatch.setattr(archives.A, "decode", lambda t: decode(t.withColumn("payload", F.when(F.col("block_id") == target, F.reverse(F.hex("payload")).cast("binary")).otherwise(F.col("payload"))).withColumn("raw_size", F.octet_length("payload").cast("long"))))
    assert target in {r.block_id for r in catalogue.QUERIES["r19_verify"](spark, SF).collect()}


def test_rehash_compares_stored_ids_of_all_documents(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cairn.plans import vfs

    chunks = vfs.chunks
    rows = [r for r in chunks(spark, SF).select("doc_id", "block_id").collect()]
    target = min(r.doc_id for r in rows if r.doc_id % 53 == 20)
    want = {r.block_id for r in rows if r.doc_id == target}
    monkeypatch.setattr(vfs, "chunks", lambda *a: chunks(*a).withColumn("block_id", F.when(F.col("doc_id") == target, F.lit("0" * 64)).otherwise(F.col("block_id"))))
    assert want <= {r.subject for r in catalogue.QUERIES["r19_rehash"](spark, SF).collect()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
