"""The registered queries on the smallest tables, and the pipeline against plain versions of its stages."""

import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from cairn.llm import common, language, packing, quality, queries, secrets
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")

COLUMNS = {
    "op1_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op2_quality": ["doc_id", "held_out", "score", "predicted"],
    "op3_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op4_chat": ["conv_id", "n_turns", "chat"],
    "op5_html_text": ["page_id", "url", "text", "n_chars"],
    "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op8_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op9_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_jaccard": ["doc_id", "class_id"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_columns(spark, name):
    assert queries.QUERIES[name](spark, SF).columns[: len(COLUMNS[name])] == COLUMNS[name]


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_equal_to_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = db.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(cur.fetchall())


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now, names = docs, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    kept = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    want = [lambda: {i: t for i, t in kept.items() if scores[i] >= 0.3}]
    want.append(lambda: {i: t for i, t in kept.items() if groups[i][0] == i})
    want.append(lambda: {i: t for i, t in kept.items() if not bad[i]})
    want.append(lambda: {i: secrets.masked(t, secrets.spans_of([t], field)[0][1], "[secret]") for i, t in kept.items()})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        groups = brute.groups(list(kept.items())) if k == 1 else {}
        bad = {w[0]: w[5] for w in brute.contamination(list(kept.items()), bench)} if k == 2 else {}
        field = secrets.train(now) if k == 3 else None
        now = common.written(stage(spark, now, SF))
        assert now.columns == docs.columns
        kept = want[k]()
        assert {r.doc_id: r.text for r in now.collect()} == kept
        assert k != 3 or all(r.n_chars == len(r.text) for r in now.collect())
    code = packing.coder()
    lengths = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        ids = np.append(code(kept[r.doc_id]), 0).astype("<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(code(t)) + 1 for i, t in kept.items()}


ODD = [
    (1, None), (1, None), (2, ""), (2, ""), (None, None), (None, "a row without an id " * 5), (3, "one"), (4, "\n \t!"), (5, "the same text again and again, of more than five words"), (5, "the same text again and again, of more than five words"),
    (6, "the same text again and again, of more than five words"), (7, "word " * 40_000), (8, "token = \"b7852d4e73166f43a80132626729b5fa5141a7a6\""), (9, "x" * 300_000), (10, "é漢\U0001f600 " * 50),
]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, tmp_path, k):
    """Nulls, empty and very long texts, ties, repeats, further columns with clashing names, and empty tables."""
    more = "text_ string, score double, digest string, state_runs int, n_words int, part int, sig binary, spans string, length int"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {more}"
    rows = [(i, t, "en", None, None if t is None else len(t), "t", 0.5, "d", 1, 2, 3, b"s", "x", 4) for i, t in ODD]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one"), (2, None), (None, "word word")], "item_id long, text string")
    for name, t in (("labels", labels), ("benchmark", bench)):
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, str(tmp_path))
    out = got.collect()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if name == "best-fit packing":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out if r.piece == 0) == sorted((i is None, i or 0) for i, _ in ODD)
        return
    assert got.schema == docs.schema
    texts = sorted((repr((r.doc_id, r.text)) for r in out))
    if name == "n-gram Jaccard join":
        kept = [r for k, r in enumerate(ODD) if r != (6, ODD[8][1]) and not (r[0] == 5 and r in ODD[:k])]
        assert texts == sorted(map(repr, kept))
    elif name == "benchmark decontamination":
        assert texts == sorted(repr(r) for r in ODD if r[1] != "one")
    elif name == "secret scans":
        assert texts == sorted(repr(r if r[0] != 8 else (8, 'token = "[secret]"')) for r in ODD)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    else:
        scores = {repr((r.doc_id, r.text)): r.s for r in quality.score(docs.drop("score"), quality.train(docs, labels), ("doc_id", "text")).withColumnRenamed("score", "s").collect()}
        assert texts == sorted(t for t in (repr(r) for r in ODD) if scores[t] >= 0.3)


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_quality", "op3_fingerprints", "op6_language", "op7_packing", "op8_secrets", "op9_suffix_dedup", "op10_jaccard"])
def test_queries_take_odd_and_empty_tables(spark, tmp_path, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, part int, key string"
    rows = [(i, t, "en" if k % 2 else None, None, None, 0.1, "f", 1, "k") for k, (i, t) in enumerate(ODD)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for place, some in (("full", rows), ("none", [])):
        (tmp_path / place).mkdir()
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / place / "documents.parquet"))
        for t in ("labels", "benchmark"):
            (tmp_path / place / f"{t}.parquet").symlink_to(tmp_path / f"{t}.parquet")
        got = queries.QUERIES[name](spark, str(tmp_path / place))
        out = got.collect()
        assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
        first = [r for r in out if name != "op7_packing" or r.piece == 0]
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in first) == sorted((i is None, i or 0) for i, *_ in some)


def test_quality_query_equals_plain_walk(spark):
    """Scores are the trees' walked one row at a time; held-out rows are those of the contract."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op2_quality"](spark, SF).collect()}
    for d in docs.collect():
        raw = np.frombuffer((d.text or "").encode(), np.uint8)
        x = quality.statistics(raw, np.array([0, len(raw)]))[0]
        m = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + (2 if x[f[k]] > t[k] else 1)
            m += leaf[k - len(f)]
        r = got[d.doc_id]
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(m, -30, 30)))) < 1e-9
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


def test_language_query_equals_plain_count(spark):
    """Each n-gram is looked up on its own, a language's bit at a time."""
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    f = language.train(docs)
    got = {r.doc_id: r for r in queries.QUERIES["op6_language"](spark, SF).collect()}
    for d in docs.collect()[:60]:
        low = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", (d.text or "").lower().encode())
        total, count = 0, [0] * len(f.langs)
        for size in f.spec.sizes:
            for k in range(len(low) - size + 1):
                h = 0
                for c in low[k : k + size]:
                    h = (h * 0x100000001B3 + c) % (1 << 64)
                h = common.mix64(np.array([(h + (size << 59)) % (1 << 64)], np.uint64)) & ~np.uint64(language.DOC_BITS)
                total += 1
                at = [int(p[0]) for p in f.places(h)]
                for lang in range(len(f.langs)):
                    count[lang] += all(int(f.table[lang // 64][p]) >> (lang % 64) & 1 for p in at)
        fixed = [max((c - total * w) / (1 - min(w, 0.99)), 0) for c, w in zip(count, f.wrong.tolist(), strict=True)]
        if any(x.isalpha() for x in d.text or ""):
            best = int(np.argmax(fixed))
            assert got[d.doc_id].lang_pred == f.langs[best] and abs(got[d.doc_id].score - fixed[best] / max(sum(fixed), 1e-9)) < 1e-9
        else:
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0)


def test_figures_hold(spark):
    """The figures of README.md, on smaller tables: held-out accuracy, likeness of edited texts, sequences over their least number."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("the tables are not here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r for r in docs.select("doc_id", "lang").collect()}
    lang = [r.lang_pred == truth[r.doc_id].lang for r in queries.QUERIES["op6_language"](spark, sf).collect() if r.held_out and r.lang_pred != "und" and truth[r.doc_id].lang]
    assert len(lang) > 100 and np.mean(lang) > 0.98
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r.predicted == labels[r.doc_id] for r in queries.QUERIES["op2_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(good) > 50 and np.mean(good) > 0.97
    prints = [(r.near_edited, r.near_next) for r in queries.QUERIES["op3_fingerprints"](spark, sf).collect() if r.n_chars > 200]
    a, b = np.array(prints).T
    assert np.mean(a[:, None] > b[None, :]) + np.mean(a[:, None] == b[None, :]) / 2 > 0.95
    pieces = queries.QUERIES["op7_packing"](spark, sf).select("sequence_id", "length").collect()
    assert len({r.sequence_id for r in pieces}) <= 1.005 * sum(r.length for r in pieces) / 2048 + 1
