"""Queries: packing and unpacking, codecs, rules on whole archives, and a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import model as M
from cairn.operators import archiving as A
from cairn.operators import codecs as D
from cairn.operators import constraints as C
from cairn.plans import vfs as V
from cairn.plans.registry import query
from cairn.plans.relations import _LINKS, _cdc_sql, conflicting
from cairn.plans.scans import _ADVICE as ADVICE
from cairn.plans.scans import CATEGORY, EXT, NAMED, named
from cairn.streaming import dedup as T

_META = [("mtime_ns", "long"), ("mode", "int"), ("uid", "long"), ("gid", "long"), ("dev", "long"), ("inode", "long"), ("nlink", "int"), ("target", "string")]


def files(spark, sf):
    """Documents as rows of model.FILE."""
    d = V.docs(spark, sf)
    return d.select("path", F.lit("file").alias("type"), F.col("text").cast("binary").alias("content"), "size", *[F.lit(None).cast(t).alias(c) for c, t in _META])


_CUT = _cdc_sql(f"{V.DOCS}, s AS (SELECT doc_id AS k, text AS t FROM docs WHERE size > {M.CHUNK_MIN})", M.CHUNK_MIN, M.CHUNK_MAX, M.CHUNK_MASK_BITS)


@query("k1_pack_entries", f"WITH {V.DOCS}, cut AS ({_CUT}), n AS (SELECT k, count(*) AS n FROM cut GROUP BY k) SELECT path, size, CASE WHEN size = 0 THEN 0 ELSE coalesce(n, 1) END::INTEGER AS segments, size AS held FROM docs LEFT JOIN n ON k = doc_id")
def k1_pack_entries(spark, sf):
    entries, _ = A.pack(files(spark, sf))
    held = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["zero"], s["length"]))
    return entries.select("path", "size", F.size("segments").alias("segments"), held.alias("held"))


@query("k5_unpack", f"WITH {V.DOCS} SELECT path, sha256(text) AS sha256 FROM docs WHERE size > 0")
def k5_unpack(spark, sf):
    entries, blocks = A.pack(files(spark, sf), "fast", spread=2, chunking=(256, 4096, 10))
    parts = A.pieces(entries, blocks).where("piece is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seg_no", F.hex("piece").alias("h")))).alias("a"))
    return parts.select("path", F.sha2(F.unhex(F.array_join("a.h", "")), 256).alias("sha256"))


@query("r19_verify", f"WITH {V.DOCS} SELECT sha256(text) AS block_id, min(CASE WHEN doc_id % 53 = 7 THEN 'digest differs' ELSE 'block has not ' || (size + 1) || ' bytes' END) AS problem FROM docs WHERE doc_id % 53 IN (7, 8) GROUP BY 1")
def r19_verify(spark, sf):
    d = V.docs(spark, sf).select("doc_id", "size", F.col("text").cast("binary").alias("content"), F.sha2(F.col("text").cast("binary"), 256).alias("block_id"))
    k = F.col("doc_id") % 53
    # every block is decoded and hashed again; only the faults are laid by document
    stored = d.select(
        "block_id", F.lit(0).cast("byte").alias("method"), F.when(k == 7, F.reverse(F.hex("content")).cast("binary")).otherwise(F.col("content")).alias("payload"), F.when(k == 7, F.col("size") * 2).when(k == 8, F.col("size") + 1).otherwise(F.col("size")).alias("raw_size")
    )
    bad = A.decode(stored).where("error is not null")
    return bad.groupBy("block_id").agg(F.min(F.regexp_replace("error", "^ValueError: ", "")).alias("problem"))


@query("x32_probe")
def x32_probe(spark, sf):
    return V.docs(spark, sf).select("doc_id", D.probed(F.col("text").cast("binary")).alias("ratio"))


@query("x33_codecs", f"WITH {V.DOCS} SELECT doc_id, m::TINYINT AS method, sha256(text) AS sha256 FROM docs CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 6]) AS m)")
def x33_codecs(spark, sf):
    """Every document under every codec, and back."""
    d = V.docs(spark, sf).select("doc_id", F.col("text").cast("binary").alias("content"))
    every = D.encode_as(d, (D.RAW, D.ZLIB, D.BZ2, D.LZMA, D.ZSTD, D.XZ))
    return every.select("doc_id", "method", F.sha2(D.decoded(F.col("method"), F.col("payload"), F.col("raw_size"))["content"], 256).alias("sha256"))


@query("c1_profiles")
def c1_profiles(spark, sf):
    """Every blob under the balanced profile: what looks compressed, or would not get smaller, stays raw."""
    return D.encode_blocks(V.blobs(spark, sf).select("doc_id", F.col("b").alias("content")), "balanced").select("doc_id", "method", "raw_size", "stored_size")


@query("c2_adaptive")
def c2_adaptive(spark, sf):
    d = V.docs(spark, sf).select("doc_id", F.col("text").cast("binary").alias("content"))
    return D.encode_blocks(d, adaptive="auto").groupBy("method").agg(F.count("*").alias("blocks"), F.sum("raw_size").alias("raw_bytes"), F.sum("stored_size").alias("stored_bytes"))


#: Bounds of the sample in the two queries, so small that both are met.
_EACH, _ALL = 2000, 1_000_000


def _analyzed(spark, sf):
    f = named(spark, sf).join(V.docs(spark, sf).select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id").select(F.concat_ws("/", F.col("doc_id").cast("string"), "path").alias("path"), F.lit("file").alias("type"), "size", "content")
    return A.analyze(f, _EACH, _ALL)


@query("a9_analyze", f"WITH {V.DOCS}, {NAMED}, e AS (SELECT *, {EXT} AS ext, least(size, {_EACH}) AS want, replace(doc_id || '/' || path, '/', chr(0)) AS walk FROM named), r AS (SELECT {CATEGORY} AS category, size, want, sum(want) OVER (ORDER BY walk ROWS UNBOUNDED PRECEDING) AS upto FROM e), g AS (SELECT category, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes, sum(greatest(0, least(want, {_ALL} - (upto - want))))::BIGINT AS sampled FROM r GROUP BY 1) SELECT *, 100.0::DOUBLE * bytes / (sum(bytes) OVER ())::DOUBLE AS share FROM g")
def a9_analyze(spark, sf):
    return _analyzed(spark, sf).select("category", "files", "bytes", "sampled", "share")


@query("a9_ratio")
def a9_ratio(spark, sf):
    """The capped sample's compressed share and the advice that follows from it."""
    return _analyzed(spark, sf).select("category", "ratio", F.expr(ADVICE.replace("p ", "ratio ")).alias("advice"))


@query("r12_collisions", f"WITH {V.ODD} SELECT 'R12' AS rule, lower(rtrim(path, '/')) AS subject, count(*)::VARCHAR AS detail FROM odd GROUP BY 2 HAVING count(*) > 1")
def r12_collisions(spark, sf):
    e = V.odd_paths(spark, sf).select("path", F.lit("file").alias("type"), F.lit(None).cast("string").alias("target"))
    return C.path_rules(e).where("rule = 'R12'")


@query("r14_ancestors", f"WITH {V.DOCS} SELECT 'R14' AS rule, path || '/c' AS subject, lower(path) AS detail FROM docs WHERE doc_id % 9 IN (1, 2)")
def r14_ancestors(spark, sf):
    return C.path_rules(conflicting(spark, sf).withColumn("target", F.lit(None).cast("string"))).where("rule = 'R14'")


@query("r21_link_targets", f"WITH {V.DOCS}, {_LINKS} SELECT 'R21' AS rule, path || '.l' AS subject, target AS detail FROM links WHERE doc_id % 3 = 2")
def r21_link_targets(spark, sf):
    d = V.docs(spark, sf)
    k, p = F.col("doc_id") % 3, F.col("path")
    links = d.where("doc_id % 5 = 0").select(F.concat(p, F.lit(".l")).alias("path"), F.lit("hardlink").alias("type"), F.when(k == 0, p).when(k == 1, F.upper(p)).otherwise(F.concat(p, F.lit("/gone"))).alias("target"))
    return C.path_rules(d.select("path", F.lit("file").alias("type"), F.lit(None).cast("string").alias("target")).unionByName(links), links="allow").where("rule = 'R21'")


@query("r22_destination", f"WITH {V.DOCS}, present AS (SELECT path, doc_id % 2 = 0 AS is_dir FROM docs WHERE doc_id % 10 < 2) SELECT d.path FROM docs d JOIN present p USING (path) WHERE NOT p.is_dir")
def r22_destination(spark, sf):
    d = V.docs(spark, sf)
    present = d.where("doc_id % 10 < 2").select("path", (F.col("doc_id") % 2 == 0).alias("is_dir"))
    return d.join(present.where("not is_dir").select("path"), "path", "left_semi").select("path")


@query("r24_unchanged", f"WITH {V.DOCS} SELECT path FROM docs WHERE doc_id % 47 = 9")
def r24_unchanged(spark, sf):
    f = files(spark, sf).join(V.docs(spark, sf).select("path", "doc_id"), "path").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 47 == 9, 1).otherwise(0))
    return f.where(F.octet_length("content") != F.col("size")).select("path")


@query("t2_stream_blocks", f"WITH {V.DOCS}, c AS (SELECT hex(encode(text)) AS h, size, unnest(range(0, size, 1024)) AS o FROM docs WHERE size > 0) SELECT DISTINCT sha256(unhex(substr(h, 2 * o + 1, 2048))) AS block_id, least(1024, size - o)::BIGINT AS length FROM c")
def t2_stream_blocks(spark, sf):
    path = f"{sf}/documents.parquet"
    # as a pattern, so that the table may be one file or a folder
    stream = T.document_stream(spark, f"{sf}/documents.parque[t]", spark.read.parquet(path).schema).select(F.col("text").cast("binary").alias("content"))
    return T.finished(T.distinct_blocks(stream, 1024))
