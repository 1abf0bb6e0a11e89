"""Queries: joins, aggregations, windows, order, sets, generators and rules on archive relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import paths as P
from cairn.operators import blocks as K
from cairn.operators import chunking as G
from cairn.operators import constraints as C
from cairn.operators import solid as S
from cairn.operators.digests import corpus_digest
from cairn.operators.order import pinned, ranked, running_sum, with_next
from cairn.plans import vfs as V
from cairn.plans.registry import query
from cairn.plans.scans import INODES, NAMED, CATEGORY, EXT, inodes, named

# Some references are broken on purpose: block ids of every 31st document's chunks are unknown, ranges of every 37th are too long.
SEG = f"{V.CHUNKS}, seg AS (SELECT doc_id, path, chunk_no, CASE WHEN doc_id % 31 = 3 THEN reverse(block_id) ELSE block_id END AS block, CASE WHEN doc_id % 41 = 5 THEN 1::BIGINT ELSE 0::BIGINT END AS \"offset\", length + CASE WHEN doc_id % 37 = 4 THEN 7 ELSE 0 END AS length FROM chunks), blocks AS (SELECT block_id, max(length)::BIGINT AS raw_size, (max(length) * 3 // 4)::BIGINT AS stored_size, (min(doc_id) % 7)::TINYINT AS method FROM chunks GROUP BY block_id)"


def seg(spark, sf):
    """doc_id, path, chunk_no, block, offset, length of segments, some of them broken."""
    d = F.col("doc_id")
    return V.chunks(spark, sf).select(
        "doc_id", "path", "chunk_no", F.when(d % 31 == 3, F.reverse("block_id")).otherwise(F.col("block_id")).alias("block"), F.when(d % 41 == 5, 1).otherwise(0).cast("long").alias("offset"), (F.col("length") + F.when(d % 37 == 4, 7).otherwise(0)).alias("length")
    )


def block_index(spark, sf):
    """block_id, raw_size, stored_size, method of the distinct chunks."""
    return V.chunks(spark, sf).groupBy("block_id").agg(F.max("length").alias("raw_size"), F.expr("max(length) * 3 div 4").alias("stored_size"), F.expr("cast(min(doc_id) % 7 as tinyint)").alias("method"))


def entries(spark, sf):
    """Entries with nested segments, built from seg; sizes of every 43rd are wrong."""
    held = seg(spark, sf).groupBy("doc_id", "path").agg(F.array_sort(F.collect_list(F.struct("chunk_no", F.struct("block", "offset", "length", F.lit(None).cast("long").alias("zero")).alias("s")))).alias("a"))
    sizes = V.docs(spark, sf).select("doc_id", (F.col("size") + F.when(F.col("doc_id") % 43 == 6, 1).otherwise(0)).alias("size"))
    return held.join(sizes, "doc_id").select("doc_id", "path", F.lit("file").alias("type"), "size", F.col("a.s").alias("segments"))


@query("j1_segment_join", f"WITH {SEG} SELECT path, chunk_no, length, raw_size FROM seg JOIN blocks ON block = block_id")
def j1_segment_join(spark, sf):
    return seg(spark, sf).join(block_index(spark, sf), F.col("block") == F.col("block_id")).select("path", "chunk_no", "length", "raw_size")


@query("j2_missing_block", f"WITH {SEG} SELECT path, chunk_no, block FROM seg WHERE NOT EXISTS (SELECT 1 FROM blocks WHERE block_id = block)")
def j2_missing_block(spark, sf):
    return seg(spark, sf).join(block_index(spark, sf).select(F.col("block_id").alias("block")), "block", "left_anti").select("path", "chunk_no", "block")


@query("j3_bad_range", f"WITH {SEG} SELECT path, chunk_no FROM seg JOIN blocks ON block = block_id WHERE \"offset\" + length > raw_size")
def j3_bad_range(spark, sf):
    return seg(spark, sf).join(block_index(spark, sf), F.col("block") == F.col("block_id")).where(F.col("offset") + F.col("length") > F.col("raw_size")).select("path", "chunk_no")


@query("j4_first_occurrence", f"WITH {V.CHUNKS} SELECT block_id, doc_id, chunk_no FROM chunks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY doc_id, chunk_no) = 1")
def j4_first_occurrence(spark, sf):
    return K.first_occurrence(V.chunks(spark, sf), ["doc_id", "chunk_no"])


@query("j5_small_dup", f"WITH {V.DOCS}, d AS (SELECT doc_id, path, sha256(text) AS h FROM docs WHERE size <= 4096) SELECT d.path, f.path AS original FROM d JOIN (SELECT h, min(doc_id) AS first FROM d GROUP BY h) m USING (h) JOIN d f ON f.doc_id = m.first WHERE d.doc_id <> m.first")
def j5_small_dup(spark, sf):
    d = V.docs(spark, sf).where("size <= 4096").select("doc_id", "path", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    firsts = pinned(d.groupBy("h").agg(F.min(F.struct("doc_id", "path")).alias("f")))  # so that the join of a hot digest can be split
    return d.join(firsts, "h").where("doc_id <> f.doc_id").select("path", F.col("f.path").alias("original"))


@query("j6_hardlink", f"WITH {V.DOCS}, {INODES} SELECT path, first_value(path) OVER (PARTITION BY dev, inode ORDER BY doc_id) AS first FROM i WHERE nlink > 1")
def j6_hardlink(spark, sf):
    w = Window.partitionBy("dev", "inode").orderBy("doc_id")
    return inodes(spark, sf).where("nlink > 1").select("path", F.first("path").over(w).alias("first"))


_LINKS = "links AS (SELECT doc_id, path, CASE doc_id % 3 WHEN 0 THEN path WHEN 1 THEN upper(path) ELSE path || '/gone' END AS target FROM docs WHERE doc_id % 5 = 0)"


@query("j7_link_targets", f"WITH {V.DOCS}, {_LINKS} SELECT l.path, l.target FROM links l LEFT JOIN docs d ON lower(d.path) = lower(l.target) WHERE d.path IS NULL")
def j7_link_targets(spark, sf):
    d = V.docs(spark, sf)
    k, p = F.col("doc_id") % 3, F.col("path")
    links = d.where("doc_id % 5 = 0").select("path", F.when(k == 0, p).when(k == 1, F.upper(p)).otherwise(F.concat(p, F.lit("/gone"))).alias("target"))
    return links.withColumn("key", P.path_key(F.col("target"))).join(d.select(P.path_key(p).alias("key")), "key", "left_anti").select("path", "target")


_CONF = f"{V.DOCS}, e AS (SELECT path, 'file' AS type FROM docs UNION ALL SELECT path || '-b', 'file' FROM docs WHERE doc_id % 9 = 1 UNION ALL SELECT path || '/c', 'file' FROM docs WHERE doc_id % 9 IN (1, 2))"


def conflicting(spark, sf):
    """Entries of which some files have others below them, some with a key in between."""
    d = V.docs(spark, sf)
    f = F.lit("file").alias("type")
    return d.select("path", f).unionAll(d.where("doc_id % 9 = 1").select(F.concat("path", F.lit("-b")), f)).unionAll(d.where("doc_id % 9 in (1, 2)").select(F.concat("path", F.lit("/c")), f))


@query("j8_ancestor_conflict", f"WITH {_CONF}, a AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS above FROM e) SELECT a.path, a.above FROM a JOIN e ON lower(e.path) = lower(a.above) AND e.type = 'file'")
def j8_ancestor_conflict(spark, sf):
    e = conflicting(spark, sf)
    above = e.select("path", F.explode(P.ancestors(F.col("path"))).alias("above")).withColumn("key", P.path_key(F.col("above")))
    return above.join(e.where("type = 'file'").select(P.path_key(F.col("path")).alias("key")), "key").select("path", "above")


@query("j9_adjacent_conflict", f"WITH {_CONF}, k AS (SELECT path, lower(path) AS key, lead(lower(path)) OVER (ORDER BY lower(path)) AS next FROM e) SELECT path, key, next FROM k WHERE starts_with(next, key || '/')")
def j9_adjacent_conflict(spark, sf):
    return C.adjacent_conflicts(conflicting(spark, sf)).select("path", "key", "next")


@query("j10_manifest_check", f"WITH {V.DOCS}, m AS (SELECT path, CASE WHEN doc_id % 19 = 0 THEN 'bad' ELSE sha256(text) END AS digest FROM docs), a AS (SELECT path, sha256(text) AS digest FROM docs WHERE doc_id % 23 <> 0) SELECT m.path, CASE WHEN a.path IS NULL THEN 'missing' ELSE 'mismatch' END AS problem FROM m LEFT JOIN a USING (path) WHERE a.path IS NULL OR a.digest <> m.digest")
def j10_manifest_check(spark, sf):
    d = V.docs(spark, sf).withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    m = d.select("path", F.when(F.col("doc_id") % 19 == 0, "bad").otherwise(F.col("h")).alias("digest"))
    a = d.where("doc_id % 23 <> 0").select("path", F.col("h").alias("actual"))
    return m.join(a, "path", "left").where("actual is null or actual <> digest").select("path", F.when(F.col("actual").isNull(), "missing").otherwise("mismatch").alias("problem"))


@query("j11_roundtrip_diff", f"WITH {V.DOCS}, x AS (SELECT path, sha256(text) AS h FROM docs WHERE doc_id % 29 <> 1), y AS (SELECT path, CASE WHEN doc_id % 31 = 2 THEN 'other' ELSE sha256(text) END AS h FROM docs WHERE doc_id % 29 <> 2) SELECT coalesce(x.path, y.path) AS path, x.h IS NULL AS only_after, y.h IS NULL AS only_before FROM x FULL JOIN y ON x.path = y.path WHERE x.h IS DISTINCT FROM y.h")
def j11_roundtrip_diff(spark, sf):
    d = V.docs(spark, sf).withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    x = d.where("doc_id % 29 <> 1").select("path", F.col("h").alias("before"))
    y = d.where("doc_id % 29 <> 2").select("path", F.when(F.col("doc_id") % 31 == 2, "other").otherwise(F.col("h")).alias("after"))
    return x.join(y, "path", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("path", F.col("before").isNull().alias("only_after"), F.col("after").isNull().alias("only_before"))


@query("j12_positional", f"WITH {V.CHUNKS}, n AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY chunk_no) - 1 AS place, CASE WHEN doc_id % 53 = 7 THEN reverse(block_id) ELSE block_id END AS name, block_id FROM chunks) SELECT path, place, name, CASE WHEN name = block_id THEN 'ok' ELSE 'differs' END AS status FROM n")
def j12_positional(spark, sf):
    # names as an index holds them, a list for each path, against what is read from the contents, place by place
    broken = F.when(F.col("doc_id") % 53 == 7, F.reverse("block_id")).otherwise(F.col("block_id"))
    listed = V.chunks(spark, sf).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_no", broken.alias("name")))).alias("a"))
    names = listed.select("path", F.posexplode("a.name").alias("place", "name"))
    d = V.docs(spark, sf).select("path", F.col("text").cast("binary").alias("content"))
    found = G.fixed_chunks(d, V.PIECE).select("path", F.col("chunk_no").alias("place"), F.sha2("chunk", 256).alias("digest"))
    both = names.join(found, ["path", "place"])
    return both.select("path", F.col("place").cast("long").alias("place"), "name", F.when(F.col("name") == F.col("digest"), "ok").otherwise("differs").alias("status"))


@query("j16_method_names", f"WITH {SEG}, n AS (SELECT unnest(range(7))::TINYINT AS method, unnest(['raw', 'zlib', 'bz2', 'lzma', 'zstd', 'zero', 'xz']) AS name) SELECT name, count(*)::BIGINT AS blocks FROM blocks JOIN n USING (method) GROUP BY name")
def j16_method_names(spark, sf):
    names = spark.createDataFrame(list(enumerate(["raw", "zlib", "bz2", "lzma", "zstd", "zero", "xz"])), "method tinyint, name string")
    return block_index(spark, sf).join(F.broadcast(names), "method").groupBy("name").agg(F.count("*").alias("blocks"))  # seven rows


@query("j17_cross", "SELECT t.tool, c.case_name FROM (SELECT unnest(['tar', 'zip', 'native']) AS tool) t CROSS JOIN (SELECT DISTINCT event_type AS case_name FROM events) c")
def j17_cross(spark, sf):
    tools = spark.createDataFrame([("tar",), ("zip",), ("native",)], "tool string")
    return tools.crossJoin(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("case_name")).distinct())  # tools times kinds


@query("a1_total", f"WITH {V.TREE} SELECT sum(size)::BIGINT AS bytes FROM tree")
def a1_total(spark, sf):
    return V.tree(spark, sf).agg(F.sum("size").alias("bytes"))


@query("a2_raw_total", f"WITH {SEG} SELECT sum(raw_size)::BIGINT AS bytes, count(*)::BIGINT AS blocks FROM blocks")
def a2_raw_total(spark, sf):
    return block_index(spark, sf).agg(F.sum("raw_size").alias("bytes"), F.count("*").alias("blocks"))


@query("a3_checked_total", f"WITH {V.DOCS} SELECT sum(size)::BIGINT AS bytes, sum(size) > 1000000 AS over FROM docs")
def a3_checked_total(spark, sf):
    total = V.docs(spark, sf).agg(F.sum(F.col("size").cast("decimal(38,0)")).alias("t"))
    return total.select(F.col("t").cast("long").alias("bytes"), (F.col("t") > 1_000_000).alias("over"))


@query("a4_size_mismatch", f"WITH {SEG}, h AS (SELECT path, doc_id, sum(length)::BIGINT AS held FROM seg GROUP BY ALL) SELECT h.path, d.size + CASE WHEN h.doc_id % 43 = 6 THEN 1 ELSE 0 END AS size, held FROM h JOIN docs d USING (doc_id) WHERE held <> d.size + CASE WHEN h.doc_id % 43 = 6 THEN 1 ELSE 0 END")
def a4_size_mismatch(spark, sf):
    held = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["zero"], s["length"]))
    return entries(spark, sf).withColumn("held", held).where("held <> size").select("path", "size", "held")


@query("a5_stats", f"WITH {V.CHUNKS}, n AS (SELECT block_id, length, count(*) AS n FROM chunks GROUP BY ALL) SELECT count(*)::BIGINT AS blocks, sum(length)::BIGINT AS unique_raw, sum(length * (n - 1))::BIGINT AS dup_saved FROM n")
def a5_stats(spark, sf):
    n = V.chunks(spark, sf).groupBy("block_id", "length").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("blocks"), F.sum("length").alias("unique_raw"), F.sum(F.col("length") * (F.col("n") - 1)).alias("dup_saved"))


@query("a6_by_method", f"WITH {SEG} SELECT method, count(*)::BIGINT AS blocks, sum(raw_size)::BIGINT AS raw_bytes, sum(stored_size)::BIGINT AS stored_bytes FROM blocks GROUP BY method")
def a6_by_method(spark, sf):
    return K.by_method(block_index(spark, sf))


@query("a7_by_category", f"WITH {V.DOCS}, {NAMED}, e AS (SELECT size, {EXT} AS ext FROM named), g AS (SELECT {CATEGORY} AS category, sum(size)::BIGINT AS bytes FROM e GROUP BY 1) SELECT category, bytes, 100.0::DOUBLE * bytes / (sum(bytes) OVER ())::BIGINT AS share FROM g")
def a7_by_category(spark, sf):
    g = named(spark, sf).groupBy(P.category(F.col("path")).alias("category")).agg(F.sum("size").alias("bytes"))
    total = g.agg(F.sum("bytes").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("category", "bytes", (F.lit(100.0) * F.col("bytes") / F.col("t")).alias("share"))  # three rows and one


@query("a8_counts", f"WITH {V.DOCS} SELECT count(*) FILTER (doc_id % 4 = 0)::BIGINT AS dirs, count(*) FILTER (doc_id % 4 <> 0)::BIGINT AS files FROM docs")
def a8_counts(spark, sf):
    return V.docs(spark, sf).agg(F.count_if(F.col("doc_id") % 4 == 0).alias("dirs"), F.count_if(F.col("doc_id") % 4 != 0).alias("files"))


CAP_FILE, CAP_ALL = 4096, 500_000


@query("a9_sample_cap", f"WITH {V.DOCS}, s AS (SELECT doc_id, size, sum(least({CAP_FILE}, size)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - least({CAP_FILE}, size) AS prior FROM docs) SELECT doc_id, least(least({CAP_FILE}, size), greatest(0, {CAP_ALL} - prior))::BIGINT AS take FROM s")
def a9_sample_cap(spark, sf):
    d = V.docs(spark, sf).select("doc_id", "size", F.least(F.lit(CAP_FILE), F.col("size")).alias("want"))
    run = running_sum(d, [F.col("doc_id")], F.col("want"))
    return run.select("doc_id", F.least(F.col("want"), F.greatest(F.lit(0), F.lit(CAP_ALL) - (F.col("total") - F.col("want")))).cast("long").alias("take"))


@query("a11_median", "SELECT event_type, median(value) AS mid, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def a11_median(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("mid"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("a12_peak", "SELECT user_id, max(value) AS peak FROM events GROUP BY user_id")
def a12_peak(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.max("value").alias("peak"))


@query("a13_corpus_digest", f"WITH {V.DOCS} SELECT sha256(string_agg(path || ':' || sha256(text), chr(10) ORDER BY path)) AS digest, count(*)::BIGINT AS files FROM docs")
def a13_corpus_digest(spark, sf):
    return corpus_digest(V.docs(spark, sf).select("path", F.sha2(F.col("text").cast("binary"), 256).alias("digest")))


@query("a14_distinct", f"WITH {V.CHUNKS} SELECT lang, count(DISTINCT block_id)::BIGINT AS blocks, count(DISTINCT path)::BIGINT AS paths FROM chunks GROUP BY lang")
def a14_distinct(spark, sf):
    return V.chunks(spark, sf).groupBy("lang").agg(F.count_distinct("block_id").alias("blocks"), F.count_distinct("path").alias("paths"))


@query("a15_argmin", f"WITH {V.DOCS}, t AS (SELECT doc_id, unnest([0, 1, 2]) AS ord, unnest([size * 3 % 1009, size * 5 % 1009, size % 1009]) AS len FROM docs) SELECT doc_id, ord, len FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len, ord) = 1")
def a15_argmin(spark, sf):
    best = F.array_min(F.array(*[F.struct((F.col("size") * k % 1009).alias("len"), F.lit(o).alias("ord")) for o, k in enumerate((3, 5, 1))]))
    return V.docs(spark, sf).select("doc_id", best.alias("b")).select("doc_id", "b.ord", "b.len")


@query("a16_any_all", f"WITH {V.DOCS} SELECT source, bool_or(doc_id % 97 = 0) AS some, bool_and(size > 20) AS every FROM docs GROUP BY source")
def a16_any_all(spark, sf):
    return V.docs(spark, sf).groupBy("source").agg(F.bool_or(F.col("doc_id") % 97 == 0).alias("some"), F.bool_and(F.col("size") > 20).alias("every"))


@query("a17_recovery_memory", f"WITH {V.CHUNKS} SELECT (count(*) FILTER (doc_id % 17 = 0) * {V.PIECE})::BIGINT AS needed, count(*) FILTER (doc_id % 17 = 0) * {V.PIECE} <= 536870912 AS fits FROM chunks")
def a17_recovery_memory(spark, sf):
    n = V.chunks(spark, sf).agg((F.count_if(F.col("doc_id") % 17 == 0) * V.PIECE).alias("needed"))
    return n.select("needed", (F.col("needed") <= 512 << 20).alias("fits"))


@query("a18_control_count", f"WITH {V.DOCS} SELECT doc_id, len(regexp_extract_all(text, '[\\x00-\\x1f]'))::INTEGER AS n FROM docs")
def a18_control_count(spark, sf):
    return V.docs(spark, sf).select("doc_id", F.regexp_count("text", F.lit(r"[\x00-\x1f]")).alias("n"))


SMALL = f"{V.DOCS}, small AS (SELECT lang, doc_id, path, size, text FROM docs WHERE size <= 4096)"
PACK_LIMIT = 32768
_PACKED = f"""WITH RECURSIVE {SMALL}, o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM small),
p AS (SELECT lang, doc_id, text, size, rn, 0::BIGINT AS block, 0::BIGINT AS "offset", size AS n FROM o WHERE rn = 1
 UNION ALL SELECT o.lang, o.doc_id, o.text, o.size, o.rn, CASE WHEN p.n + o.size > {PACK_LIMIT} OR p.n >= {PACK_LIMIT} THEN p.block + 1 ELSE p.block END, CASE WHEN p.n + o.size > {PACK_LIMIT} OR p.n >= {PACK_LIMIT} THEN 0 ELSE p.n END,
  CASE WHEN p.n + o.size > {PACK_LIMIT} OR p.n >= {PACK_LIMIT} THEN o.size ELSE p.n + o.size END FROM p JOIN o ON o.lang = p.lang AND o.rn = p.rn + 1)"""


def packed(spark, sf):
    return S.solid_pack(V.docs(spark, sf).where("size <= 4096").select("lang", "doc_id", "size"), ["lang"], ["doc_id"], "size", PACK_LIMIT)


@query("w8_solid_pack", f"{_PACKED} SELECT lang, doc_id, block, \"offset\" FROM p")
def w8_solid_pack(spark, sf):
    return packed(spark, sf).select("lang", "doc_id", "block", "offset")


@query("a19_solid_blocks", f"{_PACKED} SELECT lang, block, sha256(string_agg(text, '' ORDER BY \"offset\", doc_id)) AS block_id FROM p GROUP BY lang, block")
def a19_solid_blocks(spark, sf):
    content = V.docs(spark, sf).select("doc_id", F.col("text").cast("binary").alias("content"))
    members = packed(spark, sf).select("lang", "doc_id", "block", "offset").join(content, "doc_id")
    return S.concatenated(members, ["lang", "block"]).select("lang", "block", F.sha2("content", 256).alias("block_id"))


@query("a20_file_stats", f"WITH {V.TREE} SELECT string_split(path, '/')[1] AS top, sum(size)::BIGINT AS input_bytes, count(*)::BIGINT AS input_files FROM tree GROUP BY 1")
def a20_file_stats(spark, sf):
    return V.tree(spark, sf).groupBy(F.element_at(F.split("path", "/"), 1).alias("top")).agg(F.sum("size").alias("input_bytes"), F.count("*").alias("input_files"))


@query("w2_first_per_inode", f"WITH {V.DOCS}, {INODES} SELECT dev, inode, min(doc_id) AS doc_id FROM i GROUP BY dev, inode")
def w2_first_per_inode(spark, sf):
    return inodes(spark, sf).groupBy("dev", "inode").agg(F.min("doc_id").alias("doc_id"))


@query("w3_running", f"WITH {V.DOCS} SELECT doc_id, (sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS completed FROM docs")
def w3_running(spark, sf):
    return running_sum(V.docs(spark, sf).select("doc_id", "size"), [F.col("doc_id")], F.col("size")).select("doc_id", F.col("total").alias("completed"))


@query("w4_logical_offset", f"WITH {SEG} SELECT path, chunk_no, (sum(length) OVER (PARTITION BY path ORDER BY chunk_no) - length)::BIGINT AS at FROM seg")
def w4_logical_offset(spark, sf):
    w = Window.partitionBy("path").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return seg(spark, sf).select("path", "chunk_no", (F.sum("length").over(w) - F.col("length")).alias("at"))


@query("w6_record_offset", f"WITH {SEG} SELECT block_id, (41 + sum(50 + stored_size) OVER (ORDER BY block_id ROWS UNBOUNDED PRECEDING) - stored_size)::BIGINT AS \"offset\" FROM blocks")
def w6_record_offset(spark, sf):
    return K.record_offsets(block_index(spark, sf), [F.col("block_id")]).select("block_id", "offset")


@query("w7_adjacent_pairs", f"WITH {V.DOCS} SELECT path, lead(path) OVER (PARTITION BY source ORDER BY path) AS next FROM docs")
def w7_adjacent_pairs(spark, sf):
    d = with_next(V.docs(spark, sf).select("source", "path"), [F.col("source"), F.col("path")], ["source", "path"])
    return d.select("path", F.when(F.col("next_source") == F.col("source"), F.col("next_path")).alias("next"))


@query("w9_share", f"WITH {V.DOCS}, g AS (SELECT lang, sum(size)::BIGINT AS bytes FROM docs GROUP BY lang) SELECT lang, bytes, (sum(bytes) OVER ())::BIGINT AS total FROM g")
def w9_share(spark, sf):
    g = V.docs(spark, sf).groupBy("lang").agg(F.sum("size").alias("bytes"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("bytes").alias("total"))))  # one row


@query("o1_tree_sort", f"WITH {V.DOCS} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM docs")
def o1_tree_sort(spark, sf):
    return ranked(V.docs(spark, sf).select("path"), [F.split("path", "/")])


@query("o3_key_sort", f"WITH {V.DOCS} SELECT lower(path) AS key, row_number() OVER (ORDER BY lower(path)) AS place FROM docs")
def o3_key_sort(spark, sf):
    return ranked(V.docs(spark, sf).select(P.path_key(F.col("path")).alias("key")), [F.col("key")])


@query("o4_method_sort", f"WITH {SEG} SELECT method, count(*)::BIGINT AS n, row_number() OVER (ORDER BY method) AS place FROM blocks GROUP BY method")
def o4_method_sort(spark, sf):
    return ranked(block_index(spark, sf).groupBy("method").agg(F.count("*").alias("n")), [F.col("method")])


@query("o5_deepest_first", f"WITH {V.TREE}, d AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:-2], '/') AS dir FROM tree) SELECT dir, row_number() OVER (ORDER BY dir DESC) AS place FROM d")
def o5_deepest_first(spark, sf):
    return ranked(V.tree(spark, sf).select(P.parent(F.col("path")).alias("dir")).distinct(), [F.desc("dir")])


_PHASE = "CASE doc_id % 4 WHEN 0 THEN 'directory' WHEN 1 THEN 'symlink' WHEN 2 THEN 'hardlink' ELSE 'file' END"


@query("o6_phase_order", f"WITH {V.DOCS}, t AS (SELECT doc_id, {_PHASE} AS type FROM docs) SELECT doc_id, type, CASE type WHEN 'directory' THEN 0 WHEN 'file' THEN 1 WHEN 'hardlink' THEN 2 ELSE 3 END AS phase, row_number() OVER (ORDER BY CASE type WHEN 'directory' THEN 0 WHEN 'file' THEN 1 WHEN 'hardlink' THEN 2 ELSE 3 END, doc_id) AS place FROM t")
def o6_phase_order(spark, sf):
    t = V.docs(spark, sf).select("doc_id", F.expr(_PHASE).alias("type"))
    phase = F.when(F.col("type") == "directory", 0).when(F.col("type") == "file", 1).when(F.col("type") == "hardlink", 2).otherwise(3)
    return ranked(t.withColumn("phase", phase), [F.col("phase"), F.col("doc_id")])


@query("o7_top300", f"WITH {V.DOCS} SELECT path FROM docs WHERE contains(path, '1') ORDER BY path LIMIT 300")
def o7_top300(spark, sf):
    return V.docs(spark, sf).where(F.contains("path", F.lit("1"))).select("path").orderBy("path").limit(300)


@query("o8_bounded_read", f"WITH {V.DOCS} SELECT doc_id, least(size, 4097)::BIGINT AS read, size > 4096 AS over FROM docs")
def o8_bounded_read(spark, sf):
    piece = F.substring(F.col("text").cast("binary"), 1, 4097)
    return V.docs(spark, sf).select("doc_id", F.octet_length(piece).cast("long").alias("read"), (F.octet_length(piece) > 4096).alias("over"))


@query("o9_newest_first", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def o9_newest_first(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(100)


@query("u1_collision", f"WITH {V.ODD} SELECT lower(rtrim(path, '/')) AS key, count(*)::BIGINT AS n FROM odd GROUP BY 1 HAVING count(*) > 1")
def u1_collision(spark, sf):
    return V.odd_paths(spark, sf).groupBy(P.path_key(F.col("path")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query("u2_distinct_blocks", f"WITH {V.CHUNKS} SELECT DISTINCT block_id FROM chunks")
def u2_distinct_blocks(spark, sf):
    return V.chunks(spark, sf).select("block_id").distinct()


@query("u3_segment_union", f"WITH {V.DOCS} SELECT doc_id, 'solid' AS kind, size AS length FROM docs WHERE size <= 4096 UNION ALL SELECT doc_id, 'chunk', size FROM docs WHERE size > 4096 UNION ALL SELECT doc_id, 'zero', doc_id % 50 FROM docs WHERE doc_id % 13 = 1")
def u3_segment_union(spark, sf):
    d = V.docs(spark, sf)
    one = lambda when, kind, length: d.where(when).select("doc_id", F.lit(kind).alias("kind"), length.alias("length"))
    return one("size <= 4096", "solid", F.col("size")).unionByName(one("size > 4096", "chunk", F.col("size"))).unionByName(one("doc_id % 13 = 1", "zero", F.col("doc_id") % 50))


@query("u4_except", "SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_suppkey % 3 <> 0 EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000")
def u4_except(spark, sf):
    want = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_suppkey % 3 <> 0").select(F.col("l_suppkey").alias("k")).distinct()
    return want.join(spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k")), "k", "left_anti")


@query("u5_set_equality", f"WITH {V.DOCS}, x AS (SELECT source, sha256(text) AS h FROM docs), y AS (SELECT source, CASE WHEN doc_id = 7 THEN 'other' ELSE sha256(text) END AS h FROM docs) SELECT count(*)::BIGINT AS different FROM ((SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL (SELECT * FROM y EXCEPT ALL SELECT * FROM x))")
def u5_set_equality(spark, sf):
    d = V.docs(spark, sf).withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    x, y = d.select("source", "h"), d.select("source", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("h")).alias("h"))
    return x.exceptAll(y).unionAll(y.exceptAll(x)).agg(F.count("*").alias("different"))


@query("u6_concat_kinds", f"WITH {V.DOCS}, t AS (SELECT doc_id, {_PHASE} AS type FROM docs) SELECT type, count(*)::BIGINT AS n FROM t GROUP BY type")
def u6_concat_kinds(spark, sf):
    t = V.docs(spark, sf).select("doc_id", F.expr(_PHASE).alias("type"))
    parts = [t.where(F.col("type") == k) for k in ("directory", "file", "hardlink", "symlink")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("type").agg(F.count("*").alias("n"))


CDC = (256, 4096, 10)


def _cdc_sql(source: str, least: int, most: int, bits: int) -> str:
    """source: a relation `s` with columns k and t (text)."""
    gear = ", ".join(f"{g}::UHUGEINT" for g in G.GEAR)
    m = "18446744073709551615::UHUGEINT"
    nxt = f"((((a.f << 1) | (a.f >> 63)) & {m}) + x.f) & {m}"
    zero = "0::UHUGEINT"
    return f"""WITH {source}, g AS (SELECT [{gear}] AS gear),
b AS (SELECT k, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda y: {{'n': 0::BIGINT, 'f': gear[('0x' || y)::INT + 1], 'cuts': []::BIGINT[]}}) AS bytes FROM s, g),
r AS (SELECT k, list_reduce(list_prepend({{'n': 0::BIGINT, 'f': {zero}, 'cuts': []::BIGINT[]}}, bytes), lambda a, x: CASE WHEN a.n + 1 >= {least} AND (({nxt}) & {(1 << bits) - 1}::UHUGEINT = {zero} OR a.n + 1 >= {most})
 THEN {{'n': 0::BIGINT, 'f': {zero}, 'cuts': list_append(a.cuts, a.n + 1)}} ELSE {{'n': a.n + 1, 'f': {nxt}, 'cuts': a.cuts}} END) AS z FROM b),
c AS (SELECT k, CASE WHEN z.n > 0 THEN list_append(z.cuts, z.n) ELSE z.cuts END AS cuts FROM r)
SELECT k, unnest(range(len(cuts)))::INTEGER AS chunk_no, unnest(list_transform(range(len(cuts)), lambda i: coalesce(list_sum(cuts[1:i]), 0)))::BIGINT AS "offset", unnest(cuts)::BIGINT AS length FROM c"""


@query("g1_cdc_scaled", _cdc_sql(f"{V.DOCS}, s AS (SELECT doc_id AS k, text AS t FROM docs)", *CDC))
def g1_cdc_scaled(spark, sf):
    d = V.docs(spark, sf).select(F.col("doc_id").alias("k"), F.col("text").cast("binary").alias("content"))
    return G.content_chunks(d, ["k"], "content", *CDC).select("k", "chunk_no", "offset", "length")


@query("g1_cdc_stream", _cdc_sql(f"{V.DOCS}, s AS (SELECT doc_id // 5000 AS k, string_agg(text, chr(10) ORDER BY doc_id) AS t FROM docs GROUP BY 1)", 64 << 10, 1 << 20, 18))
def g1_cdc_stream(spark, sf):
    # streams of 5,000 documents, so that the longest chunk is met; a stream is cut in order, so its length bounds a task
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    d = V.docs(spark, sf).groupBy(F.expr("doc_id div 5000").alias("k")).agg(F.array_join(texts, "\n").cast("binary").alias("content"))
    return G.content_chunks(d, ["k"]).select("k", "chunk_no", "offset", "length")


@query("g2_fixed_chunks", f"WITH {V.CHUNKS} SELECT path, chunk_no::INTEGER AS chunk_no, \"offset\", length, block_id FROM chunks")
def g2_fixed_chunks(spark, sf):
    d = V.docs(spark, sf).select("path", F.col("text").cast("binary").alias("content"))
    return G.fixed_chunks(d, V.PIECE).select("path", "chunk_no", "offset", "length", F.sha2("chunk", 256).alias("block_id"))


@query("g4_explode", f"WITH {SEG} SELECT path, chunk_no::INTEGER AS seg_no, block, \"offset\", length FROM seg")
def g4_explode(spark, sf):
    return C.segments(entries(spark, sf)).select("path", "seg_no", "block", "offset", "length")


@query("g5_zero_extents", f"WITH {V.DOCS} SELECT doc_id, 'hole' AS kind, 0::BIGINT AS \"offset\", doc_id % 50 + 10 AS length FROM docs UNION ALL SELECT doc_id, 'data', doc_id % 50 + 10, size FROM docs WHERE size > 0")
def g5_zero_extents(spark, sf):
    d = V.docs(spark, sf).select("doc_id", F.concat(F.repeat(F.expr("X'00'"), (F.col("doc_id") % 50 + 10).cast("int")), F.col("text").cast("binary")).cast("binary").alias("b"))
    return d.lateralJoin(G.ZeroExtents(F.col("b").outer(), F.lit(10))).select("doc_id", "kind", "offset", "length")


@query("g6_ancestors", f"WITH {V.DOCS} SELECT path, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS above FROM docs")
def g6_ancestors(spark, sf):
    return V.docs(spark, sf).select("path", F.explode(P.ancestors(F.col("path"))).alias("above"))


def _rule(rule: str, subject: str = "subject", detail: str = "detail") -> str:
    return f"'{rule}' AS rule, {subject} AS subject, ({detail})::VARCHAR AS detail"


@query("r3_block_cap", f"WITH {SEG}, x AS (SELECT block_id, raw_size * 40000 AS raw_size FROM blocks) SELECT {_rule('R3', 'block_id', 'raw_size')} FROM x WHERE raw_size > 33554432")
def r3_block_cap(spark, sf):
    big = block_index(spark, sf).withColumn("raw_size", F.col("raw_size") * 40000)
    return C.block_rules(big).where("rule = 'R3'")


@query("r4_block_place", f"WITH {SEG}, x AS (SELECT block_id, stored_size, 41 + sum(50 + stored_size) OVER (ORDER BY block_id ROWS UNBOUNDED PRECEDING) - stored_size AS place FROM blocks) SELECT {_rule('R4', 'block_id', 'place::BIGINT')} FROM x WHERE place + stored_size > 100000")
def r4_block_place(spark, sf):
    return C.block_rules(K.record_offsets(block_index(spark, sf), [F.col("block_id")]), 100_000).where("rule = 'R4'")


@query("r5_unique_blocks", f"WITH {V.CHUNKS} SELECT {_rule('R5', 'block_id', 'count(*)')} FROM chunks GROUP BY block_id HAVING count(*) > 1")
def r5_unique_blocks(spark, sf):
    every = V.chunks(spark, sf).select("block_id", F.col("length").alias("raw_size"), F.col("length").alias("stored_size"))
    return C.block_rules(every).where("rule = 'R5'")


@query("r1_r2_header", f"WITH {V.DOCS}, h AS (SELECT doc_id, (doc_id % 5)::INTEGER AS version, doc_id % 2 = 1 AS enc, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 65536 END AS mem, 67108860 + doc_id % 7 AS raw, CASE WHEN doc_id % 11 = 3 THEN 67109889 ELSE 90 END AS stored FROM docs) SELECT 'R1' AS rule, 'header' AS subject, version::VARCHAR AS detail, count(*)::BIGINT AS n FROM h WHERE version NOT IN (2, 3) GROUP BY version UNION ALL SELECT 'R2', 'header', 'key derivation settings', count(*)::BIGINT FROM h WHERE (enc AND mem = 0) OR (NOT enc AND mem <> 0) UNION ALL SELECT 'R6', 'header', raw::VARCHAR, count(*)::BIGINT FROM h WHERE raw > 67108864 OR stored > 67109888 GROUP BY raw")
def r1_r2_header(spark, sf):
    mem = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(65536)
    other = lambda v: F.when(F.col("doc_id") % 3 == 0, 0).otherwise(v)
    raw, stored = F.lit(67108860) + F.col("doc_id") % 7, F.when(F.col("doc_id") % 11 == 3, 67109889).otherwise(90)
    h = V.docs(spark, sf).select((F.col("doc_id") % 5).cast("int").alias("version"), (F.col("doc_id") % 2 == 1).alias("encrypted"), mem.alias("kdf_memory_kib"), other(3).alias("kdf_iterations"), other(1).alias("kdf_lanes"), raw.alias("manifest_raw_size"), stored.alias("manifest_stored_size"))
    return C.header_rules(h).groupBy("rule", "subject", "detail").agg(F.count("*").alias("n"))


@query("r10_limits", f"WITH {V.DOCS}, p AS (SELECT repeat(path, (doc_id % 4000 * 20)::INT) AS path FROM docs) SELECT {_rule('R10', 'substr(path, 1, 80)', 'strlen(path)')} FROM p WHERE strlen(path) > 65536")
def r10_limits(spark, sf):
    long = V.docs(spark, sf).select(F.repeat("path", (F.col("doc_id") % 4000 * 20).cast("int")).alias("path"), F.lit("file").alias("type"), F.lit(None).cast("string").alias("target"))
    return C.path_rules(long).where("rule = 'R10'")


@query("r11_safe_paths", f"WITH {V.ODD} SELECT {_rule('R11', 'path', chr(39) + 'unsafe path' + chr(39))} FROM odd WHERE doc_id % 23 IN (1, 2, 3, 4, 5, 6, 7, 9, 10, 13, 14, 15)")
def r11_safe_paths(spark, sf):
    e = V.odd_paths(spark, sf).select("path", F.lit("file").alias("type"), F.lit(None).cast("string").alias("target"))
    return C.path_rules(e).where("rule = 'R11'")


@query("r13_expansion", f"WITH {V.DOCS} SELECT {_rule('R13', chr(39) + 'entries' + chr(39), 'sum(size)')} FROM docs HAVING sum(size) > 100000")
def r13_expansion(spark, sf):
    return C.total_rules(V.docs(spark, sf).withColumn("type", F.lit("file")), 100_000).where("rule = 'R13'")


@query("r15_r16_segments", f"WITH {SEG}, j AS (SELECT seg.*, raw_size FROM seg LEFT JOIN blocks ON block = block_id) SELECT CASE WHEN raw_size IS NULL THEN 'R15' ELSE 'R16' END AS rule, path || '#' || chunk_no AS subject, block AS detail FROM j WHERE raw_size IS NULL OR \"offset\" + length > raw_size")
def r15_r16_segments(spark, sf):
    return C.segment_rules(entries(spark, sf), block_index(spark, sf)).where("rule in ('R15', 'R16')")


@query("r17_size_sum", f"WITH {SEG}, h AS (SELECT doc_id, path, sum(length) AS held FROM seg GROUP BY ALL) SELECT {_rule('R17', 'h.path', 'held')} FROM h JOIN docs d USING (doc_id) WHERE held <> d.size + CASE WHEN h.doc_id % 43 = 6 THEN 1 ELSE 0 END")
def r17_size_sum(spark, sf):
    return C.segment_rules(entries(spark, sf), block_index(spark, sf)).where("rule = 'R17'")


@query("r18_r20_types", f"WITH {V.DOCS}, t AS (SELECT path, CASE doc_id % 5 WHEN 0 THEN 'fifo' WHEN 1 THEN 'symlink' ELSE 'file' END AS type FROM docs) SELECT CASE type WHEN 'fifo' THEN 'R18' ELSE 'R20' END AS rule, path AS subject, type AS detail FROM t WHERE type <> 'file'")
def r18_r20_types(spark, sf):
    k = F.col("doc_id") % 5
    e = V.docs(spark, sf).select("path", F.when(k == 0, "fifo").when(k == 1, "symlink").otherwise("file").alias("type"), F.lit(None).cast("string").alias("target"))
    return C.path_rules(e).where("rule in ('R18', 'R20')")


@query("r19_rehash", f"WITH {V.CHUNKS} SELECT block_id AS subject, min(doc_id) AS doc_id FROM chunks WHERE doc_id % 53 = 7 GROUP BY block_id")
def r19_rehash(spark, sf):
    # the stored ids of all documents, those of some broken, are a table of their own; contents are read and hashed again
    broken = F.when(F.col("doc_id") % 53 == 7, F.reverse("block_id")).otherwise(F.col("block_id"))
    stored = pinned(V.chunks(spark, sf).select("doc_id", "chunk_no", broken.alias("stored")))
    d = V.docs(spark, sf).select("doc_id", F.col("text").cast("binary").alias("content"))
    b = G.fixed_chunks(d, V.PIECE).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.sha2("chunk", 256).alias("subject"))
    return b.join(stored, ["doc_id", "chunk_no"]).where("subject <> stored").groupBy("subject").agg(F.min("doc_id").alias("doc_id"))


@query("r23_inside_root", f"WITH {V.ODD} SELECT doc_id, NOT (starts_with(path, '/') OR starts_with(path, '../')) AS inside FROM odd")
def r23_inside_root(spark, sf):
    return V.odd_paths(spark, sf).select("doc_id", P.inside_root(F.col("path")).alias("inside"))


@query("r27_id_sizes", f"WITH {V.CHUNKS}, x AS (SELECT left(block_id, 3) AS block_id, length FROM chunks) SELECT {_rule('R27', 'block_id', 'count(DISTINCT length)')} FROM x GROUP BY block_id HAVING count(DISTINCT length) > 1")
def r27_id_sizes(spark, sf):
    cut = V.chunks(spark, sf).select(F.left("block_id", F.lit(3)).alias("block_id"), F.col("length").alias("raw_size"), F.col("length").alias("stored_size"))
    return C.block_rules(cut).where("rule = 'R27'")


@query("t4_progress_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS phase, sum(event_id)::BIGINT AS completed, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def t4_progress_windows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    g = e.groupBy(F.window(F.col("ts"), "1 hour").alias("w"), F.col("event_type").alias("phase")).agg(F.sum("event_id").alias("completed"), F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "phase", "completed", "n")
