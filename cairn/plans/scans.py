"""Queries: sources, filters and functions over the virtual file tree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import binary as B
from cairn.functions import formats as X
from cairn.functions import paths as P
from cairn.operators import blocks as K
from cairn.operators import chunking as G
from cairn.operators.order import pinned, ranked
from cairn.plans import vfs as V
from cairn.plans.registry import query


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


CATEGORY = f"CASE WHEN ext IN ({_list(P.TEXT_EXTENSIONS)}) THEN 'text' WHEN ext IN ({_list(P.COMPRESSED_EXTENSIONS)}) THEN 'compressed' ELSE 'binary' END"
EXT = "lower(regexp_extract(list_extract(string_split(path, '/'), -1), '^.+?(\\.[^.]+)$', 1))"


@query("m1_dedup_report", f"WITH {V.CHUNKS}, f AS (SELECT block_id, min({{'d': doc_id, 'c': chunk_no}}) AS a FROM chunks GROUP BY block_id) SELECT lang, count(*)::BIGINT AS chunks, sum(length)::BIGINT AS raw_bytes, count(f.block_id)::BIGINT AS unique_blocks, coalesce(sum(CASE WHEN f.block_id IS NOT NULL THEN length END), 0)::BIGINT AS unique_bytes FROM chunks c LEFT JOIN f ON f.block_id = c.block_id AND f.a.d = c.doc_id AND f.a.c = c.chunk_no GROUP BY lang")
def m1_dedup_report(spark, sf):
    return K.dedup_stats(V.chunks(spark, sf), ["lang"], ["doc_id", "chunk_no"])


@query("s1_tree_order", f"WITH {V.TREE}, dirs AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path, 'directory' AS type, 0::BIGINT AS size FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')))) AS i FROM tree)), a AS (SELECT path, 'file' AS type, size FROM tree UNION ALL SELECT * FROM dirs) SELECT path, type, size, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM a")
def s1_tree_order(spark, sf):
    files = V.tree(spark, sf).select("path", F.lit("file").alias("type"), "size")
    dirs = files.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct().select("path", F.lit("directory"), F.lit(0).cast("long"))
    return ranked(files.unionAll(dirs), [F.split("path", "/")])


@query("s2_walk_order", f"WITH {V.DOCS}, a AS (SELECT path, array_to_string(string_split(path, '/')[1:-2], '/') AS parent, list_extract(string_split(path, '/'), -1) AS name FROM docs) SELECT path, row_number() OVER (PARTITION BY parent ORDER BY name) AS place FROM a")
def s2_walk_order(spark, sf):
    d = V.docs(spark, sf).select("path", P.parent(F.col("path")).alias("parent"), P.basename(F.col("path")).alias("name"))
    all_ = pinned(ranked(d, [F.col("parent"), F.col("name")], "at"))
    firsts = pinned(all_.groupBy("parent").agg(F.min("at").alias("first")))
    return all_.join(firsts, "parent").select("path", (F.col("at") - F.col("first") + 1).alias("place"))


@query("s3_files_only", f"WITH {V.TREE} SELECT path, size FROM tree WHERE size > 0")
def s3_files_only(spark, sf):
    return V.tree(spark, sf).where("size > 0").select("path", "size")


@query("s6_magic_sniff", f"WITH {V.BLOBS} SELECT doc_id, CASE WHEN hex(b)[1:16] = '53504B330D0A1A0A' THEN 3 WHEN hex(b)[1:16] = '53504B320D0A1A0A' THEN 2 END::INTEGER AS version FROM blobs")
def s6_magic_sniff(spark, sf):
    return V.blobs(spark, sf).select("doc_id", B.container_version(F.col("b")).alias("version"))


@query("s7_requires_password", f"WITH {V.BLOBS} SELECT doc_id, hex(b)[1:16] = '53504B330D0A1A0A' AND hex(b)[25:26] = '01' AS locked FROM blobs")
def s7_requires_password(spark, sf):
    return V.blobs(spark, sf).select("doc_id", B.requires_password(F.col("b")).alias("locked"))


@query("s10_sidecar_json", f"WITH {V.DOCS} SELECT path, sha256(text) AS sha256, size FROM docs")
def s10_sidecar_json(spark, sf):
    row = F.to_json(F.struct("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "size"))
    return V.docs(spark, sf).select(F.from_json(row, "path string, sha256 string, size long").alias("r")).select("r.*")


@query("s11_digest_lines", f"WITH {V.DOCS} SELECT path, sha256(text) AS sha256 FROM docs")
def s11_digest_lines(spark, sf):
    lines = V.docs(spark, sf).select(F.concat_ws("  ", F.sha2(F.col("text").cast("binary"), 256), "path").alias("value"))
    pattern = r"^([0-9a-f]{64})  (.+)$"
    return lines.where(~F.startswith("value", F.lit("#"))).select(F.regexp_extract("value", pattern, 2).alias("path"), F.regexp_extract("value", pattern, 1).alias("sha256"))


@query("s12_small_files", f"WITH {V.DOCS} SELECT path, size FROM docs WHERE size <= 4096")
def s12_small_files(spark, sf):
    return V.docs(spark, sf).where("size <= 4096").select("path", "size")


@query("s15_file_hashes", f"WITH {V.TREE} SELECT path, sha256(text) AS sha256 FROM tree")
def s15_file_hashes(spark, sf):
    return V.tree(spark, sf).select("path", B.sha256(F.col("text").cast("binary")).alias("sha256"))


@query("k10_listing", f"WITH {V.DOCS} SELECT 'file' || chr(9) || size || chr(9) || path AS line FROM docs")
def k10_listing(spark, sf):
    return V.docs(spark, sf).select(F.concat_ws("\t", F.lit("file"), F.col("size").cast("string"), "path").alias("line"))


@query("k11_zeros", f"WITH {V.DOCS} SELECT doc_id, sha256(unhex(repeat('00', (doc_id % 97)::INT))) AS sha256 FROM docs")
def k11_zeros(spark, sf):
    return V.docs(spark, sf).select("doc_id", F.sha2(F.repeat(F.expr("X'00'"), (F.col("doc_id") % 97).cast("int")), 256).alias("sha256"))


@query("f1_skip_links", f"WITH {V.DOCS} SELECT path FROM docs WHERE NOT (doc_id % 7 = 0) AND path <> 'documents/en/src0/1.txt'")
def f1_skip_links(spark, sf):
    d = V.docs(spark, sf).withColumn("type", F.when(F.col("doc_id") % 7 == 0, "symlink").otherwise("file"))
    return d.where("type <> 'symlink' and path <> 'documents/en/src0/1.txt'").select("path")


@query("f2_unsupported", f"WITH {V.DOCS} SELECT path, CASE doc_id % 11 WHEN 3 THEN 'fifo' WHEN 5 THEN 'socket' END AS skipped FROM docs WHERE doc_id % 11 IN (3, 5)")
def f2_unsupported(spark, sf):
    k = F.col("doc_id") % 11
    d = V.docs(spark, sf).withColumn("type", F.when(k == 3, "fifo").when(k == 5, "socket").otherwise("file"))
    return d.where(~F.col("type").isin("file", "directory", "symlink")).select("path", F.col("type").alias("skipped"))


def _safe_sql(bare: str, controls: str) -> str:
    return f"""{bare} <> '' AND NOT starts_with(path, '/') AND NOT contains(path, '\\') AND NOT contains(path, chr(0))
 AND len(list_filter(string_split({bare}, '/'), lambda p: p IN ('', '.', '..') OR regexp_matches(p, '[. ]$') OR regexp_matches(p, '[{controls}<>:"|?*]') OR upper(string_split(p, '.')[1]) IN ({_list(P.DEVICES)}))) = 0"""


@query("f3_safe_path", f"WITH {V.ODD}, o AS (SELECT *, regexp_replace(path, '/$', '') AS bare FROM odd) SELECT doc_id, path, {_safe_sql('bare', chr(92) + 'x00-' + chr(92) + 'x1f' + chr(92) + 'x7f')} AS safe FROM o")
def f3_safe_path(spark, sf):
    return V.odd_paths(spark, sf).select("doc_id", "path", P.safe_path(F.col("path")).alias("safe"))


@query("f4_safe_path_v2", f"WITH {V.ODD} SELECT doc_id, path, {_safe_sql('path', chr(92) + 'x00-' + chr(92) + 'x1f')} AS safe FROM odd")
def f4_safe_path_v2(spark, sf):
    return V.odd_paths(spark, sf).select("doc_id", "path", P.safe_path(F.col("path"), 2).alias("safe"))


_TARGETS = ("../x", "../../../x", "../../../../x", "/x", "C:x", "a\\b", "a/../../b", "", "./y", "../../z/../../../w/../../..")


@query("f5_link_target", f"WITH {V.DOCS}, t AS (SELECT doc_id, path, [{_list(_TARGETS)}][doc_id % {len(_TARGETS)} + 1] AS target FROM docs), w AS (SELECT *, list_reduce(list_prepend({{'d': len(string_split(path, '/')) - 1, 'm': len(string_split(path, '/')) - 1, 'p': ''}}, list_transform(string_split(target, '/'), lambda p: {{'d': 0::BIGINT, 'm': 0::BIGINT, 'p': p}})), lambda a, x: CASE WHEN x.p = '..' THEN {{'d': a.d - 1, 'm': least(a.m, a.d - 1), 'p': ''}} WHEN x.p IN ('', '.') THEN a ELSE {{'d': a.d + 1, 'm': a.m, 'p': ''}} END) AS r FROM t) SELECT doc_id, target, target <> '' AND NOT regexp_matches(target, '[\\\\:\\x00-\\x1f]') AND NOT starts_with(target, '/') AND r.m >= 0 AS safe FROM w")
def f5_link_target(spark, sf):
    d = V.docs(spark, sf).withColumn("target", F.get(F.array(*[F.lit(t) for t in _TARGETS]), (F.col("doc_id") % len(_TARGETS)).cast("int")))
    return d.select("doc_id", "target", P.safe_link_target(F.col("path"), F.col("target")).alias("safe"))


@query("f6_small_file", f"WITH {V.DOCS} SELECT doc_id, size <= 4096 AS small, size <= 262144 AS small_v2 FROM docs")
def f6_small_file(spark, sf):
    return V.docs(spark, sf).select("doc_id", (F.col("size") <= 4096).alias("small"), (F.col("size") <= 256 * 1024).alias("small_v2"))


# blobs 2, 3, 5 begin with invalid UTF-8, 1, 4, 9, 10 with NUL bytes (1 may be empty); the rest is counted
@query("f7_text", f"WITH {V.BLOBS} SELECT doc_id, len(regexp_extract_all(decode(b), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')) * 20 < greatest(octet_length(b), 1) AS is_text FROM blobs WHERE doc_id % 13 IN (0, 6, 7, 8, 11, 12) UNION ALL SELECT doc_id, octet_length(b) = 0 FROM blobs WHERE doc_id % 13 IN (1, 2, 3, 4, 5, 9, 10)")
def f7_text(spark, sf):
    return V.blobs(spark, sf).select("doc_id", B.looks_like_text(F.col("b")).alias("is_text"))


@query("f8_signature", f"WITH {V.BLOBS} SELECT doc_id, len(list_filter([{_list(s.hex().upper() for s in B.SIGNATURES)}], lambda s: starts_with(hex(b), s))) > 0 AS compressed FROM blobs")
def f8_signature(spark, sf):
    return V.blobs(spark, sf).select("doc_id", B.looks_compressed(F.col("b")).alias("compressed"))


@query("f9_zero", f"WITH {V.BLOBS} SELECT doc_id, regexp_full_match(hex(b), '0*') AS zero FROM blobs")
def f9_zero(spark, sf):
    return V.blobs(spark, sf).select("doc_id", B.is_zero(F.col("b")).alias("zero"))


@query("f10_saves_space", f"WITH {V.DOCS}, s AS (SELECT doc_id, size, size * (doc_id % 5 + 1) // 5 AS stored FROM docs) SELECT doc_id, stored < size AS plain, stored + 40 < size AS sealed, stored + 16 < size AS v2 FROM s")
def f10_saves_space(spark, sf):
    s = V.docs(spark, sf).select("doc_id", "size", F.expr("size * (doc_id % 5 + 1) div 5").alias("stored"))
    return s.select("doc_id", F.expr("stored < size").alias("plain"), F.expr("stored + 40 < size").alias("sealed"), F.expr("stored + 16 < size").alias("v2"))


_RULE = "CASE WHEN hint AND p > 0.97 THEN 'raw' WHEN p > 0.992 THEN 'raw' WHEN p < 0.58 THEN 'lzma6' WHEN p < 0.93 THEN 'lzma5' ELSE 'zlib6' END"


@query("f11_probe_rule", f"WITH {V.DOCS}, s AS (SELECT doc_id, (doc_id % 1000)::DOUBLE / 1000 AS p, doc_id % 3 = 0 AS hint FROM docs) SELECT doc_id, {_RULE} AS choice FROM s")
def f11_probe_rule(spark, sf):
    s = V.docs(spark, sf).select("doc_id", (F.col("doc_id") % 1000).cast("double").alias("k"), (F.col("doc_id") % 3 == 0).alias("hint")).withColumn("p", F.col("k") / 1000)
    return s.select("doc_id", F.expr(_RULE).alias("choice"))


@query("f12_type_filter", f"WITH {V.DOCS} SELECT CASE doc_id % 4 WHEN 0 THEN 'directory' WHEN 1 THEN 'symlink' ELSE 'file' END AS type, count(*)::BIGINT AS n FROM docs GROUP BY 1 HAVING type = 'file'")
def f12_type_filter(spark, sf):
    k = F.col("doc_id") % 4
    return V.docs(spark, sf).withColumn("type", F.when(k == 0, "directory").when(k == 1, "symlink").otherwise("file")).where("type = 'file'").groupBy("type").agg(F.count("*").alias("n"))


@query("f14_search", f"WITH {V.DOCS} SELECT path FROM docs WHERE contains(lower(path), lower('SRC1/'))")
def f14_search(spark, sf):
    return V.docs(spark, sf).where(F.contains(F.lower("path"), F.lower(F.lit("SRC1/")))).select("path")


@query("f15_extension_list", f"WITH {V.DOCS}, n AS (SELECT doc_id, 'a.' || ['ZIP', 'tar', 'txt', '7z', 'Gz', 'rar', 'spk'][doc_id % 7 + 1] AS name FROM docs) SELECT doc_id, lower(list_extract(string_split(name, '.'), -1)) IN ({_list(P.ARCHIVE_EXTENSIONS)}) AS known FROM n")
def f15_extension_list(spark, sf):
    names = F.array(*[F.lit(x) for x in ("ZIP", "tar", "txt", "7z", "Gz", "rar", "spk")])
    n = V.docs(spark, sf).select("doc_id", F.concat(F.lit("a."), F.get(names, (F.col("doc_id") % 7).cast("int"))).alias("name"))
    return n.select("doc_id", F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*P.ARCHIVE_EXTENSIONS).alias("known"))


@query("f17_flag_bits", f"WITH {V.DOCS} SELECT doc_id, (doc_id % 256 & 1) = 1 AS encrypted, (doc_id % 256 & 254) <> 0 AS unknown_bits FROM docs")
def f17_flag_bits(spark, sf):
    f = (F.col("doc_id") % 256).cast("int")
    return V.docs(spark, sf).select("doc_id", (f.bitwiseAND(1) == 1).alias("encrypted"), (f.bitwiseAND(254) != 0).alias("unknown_bits"))


INODES = "i AS (SELECT doc_id, path, doc_id % 3 AS dev, doc_id // 6 AS inode, CASE WHEN doc_id % 6 < 3 THEN 1 ELSE 2 END AS nlink, size FROM docs)"


def inodes(spark, sf):
    """doc_id, path, dev, inode, nlink: pairs of documents share an inode."""
    return V.docs(spark, sf).select("doc_id", "path", "size", (F.col("doc_id") % 3).alias("dev"), F.expr("doc_id div 6").alias("inode"), F.when(F.col("doc_id") % 6 < 3, 1).otherwise(2).alias("nlink"))


@query("f18_hardlinks", f"WITH {V.DOCS}, {INODES} SELECT path FROM (SELECT path, nlink, row_number() OVER (PARTITION BY dev, inode ORDER BY doc_id) AS n FROM i) WHERE nlink > 1 AND n > 1")
def f18_hardlinks(spark, sf):
    w = Window.partitionBy("dev", "inode").orderBy("doc_id")
    return inodes(spark, sf).withColumn("n", F.row_number().over(w)).where("nlink > 1 and n > 1").select("path")


@query("x1_path_key", f"WITH {V.ODD} SELECT doc_id, lower(nfc_normalize(rtrim(path, '/'))) AS key FROM odd")
def x1_path_key(spark, sf):
    return V.odd_paths(spark, sf).select("doc_id", P.path_key(F.col("path")).alias("key"))


@query("x2_relative_path", f"WITH {V.DOCS} SELECT doc_id, replace(substr(replace(path, '/', '\\'), 11), '\\', '/') AS rel FROM docs")
def x2_relative_path(spark, sf):
    return V.docs(spark, sf).select("doc_id", F.replace(F.substring(F.replace("path", F.lit("/"), F.lit("\\")), 11, 1 << 30), F.lit("\\"), F.lit("/")).alias("rel"))


NAMES = ("a.TXT", ".bashrc", "x.tar.gz", "noext", "b.7z", "c.Rs", "d.jpeg", "e.", "f.whl", "g.fish", ".a.json")


def named(spark, sf):
    """doc_id and path with a base name of NAMES."""
    return V.docs(spark, sf).select("doc_id", "size", F.concat(F.lit("dir/"), F.get(F.array(*[F.lit(x) for x in NAMES]), (F.col("doc_id") % len(NAMES)).cast("int"))).alias("path"))


NAMED = f"named AS (SELECT doc_id, size, 'dir/' || [{_list(NAMES)}][doc_id % {len(NAMES)} + 1] AS path FROM docs)"


@query("x3_extension", f"WITH {V.DOCS}, {NAMED} SELECT doc_id, {EXT} AS ext FROM named")
def x3_extension(spark, sf):
    return named(spark, sf).select("doc_id", P.extension(F.col("path")).alias("ext"))


@query("x4_category", f"WITH {V.DOCS}, {NAMED}, e AS (SELECT doc_id, {EXT} AS ext FROM named) SELECT doc_id, {CATEGORY} AS category FROM e")
def x4_category(spark, sf):
    return named(spark, sf).select("doc_id", P.category(F.col("path")).alias("category"))


@query("x5_path_parts", f"WITH {V.DOCS} SELECT path, array_to_string(string_split(path, '/')[1:-2], '/') AS parent, list_extract(string_split(path, '/'), -1) AS name, len(string_split(path, '/'))::BIGINT AS depth FROM docs")
def x5_path_parts(spark, sf):
    p = F.col("path")
    return V.docs(spark, sf).select("path", P.parent(p).alias("parent"), P.basename(p).alias("name"), P.depth(p).alias("depth"))


@query("x6_device_stem", f"WITH {V.ODD} SELECT doc_id, upper(string_split(list_extract(string_split(path, '/'), -1), '.')[1]) AS stem FROM odd")
def x6_device_stem(spark, sf):
    return V.odd_paths(spark, sf).select("doc_id", P.device_stem(P.basename(F.col("path"))).alias("stem"))


@query("x7_is_zip", f"WITH {V.DOCS} SELECT doc_id, doc_id % 3 <> 0 AS is_zip FROM docs")
def x7_is_zip(spark, sf):
    k = F.col("doc_id") % 3
    name = F.when(k == 0, "a.tar").when(k == 1, "a.ZIP").otherwise("b.zip")
    return V.docs(spark, sf).select("doc_id", (P.extension(name) == ".zip").alias("is_zip"))


_KIND = "CASE k WHEN 0 THEN 'file' WHEN 1 THEN 'directory' WHEN 2 THEN 'symlink' WHEN 3 THEN 'hardlink' ELSE 'special' END"


@query("x8_kind", f"WITH {V.DOCS}, s AS (SELECT doc_id, doc_id % 6 AS k FROM docs) SELECT doc_id, {_KIND} AS kind FROM s")
def x8_kind(spark, sf):
    return V.docs(spark, sf).withColumn("k", F.col("doc_id") % 6).select("doc_id", F.expr(_KIND).alias("kind"))


@query("x9_metadata_row", f"WITH {V.DOCS} SELECT path, 'file' AS type, size, (1700000000 + doc_id) * 1000000000 AS mtime_ns, (33188 & 4095)::INTEGER AS mode FROM docs")
def x9_metadata_row(spark, sf):
    made = F.struct("path", F.lit("file").alias("type"), "size", ((F.lit(1700000000) + F.col("doc_id")) * 1000000000).alias("mtime_ns"), F.lit(33188).bitwiseAND(4095).alias("mode"))
    return V.docs(spark, sf).select(made.alias("m")).select("m.*")


@query("x10_mode_mask", f"WITH {V.DOCS} SELECT doc_id, ((32768 + doc_id % 5000) & 4095)::BIGINT AS mode FROM docs")
def x10_mode_mask(spark, sf):
    return V.docs(spark, sf).select("doc_id", (F.lit(32768) + F.col("doc_id") % 5000).bitwiseAND(4095).alias("mode"))


@query("x11_mtime", f"WITH {V.DOCS}, s AS (SELECT doc_id, doc_id * 1000 - 300000 AS secs, doc_id % 1000 AS nanos FROM docs) SELECT doc_id, greatest(secs, 0) * 1000000000 + nanos AS mtime_ns FROM s")
def x11_mtime(spark, sf):
    s = V.docs(spark, sf).select("doc_id", (F.col("doc_id") * 1000 - 300000).alias("secs"), (F.col("doc_id") % 1000).alias("nanos"))
    return s.select("doc_id", (F.greatest("secs", F.lit(0)) * 1000000000 + F.col("nanos")).alias("mtime_ns"))


SIZED = "sized AS (SELECT doc_id, (size * (1::BIGINT << (doc_id % 40)::INT))::BIGINT AS n FROM docs)"


def sized(spark, sf):
    """doc_id and n: sizes over many orders of magnitude."""
    return V.docs(spark, sf).select("doc_id", "size", (F.col("size") * F.expr("shiftleft(1L, cast(doc_id % 40 as int))")).alias("n"))


def _format_sql(units: tuple[str, ...], decimals: int) -> str:
    cases = "".join(f" WHEN n < {1024 ** (k + 1)} THEN printf('%.{decimals}f {u}', n::DOUBLE / {1024**k})" for k, u in enumerate(units[:-1]))
    return f"CASE{cases} ELSE printf('%.{decimals}f {units[-1]}', n::DOUBLE / {1024 ** (len(units) - 1)}) END"


@query("x12_human_size", f"WITH {V.DOCS}, {SIZED} SELECT doc_id, {_format_sql(('B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB'), 2)} AS shown FROM sized")
def x12_human_size(spark, sf):
    return sized(spark, sf).select("doc_id", X.human_size(F.col("n")).alias("shown"))


@query("x13_human_size_short", f"WITH {V.DOCS}, {SIZED} SELECT doc_id, {_format_sql(('B', 'KB', 'MB', 'GB', 'TB'), 1)} AS shown FROM sized")
def x13_human_size_short(spark, sf):
    return sized(spark, sf).select("doc_id", X.human_size_short(F.col("n")).alias("shown"))


@query("x14_pretty_size", f"WITH {V.DOCS}, {SIZED} SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.0f B', n::DOUBLE) ELSE {_format_sql(('B', 'KB', 'MB', 'GB', 'TB'), 1)} END AS shown FROM sized")
def x14_pretty_size(spark, sf):
    return sized(spark, sf).select("doc_id", X.pretty_size(F.col("n")).alias("shown"))


@query("x15_ratio", f"WITH {V.DOCS}, s AS (SELECT doc_id, doc_id % 9 AS stored, (doc_id % 4) * 2 AS raw FROM docs) SELECT doc_id, CASE WHEN raw = 0 THEN 'n/a' ELSE printf('%.3f (%.1f%% smaller)', stored::DOUBLE / raw, (1.0::DOUBLE - stored::DOUBLE / raw) * 100.0::DOUBLE) END AS shown FROM s")
def x15_ratio(spark, sf):
    s = V.docs(spark, sf).select("doc_id", (F.col("doc_id") % 9).alias("stored"), ((F.col("doc_id") % 4) * 2).alias("raw"))
    return s.select("doc_id", X.ratio_text(F.col("stored"), F.col("raw")).alias("shown"))


@query("x16_throughput", "SELECT event_id, floor(event_id::DOUBLE / greatest(value, 0.001::DOUBLE))::BIGINT AS rate FROM events")
def x16_throughput(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", X.throughput(F.col("event_id"), F.col("value")).alias("rate"))


@query("x17_percent", f"WITH {V.DOCS} SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN (size * 100) // (size + doc_id % 5) END AS percent FROM docs")
def x17_percent(spark, sf):
    d = V.docs(spark, sf).withColumn("total", F.when(F.col("doc_id") % 5 > 0, F.col("size") + F.col("doc_id") % 5).otherwise(0))
    return d.select("doc_id", X.percent(F.col("size"), F.col("total")).alias("percent"))


@query("x18_saving", f"WITH {V.DOCS} SELECT doc_id, CASE WHEN size > 0 THEN 100.0::DOUBLE * (1.0::DOUBLE - (size // 2)::DOUBLE / size::DOUBLE) END AS saving FROM docs")
def x18_saving(spark, sf):
    return V.docs(spark, sf).select("doc_id", X.saving(F.expr("size div 2"), F.col("size")).alias("saving"))


@query("x19_saturating", f"WITH {V.DOCS} SELECT doc_id, least(size::HUGEINT * (1::HUGEINT << (doc_id % 70)::INT), 9223372036854775807)::BIGINT AS bytes FROM docs")
def x19_saturating(spark, sf):
    return V.docs(spark, sf).select("doc_id", X.saturating_shift(F.col("size"), F.col("doc_id") % 70).alias("bytes"))


@query("x20_clamp", f"WITH {V.DOCS} SELECT doc_id, least(greatest(doc_id % 150 - 20, 1), 100) AS percent FROM docs")
def x20_clamp(spark, sf):
    return V.docs(spark, sf).select("doc_id", F.least(F.greatest(F.col("doc_id") % 150 - 20, F.lit(1)), F.lit(100)).alias("percent"))


_JOBS = "CASE WHEN mode = 'max' THEN 1 ELSE least(4, cpus) END"
_MIB = "CASE mode WHEN 'fast' THEN 4 WHEN 'balanced' THEN 16 WHEN 'max' THEN 32 ELSE 8 END"


@query("x21_defaults", f"WITH {V.DOCS}, s AS (SELECT doc_id, ['fast', 'auto', 'balanced', 'max'][doc_id % 4 + 1] AS mode, doc_id % 9 + 1 AS cpus FROM docs) SELECT doc_id, ({_JOBS})::BIGINT AS jobs, ({_MIB})::INTEGER AS mib FROM s")
def x21_defaults(spark, sf):
    modes = F.array(*[F.lit(m) for m in ("fast", "auto", "balanced", "max")])
    s = V.docs(spark, sf).select("doc_id", F.get(modes, (F.col("doc_id") % 4).cast("int")).alias("mode"), (F.col("doc_id") % 9 + 1).alias("cpus"))
    return s.select("doc_id", F.expr(_JOBS).cast("long").alias("jobs"), F.expr(_MIB).alias("mib"))


@query("x22_sha256", f"WITH {V.DOCS} SELECT doc_id, sha256(text) AS digest FROM docs")
def x22_sha256(spark, sf):
    return V.docs(spark, sf).select("doc_id", B.sha256(F.col("text").cast("binary")).alias("digest"))


_KEY, _LABEL = bytes(range(32)), b"cairn block id\0"
_PAD = lambda x: bytes(b ^ x for b in _KEY.ljust(64, b"\0")).hex()


@query("x23_keyed_id", f"WITH {V.DOCS} SELECT doc_id, sha256(unhex('{_PAD(0x5C)}' || sha256(unhex('{_PAD(0x36)}' || '{_LABEL.hex()}' || sha256(text))))) AS id FROM docs")
def x23_keyed_id(spark, sf):
    return V.docs(spark, sf).select("doc_id", B.keyed_id(_KEY, F.col("text").cast("binary"), _LABEL).alias("id"))


@query("x24_hex", f"WITH {V.DOCS} SELECT doc_id, lower(hex(encode(text))) AS hexed, true AS same FROM docs")
def x24_hex(spark, sf):
    return V.docs(spark, sf).select("doc_id", F.lower(F.hex("text")).alias("hexed"), (F.unhex(F.hex("text")) == F.col("text").cast("binary")).alias("same"))


@query("x26_gear", f"SELECT unnest(range(256)) AS byte, unnest([{_list(f'{g:016x}' for g in G.GEAR)}]) AS gear")
def x26_gear(spark, sf):
    return spark.createDataFrame([(b, f"{g:016x}") for b, g in enumerate(G.GEAR)], "byte long, gear string")


@query("x28_aad", f"WITH {V.DOCS} SELECT doc_id, '{b'SPK3 block'.hex()}' || sha256(text) || array_to_string(list_transform(range(7, -1, -1), lambda k: substr(printf('%016x', size), (2 * k + 1)::INT, 2)), '') || '04' AS aad FROM docs")
def x28_aad(spark, sf):
    return V.docs(spark, sf).select("doc_id", F.lower(F.hex(B.block_aad(F.sha2(F.col("text").cast("binary"), 256), F.col("size"), F.lit(4)))).alias("aad"))


@query("x31_slice", f"WITH {V.DOCS} SELECT doc_id, lower(substr(hex(encode(text)), 2 * (doc_id % 20)::INT + 1, 2 * 11)) AS bytes FROM docs")
def x31_slice(spark, sf):
    return V.docs(spark, sf).select("doc_id", F.lower(F.hex(B.slice_bytes(F.col("text").cast("binary"), (F.col("doc_id") % 20).cast("int"), F.lit(11)))).alias("bytes"))


@query("x37_defaults", f"WITH {V.DOCS} SELECT doc_id, coalesce(nullif(doc_id % 3, 0), nullif(doc_id % 5, 0), 10) AS value FROM docs")
def x37_defaults(spark, sf):
    d = F.col("doc_id")
    return V.docs(spark, sf).select("doc_id", F.coalesce(F.nullif(d % 3, F.lit(0)), F.nullif(d % 5, F.lit(0)), F.lit(10)).alias("value"))


@query("x38_checked_parse", f"WITH {V.DOCS}, s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN '-' || doc_id WHEN 2 THEN 'x' || doc_id ELSE '99999999999999999999' END AS raw FROM docs) SELECT doc_id, try_cast(raw AS BIGINT) AS parsed FROM s")
def x38_checked_parse(spark, sf):
    k, d = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    raw = F.when(k == 0, d).when(k == 1, F.concat(F.lit("-"), d)).when(k == 2, F.concat(F.lit("x"), d)).otherwise("99999999999999999999")
    return V.docs(spark, sf).select("doc_id", raw.try_cast("long").alias("parsed"))


_METHOD = "CASE m WHEN 0 THEN 'raw' WHEN 1 THEN 'zlib' WHEN 2 THEN 'bz2' WHEN 3 THEN 'lzma' WHEN 4 THEN 'zstd' WHEN 5 THEN 'zero' WHEN 6 THEN 'xz' END"


@query("x39_enum_names", f"WITH {V.DOCS}, s AS (SELECT doc_id, doc_id % 8 AS m FROM docs) SELECT doc_id, {_METHOD} AS method FROM s")
def x39_enum_names(spark, sf):
    return V.docs(spark, sf).withColumn("m", F.col("doc_id") % 8).select("doc_id", F.expr(_METHOD).alias("method"))


_ADVICE = "CASE WHEN p < 0.55 THEN 'auto or balanced' WHEN p < 0.9 THEN 'balanced' ELSE 'fast or auto' END"


@query("x40_advice", f"WITH {V.DOCS}, s AS (SELECT doc_id, (doc_id % 100)::DOUBLE / 100 AS p FROM docs) SELECT doc_id, {_ADVICE} AS advice FROM s")
def x40_advice(spark, sf):
    return V.docs(spark, sf).withColumn("p", (F.col("doc_id") % 100).cast("double") / 100).select("doc_id", F.expr(_ADVICE).alias("advice"))
