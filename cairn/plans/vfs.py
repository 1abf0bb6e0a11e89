"""The virtual file tree over the tables, as DataFrames and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """path, doc_id, lang, source, text, size of every document as a file."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    return d.select(F.format_string("documents/%s/%s/%d.txt", "lang", "source", "doc_id").alias("path"), "doc_id", "lang", "source", "text", F.octet_length("text").cast("long").alias("size"))


DOCS = "docs AS (SELECT 'documents/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, doc_id, lang, source, text, strlen(text)::BIGINT AS size FROM documents WHERE text IS NOT NULL)"


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """path, size of all files: documents, pages, conversations, benchmark."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    return (
        docs(spark, sf).select("path", "size", "text")
        .unionAll(read("pages").select(F.format_string("pages/%d.html", "page_id").alias("path"), F.octet_length("html").cast("long"), "html"))
        .unionAll(read("conversations").select(F.format_string("conversations/%d/%d-%s.txt", "conv_id", "turn", "role"), F.octet_length("text").cast("long"), "text"))
        .unionAll(read("benchmark").select(F.format_string("benchmark/%d.txt", "item_id"), F.octet_length("text").cast("long"), "text"))
    )


TREE = f"""{DOCS}, tree AS (
  SELECT path, size, text FROM docs
  UNION ALL SELECT 'pages/' || page_id || '.html', strlen(html)::BIGINT, html FROM pages
  UNION ALL SELECT 'conversations/' || conv_id || '/' || turn || '-' || role || '.txt', strlen(text)::BIGINT, text FROM conversations
  UNION ALL SELECT 'benchmark/' || item_id || '.txt', strlen(text)::BIGINT, text FROM benchmark)"""


def odd_paths(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and path: documents' paths, some made unsafe or colliding in ways that depend on doc_id."""
    d = docs(spark, sf).select("doc_id", "path", "lang", "source")
    k = F.col("doc_id") % 23
    p = F.col("path")
    made = (
        F.when(k == 1, F.concat(F.lit("../"), p)).when(k == 2, F.concat(F.lit("/"), p)).when(k == 3, F.concat(p, F.lit(":x"))).when(k == 4, F.replace(p, F.lit("/"), F.lit("\\"))).when(k == 5, F.concat(p, F.lit("/NUL.txt")))
        .when(k == 6, F.concat(p, F.lit("/./b"))).when(k == 7, F.concat(p, F.lit("."))).when(k == 8, F.concat(p, F.lit("/"))).when(k == 9, F.concat(p, F.lit("//b"))).when(k == 10, F.concat(p, F.lit("/com1.tar.gz")))
        .when(k == 11, F.upper(p)).when(k == 12, F.concat(p, F.lit("/COM0"))).when(k == 13, F.concat(p, F.lit(" "))).when(k == 14, F.concat(p, F.lit("/a*b"))).when(k == 15, F.lit("")).otherwise(p)
    )
    return d.select("doc_id", made.alias("path"))


ODD = f"""{DOCS}, odd AS (SELECT doc_id, CASE doc_id % 23 WHEN 1 THEN '../' || path WHEN 2 THEN '/' || path WHEN 3 THEN path || ':x' WHEN 4 THEN replace(path, '/', '\\') WHEN 5 THEN path || '/NUL.txt'
  WHEN 6 THEN path || '/./b' WHEN 7 THEN path || '.' WHEN 8 THEN path || '/' WHEN 9 THEN path || '//b' WHEN 10 THEN path || '/com1.tar.gz'
  WHEN 11 THEN upper(path) WHEN 12 THEN path || '/COM0' WHEN 13 THEN path || ' ' WHEN 14 THEN path || '/a*b' WHEN 15 THEN '' ELSE path END AS path FROM docs)"""


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and b: documents' bytes, some with signatures, zeros or control characters by doc_id."""
    t = F.col("text").cast("binary")
    k = F.col("doc_id") % 13
    x = lambda h: F.concat(F.expr(f"X'{h}'"), t)
    n = (F.col("doc_id") % 50).cast("int")
    made = (
        F.when(k == 0, x("504B0304")).when(k == 1, F.repeat(F.expr("X'00'"), n)).when(k == 2, x("1F8B")).when(k == 3, x("FFD8FF")).when(k == 4, F.concat(F.expr("X'00'"), t)).when(k == 5, x("C328"))
        .when(k == 6, F.concat(F.repeat(F.expr("X'01'"), n), t)).when(k == 7, x("25504446")).when(k == 8, x("5350434B")).when(k == 9, F.concat(F.expr("X'53504B330D0A1A0A0300000001'"), t)).when(k == 10, F.concat(F.expr("X'53504B320D0A1A0A02000000'"), t)).otherwise(t)
    )
    return docs(spark, sf).select("doc_id", made.cast("binary").alias("b"))


BLOBS = f"""{DOCS}, blobs AS (SELECT doc_id, CASE doc_id % 13 WHEN 0 THEN unhex('504B0304') || encode(text) WHEN 1 THEN unhex(repeat('00', (doc_id % 50)::INT)) WHEN 2 THEN unhex('1F8B') || encode(text) WHEN 3 THEN unhex('FFD8FF') || encode(text)
  WHEN 4 THEN unhex('00') || encode(text) WHEN 5 THEN unhex('C328') || encode(text) WHEN 6 THEN unhex(repeat('01', (doc_id % 50)::INT)) || encode(text) WHEN 7 THEN unhex('25504446') || encode(text)
  WHEN 8 THEN unhex('5350434B') || encode(text) WHEN 9 THEN unhex('53504B330D0A1A0A0300000001') || encode(text) WHEN 10 THEN unhex('53504B320D0A1A0A02000000') || encode(text) ELSE encode(text) END AS b FROM docs)"""

#: Bytes of the fixed chunks that stand for blocks.
PIECE = 1024


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, path, lang, source, chunk_no, offset, length, block_id of pieces of PIECE bytes."""
    d = docs(spark, sf).withColumn("b", F.col("text").cast("binary"))
    cut = d.select("doc_id", "path", "lang", "source", "b", F.posexplode(F.expr(f"sequence(0, cast(size as int) - 1, {PIECE})")).alias("chunk_no", "offset"))
    piece = F.substring(F.col("b"), F.col("offset") + 1, F.lit(PIECE))
    return cut.select("doc_id", "path", "lang", "source", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("offset").cast("long").alias("offset"), F.octet_length(piece).cast("long").alias("length"), F.sha2(piece, 256).alias("block_id"))


CHUNKS = f"""{DOCS}, cut AS (SELECT doc_id, path, lang, source, hex(encode(text)) AS h, size, unnest(range(0, size, {PIECE})) AS "offset" FROM docs WHERE size > 0),
chunks AS (SELECT doc_id, path, lang, source, "offset" // {PIECE} AS chunk_no, "offset"::BIGINT AS "offset", least({PIECE}, size - "offset")::BIGINT AS length,
  sha256(unhex(substr(h, 2 * "offset" + 1, 2 * {PIECE}))) AS block_id FROM cut)"""
