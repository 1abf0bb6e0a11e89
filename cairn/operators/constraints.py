"""Integrity and safety rules: each gives the rows that break it, as (rule, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import model as M
from cairn.functions import paths as P
from cairn.operators.order import with_next


def _broken(df: DataFrame, rule: str, when: Column, subject: Column, detail: Column) -> DataFrame:
    return df.where(when).select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def segments(entries: DataFrame) -> DataFrame:
    """A row per segment: path, type, size, seg_no, block, offset, length, zero."""
    return entries.select("path", "type", "size", F.posexplode_outer("segments").alias("seg_no", "s")).select("path", "type", "size", "seg_no", "s.block", "s.offset", "s.length", "s.zero")


def header_rules(header: DataFrame) -> DataFrame:
    """R1, R2, R6: version, key derivation settings, manifest sizes."""
    (m0, m1), (i0, i1), (l0, l1) = M.KDF_BOUNDS
    kdf_ok = F.col("kdf_memory_kib").between(m0, m1) & F.col("kdf_iterations").between(i0, i1) & F.col("kdf_lanes").between(l0, l1)
    empty = (F.coalesce("kdf_memory_kib", F.lit(0)) == 0) & (F.coalesce("kdf_iterations", F.lit(0)) == 0) & (F.coalesce("kdf_lanes", F.lit(0)) == 0)
    one = F.lit("header")
    return (
        _broken(header, "R1", ~F.col("version").isin(2, 3), one, F.col("version"))
        .unionByName(_broken(header, "R2", F.when(F.col("encrypted"), ~kdf_ok).otherwise(~empty), one, F.lit("key derivation settings")))
        .unionByName(_broken(header, "R6", (F.col("manifest_raw_size") > M.MAX_MANIFEST_BYTES) | (F.col("manifest_stored_size") > M.MAX_MANIFEST_BYTES + 1024), one, F.col("manifest_raw_size")))
    )


def block_rules(blocks: DataFrame, file_size: int | None = None) -> DataFrame:
    """R3, R4, R5, R27: sizes, places, unique ids."""
    out = _broken(blocks, "R3", (F.col("raw_size") > M.MAX_BLOCK_BYTES) | (F.col("stored_size") > M.MAX_BLOCK_BYTES + 64), F.col("block_id"), F.col("raw_size"))
    if file_size is not None:
        out = out.unionByName(_broken(blocks, "R4", F.col("offset") + F.col("stored_size") > file_size, F.col("block_id"), F.col("offset")))
    ids = blocks.groupBy("block_id").agg(F.count("*").alias("n"), F.count_distinct("raw_size").alias("sizes"))
    return (
        out.unionByName(_broken(ids, "R5", F.col("n") > 1, F.col("block_id"), F.col("n")))
        .unionByName(_broken(ids, "R27", F.col("sizes") > 1, F.col("block_id"), F.col("sizes")))
        .unionByName(_broken(blocks.agg(F.count("*").alias("n")), "R5", F.col("n") > M.MAX_BLOCKS, F.lit("blocks"), F.col("n")))
    )


def path_rules(entries: DataFrame, version: int = 3, fold: str = "lower", links: str = "refuse") -> DataFrame:
    """R10 (path length), R11, R12, R14, R18, R20, R21."""
    keyed = entries.withColumn("key", P.path_key(F.col("path"), fold)).withColumn("is_file", F.col("type") == "file")
    twice = keyed.groupBy("key").agg(F.count("*").alias("n"))
    above = keyed.select("path", F.explode(P.ancestors(F.col("key"))).alias("key"))
    out = [
        _broken(entries, "R10", F.octet_length("path") > M.MAX_PATH_BYTES, F.substring("path", 1, 80), F.octet_length("path")),
        _broken(entries, "R11", ~P.safe_path(F.col("path"), version), F.col("path"), F.lit("unsafe path")),
        _broken(twice, "R12", F.col("n") > 1, F.col("key"), F.col("n")),
        _broken(above.join(keyed.where("is_file").select("key"), "key"), "R14", F.lit(True), F.col("path"), F.col("key")),
        _broken(entries, "R18", ~F.col("type").isin(*M.ENTRY_TYPES), F.col("path"), F.col("type")),
    ]
    if links == "refuse":
        out.append(_broken(entries, "R20", F.col("type").isin("symlink", "hardlink"), F.col("path"), F.col("type")))
    else:
        out.append(_broken(entries, "R21", (F.col("type") == "symlink") & ~F.coalesce(P.safe_link_target(F.col("path"), F.col("target")), F.lit(False)), F.col("path"), F.col("target")))
        hard = keyed.where("type = 'hardlink'").select("path", "target", P.path_key(F.col("target"), fold).alias("key"))
        files = keyed.where("is_file").select("key", F.lit(True).alias("found")).distinct()
        out.append(_broken(hard.join(files, "key", "left"), "R21", F.col("found").isNull(), F.col("path"), F.col("target")))
    return reduce(DataFrame.unionByName, out)


def adjacent_conflicts(entries: DataFrame, fold: str = "lower") -> DataFrame:
    """Files of which the next key in order lies below them; hides conflicts that other keys separate (R14 finds all)."""
    keyed = entries.select("path", "type", P.path_key(F.col("path"), fold).alias("key"))
    pairs = with_next(keyed, [F.col("key"), F.col("path")], ["key"])
    return pairs.withColumnRenamed("next_key", "next").where((F.col("type") == "file") & F.startswith("next", F.concat("key", F.lit("/"))))


def segment_rules(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """R10 (segments), R15, R16, R17. Only the index of blocks is joined, never payloads."""
    files = entries.where("type = 'file'")
    seg = segments(files).where("block is not null")
    index = blocks.select(F.col("block_id").alias("block"), "raw_size")
    joined = seg.join(index, "block", "left")
    name = F.concat_ws("#", "path", "seg_no")
    held = F.aggregate(F.coalesce("segments", F.array().cast("array<struct<block:string,offset:bigint,length:bigint,zero:bigint>>")), F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(s["zero"], s["length"], F.lit(0)))
    return (
        _broken(files, "R10", F.size("segments") > M.MAX_BLOCKS, F.col("path"), F.size("segments"))
        .unionByName(_broken(joined, "R15", F.col("raw_size").isNull(), name, F.col("block")))
        .unionByName(_broken(joined, "R16", F.col("raw_size").isNotNull() & ((F.col("offset") < 0) | (F.col("length") < 0) | (F.col("offset") + F.col("length") > F.col("raw_size"))), name, F.col("block")))
        .unionByName(_broken(files.withColumn("held", held), "R17", F.col("held") != F.coalesce("size", F.lit(0)), F.col("path"), F.col("held")))
    )


def total_rules(entries: DataFrame, max_output: int = M.MAX_OUTPUT_BYTES) -> DataFrame:
    """R10 (entries), R13."""
    total = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("type") == "file", F.col("size").cast("decimal(38,0)"))), F.lit(0)).alias("bytes"))
    return _broken(total, "R10", F.col("n") > M.MAX_ENTRIES, F.lit("entries"), F.col("n")).unionByName(_broken(total, "R13", F.col("bytes") > max_output, F.lit("entries"), F.col("bytes")))


def violations(entries: DataFrame, blocks: DataFrame, version: int = 3, max_output: int = M.MAX_OUTPUT_BYTES, links: str = "refuse") -> DataFrame:
    """All rules on entries and the block index; no rows mean that all hold."""
    return path_rules(entries, version, links=links).unionByName(segment_rules(entries, blocks)).unionByName(total_rules(entries, max_output)).unionByName(block_rules(blocks))
