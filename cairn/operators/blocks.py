"""Blocks: first occurrences, statistics, places in a container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.order import running_sum

#: Bytes of a block record before its payload, of the manifest record, of a version 3 header.
BLOCK_HEAD, MANIFEST_HEAD, HEADER_V3, HEADER_V2 = 50, 49, 41, 12


def first_occurrence(chunks: DataFrame, order: list[str], block_id: str = "block_id") -> DataFrame:
    """block_id and the least `order` of its occurrences. One aggregation, partial before the shuffle; no content moves."""
    return chunks.where(F.col(block_id).isNotNull()).groupBy(block_id).agg(F.min(F.struct(*order)).alias("at")).select(block_id, "at.*")


def dedup_stats(chunks: DataFrame, by: list[str], order: list[str], length: str = "length") -> DataFrame:
    """Per group: chunks, raw bytes, and blocks and bytes that first occur there."""
    firsts = first_occurrence(chunks, order).select("block_id", *order).withColumn("is_first", F.lit(True))
    marked = chunks.join(firsts, ["block_id", *order], "left")
    return marked.groupBy(*by).agg(
        F.count("*").alias("chunks"), F.sum(length).cast("long").alias("raw_bytes"), F.count_if(F.col("is_first")).alias("unique_blocks"), F.coalesce(F.sum(F.when(F.col("is_first"), F.col(length))), F.lit(0)).cast("long").alias("unique_bytes")
    )


def record_offsets(blocks: DataFrame, order: list[Column], stored: str = "stored_size", header: int = HEADER_V3) -> DataFrame:
    """blocks with the offset of each payload when records follow each other in `order`."""
    run = running_sum(blocks, order, F.col(stored) + BLOCK_HEAD, "x__end")
    return run.withColumn("offset", (F.lit(header) + F.col("x__end") - F.col(stored)).cast("long")).drop("x__end")


def stats(blocks: DataFrame) -> DataFrame:
    """One row: blocks, raw and stored bytes."""
    return blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("raw_size"), F.lit(0)).cast("long").alias("raw_bytes"), F.coalesce(F.sum("stored_size"), F.lit(0)).cast("long").alias("stored_bytes"))


def by_method(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("method").agg(F.count("*").alias("blocks"), F.sum("raw_size").cast("long").alias("raw_bytes"), F.sum("stored_size").cast("long").alias("stored_bytes"))
