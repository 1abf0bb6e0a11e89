"""Order over whole tables without one task that sees all rows.

Rows go to ranges of the order, once, and are pinned there; sums or edges of the ranges, a row each, are
combined on their own and joined back. Equal keys never straddle two ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only where there is none, one below the warehouse is set."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(place)
    return place


def pinned(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pinned(df.repartitionByRange(n, *order).withColumn("x__range", F.spark_partition_id()))


def _by_range() -> WindowSpec:
    """Window over a table of one row per range."""
    return Window.partitionBy(F.lit(0)).orderBy("x__range")


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str = "total") -> DataFrame:
    """df with the running sum of value up to and with each row, in a total order."""
    ranged = _ranged(df.withColumn("x__value", value), order)
    sums = ranged.groupBy("x__range").agg(F.sum("x__value").alias("s"))
    before = sums.select("x__range", F.coalesce(F.sum("s").over(_by_range().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("x__before"))
    inner = Window.partitionBy("x__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(F.broadcast(before), "x__range").withColumn(name, F.sum("x__value").over(inner) + F.col("x__before")).drop("x__range", "x__before", "x__value")  # a row per range is broadcast


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's number in a total order, from 1."""
    return running_sum(df, order, F.lit(1), name)


def with_next(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """df with next_<column> of the row that follows in a total order; null for the last."""
    ranged = _ranged(df, order)
    inner = Window.partitionBy("x__range").orderBy(*order)
    heads = ranged.groupBy("x__range").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("h"))
    after = heads.select("x__range", F.lead("h").over(_by_range()).alias("x__after"))
    found = F.coalesce(F.lead(F.struct(*columns)).over(inner), F.col("x__after"))
    out = ranged.join(F.broadcast(after), "x__range").withColumn("x__next", found)  # a row per range
    return out.select(*df.columns, *[F.col(f"x__next.{c}").alias(f"next_{c}") for c in columns])
