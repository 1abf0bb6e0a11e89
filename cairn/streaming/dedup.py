"""Streams: distinct blocks of arriving files, solid packing as state, progress in windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.order import checkpoint_dir


def document_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def distinct_blocks(stream: DataFrame, size: int = 4096, content: str = "content") -> DataFrame:
    """block_id, length of each block when it is first seen. Exactness needs all ids as state, so there is no watermark."""
    n = F.octet_length(content)
    cut = stream.where(n > 0).select(F.col(content), F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("at"))
    piece = F.substring(F.col(content), F.col("at") + 1, F.lit(size))
    return cut.select(F.sha2(piece, 256).alias("block_id"), F.octet_length(piece).cast("long").alias("length")).dropDuplicates(["block_id"])


def solid_stream(stream: DataFrame, group: str, limit: int) -> DataFrame:
    """group, place, member, block, offset, round: greedy packing of each group's members in their order, however they arrive.

    A trigger's members may lie before those of earlier triggers, which moves all that follow. So a group's state is its members
    and their sizes, 16 bytes each, and a trigger tells the places that it makes or changes, under its round; `settled`
    keeps the last word on each place. Groups must be of a bounded number of members.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, held, rounds = state.get if state.exists else (b"", b"", 0)
        new = pd.concat(list(frames))  # a group's rows may come in several frames, which are in no order
        members = np.concatenate([np.frombuffer(bytes(kept), np.int64), new["member"].to_numpy(np.int64)])
        sizes = np.concatenate([np.frombuffer(bytes(held), np.int64), new["size"].to_numpy(np.int64)])
        old = len(members) - len(new)
        order = np.lexsort((sizes, members))
        first = int(np.argmax(order != np.arange(len(order)))) if (order[:old] != np.arange(old)).any() else old  # places before stay
        members, sizes = members[order], sizes[order]
        block = used = 0
        places = []
        for size in sizes.tolist():
            if used and (used + size > limit or used >= limit):
                block, used = block + 1, 0
            places.append((block, used))
            used += size
        state.update((members.tobytes(), sizes.tobytes(), rounds + 1))
        changed = range(first, len(places))
        yield pd.DataFrame({group: key[0], "place": changed, "member": members[first:], "block": [places[k][0] for k in changed], "offset": [places[k][1] for k in changed], "round": rounds})

    return stream.groupBy(group).applyInPandasWithState(step, f"{group} string, place long, member long, block long, offset long, round long", "members binary, sizes binary, rounds long", "append", GroupStateTimeout.NoTimeout)


def settled(packed: DataFrame, group: str) -> DataFrame:
    """group, member, block, offset: what the last trigger of `solid_stream` that touched a place said of it."""
    last = packed.groupBy(group, "place").agg(F.max_by(F.struct("member", "block", "offset"), "round").alias("p"))
    return last.select(group, "p.member", "p.block", "p.offset")


def finished(stream: DataFrame) -> DataFrame:
    """All that a stream makes of what is there now. Its output and state lie in the shared folder until the application ends."""
    spark = stream.sparkSession
    place = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def progress_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, phase, completed, n of progress events (ts, phase, bytes) in tumbling windows; later ones are dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "phase").agg(F.sum("bytes").alias("completed"), F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "phase", "completed", "n")
