"""Solid packing: consecutive small members share a block.

A member that would overflow the block begins the next one; a block that has reached the limit is full; a
member over the limit is a block of its own. Within a group this is a fold in order. It is done over ranges of the
order: each range tells, for every state that a block may be in at its beginning, how many blocks begin in
it and in which state it ends, which is a short table, as packings from different beginnings soon agree. One
task for each group composes these tables, a row for each range; then each range packs its members. Only keys and
sizes take part, never content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.order import pinned


def assign(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, offset) of each member."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    block, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = b = 0
    while at < n:
        end = int(np.searchsorted(total, total[at] + limit, "left"))  # least end with the limit reached
        if end > n or total[end] > total[at] + limit:
            end -= 1
        end = min(max(end, at + 1), n)
        block[at:end], offset[at:end] = b, total[at:end] - total[at]
        at, b = end, b + 1
    return block, offset


def joining(sizes: np.ndarray, limit: int) -> np.ndarray:
    """most[k]: the most bytes that an open block may hold for members 0 to k to join it; those of at least 0."""
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    most = np.minimum(limit - total[1:], limit - total[:-1] - 1)
    return most[: int(np.searchsorted(-most, 1))]


def passage(sizes: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """(most, begun, held): of members in a range, by what the open block holds.

    The first row of which `most` is not under these bytes holds (most grows; the last row, -1, is for any more, and for
    no open block): `begun` blocks begin in the range, and the last of them holds `held` bytes at its end: -1 if it is
    full or none is open, -2 if none began and the open block holds the range's bytes in addition.
    """
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = np.arange(n)
    end = np.searchsorted(total, total[:-1] + limit, "left")
    end -= (end > n) | (total[np.minimum(end, n)] > total[:-1] + limit)
    end = np.minimum(np.maximum(end, at + 1), n)
    count = np.ones(n + 1, np.int64)
    count[n] = 0
    to = np.append(end, n)
    last = np.append(np.where(end == n, at, n), n)  # where the last block begins
    while (to < n).any():
        count = count + count[to]
        last = np.where(last == n, last[to], last)
        to = to[to]
    held = np.append(total[n] - total[:-1], 0)[last]
    held = np.where(held >= limit, -1, held)
    most = joining(sizes, limit)
    rows: list[tuple[int, int, int]] = []
    for k in range(len(most), -1, -1):  # k members join the open block
        row = (int(most[k - 1]) if k else -1, int(count[k]) if k < n else 0, int(held[k]) if k < n else -2)
        if rows and rows[-1][1:] == row[1:]:
            rows.pop()
        rows.append(row)
    return tuple(map(list, zip(*rows, strict=True)))


def followed(state: tuple[int, int], begun: list[int], held: list[int], most: list[int], total: int, limit: int) -> tuple[int, int]:
    """(bytes in the open block or -1, blocks begun) after a range."""
    fill, used = state
    k = len(most) - 1 if fill < 0 else next((i for i, m in enumerate(most) if fill <= m), len(most) - 1)
    now = fill + total if held[k] == -2 else held[k]
    return (-1 if now >= limit else now), used + begun[k]


def placed(sizes: np.ndarray, limit: int, fill: int, used: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, offset) of a range's members, after a block that holds fill bytes (-1: none is open) as the last of `used`."""
    join = 0 if fill < 0 else int((fill <= joining(sizes, limit)).sum())
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    block, offset = assign(sizes[join:], limit)
    return np.concatenate([np.full(join, used - 1), block + used]), np.concatenate([total[:join] + fill, offset])


_PASSAGE = "most array<bigint>, begun array<bigint>, held array<bigint>, total bigint"


def solid_pack(members: DataFrame, group: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """members with block and offset, packed within each group in the order of the `order` columns. Pass keys and sizes, not content."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, columns = [*group, "x__range"], members.columns
    ranged = pinned(members.repartitionByRange(n, *[F.col(c) for c in (*group, *order)]).withColumn("x__range", F.spark_partition_id()))
    sorted_ = lambda t: t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in order]))

    def tell(table: pa.Table) -> pa.Table:
        sizes = np.asarray(sorted_(table).column(size), np.int64)
        most, begun, held = passage(sizes, limit)
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (most, begun, held)]
        return pa.table([*(table.column(c).slice(0, 1) for c in keys), *lists, pa.array([int(sizes.sum())])], names=[*keys, "most", "begun", "held", "total"])

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("x__range")
        state, states = (-1, 0), []
        for r in table.select(["most", "begun", "held", "total"]).to_pylist():
            states.append(state)
            state = followed(state, r["begun"], r["held"], r["most"], r["total"], limit)
        return table.select(keys).append_column("fill", pa.array([f for f, _ in states], pa.int64())).append_column("used", pa.array([u for _, u in states], pa.int64()))

    def put(table: pa.Table, before: pa.Table) -> pa.Table:
        table = sorted_(table)
        block, offset = placed(np.asarray(table.column(size), np.int64), limit, before.column("fill")[0].as_py(), before.column("used")[0].as_py()) if table.num_rows else ([], [])
        return table.select(columns).append_column("block", pa.array(block, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    of = [ranged.schema[c] for c in keys]
    told = ranged.groupBy(*keys).applyInArrow(tell, T.StructType([*of, *T._parse_datatype_string(_PASSAGE)]))
    starts = told.groupBy(*group).applyInArrow(fold, T.StructType([*of, T.StructField("fill", T.LongType()), T.StructField("used", T.LongType())]))
    return ranged.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInArrow(put, T.StructType([*members.schema, T.StructField("block", T.LongType()), T.StructField("offset", T.LongType())]))


def concatenated(members: DataFrame, keys: list[str], offset: str = "offset", content: str = "content") -> DataFrame:
    """keys and content: the members' bytes in the order of offset. Blocks are bounded by the packing limit."""
    field = next(f for f in members.schema if f.name == content)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(offset, "ascending")]))
        data = b"".join(x or b"" for x in table.column(content).to_pylist())
        return pa.table([*(table.column(k).slice(0, 1) for k in keys), pa.array([data], pa.binary())], names=[*keys, content])

    return members.groupBy(*keys).applyInArrow(run, T.StructType([*(members.schema[k] for k in keys), field]))
