"""From files to entries and blocks, and back, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import model as M
from cairn.functions import binary as B
from cairn.functions import paths as P
from cairn.operators import blocks as K
from cairn.operators import chunking as G
from cairn.operators import codecs as D
from cairn.operators import solid as S
from cairn.operators.order import running_sum

#: Order of a walk that enters each folder where its name stands.
ORDER = "x__order"


def _ordered(files: DataFrame) -> DataFrame:
    return files.withColumn(ORDER, F.replace("path", F.lit("/"), F.lit("\0")))


def pack(files: DataFrame, profile: str = "balanced", small: int = M.SMALL_FILE, solid_limit: int = M.SOLID_LIMIT, chunking: tuple[int, int, int] = (M.CHUNK_MIN, M.CHUNK_MAX, M.CHUNK_MASK_BITS), spread: int = 0, adaptive: str | None = None, links: bool = False, share_small: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, blocks) of files (model.FILE).

    Files over `small` bytes are cut by content; smaller ones share solid blocks, text apart from other data.
    spread: depth of the folders that small files are also kept apart by; 0 packs them in one sequence per
    kind. share_small: small files with equal bytes share the first one's place
    instead of being packed again. Blocks are distinct before the codec runs; chunks of zeros have none.
    Links become entries if `links`, else they are skipped, as are special files.
    """
    f = _ordered(files.where(F.col("type").isin("file", "directory", *(("symlink", "hardlink") if links else ()))))
    regular = f.where("type = 'file' and size > 0")
    order = [ORDER, "chunk_no"]
    chunks = G.content_chunks(regular.where(F.col("size") > small), ["path", ORDER], "content", *chunking)
    large_seg = chunks.select("path", F.col("chunk_no").alias("seq"), F.when(~F.col("is_zero"), F.struct(F.col("block_id").alias("block"), F.lit(0).cast("long").alias("offset"), "length", F.lit(None).cast("long").alias("zero"))).otherwise(F.struct(F.lit(None).cast("string").alias("block"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"), F.col("length").alias("zero"))).alias("s"))
    first = K.first_occurrence(chunks.select("block_id", "path", *order, "offset", "length"), [*order, "path", "offset", "length"])
    wanted = first.groupBy("path").agg(F.collect_list(F.struct("block_id", "offset", "length", "chunk_no")).alias("w"))
    large = regular.join(wanted, "path").select(ORDER, "content", F.explode("w").alias("w")).select(F.col("w.block_id").alias("block_id"), F.col(ORDER), F.col("w.chunk_no").alias("chunk_no"), F.substring(F.col("content"), (F.col("w.offset") + 1).cast("int"), F.col("w.length").cast("int")).alias("content"))
    members = regular.where(F.col("size") <= small).select("path", ORDER, "size", F.when(B.looks_like_text(F.col("content")), "text").otherwise("binary").alias("kind"), F.array_join(F.slice(F.split("path", "/"), 1, spread), "/").alias("shard"))
    every = None
    if share_small:
        every = regular.where(F.col("size") <= small).select("path", ORDER, F.sha2("content", 256).alias("digest"))
        firsts = every.groupBy("digest").agg(F.min(F.struct(ORDER, "path")).alias("m")).select("digest", F.col("m.path").alias("path"))
        every = every.drop(ORDER)
        members = members.join(firsts.select("path"), "path", "left_semi")
    placed = S.solid_pack(members, ["kind", "shard"], [ORDER], "size", solid_limit)
    held = placed.select("path", "kind", "shard", "block", "offset").join(regular.select("path", "content"), "path").drop("path")
    whole = S.concatenated(held, ["kind", "shard", "block"]).withColumn("is_zero", B.is_zero(F.col("content"))).withColumn("block_id", F.sha2("content", 256))
    small_seg = placed.join(whole.drop("content"), ["kind", "shard", "block"]).select("path", F.lit(0).alias("seq"), F.when(~F.col("is_zero"), F.struct(F.col("block_id").alias("block"), "offset", F.col("size").alias("length"), F.lit(None).cast("long").alias("zero"))).otherwise(F.struct(F.lit(None).cast("string").alias("block"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"), F.col("size").alias("zero"))).alias("s"))
    if every is not None:
        shared = small_seg.join(firsts, "path").select("digest", "seq", "s")
        small_seg = every.join(shared, "digest").select("path", "seq", "s")
    solid = whole.where("not is_zero").select("block_id", F.concat(F.lit("￿"), "kind", F.lit("\0"), "shard").alias(ORDER), F.col("block").cast("int").alias("chunk_no"), "content")
    distinct = large.unionByName(solid).groupBy("block_id").agg(F.min_by(F.struct(ORDER, "chunk_no", "content"), F.struct(ORDER, "chunk_no")).alias("r")).select("block_id", f"r.{ORDER}", "r.chunk_no", "r.content")
    blocks = D.encode_blocks(distinct, profile, adaptive=adaptive)
    segments = large_seg.unionByName(small_seg).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "s"))).alias("a")).select("path", F.col("a.s").alias("segments"))
    empty = F.array().cast("array<struct<block:string,offset:bigint,length:bigint,zero:bigint>>")
    entries = f.drop("content").join(segments, "path", "left").withColumn("segments", F.coalesce("segments", empty))
    return entries.select("path", "type", "size", "mtime_ns", "mode", "uid", "gid", "target", "segments", ORDER), blocks


def decode(blocks: DataFrame, keyed: bool = False) -> DataFrame:
    """block_id, raw_size, content, error of blocks; each is decoded once. A wrong digest is an error too, unless ids are keyed."""
    d = blocks.select("block_id", "raw_size", D.decoded(F.col("method"), F.col("payload"), F.col("raw_size")).alias("d"))
    wrong = F.lit(False) if keyed else F.sha2("d.content", 256) != F.col("block_id")
    return d.select("block_id", "raw_size", F.col("d.content").alias("content"), F.coalesce("d.error", F.when(wrong, "digest differs")).alias("error"))


def pieces(entries: DataFrame, blocks: DataFrame, keyed: bool = False) -> DataFrame:
    """path, seg_no, piece: each file's bytes in pieces; zeros are made, blocks joined by id and sliced."""
    seg = entries.where("type = 'file'").select("path", F.posexplode_outer("segments").alias("seg_no", "s")).select("path", F.coalesce("seg_no", F.lit(0)).alias("seg_no"), "s.*")
    joined = seg.join(decode(blocks, keyed).select(F.col("block_id").alias("block"), "content", "error"), "block", "left")
    piece = F.when(F.col("block").isNotNull(), F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int")))
    return joined.select("path", "seg_no", piece.alias("piece"), "zero", F.when(F.col("block").isNotNull() & F.col("content").isNull(), F.coalesce("error", F.lit("missing block"))).otherwise(F.col("error")).alias("error"))


def write_files(entries: DataFrame, blocks: DataFrame, root: str, keyed: bool = False, restore: bool = False, overwrite: bool = False) -> DataFrame:
    """Write files under root, a folder that all executors share: path, size, error of each. restore: also modes and times.

    A file's pieces come in order to one task, that appends them to a temporary file and then links it to
    its name. A file that is there stays, unless `overwrite`; then it gives way, and so does a link, which isn't followed.
    """
    import os
    import uuid

    from cairn.sources.container import publish

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: dict = {"path": None}

        def finish() -> None:
            if state["path"] is None:
                return
            state["f"].close()
            error = state["error"]
            try:
                if error:
                    os.unlink(state["temp"])
                else:
                    if restore and state["mode"] is not None:
                        os.chmod(state["temp"], state["mode"] & 0o777)
                    if restore and state["mtime_ns"] is not None:
                        os.utime(state["temp"], ns=(state["mtime_ns"], state["mtime_ns"]))
                    if overwrite:
                        os.replace(state["temp"], f"{root}/{state['path']}")
                    else:
                        publish(state["temp"], f"{root}/{state['path']}")
            except FileExistsError:
                error = "exists"
            out.append((state["path"], state["n"], error))
            state["path"] = None

        for b in batches:
            for path, piece, zero, error, mode, when in zip(*(b.column(c).to_pylist() for c in ("path", "piece", "zero", "error", "mode", "mtime_ns")), strict=True):
                if path != state["path"]:
                    finish()
                    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                    temp = f"{root}/{path}.{uuid.uuid4().hex}.partial"
                    state |= {"path": path, "temp": temp, "f": open(temp, "xb"), "n": 0, "error": None, "mode": mode, "mtime_ns": when}  # noqa: SIM115
                state["error"] = state["error"] or error
                data = piece if piece is not None else None
                if data is not None:
                    state["f"].write(data)
                    state["n"] += len(data)
                left = zero or 0
                while left:
                    step = min(left, 1 << 20)
                    state["f"].write(bytes(step))
                    left, state["n"] = left - step, state["n"] + step
        finish()
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "size", "error"])

    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces(entries, blocks, keyed).join(entries.select("path", "mode", "mtime_ns"), "path")
    return rows.repartition(n, "path").sortWithinPartitions("path", "seg_no").mapInArrow(run, "path string, size long, error string")


def analyze(files: DataFrame, per_file: int = 512 << 10, total: int = 32 << 20) -> DataFrame:
    """category, files, bytes, share, sampled, ratio: by category of file names, with a capped sample's compressed share.

    The sample takes the start of files in walk order until `total` bytes; only they are compressed.
    """
    f = _ordered(files.where("type = 'file'")).withColumn("category", P.category(F.col("path"))).withColumn("want", F.least(F.lit(per_file), F.col("size")))
    run = running_sum(f.select("path", ORDER, "want"), [F.col(ORDER)], F.col("want"), "end")
    took = f.join(run.select("path", "end"), "path").withColumn("take", F.greatest(F.lit(0), F.least(F.col("want"), F.lit(total) - (F.col("end") - F.col("want")))).cast("int"))
    sample = took.withColumn("p", F.when(F.col("take") > 0, D.probed(F.substring(F.col("content"), F.lit(1), F.col("take")))))
    g = sample.groupBy("category").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("take").alias("sampled"), F.sum(F.col("p") * F.col("take")).alias("packed"))
    all_ = g.agg(F.sum("bytes").alias("t"))
    return g.crossJoin(F.broadcast(all_)).select("category", "files", "bytes", F.when(F.col("t") > 0, F.lit(100.0) * F.col("bytes") / F.col("t")).otherwise(0.0).alias("share"), "sampled", F.when(F.col("sampled") > 0, F.col("packed") / F.col("sampled")).otherwise(1.0).alias("ratio"))
