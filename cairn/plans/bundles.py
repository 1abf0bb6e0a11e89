"""Queries: containers and other archives written and read again, damage, recovery, restored files, streams with state."""

from __future__ import annotations

import hashlib
import io
import shutil
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.operators import archiving as A
from cairn.operators import recovery as R
from cairn.operators import suite as U
from cairn.operators.order import checkpoint_dir, pinned
from cairn.plans import vfs as V
from cairn.plans.archives import files
from cairn.plans.registry import query
from cairn.sources import bundles as N
from cairn.sources import container, trees
from cairn.streaming import dedup as T

#: Documents of an archive, by id, and of a sealed one, whose key takes a while to derive.
PER, PER_SEALED = 500, 5000
PASSWORD, KDF = "correct horse", (8 << 10, 1, 1)


def _bundles(spark, sf, make=N.container_of, per: int = PER):
    d = V.docs(spark, sf).select("doc_id", "path", F.col("text").cast("binary").alias("content"))
    return N.bundled(d, F.expr(f"doc_id div {per}"), make)


def _listed(entries):
    held = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["zero"], s["length"]))
    return entries.select("archive", "path", "type", "size", held.alias("held"))


_LISTED = f"WITH {V.DOCS} SELECT (doc_id // {PER})::VARCHAR AS archive, path, 'file' AS type, size, size AS held FROM docs"


@query("s4_containers", _LISTED)
def s4_containers(spark, sf):
    """Documents packed into containers and listed from these."""
    return _listed(container.opened(_bundles(spark, sf)))


@query("s5_containers_v2", _LISTED)
def s5_containers_v2(spark, sf):
    """The same in version 2, with the adaptive policy's codecs."""
    return _listed(container.opened(_bundles(spark, sf, lambda x: N.container_of(x, version=2))))


@query("s13_payloads", f"WITH {V.DOCS} SELECT path, sha256(text) AS sha256 FROM docs WHERE size > 0")
def s13_payloads(spark, sf):
    """Files put together again from containers' payloads; a block that several containers hold is decoded once."""
    made = pinned(_bundles(spark, sf, lambda x: N.container_of(x, "smallest")))
    blocks = container.opened(made, "blocks").select("block_id", "method", "raw_size", "payload").dropDuplicates(["block_id"])
    parts = A.pieces(container.opened(made), blocks).where("piece is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seg_no", F.hex("piece").alias("h")))).alias("a"))
    return parts.select("path", F.sha2(F.unhex(F.array_join("a.h", "")), 256).alias("sha256"))


@query("x29_sealed", f"WITH {V.DOCS} SELECT path, size, true AS hidden, {KDF[0]}::BIGINT AS kdf_memory_kib FROM docs")
def x29_sealed(spark, sf):
    """Sealed containers: read with the password; neither names nor settings but the key derivation's are in the clear."""
    made = pinned(_bundles(spark, sf, lambda x: N.container_of(x, password=PASSWORD, kdf=KDF), PER_SEALED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for held in b.column("content"):
                data = held.as_py()
                ix = container.read_index(io.BytesIO(data), len(data), PASSWORD)  # the key is derived once for all that is read
                rows = list(container.entry_rows(ix.manifest))
                seen = N.occurring(data, [e["path"].encode() for e in rows])
                columns = {"path": pa.array([e["path"] for e in rows], pa.string()), "size": pa.array([e["size"] for e in rows], pa.int64()), "hidden": pa.array([not x for x in seen], pa.bool_()), "kdf_memory_kib": pa.array([ix.kdf[0]] * len(rows), pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)

    return made.select("content").mapInArrow(run, "path string, size long, hidden boolean, kdf_memory_kib long")


_HARM = {
    "cut": "container ends too early", "tail": "bytes after the end mark", "mark": "end mark is missing", "digest": "manifest digest differs", "size": "manifest has another size", "cap": "manifest is over the size limit", "whole": "",
    "version": "unknown container version", "record": "unknown record", "twice": "block id occurs twice", "magic": "not a block container",
}


def _harmed(data: bytes, kind: str) -> bytes:
    """A container with one fault."""
    stored = container.read_index(io.BytesIO(data), len(data)).manifest_stored
    m = len(data) - 1 - stored - 48 - 1  # where the manifest's record begins
    raw = struct.unpack("<Q", data[m + 1 : m + 9])[0]
    first = data[41 : 41 + 50 + struct.unpack("<Q", data[41 + 42 : 41 + 50])[0]]  # the first block's record
    return {
        "cut": data[: m + 20], "tail": data + b"E", "mark": data[:-1] + b"F", "digest": data[: m + 17] + bytes(32) + data[m + 49 :], "size": data[: m + 1] + struct.pack("<Q", raw + 1) + data[m + 9 :],
        "cap": data[: m + 1] + struct.pack("<Q", (64 << 20) + 1) + data[m + 9 :], "whole": data, "version": data[:8] + b"\x09" + data[9:], "record": data[:41] + b"Q" + data[42:], "twice": data[:41] + first + data[41:], "magic": b"X" + data[1:],
    }[kind]


@query("r7_r9_damage", f"WITH {V.DOCS}, a AS (SELECT DISTINCT (doc_id // {PER})::VARCHAR AS archive FROM docs) SELECT archive, kind, problem FROM a CROSS JOIN (SELECT unnest({list(_HARM)}) AS kind, unnest({list(_HARM.values())}) AS problem)")
def r7_r9_damage(spark, sf):
    """What reading says about containers, each with every fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("archive").to_pylist(), b.column("content").to_pylist(), strict=True):
                said = []
                for kind in _HARM:
                    try:
                        list(container._rows_of(_harmed(data, kind), "entries", None))
                        said.append("")
                    except container.ContainerError as e:
                        said.append(str(e))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(said)), pa.array(list(_HARM)), pa.array(said)], names=["archive", "kind", "problem"])

    return _bundles(spark, sf).mapInArrow(run, "archive string, kind string, problem string")


_MEMBERS = f"WITH {V.DOCS} SELECT (doc_id // {PER})::VARCHAR AS archive, path, 'file' AS type, size, sha256(text) AS sha256 FROM docs"


def _members(spark, sf, make):
    return trees.members(_bundles(spark, sf, make)).select("archive", "path", "type", "size", F.sha2("content", 256).alias("sha256"))


@query("k3_zip_members", _MEMBERS)
def k3_zip_members(spark, sf):
    return _members(spark, sf, N.zip_of)


@query("k4_tar_members", _MEMBERS)
def k4_tar_members(spark, sf):
    return _members(spark, sf, N.tar_of)


SLICE, PERCENT = 16 << 10, 20


@query("k8_recovery", f"WITH {V.DOCS}, g AS (SELECT doc_id // {PER} AS part, string_agg(text, '' ORDER BY path) AS t, sum(size)::BIGINT AS n FROM docs GROUP BY 1), s AS (SELECT part, t, (n + {SLICE - 1}) // {SLICE} AS slices FROM g WHERE n > 0) SELECT part::VARCHAR AS archive, slices, (slices + 3) // 7 AS lost, greatest(1, (slices * {PERCENT} + 99) // 100) AS parity, sha256(t) AS sha256 FROM s")
def k8_recovery(spark, sf):
    """Parity for the slices of each group of documents; every seventh slice is lost and solved for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("archive").to_pylist(), b.column("content").to_pylist(), strict=True):
                if not data:
                    continue
                have = {j: data[a : a + SLICE].ljust(SLICE, b"\0") for j, a in enumerate(range(0, len(data), SLICE))}
                k, m = len(have), R.parity_count(len(have), PERCENT)
                index = [R.digest(x) for x in have.values()]
                parity = {i: np.bitwise_xor.reduce([R.multiply(R.coefficient(i, j, k), np.frombuffer(x, "<u2")) for j, x in have.items()]).tobytes() for i in range(m)}
                lost = list(range(3, k, 7))
                kept = {j: b"" if j in lost else x for j, x in have.items()}
                bad = [j for j, x in kept.items() if R.digest(x) != index[j]]
                good = {j: x for j, x in kept.items() if j not in bad}
                whole = good | R.solve(bad, good, parity, k)
                out = hashlib.sha256(b"".join(whole[j] for j in range(k))[: len(data)]).hexdigest()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k]), pa.array([len(bad)]), pa.array([m]), pa.array([out])], names=["archive", "slices", "lost", "parity", "sha256"])

    joined = _bundles(spark, sf, lambda x: b"".join(data for _, data in x))
    return joined.mapInArrow(run, "archive string, slices long, lost long, parity long, sha256 string")


@query("r28_preflight", f"""WITH {V.CHUNKS}, i AS (SELECT CASE WHEN doc_id % 17 = 3 THEN 'a/' ELSE 'f' END || doc_id AS file, chunk_no + CASE WHEN doc_id % 19 = 4 THEN 1 ELSE 0 END AS slice_no, doc_id FROM chunks), t AS (SELECT * FROM i UNION ALL SELECT * FROM i WHERE doc_id % 29 = 6 AND slice_no = 1), o AS (SELECT file, count(*) AS n, count(DISTINCT slice_no) AS d, min(slice_no) AS a, max(slice_no) AS b FROM t GROUP BY file), lost AS (SELECT count(*) AS n FROM i WHERE doc_id % 23 = 5)
SELECT 'R28' AS rule, file AS subject, 'unsafe name' AS detail FROM o WHERE contains(file, '/') UNION ALL SELECT 'R28', file, 'a slice occurs twice' FROM o WHERE n > d UNION ALL SELECT 'R28', file, 'slices are missing' FROM o WHERE a <> 0 OR b + 1 <> d UNION ALL SELECT 'R28', 'slices', n || ' lost, 10 parity' FROM lost WHERE n > 10""")
def r28_preflight(spark, sf):
    """An index with odd names, gaps and repeats, and more losses than parity."""
    c = V.chunks(spark, sf)
    index = c.select(F.concat(F.when(F.col("doc_id") % 17 == 3, "a/").otherwise("f"), F.col("doc_id").cast("string")).alias("file"), (F.col("chunk_no") + F.when(F.col("doc_id") % 19 == 4, 1).otherwise(0)).alias("slice_no"), F.col("block_id").alias("sha256"), "doc_id")
    twice = index.unionAll(index.where("doc_id % 29 = 6 and slice_no = 1"))
    present = index.where("doc_id % 23 <> 5").drop("doc_id")
    return R.preflight(twice.drop("doc_id"), present, 10)


@query("k12_restored", f"WITH {V.DOCS} SELECT path, size, (384 + doc_id % 64)::INTEGER AS mode, 1000000000 * (doc_id % 1000000 + 1) AS mtime_ns FROM docs")
def k12_restored(spark, sf):
    """Documents as files in the shared folder, with modes and times, as the tree source finds them there; the folder goes again."""
    place = checkpoint_dir(spark)
    if "://" in place.removeprefix("file://"):
        raise ValueError("files can only be restored to a folder that executors share as a file system")
    root = f"/{place.removeprefix('file:').lstrip('/')}/restored-{uuid.uuid4().hex}"
    d = V.docs(spark, sf)
    f = files(spark, sf).drop("mode", "mtime_ns").join(d.select("path", (F.lit(384) + F.col("doc_id") % 64).cast("int").alias("mode"), (F.lit(1_000_000_000) * (F.col("doc_id") % 1_000_000 + 1)).alias("mtime_ns")), "path")
    entries, blocks = A.pack(f, "fast")
    try:
        A.write_files(entries, blocks, root, restore=True).count()
        spark.dataSource.register(trees.TreeSource)
        found = spark.read.format("tree").option("path", f"{root}/documents").option("content", "false").load().where("type = 'file'")
        return pinned(found.select("path", "size", F.col("mode").bitwiseAND(F.lit(0o777)).alias("mode"), "mtime_ns"))
    finally:
        shutil.rmtree(root, ignore_errors=True)


@query("t3_solid_stream", f"WITH RECURSIVE {V.DOCS}, o AS (SELECT lang || '/' || doc_id // 5000 AS part, doc_id AS member, size, row_number() OVER (PARTITION BY lang, doc_id // 5000 ORDER BY doc_id) AS rn FROM docs WHERE size <= 4096), p AS (SELECT part, member, rn, 0::BIGINT AS block, 0::BIGINT AS \"offset\", size AS n FROM o WHERE rn = 1 UNION ALL SELECT o.part, o.member, o.rn, CASE WHEN p.n > 0 AND (p.n + o.size > 32768 OR p.n >= 32768) THEN p.block + 1 ELSE p.block END, CASE WHEN p.n > 0 AND (p.n + o.size > 32768 OR p.n >= 32768) THEN 0 ELSE p.n END, CASE WHEN p.n > 0 AND (p.n + o.size > 32768 OR p.n >= 32768) THEN o.size ELSE p.n + o.size END FROM p JOIN o ON o.part = p.part AND o.rn = p.rn + 1) SELECT part, member, block, \"offset\" FROM p")
def t3_solid_stream(spark, sf):
    """Greedy packing of arriving documents in the order of ids, in whatever order files bring them; groups are of 5,000 ids at most, and their members are the state."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    stream = T.document_stream(spark, f"{sf}/documents.parque[t]", schema).where("text is not null")
    size = F.octet_length("text").cast("long")
    members = stream.where(size <= 4096).select(F.concat_ws("/", "lang", F.expr("doc_id div 5000").cast("string")).alias("part"), F.col("doc_id").alias("member"), size.alias("size"))
    return T.settled(T.finished(T.solid_stream(members, "part", 32768)), "part")


@query("s16_suite", f"""WITH t AS (SELECT repeat('{U.SENTENCE.decode().strip()}' || chr(10), 3600) AS x), n AS (SELECT unnest(range({U.SMALL_FILES})) AS k)
SELECT 'text' AS "case", 'report.txt' AS path, {U.TEXT_BYTES}::BIGINT AS size, sha256(substr(x, 1, {U.TEXT_BYTES})) AS sha256 FROM t
UNION ALL SELECT 'incompressible-random', 'random.bin', {U.RANDOM_BYTES}, 'a8e1e9b1b7785a8449ab5bd1b59c9bd1c2d1167b924c500da33463bd369e45c5'
UNION ALL SELECT 'many-small-files', printf('batch-%02d/item-%03d.txt', k // {U.PER_FOLDER}, k), 12 + {U.SMALL_TEXT}, sha256(printf('record=%03d; ', k) || substr(x, 1, {U.SMALL_TEXT})) FROM t, n
UNION ALL SELECT 'duplicate-files', printf('copy-%02d.bin', k), {U.COPY_BYTES}, sha256(substr(x, 1, {U.COPY_BYTES})) FROM t, n WHERE k < {U.COPIES}""")
def s16_suite(spark, sf):
    """The benchmark's files; sf has no part in them."""
    return U.suite(spark).select("case", "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
