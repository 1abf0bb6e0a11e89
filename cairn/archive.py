"""ArchiveEngine: create, inspect, verify, extract, analyze and recover archives."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import model as M
from cairn.operators import archiving as A
from cairn.operators import constraints as C
from cairn.operators import recovery as R
from cairn.sources import container, sinks, trees

SLICE = 64 << 10


class ArchiveEngine:
    """Archives as relations of a session. Work runs under a tag, so `cancel` stops it."""

    def __init__(self, spark: SparkSession, max_output_bytes: int = M.MAX_OUTPUT_BYTES, progress=None) -> None:
        self.spark, self.max_output_bytes, self.progress = spark, max_output_bytes, progress or (lambda *_: None)
        self.tag = f"archive-{uuid.uuid4().hex[:8]}"
        spark.dataSource.register(container.ContainerSource)
        spark.dataSource.register(trees.TreeSource)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _run(self, phase: str):
        spark, tag = self.spark, self.tag

        class Tagged:
            def __enter__(inner):
                spark.sparkContext.addJobTag(tag)
                self.progress(phase, "start")

            def __exit__(inner, *error):
                spark.sparkContext.removeJobTag(tag)
                self.progress(phase, "failed" if error[0] else "done")

        return Tagged()

    def files(self, source: str, exclude: str | None = None) -> DataFrame:
        reader = self.spark.read.format("tree").option("path", source)
        return (reader.option("exclude", exclude) if exclude else reader).load()

    def create(self, source: str, destination: str, profile: str = "balanced", password: str | None = None, version: int = 3, kdf: tuple[int, int, int] = M.KDF_DEFAULT, mode: str = "auto", **options) -> None:
        """Pack a folder into a container, or a zip file by its name; neither may exist yet.

        mode: of the adaptive policy, for version 2. options: bounds of `archiving.pack` (small, solid_limit, chunking).
        """
        if profile not in M.PROFILES:
            raise ValueError(f"profile must be one of {', '.join(M.PROFILES)}")
        if password == "":
            raise ValueError("a password must not be empty")
        if os.path.exists(destination):
            raise FileExistsError(destination)
        files = self.files(source, destination)
        with self._run("compress"):
            if destination.lower().endswith(".zip"):
                if password:
                    raise ValueError("zip files can't be encrypted here")
                sinks.write_zip(files, destination)
                return
            # version 2 has other codec numbers, that the adaptive policy keeps to
            entries, blocks = A.pack(files, profile, adaptive=mode if version == 2 else None, **options)
            order = F.col(A.ORDER)
            rows = ((r.block_id, r.method, r.raw_size, bytes(r.payload)) for r in blocks.orderBy(order, "chunk_no").toLocalIterator())
            listed = (r.asDict(True) for r in entries.orderBy(order).drop(A.ORDER).toLocalIterator())
            container.write(destination, rows, listed, version, password, kdf)

    def save(self, files: DataFrame, place: str, profile: str = "balanced", **options) -> None:
        """The native form for large data: Parquet tables entries, blocks below place, written by all executors."""
        entries, blocks = A.pack(files, profile, **options)
        entries.drop(A.ORDER).write.mode("errorifexists").parquet(f"{place}/entries")
        blocks.drop(A.ORDER, "chunk_no").write.mode("errorifexists").parquet(f"{place}/blocks")

    def _is_container(self, path: str) -> bool:
        with open(path, "rb") as f:
            return f.read(8) in (M.MAGIC_V2, M.MAGIC_V3)

    def _table(self, path: str, table: str, password: str | None) -> DataFrame:
        r = self.spark.read.format("container").option("path", path).option("table", table)
        return (r.option("password", password) if password else r).load()

    def tables(self, path: str, password: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(entries, blocks) of a container file or of a native folder."""
        if os.path.isdir(path):
            return self.spark.read.parquet(f"{path}/entries"), self.spark.read.parquet(f"{path}/blocks")
        return self._table(path, "entries", password), self._table(path, "blocks", password)

    def inspect(self, path: str, password: str | None = None) -> DataFrame:
        """type, size, path of the entries."""
        if os.path.isdir(path) or self._is_container(path):
            return self.tables(path, password)[0].select("type", "size", "path")
        return trees.archives(self.spark, path, content=False).select("type", "size", "path")

    def verify(self, path: str, password: str | None = None) -> DataFrame:
        """Broken rules as (rule, subject, detail); no rows: all is well."""
        if not os.path.isdir(path) and not self._is_container(path):
            rows = trees.archives(self.spark, path)
            return C.path_rules(rows, links="allow").where("rule <> 'R21'").unionByName(C.total_rules(rows, self.max_output_bytes))
        entries, blocks = self.tables(path, password)
        index = blocks.drop("payload") if os.path.isdir(path) else self._table(path, "block_index", password)
        broken = A.decode(blocks, keyed=bool(password)).where("error is not null").select(F.lit("R19").alias("rule"), F.col("block_id").alias("subject"), F.col("error").alias("detail"))
        return C.violations(entries, index, max_output=self.max_output_bytes, links="allow").unionByName(broken)

    def extract(self, path: str, destination: str, password: str | None = None, restore: bool = False, overwrite: bool = False, links: bool = False, verify: bool = True) -> int:
        """Write an archive's files below destination, after all rules hold; the number of files.

        restore: also modes and times. overwrite: files and links that are there give way. links: links are made too, if
        they lead to a place below destination. verify: payloads are decoded and hashed before anything is written;
        rules on paths, sizes and segments are checked in any case.
        """
        with self._run("extract"):
            external = not os.path.isdir(path) and not self._is_container(path)
            if external:
                rows = trees.archives(self.spark, path)
                problems = C.path_rules(rows, links="allow" if links else "refuse").unionByName(C.total_rules(rows, self.max_output_bytes))
            else:
                entries, blocks = self.tables(path, password)
                problems = self.verify(path, password) if verify else self._rules(path, password)
                if not links:
                    problems = problems.unionByName(C.path_rules(entries).where("rule = 'R20'"))
            if first := problems.limit(5).collect():
                raise container.ContainerError("; ".join(f"{r.rule} {r.subject}: {r.detail}" for r in first))
            if external:
                entries, blocks = A.pack(rows.withColumns({c: F.lit(None).cast("long") for c in ("uid", "gid")}), "store", links=links)
            linked, taken = set(), []
            for r in entries.select("path").toLocalIterator():  # the folder is one of the driver's file system
                full = f"{destination}/{r.path}"
                if not overwrite and os.path.lexists(full) and not os.path.isdir(full):
                    taken.append(r.path)
                linked |= {p for p in _parents(r.path)[:-1] if os.path.islink(f"{destination}/{p}")}
                if os.path.islink(full) and not overwrite:
                    linked.add(r.path)
            if taken or linked:
                raise FileExistsError(", ".join(sorted([*taken, *linked])[:5]))
            os.makedirs(destination, exist_ok=True)
            for r in entries.where("type in ('directory', 'dir')").select("path").toLocalIterator():
                os.makedirs(f"{destination}/{r.path}", exist_ok=True)
            done = A.write_files(entries.where("type = 'file'"), blocks, os.path.abspath(destination), keyed=bool(password), restore=restore, overwrite=overwrite).agg(F.count("*").alias("n"), F.first("error", True).alias("error")).first()
            if done.error:
                raise OSError(done.error)
            if links:
                for r in entries.where("type in ('symlink', 'hardlink')").orderBy("type", "path").select("path", "type", "target").toLocalIterator():
                    _link(destination, r.path, r.type, r.target, overwrite)
            return done.n

    def _rules(self, path: str, password: str | None) -> DataFrame:
        """All rules that need no payload."""
        entries, blocks = self.tables(path, password)
        index = blocks.drop("payload") if os.path.isdir(path) else self._table(path, "block_index", password)
        return C.violations(entries, index, max_output=self.max_output_bytes, links="allow")

    def analyze(self, source: str) -> DataFrame:
        return A.analyze(self.files(source))

    def create_recovery(self, path: str, destination: str, percent: int = 10, size: int = SLICE) -> str:
        """Parity of one archive file as tables below destination; the index file's path."""
        R.parity_count(1, percent)
        files = trees.stored_files(self.spark, path).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
        table = R.slices(files, size)
        os.makedirs(destination, exist_ok=False)
        table.drop("data").write.parquet(f"{destination}/slices")
        R.parity(table, percent, size).write.parquet(f"{destination}/parity")
        index = f"{destination}/recovery.json"
        with open(index, "w") as f:
            json.dump({"size": size, "percent": percent}, f)
        return index

    def repair(self, index: str, base: str, destination: str) -> int:
        """Write the indexed files, repaired from base, into a new folder; the number of files."""
        root = os.path.dirname(index)
        with open(index) as f:
            size = json.load(f)["size"]
        slices = self.spark.read.parquet(f"{root}/slices")
        parity = {r.i: bytes(r.data) for r in self.spark.read.parquet(f"{root}/parity").collect()}
        if os.path.lexists(destination):
            raise FileExistsError(destination)
        there = R.slices(trees.stored_files(self.spark, base).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content"), size)
        if first := R.preflight(slices, there, len(parity)).limit(5).collect():
            raise ValueError("; ".join(f"{r.rule} {r.subject}: {r.detail}" for r in first))
        known = slices.orderBy("file", "slice_no").collect()  # one archive's slices, 65,535 at most
        names = sorted({r.file for r in known})
        data = {n: open(f"{base}/{n}", "rb").read() if os.path.exists(f"{base}/{n}") else b"" for n in names}  # noqa: SIM115
        have, lost = {}, []
        for j, r in enumerate(known):
            piece = data[r.file][r.slice_no * size : r.slice_no * size + r.length].ljust(size, b"\0")
            if R.digest(piece) == r.sha256:
                have[j] = piece
            else:
                lost.append(j)
        have |= R.solve(lost, have, parity, len(known))
        os.makedirs(destination, exist_ok=False)
        for n in names:
            with open(f"{destination}/{n}", "xb") as f:
                for j, r in enumerate(known):
                    if r.file == n:
                        if R.digest(have[j]) != r.sha256:
                            raise ValueError("repair failed")
                        f.write(have[j][: r.length])
        return len(names)


def _link(root: str, path: str, kind: str, target: str | None, overwrite: bool) -> None:
    """Make one link, if what it leads to is below root."""
    full, base = f"{root}/{path}", os.path.realpath(root)
    goal = os.path.realpath(os.path.join(root if kind == "hardlink" else os.path.dirname(full), target or ""))
    if not target or os.path.isabs(target) or os.path.commonpath([goal, base]) != base:
        raise container.ContainerError(f"unsafe link {path}")
    os.makedirs(os.path.dirname(full), exist_ok=True)
    if overwrite and os.path.lexists(full):
        os.unlink(full)
    if kind == "hardlink":
        os.link(goal, full, follow_symlinks=False)
    else:
        os.symlink(target, full)


def _parents(path: str) -> list[str]:
    p = path.rstrip("/").split("/")
    return ["/".join(p[:k]) for k in range(1, len(p) + 1)]
