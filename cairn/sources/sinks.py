"""Sinks: zip files, tar.gz with a sidecar manifest, reports. They write serially on the driver from ordered rows."""

from __future__ import annotations

import csv
import io
import json
import os
import tarfile
import uuid
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.container import publish


def _in_order(files: DataFrame) -> DataFrame:
    return files.orderBy(F.split("path", "/"))


def write_zip(files: DataFrame, path: str) -> None:
    """Deflated zip of folders (`name/`) and files, in the order of a walk; never over a file that is there."""
    temp = f"{path}.{uuid.uuid4().hex}.partial"
    try:
        with zipfile.ZipFile(temp, "x", zipfile.ZIP_DEFLATED) as z:
            for r in _in_order(files.where("type in ('file', 'directory')").select("path", "type", "content")).toLocalIterator():
                z.writestr(f"{r.path.rstrip('/')}/" if r.type == "directory" else r.path, b"" if r.type == "directory" else bytes(r.content or b""))
        publish(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def sidecar(files: DataFrame) -> DataFrame:
    """path, sha256, size of the files."""
    return files.where("type = 'file'").select("path", F.sha2("content", 256).alias("sha256"), "size")


def write_tar_gz(files: DataFrame, path: str, root: str = "") -> str:
    """tar.gz of the files and `<path>.manifest.json` with their digests; the manifest's path is returned."""
    temp = f"{path}.{uuid.uuid4().hex}.partial"
    rows = []
    try:
        with tarfile.open(temp, "x:gz", compresslevel=9) as t:
            for r in _in_order(files.where("type = 'file'").select("path", "content", F.sha2("content", 256).alias("sha256"))).toLocalIterator():
                info = tarfile.TarInfo(r.path)
                info.size = len(r.content)
                t.addfile(info, io.BytesIO(bytes(r.content)))
                rows.append({"path": r.path, "sha256": r.sha256, "size": len(r.content)})
        publish(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise
    with open(f"{path}.manifest.json", "w") as f:
        json.dump({"format": "cairn-sidecar", "root": root, "files": rows}, f, ensure_ascii=False)
    return f"{path}.manifest.json"


def check_sidecar(spark, manifest: str, members: DataFrame) -> DataFrame:
    """path and problem (missing, mismatch) of files that are not in members with the manifest's digest."""
    m = spark.read.option("multiLine", True).schema("format string, root string, files array<struct<path: string, sha256: string, size: long>>").json(manifest)
    want = m.select(F.explode("files").alias("f")).select("f.path", "f.sha256")
    have = members.where("type = 'file'").select("path", F.sha2("content", 256).alias("actual"))
    return want.join(have, "path", "left").where("actual is null or actual <> sha256").select("path", F.when(F.col("actual").isNull(), "missing").otherwise("mismatch").alias("problem"))


def digest_lines(files: DataFrame) -> DataFrame:
    """`digest  path` lines, as `write.text` takes them."""
    return files.where("type = 'file'").select(F.concat_ws("  ", F.sha2("content", 256), "path").alias("value"))


def read_digest_lines(spark, path: str) -> DataFrame:
    """path and sha256 from such lines; lines that begin with # are skipped."""
    pattern = r"^([0-9a-f]{64})  (.+)$"
    t = spark.read.text(path).where(~F.startswith("value", F.lit("#")))
    return t.select(F.regexp_extract("value", pattern, 2).alias("path"), F.regexp_extract("value", pattern, 1).alias("sha256")).where("path <> ''")


def write_report(rows: list[dict], stem: str) -> None:
    """Benchmark rows as JSON and CSV side by side."""
    with open(f"{stem}.json", "w") as f:
        json.dump(rows, f, indent=1)
    with open(f"{stem}.csv", "w", newline="") as f:
        w = csv.DictWriter(f, sorted({k for r in rows for k in r}))
        w.writeheader()
        w.writerows(rows)
