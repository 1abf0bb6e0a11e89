"""Many archives at once: a task packs the files of a group into one archive, which is a row.

A single container is one ordered file; a large corpus is better kept as many, each of a bounded number of files.
Groups must be small enough for a task. `container.opened` and `trees.members` read such rows.
"""

from __future__ import annotations

import hashlib
import io
import tarfile
import zipfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from cairn import model as M
from cairn.operators import chunking as G
from cairn.operators import codecs as D
from cairn.sources import container

Files = list[tuple[str, bytes]]
#: Bytes that a search looks at together.
_PASS = 1 << 20


def container_of(files: Files, profile: str = "balanced", version: int = 3, password: str | None = None, kdf: tuple[int, int, int] = M.KDF_DEFAULT) -> bytes:
    """A container: chunks by content, distinct blocks, chunks of zeros as extents. Version 2 has the adaptive policy's codecs."""
    blocks: dict[str, tuple[int, int, bytes]] = {}
    entries = []
    for path, data in files:
        at, segments = 0, []
        for size in G.cut_one(data) if data else ():
            piece = data[at : at + size]
            at += size
            if not piece.strip(b"\0"):
                segments.append({"block": None, "offset": None, "length": None, "zero": size})
                continue
            name = hashlib.sha256(piece).hexdigest()
            if name not in blocks:
                method, payload = D.encode_adaptive(piece) if version == 2 else D.encode(piece, profile)
                blocks[name] = method, size, payload
            segments.append({"block": name, "offset": 0, "length": size, "zero": None})
        entries.append({"path": path, "type": "file", "size": len(data), "segments": segments})
    out = io.BytesIO()
    container.emit(out, ((name, *b) for name, b in blocks.items()), entries, version, password, kdf)
    return out.getvalue()


def occurring(data: bytes, names: list[bytes]) -> list[bool]:
    """Which of the names occur in data; one pass over it for all of them, that stops where two bytes begin a name."""
    wanted = {n for n in names if len(n) > 1}
    begins = np.zeros(1 << 16, np.bool_)
    for n in wanted:
        begins[n[0] | n[1] << 8] = True
    lengths, found, raw = sorted({len(n) for n in wanted}), set(), np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - 1 if wanted else 0, _PASS):
        part = raw[at : at + _PASS + 1].astype(np.uint16)
        for k in (at + np.flatnonzero(begins[part[:-1] | part[1:] << 8])).tolist():
            found.update(n for n in (data[k : k + length] for length in lengths) if n in wanted)
    return [n in found if len(n) > 1 else n in data for n in names]


def zip_of(files: Files) -> bytes:
    """A deflated zip file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, data in files:
            z.writestr(zipfile.ZipInfo(path), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def tar_of(files: Files) -> bytes:
    """A tar.gz file."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz", compresslevel=9) as t:
        for path, data in files:
            info = tarfile.TarInfo(path)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def bundled(files: DataFrame, group: Column, make: Callable[[Files], bytes] = container_of) -> DataFrame:
    """archive (the group as a string), content and files: one archive for each group of files (path, content), in the order of paths."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("path")
        data = make(list(zip(table.column("path").to_pylist(), table.column("content").to_pylist(), strict=True)))
        return pa.table([table.column("archive").slice(0, 1).combine_chunks(), pa.array([data], pa.binary()), pa.array([table.num_rows], pa.int64())], names=["archive", "content", "files"])

    return files.select(group.cast("string").alias("archive"), "path", "content").groupBy("archive").applyInArrow(run, "archive string, content binary, files long")
