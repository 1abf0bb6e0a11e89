"""Paths in archives: safety, keys, parts, ancestors, categories."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions that hint at what a file holds.
COMPRESSED_EXTENSIONS = (
    ".7z", ".rar", ".zip", ".gz", ".bz2", ".xz", ".zst", ".lz4", ".cab",
    ".jpg", ".jpeg", ".webp", ".avif", ".heic", ".heif", ".jxl",
    ".mp3", ".aac", ".m4a", ".ogg", ".opus", ".flac",
    ".mp4", ".m4v", ".mkv", ".mov", ".webm", ".avi",
    ".apk", ".aab", ".ipa", ".jar", ".war", ".whl",
)
TEXT_EXTENSIONS = (
    ".txt", ".log", ".csv", ".tsv", ".json", ".jsonl", ".xml", ".yaml", ".yml",
    ".html", ".htm", ".css", ".js", ".ts", ".jsx", ".tsx", ".md", ".rst",
    ".sql", ".ini", ".cfg", ".conf", ".toml", ".py", ".java", ".c", ".cc",
    ".cpp", ".h", ".hpp", ".go", ".rs", ".cs", ".sh", ".bash", ".fish",
)
ARCHIVE_EXTENSIONS = ("spk", "zip", "7z", "tar", "gz", "xz", "zst", "lz4")
#: Names that devices have on some systems, before the first dot.
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"COM{k}" for k in range(1, 10)), *(f"LPT{k}" for k in range(1, 10)))


@F.arrow_udf(T.StringType())
def _nfc(x: pa.Array) -> pa.Array:
    return pc.utf8_normalize(x, form="NFC")


@F.arrow_udf(T.StringType())
def _casefold(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else v.casefold() for v in x.to_pylist()], pa.string())


def trimmed(path: Column) -> Column:
    """path without one trailing slash."""
    return F.regexp_replace(path, "/$", "")


def path_key(path: Column, fold: str = "lower") -> Column:
    """Key under which paths collide: no trailing slashes, NFC, then lower case (or casefold)."""
    bare = _nfc(F.regexp_replace(path, "/+$", ""))
    return F.lower(bare) if fold == "lower" else _casefold(bare)


def parts(path: Column) -> Column:
    return F.split(path, "/")


def depth(path: Column) -> Column:
    return F.size(parts(path)).cast("long")


def parent(path: Column) -> Column:
    """All but the last part; the empty string at the top."""
    p = parts(path)
    return F.array_join(F.slice(p, 1, F.size(p) - 1), "/")


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def ancestors(path: Column) -> Column:
    """Every proper prefix, the topmost first."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.array_join(F.slice(p, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def extension(path: Column) -> Column:
    """Last dot and what follows it in the base name, in lower case; none for names that only begin with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+?(\.[^.]+)$", 1))


def category(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*TEXT_EXTENSIONS), "text").when(ext.isin(*COMPRESSED_EXTENSIONS), "compressed").otherwise("binary")


def device_stem(part: Column) -> Column:
    """What stands before the first dot, in upper case."""
    return F.upper(F.substring_index(part, ".", 1))


def _safe_part(part: Column, controls: str) -> Column:
    bad = (part == "") | part.isin(".", "..") | part.rlike(r"[. ]$") | part.rlike(rf'[{controls}<>:"|?*]') | device_stem(part).isin(*DEVICES)
    return ~bad


def safe_path(path: Column, version: int = 3) -> Column:
    """Whether a path may be extracted anywhere. Version 3 allows one trailing slash and forbids more control characters."""
    bare = trimmed(path) if version == 3 else path
    controls = r"\x00-\x1f\x7f-\x9f" if version == 3 else r"\x00-\x1f"
    ok = (bare != "") & ~path.startswith("/") & ~path.contains("\\") & ~path.contains("\x00")
    return ok & F.forall(parts(bare), lambda p: _safe_part(p, controls))


def safe_link_target(entry: Column, target: Column) -> Column:
    """Whether a link from entry's folder to target stays in the tree: relative, without drive, never above the root."""
    start = F.size(parts(entry)) - 1
    least = F.aggregate(
        parts(target),
        F.struct(start.alias("d"), start.alias("m")),
        lambda a, p: F.when(p == "..", F.struct((a["d"] - 1).alias("d"), F.least(a["m"], a["d"] - 1).alias("m"))).when(p.isin("", "."), a).otherwise(F.struct((a["d"] + 1).alias("d"), a["m"].alias("m"))),
        lambda a: a["m"],
    )
    return (target != "") & ~target.rlike(r"[\\:\x00-\x1f]") & ~target.startswith("/") & (least >= 0)


def inside_root(path: Column) -> Column:
    """Whether the path, with `.` and `..` resolved as text, stays below its root."""
    return ~path.startswith("/") & (F.aggregate(parts(path), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda a, p: F.when(p == "..", F.struct((a["d"] - 1).alias("d"), F.least(a["m"], a["d"] - 1).alias("m"))).when(p.isin("", "."), a).otherwise(F.struct((a["d"] + 1).alias("d"), a["m"].alias("m"))), lambda a: a["m"]) >= 0)
