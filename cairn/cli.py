"""Command line: python -m cairn.cli COMMAND ..."""

from __future__ import annotations

import argparse
import getpass
import sys

from pyspark.sql import functions as F

from cairn.functions import formats as X
from cairn.model import CHUNK_MASK_BITS, CHUNK_MIN, MAX_BLOCK_BYTES, PROFILES
from cairn.session import local_session
from cairn.sources.container import requires_password

__version__ = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn", description="Create, inspect, verify and extract archives on Spark.")
    p.add_argument("-V", "--version", action="version", version=f"cairn {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create", aliases=["pack"])
    c.add_argument("source")
    c.add_argument("destination")
    c.add_argument("--profile", choices=PROFILES, default="balanced")
    c.add_argument("--encrypt", action="store_true")
    c.add_argument("--format", type=int, choices=(3, 2), default=3, help="container version")
    c.add_argument("--mode", choices=("fast", "auto", "balanced", "max"), default="auto", help="of version 2's codec policy")
    c.add_argument("--small-kib", type=int, help="files up to this size share blocks")
    c.add_argument("--chunk-mib", type=int, help="largest chunk of a file")
    c.add_argument("--solid-mib", type=int, help="size of shared blocks")
    for name, alias in (("list", "inspect"), ("verify", None)):
        sub.add_parser(name, aliases=[alias] if alias else []).add_argument("archive")
    e = sub.add_parser("extract", aliases=["unpack"])
    e.add_argument("archive")
    e.add_argument("destination")
    e.add_argument("--overwrite", action="store_true", help="replace files and links that are there")
    e.add_argument("--unsafe-links", action="store_true", help="make links that lead to places below the destination")
    e.add_argument("--no-verify", action="store_true", help="don't decode and hash everything before writing")
    e.add_argument("--restore", action="store_true", help="restore modes and times")
    a = sub.add_parser("analyze")
    a.add_argument("source")
    r = sub.add_parser("recover")
    r.add_argument("action", choices=["create"])
    r.add_argument("archive")
    r.add_argument("destination")
    r.add_argument("percent", nargs="?", type=int, default=10)
    f = sub.add_parser("repair")
    f.add_argument("index")
    f.add_argument("base")
    f.add_argument("destination")
    return p


def _bounds(args: argparse.Namespace) -> dict:
    """Options of packing that were given; they must be positive and within the format's block size."""
    out: dict = {}
    if args.small_kib is not None:
        out["small"] = args.small_kib << 10
    if args.solid_mib is not None:
        out["solid_limit"] = args.solid_mib << 20
    if args.chunk_mib is not None:
        out["chunking"] = (min(CHUNK_MIN, args.chunk_mib << 20), args.chunk_mib << 20, CHUNK_MASK_BITS)
    if any(not 0 < (v[1] if isinstance(v, tuple) else v) <= MAX_BLOCK_BYTES for v in out.values()):
        raise ValueError("sizes must be positive and at most a block's limit")
    return out


def _new_password() -> str:
    first, again = getpass.getpass("Archive password: "), getpass.getpass("Once more: ")
    if first != again:
        raise ValueError("passwords did not match")
    if not first:
        raise ValueError("a password must not be empty")
    return first


def _password(path: str) -> str | None:
    import os

    return getpass.getpass("Archive password: ") if os.path.isfile(path) and requires_password(path) else None


def run(args: argparse.Namespace, spark=None, out=None) -> None:
    from cairn.archive import ArchiveEngine

    e = ArchiveEngine(spark or local_session())
    match args.command:
        case "create" | "pack":
            e.create(args.source, args.destination, args.profile, _new_password() if args.encrypt else None, args.format, mode=args.mode, **_bounds(args))
            print("Created.", file=out)
        case "list" | "inspect":
            print("TYPE\tSIZE\tPATH", file=out)
            for r in e.inspect(args.archive, _password(args.archive)).toLocalIterator():
                print(r.type, r.size, r.path, sep="\t", file=out)
        case "verify":
            bad = e.verify(args.archive, _password(args.archive)).limit(20).collect()
            if bad:
                raise ValueError("; ".join(f"{r.rule} {r.subject}: {r.detail}" for r in bad))
            print("Verified.", file=out)
        case "extract" | "unpack":
            n = e.extract(args.archive, args.destination, _password(args.archive), args.restore, args.overwrite, args.unsafe_links, not args.no_verify)
            print(f"Extracted {n} files.", file=out)
        case "analyze":
            for r in e.analyze(args.source).withColumn("shown", X.human_size(F.col("bytes"))).collect():  # three categories
                print(f"{r.category}\t{r.files}\t{r.shown}\t{r.share:.1f}%\t{r.ratio:.3f}", file=out)
        case "recover":
            print(e.create_recovery(args.archive, args.destination, args.percent), file=out)
        case "repair":
            print(f"Repaired {e.repair(args.index, args.base, args.destination)} files.", file=out)


def main(argv: list[str] | None = None) -> int:
    try:
        run(parser().parse_args(argv))
    except Exception as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
