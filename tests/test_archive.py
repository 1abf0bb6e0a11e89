import hashlib
import io
import json
import lzma
import os
import random
import struct
import tarfile
import threading
import time
import zipfile
import zlib

import pytest

from cairn import cli
from cairn.archive import ArchiveEngine
from cairn.jobs import JobManager
from cairn.functions import crypto
from cairn.operators import archiving as A
from cairn.sources import container, sinks, trees

KDF = (8 << 10, 1, 1)


@pytest.fixture(scope="module")
def engine(spark):
    return ArchiveEngine(spark)


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "source"
    (root / "sub/empty").mkdir(parents=True)
    rng = random.Random(9)
    sizes = {"empty.bin": 0, "one.txt": 1, "small.txt": 4096, "large.txt": 4097, "zero.bin": 70_000, "mega.bin": (1 << 20) + 1}
    for name, n in sizes.items():
        (root / name).write_bytes(bytes(n) if name == "zero.bin" else rng.randbytes(n) if name == "mega.bin" else (b"line of text\n" * (n // 13 + 1))[:n])
    data = b"repeat me" * 20000 + bytes(150_000)
    (root / "sub/one.bin").write_bytes(data)
    (root / "sub/two.bin").write_bytes(data)
    (root / "sub/zeros.small").write_bytes(bytes(100))
    return root


def contents(root):
    return {os.path.relpath(f"{d}/{n}", root): open(f"{d}/{n}", "rb").read() for d, _, names in os.walk(root) for n in names}  # noqa: SIM115


@pytest.mark.parametrize("profile", ["fast", "balanced", "smallest", "store"])
def test_round_trip(engine, source, tmp_path, profile):
    out = str(tmp_path / "x.spk")
    engine.create(str(source), out, profile)
    assert engine.verify(out).collect() == []
    blocks = engine.tables(out)[1]
    assert blocks.count() == blocks.select("block_id").distinct().count()
    assert engine.extract(out, str(tmp_path / "out")) == 9
    assert contents(tmp_path / "out/source") == contents(source)
    assert (tmp_path / "out/source/sub/empty").is_dir()
    with pytest.raises(FileExistsError):
        engine.create(str(source), out)
    with pytest.raises(FileExistsError):
        engine.extract(out, str(tmp_path / "out"))


def test_duplicates_share_blocks(engine, tmp_path):
    root = tmp_path / "source"
    root.mkdir()
    for n in ("one.bin", "two.bin"):
        (root / n).write_bytes(b"repeat me" * 20000 + bytes(150_000))
    out = str(tmp_path / "d.spk")
    engine.create(str(root), out)
    entries, blocks = engine.tables(out)
    assert blocks.count() == 2
    assert entries.selectExpr("size(segments) n").where("n > 0").agg({"n": "sum"}).first()[0] == 6


def test_encryption(engine, tmp_path):
    root = tmp_path / "s"
    root.mkdir()
    (root / "private-name.txt").write_text("classified content marker")
    out = str(tmp_path / "e.spk")
    engine.create(str(root), out, password="correct horse", kdf=KDF)
    assert container.requires_password(out)
    raw = open(out, "rb").read()  # noqa: SIM115
    assert b"private-name" not in raw and b"classified" not in raw
    assert engine.verify(out, "correct horse").collect() == []
    assert engine.extract(out, str(tmp_path / "o"), "correct horse") == 1
    assert (tmp_path / "o/s/private-name.txt").read_text() == "classified content marker"
    with pytest.raises(ValueError):
        container.read_index(io.BytesIO(raw), len(raw), "wrong")
    with pytest.raises(ValueError):
        engine.create(str(root), str(tmp_path / "f.spk"), password="")


def old_container(path, entries, payload=b"made with the older layout", trailing=b""):
    digest = hashlib.sha256(payload).digest()
    packed = zlib.compress(payload)
    plain = json.dumps({"format": "x", "version": 2, "entries": entries(digest.hex(), len(payload))}).encode()
    stored = lzma.compress(plain, preset=6)
    with open(path, "wb") as f:
        f.write(b"SPK2\r\n\x1a\n" + struct.pack("<I", 2) + b"B" + struct.pack("<32sBQQ", digest, 1, len(payload), len(packed)) + packed)
        f.write(b"M" + struct.pack("<QQ32s", len(plain), len(stored), hashlib.sha256(plain).digest()) + stored + b"E" + trailing)


def test_older_version_is_read(engine, tmp_path):
    p = str(tmp_path / "old.spk")
    old_container(p, lambda h, n: [{"path": "legacy", "type": "directory", "mtime_ns": -5}, {"path": "legacy/file.txt", "type": "file", "size": n, "mode": 420, "modified_unix": 7, "segments": [{"block": h, "offset": 0, "length": n}]}], trailing=b"more")
    rows = {r.path: r for r in engine.tables(p)[0].collect()}
    assert rows["legacy"].size == 0 and rows["legacy"].mtime_ns == -5 and rows["legacy/file.txt"].mtime_ns == 7_000_000_000
    assert engine.verify(p).collect() == []
    engine.extract(p, str(tmp_path / "o"))
    assert (tmp_path / "o/legacy/file.txt").read_bytes() == b"made with the older layout"


@pytest.mark.parametrize("entry", [{"path": "../escape", "type": "file", "size": 0}, {"path": "large.bin", "type": "file", "size": (1 << 40) + 1, "segments": [{"zero": (1 << 40) + 1}]}, {"path": "l", "type": "symlink", "target": "x"}])
def test_nothing_is_written_for_bad_manifests(engine, tmp_path, entry):
    p = str(tmp_path / "bad.spk")
    old_container(p, lambda h, n: [entry])
    with pytest.raises(container.ContainerError):
        engine.extract(p, str(tmp_path / "o"))
    assert not (tmp_path / "o").exists()


def test_damage_is_found(engine, source, tmp_path):
    p = str(tmp_path / "x.spk")
    engine.create(str(source), p, "store")
    b = engine._table(p, "block_index", None).orderBy("offset").first()
    with open(p, "r+b") as f:
        f.seek(b.offset)
        f.write(b"\xff\xfe")
    assert [r.rule for r in engine.verify(p).collect()] == ["R19"]
    raw = open(p, "rb").read()  # noqa: SIM115
    for broken in (raw[:-1], raw + b"x", b"nothing", raw[:12] + b"\x02" + raw[13:], raw[:20] + b"\x01" + raw[21:]):
        with pytest.raises(ValueError):
            container.read_index(io.BytesIO(broken), len(broken))


def test_zip_and_tar(engine, spark, source, tmp_path):
    out = str(tmp_path / "x.zip")
    engine.create(str(source), out)
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None and "source/sub/empty/" in z.namelist()
    assert engine.verify(out).collect() == []
    engine.extract(out, str(tmp_path / "o"))
    assert contents(tmp_path / "o/source") == contents(source)
    tar = str(tmp_path / "x.tar.gz")
    manifest = sinks.write_tar_gz(engine.files(str(source)), tar)
    assert sinks.check_sidecar(spark, manifest, trees.archives(spark, tar)).collect() == []
    got = {r.path: bytes(r.content) for r in trees.archives(spark, tar).where("type = 'file'").collect()}
    assert got == {f"source/{k}": v for k, v in contents(source).items()}
    with tarfile.open(str(tmp_path / "evil.tar"), "w") as t:
        t.addfile(tarfile.TarInfo("../evil"), io.BytesIO())
    with pytest.raises(ValueError):
        engine.extract(str(tmp_path / "evil.tar"), str(tmp_path / "p"))
    with pytest.raises(Exception, match="unknown archive|can't be read"):
        (tmp_path / "y.7z").write_bytes(b"7z\xbc\xaf\x27\x1c0000")
        trees.archives(spark, str(tmp_path / "y.7z")).count()


def test_links_at_the_destination_are_not_followed(engine, source, tmp_path):
    p = str(tmp_path / "x.spk")
    engine.create(str(source), p, "store")
    (tmp_path / "target").write_text("keep")
    (tmp_path / "o/source").mkdir(parents=True)
    (tmp_path / "o/source/one.txt").symlink_to(tmp_path / "target")
    with pytest.raises(FileExistsError):
        engine.extract(p, str(tmp_path / "o"))
    assert (tmp_path / "target").read_text() == "keep"


def test_overwriting_replaces_the_link_itself(engine, source, tmp_path):
    p = str(tmp_path / "x.spk")
    engine.create(str(source), p, "store")
    (tmp_path / "target").write_text("keep")
    (tmp_path / "o/source/sub").mkdir(parents=True)
    (tmp_path / "o/source/one.txt").symlink_to(tmp_path / "target")
    (tmp_path / "o/source/small.txt").write_text("old")
    assert engine.extract(p, str(tmp_path / "o"), overwrite=True) == 9
    assert (tmp_path / "target").read_text() == "keep" and contents(tmp_path / "o/source") == contents(source)
    (tmp_path / "p/source").mkdir(parents=True)
    (tmp_path / "away").mkdir()
    (tmp_path / "p/source/sub").symlink_to(tmp_path / "away")
    with pytest.raises(FileExistsError):  # a folder that is a link is never followed
        engine.extract(p, str(tmp_path / "p"), overwrite=True)
    assert not list((tmp_path / "away").iterdir())


def test_links_are_made_below_the_destination_only(engine, tmp_path):
    def tar(name, links):
        with tarfile.open(tmp_path / name, "w") as t:
            info = tarfile.TarInfo("d/f.txt")
            info.size = 4
            t.addfile(info, io.BytesIO(b"text"))
            for path, kind, target in links:
                info = tarfile.TarInfo(path)
                info.type, info.linkname = kind, target
                t.addfile(info)
        return str(tmp_path / name)

    good = tar("good.tar", [("d/s", tarfile.SYMTYPE, "f.txt"), ("h", tarfile.LNKTYPE, "d/f.txt")])
    with pytest.raises(container.ContainerError):
        engine.extract(good, str(tmp_path / "no"))
    assert engine.extract(good, str(tmp_path / "o"), links=True) == 1
    assert os.readlink(tmp_path / "o/d/s") == "f.txt" and os.path.samefile(tmp_path / "o/h", tmp_path / "o/d/f.txt") and not os.path.islink(tmp_path / "o/h")
    with pytest.raises(container.ContainerError):
        engine.extract(tar("bad.tar", [("d/s", tarfile.SYMTYPE, "../../target")]), str(tmp_path / "q"), links=True)
    assert not os.path.lexists(tmp_path / "q/d/s")


def test_bounds_on_the_command_line(spark, source, tmp_path):
    out = io.StringIO()
    cli.run(cli.parser().parse_args(["create", str(source), str(tmp_path / "a.spk"), "--small-kib", "2", "--chunk-mib", "2", "--solid-mib", "1", "--profile", "fast"]), spark, out)
    cli.run(cli.parser().parse_args(["pack", str(source), str(tmp_path / "b.spk"), "--format", "2", "--mode", "fast"]), spark, out)
    for name in "ab":
        cli.run(cli.parser().parse_args(["extract", str(tmp_path / f"{name}.spk"), str(tmp_path / "o"), "--overwrite", "--no-verify", "--restore"]), spark, out)
        assert contents(tmp_path / "o/source") == contents(source)
    for wrong in (["--small-kib", "0"], ["--chunk-mib", "33"], ["--solid-mib", "-1"]):
        with pytest.raises(ValueError):
            cli.run(cli.parser().parse_args(["create", str(source), str(tmp_path / "c.spk"), *wrong]), spark, out)


def test_native_tables_and_scan(engine, spark, source, tmp_path):
    place = str(tmp_path / "native")
    engine.save(engine.files(str(source)), place, spread=1)
    assert engine.verify(place).collect() == []
    assert engine.extract(place, str(tmp_path / "o")) == 9
    assert contents(tmp_path / "o/source") == contents(source)
    engine.create(str(source), str(tmp_path / "c/x.spk") if (tmp_path / "c").mkdir() is None else "")
    assert container.scan(spark, str(tmp_path / "c")).where("type = 'file'").count() == 9


def test_older_version_is_written_and_metadata_restored(engine, source, tmp_path):
    p = str(tmp_path / "two.spk")
    os.chmod(source / "one.txt", 0o640)
    os.utime(source / "one.txt", ns=(5_000_000_001, 5_000_000_001))
    engine.create(str(source), p, version=2)
    assert open(p, "rb").read(4) == b"SPK2" and engine.verify(p).collect() == []  # noqa: SIM115
    engine.extract(p, str(tmp_path / "o"), restore=True)
    assert contents(tmp_path / "o/source") == contents(source)
    st = os.stat(tmp_path / "o/source/one.txt")
    assert st.st_mode & 0o777 == 0o640 and st.st_mtime_ns == 5_000_000_001


def test_equal_small_files_can_share_a_place(engine, tmp_path):
    root = tmp_path / "s"
    root.mkdir()
    for k in range(5):
        (root / f"{k}.txt").write_text("the same text" if k != 2 else "another text")
    f = engine.files(str(root))
    for share, size in ((False, 64), (True, 25)):
        entries, blocks = A.pack(f, "store", share_small=share)
        assert blocks.agg({"raw_size": "sum"}).first()[0] == size
        got = {r.path: bytes(r.piece) for r in A.pieces(entries, blocks).where("piece is not null").collect()}
        assert got == {f"s/{k}": v for k, v in contents(root).items()}


def test_jobs(spark):
    jobs = JobManager(spark)
    gate = threading.Event()
    a, b = jobs.start("verify", lambda progress: (progress("verify", 1, 2), gate.wait(20))[1]), jobs.start("list", lambda _: gate.wait(20))
    with pytest.raises(RuntimeError):
        jobs.start("third", lambda _: None)
    gate.set()
    assert jobs.result(a, 20) and jobs.result(b, 20)
    bad = jobs.start("bad", lambda _: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        jobs.result(bad, 20)
    rows = jobs.table().collect()
    assert rows[0].job_id == 3 and {(r.event, r.phase) for r in rows if r.job_id == 1} == {("progress", "verify"), ("finished", None)}
    slow = jobs.start("slow", lambda _: spark.range(10**12).selectExpr("sum(hash(id))").collect())
    time.sleep(3)
    jobs.cancel(slow)
    with pytest.raises(Exception, match="cancel"):
        jobs.result(slow, 60)


def test_recovery(engine, source, tmp_path):
    p = tmp_path / "x.spk"
    engine.create(str(source), str(p))
    index = engine.create_recovery(str(p), str(tmp_path / "r"), 20)
    good = p.read_bytes()
    bad = bytearray(good)
    bad[100:200] = bytes(100)
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.spk").write_bytes(bad)
    assert engine.repair(index, str(tmp_path / "b"), str(tmp_path / "fixed")) == 1
    assert (tmp_path / "fixed/x.spk").read_bytes() == good
    with pytest.raises(ValueError):
        engine.create_recovery(str(p), str(tmp_path / "r2"), 0)


def test_analyze(engine, source):
    rows = {r.category: r for r in engine.analyze(str(source)).collect()}
    assert rows["text"].files == 3 and abs(sum(r.share for r in rows.values()) - 100) < 1e-9


def test_command_line(spark, source, tmp_path, capsys):
    p = str(tmp_path / "x.spk")
    assert cli.main(["create", str(source), p, "--profile", "fast"]) == 0
    assert cli.main(["list", p]) == 0
    assert "file\t4096\tsource/small.txt" in capsys.readouterr().out
    assert cli.main(["verify", p]) == 0
    assert cli.main(["extract", p, str(tmp_path / "o")]) == 0
    assert cli.main(["analyze", str(source)]) == 0
    assert cli.main(["extract", p, str(tmp_path / "o")]) == 1
    assert crypto is not None
