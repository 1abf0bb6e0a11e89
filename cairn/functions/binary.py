"""Bytes: digests, signatures, text and zero tests, header fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.model import MAGIC_V2, MAGIC_V3

# First bytes of data that is compressed already.
SIGNATURES = (
    b"PK\x03\x04",
    b"\x1f\x8b",
    b"BZh",
    b"\xfd7zXZ\0",
    b"\x28\xb5\x2f\xfd",
    b"\x89PNG\r\n\x1a\n",
    b"\xff\xd8\xff",
    b"%PDF",
    b"OggS",
    b"RIFF",
)


def _bytes(x: bytes) -> Column:
    return F.expr(f"X'{x.hex()}'")


def sha256(data: Column) -> Column:
    """Lower-case hexadecimal digest."""
    return F.sha2(data, 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 with built-in digests only; lower-case hexadecimal."""
    import hashlib

    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(_bytes(inner), message), 256))
    return F.sha2(F.concat(_bytes(outer), first), 256)


def keyed_id(key: bytes, data: Column, label: bytes = b"cairn block id\0") -> Column:
    """Block id under a key: HMAC over a label and the data's digest. The label is the writer's."""
    return hmac_sha256(key, F.concat(_bytes(label), F.unhex(F.sha2(data, 256))))


def is_zero(data: Column) -> Column:
    """All bytes are zero; true for no bytes."""
    return data == F.repeat(F.lit(b"\0"), F.octet_length(data))


def looks_compressed(data: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(data, _bytes(s)) for s in SIGNATURES])


def looks_like_text(data: Column) -> Column:
    """Valid UTF-8 without NUL, and under a twentieth control characters but line feed, return and tab."""
    s = data.cast("string")
    controls = F.regexp_count(s, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))
    return F.is_valid_utf8(s) & ~s.contains("\x00") & (controls * 20 < F.greatest(F.octet_length(data), F.lit(1)))


def container_version(data: Column) -> Column:
    """2 or 3 by the first eight bytes, else null."""
    return F.when(F.startswith(data, _bytes(MAGIC_V3)), 3).when(F.startswith(data, _bytes(MAGIC_V2)), 2)


def requires_password(data: Column) -> Column:
    """Bit 0 of byte 12 of a version 3 container."""
    flag = F.conv(F.hex(F.substring(data, 13, 1)), 16, 10).cast("int")
    return F.coalesce((container_version(data) == 3) & (flag.bitwiseAND(1) == 1), F.lit(False))


def slice_bytes(data: Column, offset: Column, length: Column) -> Column:
    return F.substring(data, offset + 1, length)


def block_aad(block_id: Column, raw_size: Column, method: Column) -> Column:
    """Associated data of a sealed block: label, id, size as eight little-endian bytes, method."""
    little = F.unhex(F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda k: F.substring(F.lpad(F.hex(raw_size), 16, "0"), k * 2 + 1, F.lit(2))), ""))
    return F.concat(_bytes(b"SPK3 block"), F.unhex(block_id), little, F.unhex(F.lpad(F.hex(method), 2, "0")))
