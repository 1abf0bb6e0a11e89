"""Schemas of the relations that stand for archives."""

from __future__ import annotations

from pyspark.sql import types as T

SEGMENT = T.StructType([T.StructField("block", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("zero", T.LongType())])
ENTRY = T.StructType([
    T.StructField("path", T.StringType(), False), T.StructField("type", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime_ns", T.LongType()),
    T.StructField("mode", T.IntegerType()), T.StructField("uid", T.LongType()), T.StructField("gid", T.LongType()), T.StructField("target", T.StringType()), T.StructField("segments", T.ArrayType(SEGMENT)),
])
BLOCK_INDEX = T.StructType([T.StructField("block_id", T.StringType()), T.StructField("method", T.ByteType()), T.StructField("raw_size", T.LongType()), T.StructField("stored_size", T.LongType()), T.StructField("offset", T.LongType())])
BLOCK = T.StructType([*BLOCK_INDEX, T.StructField("payload", T.BinaryType())])
HEADER = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("encrypted", T.BooleanType()), T.StructField("salt", T.BinaryType()), T.StructField("kdf_memory_kib", T.LongType()), T.StructField("kdf_iterations", T.LongType()),
    T.StructField("kdf_lanes", T.LongType()), T.StructField("manifest_raw_size", T.LongType()), T.StructField("manifest_stored_size", T.LongType()), T.StructField("manifest_digest", T.BinaryType()),
])
FILE = T.StructType([
    T.StructField("path", T.StringType(), False), T.StructField("type", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("mtime_ns", T.LongType()), T.StructField("mode", T.IntegerType()),
    T.StructField("uid", T.LongType()), T.StructField("gid", T.LongType()), T.StructField("dev", T.LongType()), T.StructField("inode", T.LongType()), T.StructField("nlink", T.IntegerType()), T.StructField("target", T.StringType()),
])
VIOLATION = T.StructType([T.StructField("rule", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("detail", T.StringType())])

# Fixed values of the container format and its limits.
MAGIC_V2 = b"SPK2\r\n\x1a\n"
MAGIC_V3 = b"SPK3\r\n\x1a\n"
METHOD_NAMES = {0: "raw", 1: "zlib", 2: "bz2", 3: "lzma", 4: "zstd", 5: "zero", 6: "xz"}
MAX_MANIFEST_BYTES = 64 << 20
MAX_BLOCK_BYTES = 32 << 20
MAX_XZ_MEMORY = 256 << 20
MAX_BLOCKS = 2_000_000
MAX_ENTRIES = 1_000_000
MAX_OUTPUT_BYTES = 1 << 40
MAX_RECOVERY_MEMORY = 512 << 20
MAX_PATH_BYTES = 64 << 10
KDF_DEFAULT = (64 << 10, 3, 1)  # KiB of memory, iterations, lanes
KDF_BOUNDS = ((8 << 10, 256 << 10), (1, 10), (1, 8))
CHUNK_MIN, CHUNK_MAX, CHUNK_MASK_BITS = 64 << 10, 1 << 20, 18
SMALL_FILE = 4096
SOLID_LIMIT = 256 << 10
ENTRY_TYPES = ("file", "directory", "dir", "symlink", "hardlink")
PROFILES = ("fast", "balanced", "smallest", "store")
