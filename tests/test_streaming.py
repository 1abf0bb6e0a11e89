import os

from pyspark.sql import functions as F

from cairn.streaming import dedup as S


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_distinct_blocks_over_batches(spark, tmp_path):
    rows = [[(1, "a" * 10), (2, "b" * 10)], [(3, "a" * 10), (4, "a" * 5 + "c" * 5)]]
    for k, r in enumerate(rows):
        spark.createDataFrame(r, "id long, content string").select("id", F.col("content").cast("binary").alias("content")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(S.distinct_blocks(stream, 5), "blocks1").select("block_id").collect()
    assert len(got) == len(set(got)) == 3


def test_solid_state(spark, tmp_path):
    sizes = [3, 3, 5, 9, 1, 1, 8]
    spark.createDataFrame([("t", k, s) for k, s in enumerate(sizes)], "kind string, member long, size long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = S.document_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    got = sorted((r.member, r.block, r.offset) for r in drain(S.solid_stream(stream, "kind", 10), "solid1").collect())
    assert [(b, o) for _, b, o in got] == [(0, 0), (0, 3), (1, 0), (2, 0), (2, 9), (3, 0), (3, 1)]


def test_solid_state_of_files_in_any_order(spark, tmp_path):
    """Members that arrive late, in several frames and as equal ids are packed as if all had come in order."""
    sizes = {k: (k * 37) % 11 for k in range(60)}
    files = [range(40, 60), range(0, 20, 2), range(20, 40), range(1, 20, 2), [7, 59]]
    for n, ids in enumerate(files):
        rows = [(g, k, sizes[k]) for g in "ab" for k in reversed(ids)]
        spark.createDataFrame(rows, "kind string, member long, size long").coalesce(1).write.parquet(f"{tmp_path}/made/{n}")
        source = next((tmp_path / "made" / str(n)).glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        source.rename(tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    few = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(few)
    spark.conf.set(few, 7)
    try:
        stream = S.document_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        got = S.settled(S.finished(S.solid_stream(stream, "kind", 20)), "kind").collect()
    finally:
        spark.conf.set(few, before)
    block = used = 0
    want = []
    for k in sorted(k for ids in files for k in ids):
        if used and (used + sizes[k] > 20 or used >= 20):
            block, used = block + 1, 0
        want.append((k, block, used))
        used += sizes[k]
    for g in "ab":
        assert sorted((r.member, r.block, r.offset) for r in got if r.kind == g) == sorted(want)


def test_progress(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "verify", 5), ("2024-01-01 00:20:00", "verify", 6), ("2024-01-01 02:00:00", "extract", 1)]
    spark.createDataFrame(rows, "ts string, phase string, bytes long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = S.document_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    got = {(r.phase, r.completed, r.n) for r in drain(S.progress_windows(stream), "progress1", "complete").collect()}
    assert got == {("verify", 11, 2), ("extract", 1, 1)}
