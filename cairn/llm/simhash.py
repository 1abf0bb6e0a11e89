"""Document fingerprints: SimHash with DataFrame functions only.

A text's terms are its shingles of five words (fewer words, but not none, make one); a term weighs as often
as it occurs. Each term's hash votes with its weight for or against every bit of the fingerprint. Votes
are summed two bits to a long (a vote in each half), so 128 bits take 64 sums in one aggregation; up to
2**31 terms fit. Ties count as 0. A text without words has the fingerprint of all zeros.

Near fingerprints are found with permuted block tables: the bits are cut into blocks, and every choice of
blocks that must agree by the pigeonhole principle is a table keyed by these blocks' bits. The query searches
for the fingerprints of every row whose doc_id is divisible by EVERY, against all rows.

A null text is the empty one. Very long texts count with all their shingles. Rows that repeat an id, or have
none, are rows of their own, in the order of id (none first) and text; the only row of a table is its own next
one. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import common as C

BITS = 128
SHINGLE = 5
#: Buckets of consecutive documents per shuffle partition.
BUCKETS = 4
#: Bits in which near fingerprints may differ, and blocks that they are cut into.
RADIUS, BLOCKS = 6, 8
#: Of the rows whose doc_id is divisible by this, the query counts the near ones.
EVERY = 100
_HALVES = 0x0000000100000001


def terms(text: Column, size: int = SHINGLE) -> Column:
    """Array of structs of two longs: the 128-bit hashes of the text's shingles."""
    words = F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")

    def made(w: Column) -> Column:
        n = F.size(w)
        def one(i: Column) -> Column:  # noqa: E306
            own = [F.get(w, i + k) for k in range(size)]
            return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(*reversed(own)).alias("b"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), one))

    return F.element_at(F.transform(F.array(words), made), 1)


def _sums() -> list[Column]:
    """64 sums: bits s and s + 32 of a term's two hashes."""
    return [F.sum(F.expr(f"(shiftrightunsigned(term.{h}, {s}) & {_HALVES}L)")).alias(f"{h}{s}") for h in "ab" for s in range(32)]


def _bits(h: str) -> Column:
    """The long whose bits are those with more than half of the terms' votes."""
    parts = []
    for s in range(32):
        low, high = f"({h}{s} & 4294967295L)", f"shiftrightunsigned({h}{s}, 32)"
        parts += [f"shiftleft(cast(2 * {low} > n_terms as bigint), {s})", f"shiftleft(cast(2 * {high} > n_terms as bigint), {s + 32})"]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.expr(p) for p in parts])


def votes(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys (that tell rows apart), fa and fb: the fingerprints' two longs. One aggregation by keys."""
    exploded = texts.select(*keys, F.explode_outer(terms(F.coalesce(F.col(column), F.lit("")))).alias("term"))
    summed = exploded.groupBy(*keys).agg(F.count("term").alias("n_terms"), *_sums())
    return summed.select(*keys, F.coalesce(_bits("a"), F.lit(0)).alias("fa"), F.coalesce(_bits("b"), F.lit(0)).alias("fb"))


def likeness(a: str, b: str) -> Column:
    """Share of the bits in which fingerprints (fa, fb) under the prefixes a and b agree."""
    apart = F.bit_count(F.col(f"{a}fa").bitwiseXOR(F.col(f"{b}fa"))) + F.bit_count(F.col(f"{a}fb").bitwiseXOR(F.col(f"{b}fb")))
    return 1 - apart / F.lit(float(BITS))


def text_of(a: str = "") -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(f"{a}{h}")), 16, "0") for h in ("fa", "fb")]))


def _tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """fa, fb with k and key of each permuted table: any radius flipped bits leave blocks - radius blocks as they are; each choice of so many is a table."""
    if not 0 < radius < blocks <= BITS:
        raise ValueError("radius must be positive and under the number of blocks")
    size = -(-BITS // blocks)
    bits = F.concat(*[F.lpad(F.conv(F.hex(c), 16, 2), 64, "0") for c in ("fa", "fb")])
    tables = F.array(*[
        F.struct(F.lit(k).alias("k"), F.xxhash64(*[F.substring("bits", 1 + size * b, size) for b in pick]).alias("key")) for k, pick in enumerate(combinations(range(blocks), blocks - radius))
    ])
    return prints.select("fa", "fb", bits.alias("bits")).select("fa", "fb", F.explode(tables).alias("t")).select("fa", "fb", "t.k", "t.key")


def _met(left: DataFrame, right: DataFrame, radius: int, blocks: int) -> DataFrame:
    """l_fa, l_fb, r_fa, r_fb, distance: rows of left and right within radius, each pair once."""
    named = lambda t, p: _tables(t, radius, blocks).select("k", "key", *[F.col(c).alias(f"{p}_{c}") for c in ("fa", "fb")])
    both = named(left, "l").join(named(right, "r"), ["k", "key"])
    apart = F.bit_count(F.col("l_fa").bitwiseXOR(F.col("r_fa"))) + F.bit_count(F.col("l_fb").bitwiseXOR(F.col("r_fb")))
    return both.select("l_fa", "l_fb", "r_fa", "r_fb", apart.alias("distance")).where(F.col("distance") <= radius).distinct()


def near(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b, distance), a < b: all pairs of different fingerprints (columns fa, fb) within radius, by their text. For small sets: pairs grow with the square of a group."""
    one = prints.select("fa", "fb").distinct()
    return _met(one, one, radius, blocks).select(text_of("l_").alias("a"), text_of("r_").alias("b"), "distance").where("a < b")


def near_rows(prints: DataFrame, every: int = EVERY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fa, fb, n_near, near_doc_id for the fingerprints of rows (doc_id, fa, fb) whose doc_id is divisible by `every`.

    n_near: rows, besides one of its own, with a fingerprint within radius; near_doc_id: the smallest doc_id of all of them.
    Equal fingerprints are one, with their number, so that copies are not compared.
    """
    some = prints.groupBy("fa", "fb").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    asked = prints.where(F.col("doc_id") % every == 0).select("fa", "fb").distinct()
    found = _met(asked, some, radius, blocks).join(some.select(F.col("fa").alias("r_fa"), F.col("fb").alias("r_fb"), "n", "first"), ["r_fa", "r_fb"])
    return found.groupBy(F.col("l_fa").alias("fa"), F.col("l_fb").alias("fb")).agg((F.sum("n") - 1).alias("n_near"), F.min("first").alias("near_doc_id"))


def with_next(docs: DataFrame) -> DataFrame:
    """b (bucket), rn, doc_id, text, next_text and whether the row only stands for the next bucket's head.

    Buckets are ranges of doc_id with about equally many rows; each also gets the first row of the next
    one, so that every row's successor is in its bucket. Text is dealt out once. The very last row's
    successor is the very first row. Rows with equal doc_id follow in the order of their texts; null ids come first.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = own.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    array = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    step = 1 << max(0, len(cuts).bit_length() - 1)
    steps = F.array(*[F.lit(step >> k) for k in range(step.bit_length())])
    # number of cuts <= doc_id, by halving steps
    bucket = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(array, at + s - 1) <= F.col("doc_id")), at + s).otherwise(at))
    dealt = own.withColumn("b", F.when(F.col("doc_id").isNull() | F.lit(not cuts), F.lit(0)).otherwise(bucket))
    # first id and text of each bucket that has rows, and the bucket before it: as many rows as buckets
    heads = dealt.groupBy("b").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", F.xxhash64("text").alias("x"))).alias("h")).collect()
    heads.sort(key=lambda r: r["b"])
    mark = F.lit(None).cast("int")
    if heads:
        size = len(cuts) + 1
        before, ids, marks = [None] * size, [None] * size, [None] * size  # by bucket; empty buckets stay None
        for k, r in enumerate(heads):
            before[r["b"]], ids[r["b"]], marks[r["b"]] = heads[k - 1]["b"], r["h"]["doc_id"], r["h"]["x"]
        here = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("b"))
        mark = F.when(here(ids, "bigint").eqNullSafe(F.col("doc_id").cast("long")) & (here(marks, "bigint") == F.xxhash64("text")), here(before, "int"))
    two = dealt.withColumn("to", mark).select("doc_id", "text", F.explode(F.when(F.col("to").isNull(), F.array(F.struct("b", F.lit(False).alias("head")))).otherwise(F.array(F.struct("b", F.lit(False).alias("head")), F.struct(F.col("to").alias("b"), F.lit(True).alias("head"))))).alias("p"))
    w = Window.partitionBy("b").orderBy("head", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    spread = two.select("p.b", "p.head", "doc_id", "text")
    return spread.withColumn("rn", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w))


def fingerprints(docs: DataFrame) -> DataFrame:
    """What op3 returns, for docs with doc_id and text."""
    rows = with_next(docs)
    n = F.char_length("text")
    # the last half gives way to the first as many characters of the next text, or all of it
    edited = F.when(F.col("head"), F.lit(None).cast("string")).otherwise(F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("left(coalesce(next_text, text), cast(floor(char_length(text) / 2) as int))")))
    both = rows.select("b", "rn", "head", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    one = both.select("b", "rn", "head", "doc_id", "n_chars", "edited_sha256", F.explode(F.when(F.col("head"), F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("x")))).otherwise(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("x")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("x"))))).alias("v"))
    prints = votes(one.select("b", "rn", "head", "doc_id", "n_chars", "edited_sha256", "v.which", "v.x"), ["b", "rn", "head", "doc_id", "n_chars", "edited_sha256", "which"], "x")
    pair = prints.groupBy("b", "rn", "head", "doc_id", "n_chars", "edited_sha256").agg(*[F.max(F.when(F.col("which") == k, F.col(h))).alias(f"{p}{h}") for k, p in ((0, ""), (1, "e_")) for h in ("fa", "fb")])
    w = Window.partitionBy("b").orderBy("rn")
    own = pair.withColumn("x_fa", F.coalesce(F.lead("fa").over(w), F.col("fa"))).withColumn("x_fb", F.coalesce(F.lead("fb").over(w), F.col("fb"))).where("not head")
    return own.select("doc_id", "n_chars", "edited_sha256", text_of().alias("fingerprint"), text_of("e_").alias("edited_fingerprint"), likeness("", "e_").alias("near_edited"), likeness("", "x_").alias("near_next"))


def searched(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """fingerprints(docs) with n_near and near_doc_id of `near_rows`; null for rows that aren't asked for."""
    long = lambda c: F.conv(c, 16, -10).cast("long")
    got = C.written(fingerprints(docs).withColumns({"fa": long(F.left("fingerprint", F.lit(16))), "fb": long(F.right("fingerprint", F.lit(16)))}))
    found = C.written(near_rows(got.select("doc_id", "fa", "fb"), every))
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    # the many rows that aren't asked for need no join
    return got.where(~asked).drop("fa", "fb").withColumns({"n_near": F.lit(None).cast("long"), "near_doc_id": F.lit(None).cast("long")}).unionByName(got.where(asked).join(found, ["fa", "fb"], "left").drop("fa", "fb"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark.read.parquet(f"{sf_dir}/documents.parquet"))
