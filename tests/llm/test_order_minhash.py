"""Fingerprints against a plain version."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.llm import order_minhash


def cut_hash(name):
    """The hash's lower bits that are kept, with sign."""
    top = 1 << (64 - order_minhash.POSITION_BITS)
    return F.expr(f"pmod({name}, {top}) - if(pmod({name}, {top}) >= {top // 2}, {top}, 0)")


def plain_fingerprints(df):
    """Order MinHash of texts of plain words, with a row for each k-mer."""
    words = df.select("doc_id", F.split("text", " ").alias("w"))
    kmers = words.select("doc_id", F.posexplode(F.expr("transform(sequence(1, size(w) - 1), i -> xxhash64(xxhash64(w[i - 1]), xxhash64(w[i])))")).alias("at", "h")).withColumn("h", cut_hash("h"))
    number = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("at")) - 1
    dealt = kmers.withColumn("s", F.xxhash64("h", number)).withColumn("s", cut_hash("s"))
    dealt = dealt.withColumn("bucket", F.expr(f"pmod(s, {1 << (64 - order_minhash.POSITION_BITS)}) div {(1 << (64 - order_minhash.POSITION_BITS)) // order_minhash.BUCKETS}"))
    chosen = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy("s", "at"))).filter(F.col("rank") <= order_minhash.TUPLE)
    tuples = chosen.groupBy("doc_id", "bucket").agg(F.lower(F.hex(F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"])))).alias("t"))
    found = {(r["doc_id"], r["bucket"]): r["t"] for r in tuples.collect()}
    return {r["doc_id"]: ".".join(found.get((r["doc_id"], j), "-") for j in range(order_minhash.BUCKETS)) for r in df.collect()}


def test_fingerprints_choose_among_all_kmers_of_a_long_text(spark):
    hot = spark.range(20_000).selectExpr("concat('hot', id) AS w").selectExpr("w", "xxhash64(xxhash64(w), xxhash64(w)) AS h").orderBy(cut_hash("h")).first()["w"]
    texts = [f"{hot} " * 700 + " ".join(f"{v}{i}" for i in range(900)) for v in ("x", "y")]  # more than half of the k-mers differ
    texts += [" ".join([hot] * 700), "one two three four five six", " ".join(f"w{i % 40}" for i in range(3000)), " ".join(f"w{-i % 40}" for i in range(3000))]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["f"] for r in order_minhash.fingerprint(df, "text", "f").collect()}
    assert sum(x == y for x, y in zip(got[0].split("."), got[1].split("."))) < order_minhash.BUCKETS / 2
    assert got == plain_fingerprints(df)


def test_near_copies_are_alike_at_every_length(spark):
    assert 1 << order_minhash.POSITION_BITS >= (1 << 31)  # no text has more places
    texts = [" ".join(f"w{(i * i) % 7919}" for i in range(n)) for n in (126, 127, 129, 65_535, 65_537, 65_540)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = [r["f"].split(".") for r in order_minhash.fingerprint(df, "text", "f").orderBy("doc_id").collect()]
    for a, b in ((0, 1), (1, 2), (3, 4), (4, 5)):
        assert sum(x == y for x, y in zip(got[a], got[b])) > order_minhash.BUCKETS * 0.8
