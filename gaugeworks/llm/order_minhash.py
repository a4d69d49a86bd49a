"""Order MinHash fingerprints with SQL functions alone (operator 9)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words (or pieces of longer ones) in a k-mer, bits of a bucket's number, k-mers in a tuple.
K, BUCKET_BITS, TUPLE = 2, 5, 2
#: Tuples in a fingerprint.
BUCKETS = 1 << BUCKET_BITS
#: Longer runs of characters without white space are cut into pieces of this length.
PIECE = 12
#: Bytes of text in a range of doc_id, in which the next document is found, and how many ranges there are at most (beyond 256 GB they grow).
RANGE_BYTES, RANGES = 16 << 20, 1 << 14
#: Bits of a k-mer's place below its hash, for texts of any length, so that hashes of all texts are alike.
POSITION_BITS = 31


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column out: the Order MinHash fingerprint of column text.

    A text's k-mers are K units in a row, units being runs of up to PIECE
    characters without white space. All k-mers of the text are numbered among
    their equals in order of place, so that repeats count. A second hash, of
    k-mer and number, deals them into BUCKETS by its upper bits; each bucket
    takes its TUPLE least of the whole text, puts them back in text order and
    hashes the tuple. The fingerprint is the tuples' hashes in hexadecimal, '-'
    for a bucket without k-mers.

    All of it stays within the row: no shuffle, and no step gathers more than a text.
    """
    u, w, h, occ, best, least = (f"__{out}_{x}" for x in ("u", "w", "h", "occ", "best", "least"))
    df = df.withColumn(w, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"\S{{1,{PIECE}}}"), 0), lambda x: F.xxhash64(x)))

    def shift_left(x: Column) -> Column:
        return F.shiftleft(x, POSITION_BITS)

    def shift_right(x: Column) -> Column:
        return F.shiftright(x, POSITION_BITS)

    low = F.lit((1 << POSITION_BITS) - 1)
    # hash in the upper bits and place in the lower ones: sorting longs needs no comparison of structures
    kmers = F.transform(
        F.when(F.size(w) >= K, F.sequence(F.lit(1), F.size(w) - (K - 1))).otherwise(F.when(F.size(w) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))),
        lambda i: shift_left(F.xxhash64(*[F.get(F.col(w), i + (k - 1)) for k in range(K)])).bitwiseOR(i.cast("long")),
    )
    df = df.withColumn(h, F.sort_array(kmers))
    # where a new k-mer begins in the sorted array; within a run the number is the distance from there
    df = df.withColumn(occ, F.transform(F.col(h), shift_right))
    starts = F.filter(F.sequence(F.lit(0), F.size(occ) - 1), lambda i: (i == 0) | (F.get(F.col(occ), i) != F.get(F.col(occ), i - 1)))
    df = df.withColumn(u, F.when(F.size(occ) > 0, starts).otherwise(F.array().cast("array<int>")))
    runs = F.transform(F.col(u), lambda s, j: F.sequence(F.lit(0), F.coalesce(F.get(F.col(u), j + 1), F.size(occ)) - s - 1))
    df = df.withColumn(u, F.flatten(runs))
    second = F.zip_with(F.col(h), F.col(u), lambda x, o: shift_left(F.xxhash64(shift_right(x), o)).bitwiseOR(x.bitwiseAND(low)))
    df = df.withColumn(best, F.sort_array(second))

    def bucket_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - BUCKET_BITS)

    # sorted, each bucket is a run, and its least are those with another bucket's k-mer, or none, TUPLE places before
    df = df.withColumn(least, F.filter(F.col(best), lambda x, i: (i < TUPLE) | (bucket_of(x) != bucket_of(F.get(F.col(best), i - TUPLE)))))

    def bucket(j: Column) -> Column:
        mine = F.filter(F.col(least), lambda x: bucket_of(x) == j)
        ordered = F.array_sort(F.transform(mine, lambda x: F.struct(x.bitwiseAND(low).alias("at"), shift_right(x).alias("h"))))
        return F.when(F.size(mine) == 0, F.lit("-")).otherwise(F.lower(F.hex(F.xxhash64(F.transform(ordered, lambda x: x["h"])))))

    df = df.withColumn(out, F.concat_ws(".", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), bucket)))
    return df.drop(u, w, h, occ, best, least)


def likeness(a: str, b: str) -> Column:
    """Share of equal tuples among the buckets that either fingerprint fills; 1 if neither fills any."""
    pairs = F.arrays_zip(F.split(F.col(a), r"\.").alias("a"), F.split(F.col(b), r"\.").alias("b"))
    used = F.size(F.filter(pairs, lambda p: (p["a"] != "-") | (p["b"] != "-")))
    same = F.size(F.filter(pairs, lambda p: (p["a"] != "-") & (p["a"] == p["b"])))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, range, ghost, next_text): the document that follows in descending doc_id, the first after the last.

    Ids are cut at quantiles into ranges of about RANGE_BYTES of text, and each range is ordered in its own
    partition. The first document of each range also stands, as a ghost, at the
    end of the range above, whose last document it follows. Ghosts are kept in the
    result, for columns to be carried on by lead(); drop them at the end.
    Only cut points and the ranges' first ids go to the driver: at most `ranges` of either.
    """
    rows = common.texts(docs)
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("doc_id")).first()
    if ranges is None:
        ranges = min(RANGES, max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / RANGE_BYTES)))
    cuts = rows.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges) if n and ranges > 1 else []
    cuts = sorted({int(c) for c in cuts})
    placed = rows.withColumn("range", _range_of(cuts).cast("int"))
    first = [(r["range"], r["top"]) for r in placed.groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()]
    tops, above = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for i, (k, top) in enumerate(first):
        tops[k], above[k] = top, first[(i + 1) % len(first)][0]
    is_top = F.col("doc_id").eqNullSafe(F.get(_literals(tops), F.col("range")))
    ghost = F.array(F.struct(F.get(_literals(above), F.col("range")).cast("int").alias("range"), F.lit(True).alias("ghost")))
    own = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost")))
    places = F.when(is_top, F.concat(own, ghost)).otherwise(own)
    spread = placed.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.range", "place.ghost")
    return spread.withColumn("next_text", F.lead("text").over(order()))


def _literals(values: list[int | None]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _range_of(cuts: list[int]) -> Column:
    """How many cuts lie below doc_id, by way of every so many of them; a null id comes last, in the lowest range."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1

    def below(cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c < F.col("doc_id")))

    coarse = below(_literals(cuts[step - 1 :: step])) * step
    at = coarse + below(F.slice(_literals(cuts), coarse + 1, step))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at)


def order() -> Window:
    return Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of docs(doc_id, text).

    The edited text has the last floor(n_chars / 2) characters replaced by the
    first as many (or all) of the next document in descending doc_id; the first
    document follows the last. A single document is its own next one.

    A null text is an empty one; fingerprints of texts without k-mers are alike.
    A null doc_id comes last. Rows with one doc_id are ordered by text. Other columns are ignored.
    """
    n, half = F.length("text").cast("long"), F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs).withColumns({"n_chars": n, "half": half})
    edited = F.concat(F.expr("substring(text, 1, n_chars - half)"), F.expr("substring(coalesce(next_text, ''), 1, half)"))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    rows = fingerprint(fingerprint(rows, "text", "fingerprint"), "edited", "edited_fingerprint")
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(order())).filter(~F.col("ghost"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.read(spark, sf_dir, "documents"))
