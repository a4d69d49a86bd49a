"""Many rows of one doc_id, and ids of any size."""

from pyspark.sql import functions as F

from gaugeworks.llm import jaccard, suffix_dedup

PASSAGE = " ".join(f"word{k * k}" for k in range(20))


def test_an_id_of_over_65536_rows_shares_no_key_with_the_next(spark):
    many = spark.range(65_536).select(F.lit(7).cast("long").alias("doc_id"), F.format_string("a%06d", "id").alias("text"))
    few = spark.createDataFrame([(7, "z" + PASSAGE), (8, "the first " + PASSAGE + "!")], "doc_id long, text string")
    out = suffix_dedup.remove_repeats(many.unionByName(few))
    assert out.count() == 65_538
    long = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_text"]) for r in out.filter("n_bytes > 7").collect()}
    assert long == {7: (len(PASSAGE) + 1, 0, "z" + PASSAGE), 8: (len(PASSAGE) + 11, len(PASSAGE), "the first !")}


def test_repeated_ids_may_be_of_any_size(spark):
    rows = [(1 << 60, "b" + PASSAGE), (1 << 60, "a" + PASSAGE), (-(1 << 60), "c" + PASSAGE), (None, "e" + PASSAGE), (None, "d" + PASSAGE)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((r["doc_id"] or 0, r["kept_text"]) for r in out)
    assert kept == [(-(1 << 60), "c"), (0, "d" + PASSAGE), (0, "e"), (1 << 60, "a"), (1 << 60, "b")]


def test_equal_rows_of_one_id_take_part_once(spark):
    text = " ".join(f"w{k}" for k in range(40))
    many = spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    rows = many.unionByName(spark.createDataFrame([(3, text + " end"), (2, text + " more"), (9, "other words")], "doc_id long, text string"))
    once = jaccard._rows_once(rows, rows)
    assert sorted(tuple(r) for r in once.collect()) == sorted([(3, text), (3, text + " end"), (2, text + " more"), (9, "other words")])
    groups = jaccard.near_duplicates(rows.filter("doc_id != 3").unionByName(many.limit(2000)), 4, 80).groupBy("doc_id", "component_id").count().collect()
    assert sorted(tuple(r) for r in groups) == [(2, 2, 1), (3, 2, 2000), (9, 9, 1)]
