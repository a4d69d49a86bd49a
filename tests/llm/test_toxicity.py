"""A labelled id of many rows trains as one."""

from pyspark.sql import functions as F

from gaugeworks.llm import common, toxicity

SF = "/root/testdata/sf0.001"


def test_rows_of_a_labelled_id_count_once(spark):
    docs, labels = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    some = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4).select("doc_id").limit(1)
    copies = docs.join(some, "doc_id").crossJoin(spark.range(500)).select("doc_id", "text", "lang", "source", "n_chars")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs.unionByName(copies), labels)
