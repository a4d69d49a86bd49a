"""A corpus from raw documents to token ids, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, common, decontaminate, jaccard, suffix_dedup, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_documents_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go.

    Each row is judged by its own text, a null one as empty. Rows without an id and
    repeated ids are judged like others. Without labels of both classes the share of
    the one decides; no rows give no rows. Columns other than COLUMNS go.
    """
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.accepted(docs.select(*COLUMNS), model)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that a Jaccard similarity of 0.8 on five-word shingles links, the one of least id stays.

    Texts without words, null ones among them, and rows without an id link with
    nothing and stay. Rows that share an id stand or fall together. No rows give no rows; columns other than COLUMNS go.
    """
    groups = jaccard.near_duplicates(docs, n=5, threshold=80)
    copies = groups.filter("component_id != doc_id").select("doc_id")
    return docs.select(*COLUMNS).join(copies, "doc_id", "left_anti")


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 that occurred before are cut out of the texts.

    Every row stays, if with an empty text; null texts become empty, n_chars is that of
    what is left. Rows without an id count as first, rows that share an id as documents
    in order of text. No rows give no rows; columns other than COLUMNS go.
    """
    kept = suffix_dedup.remove_repeats(docs, length=100, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the benchmark's windows hit a twentieth or more go.

    Each row is judged by its own text, and goes or stays alone, with or without an
    id; null texts have no words and stay. An empty benchmark leaves all; columns other than COLUMNS go.
    """
    found = decontaminate.verdicts(decontaminate.matches(docs, common.read(spark, sf_dir, "benchmark"), keys=True), "row_key")
    bad = found.filter("contaminated").select(F.col("doc_id").alias("bad_id"), "row_key").distinct()
    rows = docs.select(*COLUMNS).withColumn("own_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("own_key") == F.col("row_key"))
    return rows.join(bad, same, "left_anti").drop("own_key")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with their hash and the hash of what they decode to. A null text has none; every row has a result."""
    import public_tokenizers

    return bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", toxic_documents_out),
    ("near_duplicates", near_duplicates_out),
    ("suffix_dedup", repeats_out),
    ("decontamination", benchmark_out),
    ("bpe", token_ids),
]

#: Training a classifier can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each stage's rows written and read again by the next."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs
