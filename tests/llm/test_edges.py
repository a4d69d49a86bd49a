"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, chat, decontaminate, jaccard, order_minhash, quality, suffix_dedup, token_counts, token_files, toxicity

LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
ROWS = [
    (None, "a text without an id"), (1, None), (2, ""), (3, LONG), (4, BASE * 3), (4, BASE * 3), (5, BASE * 3), (6, " \n\t "), (7, "   two   spaces  "),
    (8, "x" * 50_000), (9, "é中😀 <|endoftext|> ok"), (10, "short"), (-3, BASE + "end"),
]
CLASHING = ["shard", "spans", "band", "component", "range", "ghost", "score", "ids", "row_key", "label", "fold", "system", "next_text", "own_id", "content", "node", "word", "a", "b"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(None).cast("long"))
    for c in CLASHING:
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (4, 1, 1), (5, 0, 0), (None, 1, 1), (4, 1, 1), (99, 0, 7)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("i1", BASE), ("i2", "short"), ("i3", None), (None, "two spaces"), ("i1", BASE), ("i4", "!!")], "item_id string, text string")


def write_and_digest(df, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orc") / "tokens")
    token_files.write_token_files(df, path, P.path("byte_bpe_50k.json"))
    return token_files.digest(spark, path)


def operators(spark, labels, bench, tmp_path_factory):
    word = P.path("word_bpe_49k.json")
    return {
        "token_files": lambda d: write_and_digest(d, spark, tmp_path_factory),
        "token_counts": lambda d: token_counts.token_counts(d, P.path("piece_bpe_32k.model")),
        "suffix_dedup": lambda d: suffix_dedup.remove_repeats(d),
        "jaccard": lambda d: jaccard.near_duplicates(d),
        "quality": lambda d: quality.quality_scores(d, labels),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "decontaminate": lambda d: decontaminate.verdicts(decontaminate.matches(d, bench)),
        "order_minhash": lambda d: order_minhash.fingerprints(d),
        "bpe": lambda d: bpe.digest(d, word),
    }


NAMES = ["token_files", "token_counts", "suffix_dedup", "jaccard", "quality", "toxicity", "decontaminate", "order_minhash", "bpe"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(name, spark, docs, labels, bench, tmp_path_factory):
    out = operators(spark, labels, bench, tmp_path_factory)[name](docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((i is None, i or 0) for i, _ in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_an_empty_table_gives_no_rows(name, spark, docs, labels, bench, tmp_path_factory):
    empty = spark.createDataFrame([], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    if name == "token_files":
        return  # no rows, no files
    assert operators(spark, labels, bench, tmp_path_factory)[name](empty).collect() == []


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_null_and_empty_texts(spark, docs, labels, bench, tmp_path_factory):
    ops = operators(spark, labels, bench, tmp_path_factory)
    t, s, j, d = (by_id(ops[n](docs)) for n in ("token_files", "suffix_dedup", "jaccard", "decontaminate"))
    empty = hashlib.sha256(b"").hexdigest()
    for i in (1, 2):
        assert t[i]["n_tokens"] == 1
        assert (s[i]["n_bytes"], s[i]["n_removed"], s[i]["kept_sha256"], s[i]["kept_text"]) == (0, 0, empty, "")
        assert (j[i]["n_shingles"], j[i]["component_id"]) == (0, i)
        assert (d[i]["n_words"], d[i]["contaminated"]) == (0, False)
    assert j[None]["component_id"] is None
    assert j[5]["component_id"] == j[4]["component_id"] == 4
    assert d[10]["contaminated"] and d[10]["n_items"] == 1
    c = by_id(ops["token_counts"](docs))
    assert (c[1]["n_tokens"], c[2]["n_tokens"]) == (0, 0)
    assert c[8]["n_tokens"] > 0
    o = by_id(ops["order_minhash"](docs))
    assert o[1]["fingerprint"] == o[2]["fingerprint"] and o[4]["fingerprint"] == o[5]["fingerprint"]


def test_repeated_rows_of_one_id_are_documents_in_order_of_text(docs):
    rows = [r for r in suffix_dedup.remove_repeats(docs).collect() if r["doc_id"] == 4]
    assert len(rows) == 2
    assert max(r["n_removed"] for r in rows) == len(BASE * 3)  # the second copy goes whole


def test_conversations_with_nulls_ties_and_no_rows(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 1, "user", "again"), (1, 2, "assistant", "<s>[INST] \\ </s>"), (None, 0, None, "x"), (2, None, "assistant", "a" * 9000), (2, 300, "tool\n%", "t"), (2, 300, "tool\n%", "t")],
        "conv_id long, turn long, role string, text string",
    ).withColumn("spans", F.lit(1)).withColumn("chapter", F.lit("c"))
    out = chat.format_conversations(turns, P.path("byte_bpe_50k.json"))
    assert out.columns == ["conv_id", "chapter", "window", "text", "new_at", "spans", "n_tokens"]
    d = {r["conv_id"]: r for r in chat.digest(out).collect()}
    assert {k: r["n_turns"] for k, r in d.items()} == {1: 4, None: 1, 2: 3}
    said = "system\nbe kind\nuser\n\nuser\nagain\nassistant\n<s>[INST] \\ </s>\n"
    assert d[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert d[1]["loss_sha256"] == hashlib.sha256(b"<s>[INST] \\ </s>").hexdigest()
    assert d[2]["loss_chars"] == 9000
    assert chat.format_conversations(turns.limit(0), P.path("byte_bpe_50k.json")).count() == 0
