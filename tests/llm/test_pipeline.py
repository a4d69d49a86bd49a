"""Each stage against a plain version on its own input."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from gaugeworks.llm import common, decontaminate, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    docs, out = common.read(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = common.stored(stage(spark, docs, SF), "test-stage")
    return [*out, docs]


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns_of_documents(inputs):
    for df in inputs[:-1]:
        assert sorted(df.columns) == sorted(corpus_pipeline.COLUMNS)


def test_toxic_documents_go(spark, inputs):
    score = toxicity.score(inputs[0], toxicity.fit(inputs[0], common.read(spark, SF, "labels")))
    assert ids(inputs[1]) == ids(score.filter("predicted = 0"))


def test_one_of_each_group_stays(inputs):
    from test_operators import brute_groups

    groups = brute_groups(dict(inputs[1].select("doc_id", "text").collect()), 5, 80)
    assert ids(inputs[2]) == {i for i, (_, c) in groups.items() if c == i}


def test_repeats_go_and_documents_stay(inputs):
    from test_operators import brute_repeats

    before = dict(inputs[2].select("doc_id", "text").collect())
    want = brute_repeats(before, 100)
    after = inputs[3].collect()
    assert {r["doc_id"] for r in after} == set(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    assert all(r["text"] == before[r["doc_id"]] for r in after if want[r["doc_id"]][1] == 0)


def test_contaminated_documents_go(spark, inputs):
    found = decontaminate.verdicts(decontaminate.matches(inputs[3], common.read(spark, SF, "benchmark")))
    assert ids(inputs[4]) == ids(found.filter("not contaminated"))


def test_last_stage_encodes(inputs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    text = dict(inputs[4].select("doc_id", "text").collect())
    for r in inputs[5].collect():
        assert list(r["ids"]) == library.encode(text[r["doc_id"]], add_special_tokens=False).ids


LINES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "


@pytest.fixture(scope="module")
def odd(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a text without an id"), (None, bench), (5, LINES * 4), (5, bench), (6, LINES * 4), (7, LINES * 4 + "end"), (8, "x" * 30_000), (9, "short"), (9, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "cast(null AS string) AS source", "cast(null AS long) AS n_chars")
    return df.selectExpr("*", "1 AS component", "'k' AS row_key", "2.0 AS score", "3 AS own_id")


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_each_stage_takes_odd_rows(spark, odd):
    before = kept(odd)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, SF)
        if k < 4:
            assert sorted(out.columns) == sorted(corpus_pipeline.COLUMNS)
        if k == 1:
            assert kept(out) == [r for r in before if r[0] not in (6, 7)]
        elif k == 3:
            bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
            assert kept(out) == [r for r in before if r[1] != bench]
        elif k in (2, 4):
            assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(i) for i, _ in before)
        else:
            assert out.count() <= len(before)


def test_each_stage_takes_an_empty_table(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).collect() == []
