"""Tables of single short texts."""

import numpy as np
import pytest

from gaugeworks.llm import common, jaccard


def test_shingles_of_chunks_with_few_words():
    hasher = common.WordHasher(jaccard.SEPARATORS)

    def sets(texts, n):
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        return jaccard.shingle_sets(raw, np.cumsum([0, *map(len, texts)]), hasher, n)

    for n in range(1, 7):
        for m in range(8):
            text = " ".join(f"w{k}" for k in range(m))
            alone = sets([text], n)[0]
            assert len(alone) == (max(1, m - n + 1) if m else 0)
            assert alone.tolist() == sets([text, "some other text of many words that follows it"], n)[0].tolist()


@pytest.mark.parametrize("words", [1, 2, 3, 4])
def test_a_table_of_one_short_text(spark, words):
    text = " ".join(["one", "two", "three", "four"][:words])
    out = jaccard.near_duplicates(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out] == [(7, 1, 7)]
