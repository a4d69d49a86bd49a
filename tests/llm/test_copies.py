"""Sets of many copies are looked up by broadcast."""

from gaugeworks.llm import components, jaccard


def test_many_copies_and_few(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_EDGES", 5)
    text, other = "one two three four five six seven eight", "nine ten eleven twelve thirteen"
    rows = [(k, text) for k in range(10, 40)] + [(k, other) for k in (3, 50, 51)] + [(2, text + " nine"), (4, ""), (None, text)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == {**{k: 2 for k in range(10, 40)}, 3: 3, 50: 3, 51: 3, 2: 2, 4: 4, None: None}
