"""Candidates of near duplicates: how often they are linked, and under how many joins they come."""

import random

import numpy as np

from gaugeworks.llm import components, jaccard


def counted(monkeypatch, module, name, rows):
    f = getattr(module, name)

    def run(df, *more):
        rows.append(df.count())
        return f(df, *more)

    monkeypatch.setattr(module, name, run)


def test_equal_sets_are_one_candidate(spark, monkeypatch):
    edges = []
    counted(monkeypatch, components, "connected", edges)
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(9999)}" for _ in range(150)) for _ in range(4)]
    rows = [(k, texts[k % 4]) for k in range(400)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {k: k % 4 for k, _ in rows}
    assert edges[0] <= 3  # stars over four sets


def test_chains_of_sets_do_not_meet_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 3000)
    pairs = []
    f = jaccard._parts
    monkeypatch.setattr(jaccard, "_parts", lambda inside: (pairs.append((p := f(inside)).count()), p)[1])
    r = random.Random(6)
    passages = [" ".join(f"w{r.randrange(99999)}" for _ in range(300)) for _ in range(61)]
    rows = [(k, f"{passages[k]} {passages[k + 1]}") for k in range(60)] + [(100, f"{passages[30]} {passages[31]} more")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {**{k: k for k in range(60)}, 100: 30}
    assert pairs[0] < 4 * len(rows)  # each set beside its neighbours, not beside all sets of the chain


def test_packed_keys_come_back():
    r = np.random.default_rng(2)
    keys = np.sort(r.integers(0, 1 << 64, 500, np.uint64)) >> jaccard.CUT << jaccard.CUT
    nodes = r.integers(0, 1 << 40, 500)
    k, i = jaccard._unpacked(np.frombuffer(jaccard._packed(keys, nodes), np.uint8))
    assert (k == keys).all() and (i == nodes).all()
