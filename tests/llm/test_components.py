"""Components of graphs with hot nodes."""

import random

from gaugeworks.llm import components


def test_hot_nodes_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_EDGES", 5)
    r = random.Random(4)
    edges = [(0, k) for k in range(1, 60)] + [(500, k) for k in range(400, 480)] + [(r.randint(100, 390), r.randint(100, 390)) for _ in range(150)] + [(59, 100)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert dict(components.connected(spark.createDataFrame(edges, "a long, b long")).collect()) == {x: top(x) for x in root if x not in loops}


def test_stars_need_no_round(spark, monkeypatch):
    monkeypatch.setattr(components, "_large_star", None)  # not called: nothing is left to move
    edges = [(9, 1), (1, 5), (7, 1), (8, 2), (2, 2), (None, 3)]
    assert dict(components.connected(spark.createDataFrame(edges, "a long, b long")).collect()) == {1: 1, 5: 1, 7: 1, 9: 1, 2: 2, 8: 2}
    assert components.connected(spark.createDataFrame([(2, 2)], "a long, b long")).collect() == []


def test_settled_edges_are_not_joined_in_every_round(spark, monkeypatch):
    monkeypatch.setattr(components, "PEEL_EDGES", 20)
    joined, star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda now, hot: (joined.append(now.count()), star(now, hot))[1])
    settled = [(1000 * c + k, 1000 * c) for c in range(1, 5) for k in range(1, 200)]  # stars
    chain = [(k + 1, k) for k in range(12)] + [(500 + k, k) for k in range(13)]  # a path with a leaf at each node
    got = dict(components.connected(spark.createDataFrame(settled + chain, "a long, b long")).collect())
    assert got == {**{1000 * c + k: 1000 * c for c in range(1, 5) for k in range(200)}, **{k: 0 for k in range(13)}, **{500 + k: 0 for k in range(13)}}
    assert joined and sum(joined) < len(settled + chain) / 4


def test_leaves_of_hot_nodes_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(components, "PEEL_EDGES", 2)
    monkeypatch.setattr(components, "HOT_EDGES", 5)
    r = random.Random(7)
    for _ in range(3):
        edges = [(50, k) for k in range(51, 90)] + [(7, k) for k in range(100, 130)] + [(r.randint(0, 300), r.randint(0, 300)) for _ in range(70)]
        low = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in low:
            for a, b in edges:
                if a != b:
                    low[a] = low[b] = min(low[a], low[b])
        rows = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(rows) == len(low) and dict(rows) == low


def test_blocks_of_many_shingles_are_split(spark, monkeypatch):
    from gaugeworks.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 5000)
    rows = [(k, 0, 30, 1000) for k in range(40)] + [(100 + k, 100, 1, 2) for k in range(40)]  # one block of 40,000 shingles, one of 80
    got = jaccard._parts(spark.createDataFrame(rows, "node long, component long, band long, n_shingles long")).collect()
    small, large = ([r for r in got if r["component"] == c] for c in (100, 0))
    assert len(small) == 40 and len({(r["left"], r["right"]) for r in small}) == 1
    met = {}
    for r in large:
        met.setdefault((r["left"], r["right"]), set()).add(r["doc_id"])
    assert max(map(len, met.values())) < 30
    assert {(a, b) for at in met.values() for a in at for b in at} == {(a, b) for a in range(40) for b in range(40)}
