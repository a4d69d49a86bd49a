"""Near-duplicate embeddings against comparing all pairs."""

from collections import Counter

import numpy as np
import pytest
from conftest import SF
from helpers import difference

from gaugeworks.llm import subspace_join

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold):
    ok = [k for k, (_, e, label) in enumerate(rows) if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, group = Counter(), list(range(len(rows)))
    for x, i in enumerate(ok):
        for j in ok[x + 1 :]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links.update([i, j])
                    old, new = group[j], group[i]
                    group = [new if g == old else g for g in group]
    out = []
    for k, r in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if group[m] == group[k] and rows[m][0] is not None]
        least = min(ids, default=None)
        out.append((r[0], links[k], least, r[0] == least))
    return out


def found(spark, rows, threshold=0.98, kind=SCHEMA):
    df = spark.createDataFrame([(None if r[0] is None else int(r[0]), r[1], r[2]) for r in rows], kind)
    return [tuple(r) for r in subspace_join.near_duplicates(df.repartition(3), threshold).collect()]


def made(seed, n=120, d=16, spread=0.03):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rng.normal(size=d) if k < 10 or rng.random() < 0.3 else np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=d) * spread * rng.random() * 4
        rows.append((k, [float(np.float32(x)) for x in base * rng.choice([0.01, 1, 50])] if k % 7 else [float(np.float32(x)) for x in base], int(rng.integers(2))))
    return rows


ODD = [
    (900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [1.0, None, *[0.0] * 14], 0), (904, [float("nan")] + [1.0] * 15, 0), (905, [float("inf")] + [1.0] * 15, 0), (906, [1.0] * 16, None), (907, [1.0] * 16, 0),
    (908, [1.0] * 16, 0), (908, [1.0] * 16, 0), (908, [1.0] * 15 + [1.1], 0), (None, [1.0] * 16, 0), (None, [2.0] * 3, 5), (None, None, None), (910, [1.0] * 3, 5), (911, [-1.0] * 16, 0), (912, [3.0], 0), (913, [2.0], 0), (914, [-2.0], 0), (None, [7.0, 1.0], 9),
]


@pytest.mark.parametrize("seed, leaf, part", [(0, 1024, 1024), (1, 10, 1024), (2, 3, 5), (3, 1000, 7), (4, 1, 3)])
def test_equals_all_pairs(spark, monkeypatch, seed, leaf, part):
    monkeypatch.setattr(subspace_join, "LEAF", leaf)
    monkeypatch.setattr(subspace_join, "PART", part)
    rows = made(seed) + (ODD if seed % 2 == 0 else [])
    assert sorted(found(spark, rows), key=repr) == sorted(plain(rows, 0.98), key=repr)


@pytest.mark.parametrize("threshold, d", [(0.9, 24), (0.5, 5), (0.995, 64)])
def test_other_thresholds_and_lengths(spark, monkeypatch, threshold, d):
    monkeypatch.setattr(subspace_join, "LEAF", 8)
    rows = made(5, n=100, d=d, spread=0.05)
    assert sorted(found(spark, rows, threshold)) == sorted(plain(rows, threshold))


def test_large_group_of_copies_and_near_copies(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    rows = [(k, base.astype(np.float32).tolist(), 1) for k in range(4000)]
    near = base + rng.normal(size=(1500, 64)) * 0.02 * np.linalg.norm(base) / 8
    rows += [(4000 + k, v.astype(np.float32).tolist(), 1) for k, v in enumerate(near)]
    got = {r[0]: r for r in found(spark, rows)}
    v = np.concatenate([np.tile(base.astype(np.float32), (1, 1)), near.astype(np.float32)]).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    linked = v @ v.T >= 0.98
    weight = np.array([4000] + [1] * 1500)
    want = linked @ weight - 1
    assert all(r[2] == 0 for r in got.values()) and got[0][1] == want[0] and [got[4000 + k][1] for k in range(1500)] == want[1:].tolist()


def test_each_pair_meets_once_in_a_block_within_its_share():
    rng = np.random.default_rng(7)
    q = np.rint(rng.normal(size=(400, 6)) * 3000).astype(np.int16)
    cuts = np.quantile(q, [0.25, 0.5, 0.75], axis=0)
    for bits in (0, 1, 5, 6, 8, 12):
        limit = 2500.0**2
        row, cell, home = subspace_join._visits(q, cuts, bits, limit)
        met = Counter()
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            for x, i in enumerate(at):
                met.update(tuple(sorted((int(row[i]), int(row[j])))) for j in at[x + 1 :] if home[i] or home[j])
        gap = q[:, None, :].astype(float) - q[None]
        near = (gap * gap).sum(2) <= limit
        assert all(met[i, j] == 1 for i in range(400) for j in range(i + 1, 400) if near[i, j]) and max(met.values()) == 1


def test_doubles_and_extreme_lengths(spark):
    rows = [(1, [1e-300, 2e-300], 1), (2, [1e300, 2e300], 1), (3, [2.0, -1.0], 1)]
    got = found(spark, rows, kind="vec_id long, embedding array<double>, label int")
    assert sorted(got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_no_rows_and_columns_of_other_names(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([(1, [1.0, 2.0], "x", 3, 4, 5, b"q")], "vec_id int, embedding array<float>, label string, node int, d int, part int, q binary")
    assert [tuple(r) for r in subspace_join.near_duplicates(df).collect()] == [(1, 0, 1, True)]


def test_query_equals_its_sql(spark):
    assert not difference(subspace_join.op12_embedding_dedup, subspace_join.OP12_SQL, spark, SF)
