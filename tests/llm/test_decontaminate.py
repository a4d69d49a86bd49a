"""Suffix arrays and longest matches against plain versions."""

import random

import numpy as np
import pytest

from gaugeworks.llm import common, decontaminate


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return "".join(c if c.isalnum() or not c.isascii() else " " for c in low).split()


def plain_longest(docs, items, at_least):
    """All documents as one shard."""
    out = set()
    for item, text in items:
        w, before = words(text), 0
        for p in range(len(w)):
            best, places = 0, []
            for d, t in docs.items():
                v = words(t)
                for q in range(len(v)):
                    n = 0
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    if n > best:
                        best, places = n, []
                    if n == best and n:
                        places.append((d, q))
            found = best >= min(at_least, len(w)) and (p == 0 or len(w) >= at_least)
            if found and before != best + 1:
                out |= {(item, p, best, d, q) for d, q in places}
            before = best if found else 0
    return out


@pytest.mark.parametrize("seed", range(3))
def test_longest_matches_equal_the_plain_ones(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(r.choice([2, 6, 40]))]
    passage = [r.choice(vocabulary) for _ in range(150)]
    docs, items = {}, []
    for d in range(12):
        a = r.randint(0, 120)
        docs[d] = " ".join([r.choice(vocabulary) for _ in range(r.randint(0, 12))] + passage[a : a + r.choice([0, 5, 100])] + [r.choice(vocabulary) for _ in range(r.randint(0, 9))])
    for k in range(8):
        a = r.randint(0, 100)
        items.append((f"i{k}", " ".join(passage[a : a + r.choice([0, 3, 20, 130])])))
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = plain_longest(docs, items, 6)
    assert {tuple(x) for x in decontaminate.longest_matches(df, bench, 6).collect()} == want
    assert {tuple(x) for x in decontaminate.longest_matches(df, bench, 6, block_bytes=300).collect()} == want
    assert want


def test_suffixes_are_in_order():
    r = np.random.default_rng(3)
    for distinct in (1, 3, 50, 5000):
        values = np.sort(r.integers(0, 1 << 63, distinct).astype(np.uint64))
        w, first = values[r.integers(0, distinct, 900)], np.array([0, 0, 300, 301, 420, 900])
        array = decontaminate.SuffixArray(w, first, None)
        stop = np.repeat(first[1:], np.diff(first))
        suffixes = [tuple(w[i : stop[i]].tolist()) for i in array.order]
        assert suffixes == sorted(suffixes)


def test_any_number_of_distinct_words():
    n = (1 << 21) + 5
    w = np.random.default_rng(1).permutation(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    array = decontaminate.SuffixArray(w, np.array([0, n]), 13)
    low, high = array.ranges(array.number(w[1000:1013])[None, :], np.array([13]))
    assert array.order[low[0] : high[0]].tolist() == [1000]


def test_a_long_text_in_pieces(monkeypatch, spark):
    text = " ".join(f"w{k * k % 8191}" for k in range(5000))
    items = [("a", " ".join(text.split()[90:110])), ("b", " ".join(text.split()[995:1020])), ("c", "w4"), ("d", "w1 w2 w3")]
    df, bench = spark.createDataFrame([(1, text), (2, "w4 " + text[:500])], "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    whole = sorted(map(str, decontaminate.matches(df, bench).collect()))
    raw = np.frombuffer(text.encode(), np.uint8)
    hasher = common.WordHasher(decontaminate.SEPARATORS)
    w, start, end, first = hasher.words(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(common, "CHUNK_BYTES", 1000)
    for x, y in zip((w, start, end, first), hasher.words(raw, np.array([0, len(raw)]))):
        assert (x == y).all()
    test = decontaminate.Benchmark(items, 13)
    one = sorted(zip(*(x.tolist() for x in decontaminate._hits(w, first, test))))
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 100)
    assert sorted(zip(*(x.tolist() for x in decontaminate._hits(w, first, test)))) == one and len(one) > 10
    assert whole == sorted(map(str, decontaminate.matches(df, bench).collect()))
