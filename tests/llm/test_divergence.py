"""Source divergences against plain counting."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from helpers import difference

from gaugeworks.llm import common, divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, min_docs, top=10):
    held, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups[lang].add(source)
        n[lang, source].update(words)
        held[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in held[lang].items() if k >= min_docs]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + floor(Fraction(10**9 * (count[t] + 2), total)) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        f = lambda a, b: floor(Fraction((a - b) ** 2, a + b))
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def made(seed, rows=120):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "naïve", "x", "ÄÖ", "z", "don't", "日本", "a1b", "É", *(f"w{chr(97 + k)}" for k in range(20))]
    out = []
    for k in range(rows):
        source = "hot" if rng.random() < 0.4 else f"s{rng.integers(6)}"
        text = " ".join(rng.choice(words, rng.integers(0, 30)))
        out.append((k, text, str(rng.choice(["en", "de"])), source, 0))
    return out + [(None, None, None, None, None), (1, "", "xx", "alone", 0), (1, "12 34", "en", "no words", 0), (5, "the " * 30_000, "en", "long", 0)]


@pytest.mark.parametrize("seed, shard", [(0, 1), (1, 7), (2, None)])
def test_equals_plain_counting(spark, seed, shard):
    rows = made(seed)
    rows += rows[:5]
    found = divergence.divergences(spark.createDataFrame(rows, SCHEMA).repartition(5), min_docs=3, shard=shard)
    got = [tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 3)


def test_hashes_that_collide_are_told_apart_by_bytes():
    texts = [r[1] or "" for r in made(3, 40)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    exact, few = divergence.Tokenizer(), divergence.Tokenizer(mask=3)
    for _ in range(2):  # again with what is known by then
        a, b = exact.cut(raw, offsets), few.cut(raw, offsets)
        assert (a[0] == b[0]).all() and [exact.terms[k] for k in a[1]] == [few.terms[k] for k in b[1]]
    assert len(few.by_hash) <= 4 < len(few.terms)


def test_flushes_lose_nothing(spark, monkeypatch):
    import pyarrow as pa

    rows = [r for r in made(4) if r[1]]
    monkeypatch.setattr(divergence, "TERMS", 3)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 50)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in (1, 2, 3)], names=["text", "lang", "source"])
    total = Counter()
    for b in divergence._counted([batch]):
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter()
    for _, text, lang, source, _ in rows:
        for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            want[lang, source, w] += 1
    assert total == want


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(0)
    total = rng.integers(1, 1 << 53, 1000)
    n = (rng.random(1000) * total).astype(np.int64)
    assert divergence.scaled(n, total).tolist() == [1 + 10**9 * a // b for a, b in zip(n.tolist(), total.tolist())]


def test_no_rows_and_columns_of_other_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.divergences(empty).collect() == []
    odd = spark.createDataFrame([("a b", "en", "s", 1, "x", 2, 3)], "text string, lang string, source string, shard int, term string, n int, rank int")
    assert divergence.divergences(odd).collect() == []


def test_no_kept_terms_gives_pairs_of_zero(spark):
    rows = [(1, "a", "en", "s", 0), (2, "b", "en", "t", 0)]
    got = sorted(tuple(r) for r in divergence.divergences(spark.createDataFrame(rows, SCHEMA)).select("source", "part", "item", "value", "rank").collect())
    assert got == [("s", "pair", "t", 0, 1), ("t", "pair", "s", 0, 1)]


def test_query_equals_its_sql(spark):
    from conftest import SF

    assert not difference(divergence.op13_divergence, divergence.OP13_SQL, spark, SF)
    assert common.read(spark, SF, "documents").count() >= 200
