"""Repeats of hot grams, and anchors of long texts, against plain versions."""

import random

import numpy as np
from test_operators import brute_repeats

from gaugeworks.llm import suffix_dedup


def strings_of(e):
    """{(text, start): (key, place of the anchor)} of every string that the entries cover."""
    out = {}
    for key, _, text, start, shape in zip(*(x.tolist() for x in e)):
        for k in range((shape & 127) + 1):
            assert (text, start + k) not in out
            out[text, start + k] = key, start + (shape >> 7)
    return out


def test_pieces_of_a_long_block_have_the_same_anchors():
    r = np.random.default_rng(5)
    raw = r.integers(97, 101, 9000).astype(np.uint8)
    offsets = np.array([0, 0, 50, 3000, 3000, 3120, 8900, 9000])
    sampler = suffix_dedup.Sampler(100)
    whole = strings_of(sampler.entries(raw, offsets))
    sizes = np.diff(offsets)
    assert set(whole) == {(t, k) for t in range(len(sizes)) for k in range(sizes[t] - 99)}
    for step in (1, 77, 1000, 4096):
        assert strings_of(sampler.entries(raw, offsets, step)) == whole


def test_hot_grams_are_exact(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_DOCUMENTS", 2)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 0)
    r = random.Random(8)
    passages = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (40, 70, 99, 150, 320)]
    rows = {}
    for k in range(400):
        text = ""
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.choice([0, 0, r.randint(0, len(p))])
            text += "".join(r.choice("xyz") for _ in range(r.randint(0, 40))) + p[a:] + "é" * r.randint(0, 3)
        rows[k] = text
    df = spark.createDataFrame([*rows.items()], "doc_id long, text string")
    assert len(suffix_dedup._hot_grams(df, 100, 400)) > 3
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(rows, 100)
