"""Chat windows against a plain version that walks each conversation turn by turn."""

import random

import public_tokenizers as P
import pytest

from gaugeworks.llm import chat

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def plain_windows(turns, system, budget, history, chapter_tokens):
    """turns: (form, tokens) of a conversation in order; system: whether the first is one. (text, new_at, tokens) of each window."""
    starts = [sum(n for _, n in turns[:k]) for k in range(len(turns))]
    out, i = [], 0
    while i < len(turns):
        stop = next((k for k in range(i, len(turns)) if starts[k] // chapter_tokens != starts[i] // chapter_tokens), len(turns))
        while i < stop:
            head = turns[0] if system and i else ("", 0)
            room = max(0, budget - head[1])
            back = i
            while back > (1 if system else 0) and starts[i] - starts[back - 1] <= min(history, room // 2):
                back -= 1
            fits = [k for k in range(i + 1, stop + 1) if sum(n for _, n in turns[back:k]) <= room]
            if not fits:
                back = i
                fits = [k for k in range(i + 1, stop + 1) if sum(n for _, n in turns[i:k]) <= room] or [i + 1]
            j = max(fits)
            before = head[0] + "".join(f for f, _ in turns[back:i])
            out.append((before + "".join(f for f, _ in turns[i:j]), len(before), head[1] + sum(n for _, n in turns[back:j])))
            i = j
    return out


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_the_plain_ones(spark, seed):
    r = random.Random(seed)
    rows = []
    for conv in range(25):
        n = r.choice([1, 2, 5, 30, 120]) if conv else 700  # one conversation fills several partitions
        gap = r.choice([1, 7, 1000])
        for k in range(n):
            role = "system" if k == 0 and conv % 3 == 0 else r.choice(["user", "assistant", "tool", "system"])
            rows.append((conv, k * gap, role, " ".join(r.choice(WORDS) for _ in range(r.choice([0, 1, 5, 20, 90])))))
    r.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got: dict[int, list] = {}
    out = chat.format_conversations(turns, P.path("byte_bpe_50k.json"), budget=64, history=20, chapter_tokens=256)
    for w in sorted(out.collect(), key=lambda w: (w["conv_id"], w["chapter"], w["window"])):
        got.setdefault(w["conv_id"], []).append((w["text"], w["new_at"], w["n_tokens"]))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_conv: dict[int, list] = {}
    for conv, turn, role, text in sorted(rows):
        by_conv.setdefault(conv, []).append((role, text))
    for conv, said in by_conv.items():
        forms = [chat.format_turn(role, text)[0] for role, text in said]
        sized = [(f, len(library.encode(f, add_special_tokens=False).ids)) for f in forms]
        assert got[conv] == plain_windows(sized, said[0][0] == "system", 64, 20, 256), conv


def test_a_system_turn_beyond_the_budget():
    system = ("S", 1200)
    turns = [("S", 0, 1, 1200, False), ("a", 0, 1, 20, False), ("b", 0, 1, 20, True)]
    out = [*chat.windows(turns, 0, system, 1024, 256)]
    assert [(t, n) for t, _, _, n in out] == [("S", 1200), ("Sa", 1220), ("Sb", 1220)]
    assert [len(s) for _, _, s, _ in out] == [0, 0, 1]


def test_turn_numbers_with_gaps_keep_their_history(spark):
    rows = [(1, 1000 * k, "assistant" if k % 2 else "user", "some words " * 20) for k in range(100)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), P.path("byte_bpe_50k.json"))
    found = sorted(out.collect(), key=lambda w: (w["chapter"], w["window"]))
    assert 4 < len(found) < 12 and all(w["n_tokens"] <= chat.BUDGET for w in found)
    assert all(w["new_at"] > 0 for w in found[1:])
