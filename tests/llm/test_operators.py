"""Each operator against a plain version, the library that it imitates, or held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, chat, components, decontaminate, jaccard, learn, order_minhash, quality, registry, suffix_dedup, token_counts, token_files, toxicity

SF = "/root/testdata/sf0.001"
SF1 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def odd_texts(n, alphabet, seed=5, size=80):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, size))) for _ in range(n)]


def test_sql_queries_agree(spark):
    import helpers

    con = helpers.connection(SF)
    for name, sql in registry.SQL.items():
        assert not helpers.difference(registry.QUERIES[name], sql, spark, SF, con), name
    assert not helpers.difference(lambda s, d: chat.op8_chat(s, d).drop("formatted_chars"), chat.OP8_SQL, spark, SF, con)


def test_token_files_hold_the_library_ids(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for i in sorted(texts):
        ids = np.array(library.encode(texts[i], add_special_tokens=False).ids + [0], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.op1_token_files(spark, SF).collect()}
    assert got == want


def test_token_files_can_be_looked_up_by_id(spark, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_token_files(spark.read.parquet(f"{SF}/documents.parquet"), path, P.path("byte_bpe_50k.json"))
    found = token_files.read_token_files(spark, path).filter("doc_id = 17")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in found._jdf.queryExecution().toString()
    assert found.count() == 1


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), token_files.PieceEncoder(P.path("byte_bpe_50k.json"))
    some = odd_texts(3000, "abcdefgh  \n\n\t.,!'s1234é中😀 ") + ["<|endoftext|> x<|endoftext|>", "it's  a \n b", "a.\n\nB, c"]
    for t, e in zip(some, own.encode(some)):
        assert np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == e, repr(t)


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_are_those_of_the_unigram_tokenizer(texts, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary(P.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces], unk_id=0, byte_fallback=fallback))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.CountingViterbi(pieces, fallback)
    some = [*texts.values()] + odd_texts(2000, "abcdeth ing 中😀é\n\t.é日▁")
    assert [counter.count(t)[0] for t in some] == [len(e.ids) for e in library.encode_batch(some)]


def test_bpe_gives_the_library_ids_and_texts(texts):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), bpe.SpeculativeBpe(P.path("word_bpe_49k.json"))
    some = [*texts.values()] + odd_texts(3000, "abcdefghij etaoin'1é́ß中😀.,-_\t　") + ["<|endoftext|>x<|startoftext|>", "ΣΑΣ İ ﬁ", "x" * 3000 + "y", "\x00a\x00 b", "\x1c\x85z"]
    for t, ids, e in zip(some, own.encode(some), library.encode_batch(some, add_special_tokens=False)):
        assert np.array(e.ids, "<u4").tobytes() == ids, repr(t)
        assert library.decode(e.ids, skip_special_tokens=False) == own.decode(ids)
    assert 0 < own.failed < own.tested


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if (x := b[p : p + length]) in seen:
                gone[p : p + length] = True
            seen.add(x)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_are_exact(spark, texts):
    r = random.Random(2)
    rows = dict(texts)
    for k in range(1000, 1060):  # pieces of one source text at all shifts, and runs of one letter
        a = r.randint(0, 3000)
        rows[k] = "".join(r.choice("ab") for _ in range(r.randint(0, 90))) + rows[3][a % len(rows[3]) :][: r.randint(60, 400)] + "é" * r.randint(0, 120)
    df = spark.createDataFrame([*rows.items()], "doc_id long, text string")
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(rows, 100)


def test_levels_merge_geometrically(spark, texts):
    rows = [*texts.items()]
    family = suffix_dedup.SuffixFamily(spark, 100, 4)
    sizes = []
    for k in range(5):
        family.ingest(spark.createDataFrame(rows[k * 40 : (k + 1) * 40], "doc_id long, text string"))
        sizes.append(sorted(family.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2]]


def brute_groups(rows, n, threshold):
    sets = {}
    for i, t in rows.items():
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in t).split(" ") if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    root = {i: i for i in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("n,threshold", [(4, 85), (5, 80), (1, 60)])
def test_near_duplicates_are_exact(spark, n, threshold, monkeypatch):
    r = random.Random(n)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = {}
    line = [r.choice(vocabulary) for _ in range(12)]  # stands in very many texts
    for i in range(260):
        if i % 4 and rows:
            words = rows[r.choice([*rows])].split()
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 5, 8, 20, 60, 150]))] + (line if i % 3 else [])
        rows[i] = " ".join(words)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)  # also through split blocks
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(spark.createDataFrame([*rows.items()], "doc_id long, text string"), n, threshold).collect()}
    assert got == brute_groups(rows, n, threshold)


def test_prefix_tree_finds_all_partners():
    r = np.random.default_rng(1)
    base = np.arange(60)
    paths = [np.sort(r.choice(base, r.integers(1, 60), replace=False)) for _ in range(80)] + [base, base[:50]]
    sizes = np.array([len(p) for p in paths])
    tree, member = jaccard.PrefixTree(paths, sizes, 70), np.zeros(60, bool)
    for p in paths:
        want = {j for j, q in enumerate(paths) if 100 * len(np.intersect1d(p, q)) >= 70 * len(np.union1d(p, q))}
        assert set(tree.partners(p, len(p), member).tolist()) == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50, 120)] + [(200, k) for k in range(201, 240)] + [(None, 3), (7, 7)]
    got = dict(components.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 50 for i in range(50, 121)}, **{i: 200 for i in range(200, 240)}}


def test_quality_on_held_out_rows(spark):
    out = quality.op5_quality(spark, SF1).toPandas().merge(spark.read.parquet(f"{SF1}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert learn.auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.95
    assert out.score.between(0, 1).all()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op6_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert learn.auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.93
    assert held.predicted[held.toxic == 0].mean() < 0.02


def test_benchmark_in_several_blocks_and_longest_matches(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontaminate.verdicts(decontaminate.matches(docs, items))
    many = decontaminate.verdicts(decontaminate.matches(docs, items, block_bytes=2000))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    found = decontaminate.longest_matches(docs, items).collect()
    assert found and min(r["n_words"] for r in found) >= 1


def test_fingerprints_follow_edits(spark, texts):
    got = {r["doc_id"]: r for r in order_minhash.op9_order_minhash(spark, SF).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
    near, far = (np.mean([r[c] for r in got.values()]) for c in ("near_edited", "near_next"))
    assert near > far + 0.05
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_fingerprint_is_order_minhash(spark):
    """Against a plain version that numbers repeats and picks the least, with Spark's own hash."""
    some = ["a b c a b d a b c", "x", "", "p q " * 60, "one two three four five six"]
    df = spark.createDataFrame([*enumerate(some)], "doc_id long, text string")
    same = order_minhash.fingerprint(df.withColumn("text", F.concat("text", F.lit("  "))), "text", "f").collect()
    plain = {r["doc_id"]: r["f"] for r in order_minhash.fingerprint(df, "text", "f").collect()}
    assert {r["doc_id"]: r["f"] for r in same} == plain  # white space at the end makes no k-mer
    assert plain[2] == ".".join("-" * order_minhash.BUCKETS)
    swapped = order_minhash.fingerprint(spark.createDataFrame([(0, "five six one two three four")], "doc_id long, text string"), "text", "f").first()["f"]
    assert swapped != plain[4]


def test_windows_keep_to_the_budget_and_repeat_history():
    turns = [(f"<s>{k}</s>", 3, 4, 10, k % 2 == 1) for k in range(9)]
    out = [*chat.windows(turns, 0, None, 40, 15)]
    assert all(n <= 40 for *_, n in out)
    assert "".join(t[a:] for t, a, _, _ in out) == "".join(t[0] for t in turns)
    assert all(t[:a] for t, a, _, _ in out[1:])
    assert sum(len(s) for _, _, s, _ in out) == 4


def test_escaping_is_reversible():
    for t in odd_texts(3000, ["<s>", "</s>", "[INST]", "[/INST]", "\\", "a", "<", "[", "\n", "[SYS]", "[/ROLE]"], size=12):
        for role in ("user", "assistant", "system", "tool", "odd\nrole%0A"):
            marked, a, b = chat.format_turn(role, t)
            assert chat.parse_turns(marked * 2) == [(role, t)] * 2 and chat.unescape(marked[a:b]) == t
