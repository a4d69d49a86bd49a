"""Cross-tokenizer alignment against encoding each text with both libraries and counting plainly."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from conftest import SF
from pyspark.sql import functions as F

from gaugeworks.llm import alignment, common
from gaugeworks.llm.bpe import byte_alphabet

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    docs, count = [], Counter()
    for doc_id, text in rows:
        groups, links = [], []
        a = t.encode(f" {text or ''}", add_special_tokens=False) if text else None
        b = sp.encode(text) if text else []
        a_bytes = [bytes(byte_of[c] for c in x) for x in a.tokens] if a else []
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (want := f" {text}".encode()) or b"".join(b_bytes) != want:
            docs.append((doc_id, 0, 0, [], []))
            continue
        i = j = x = y = 0
        mine, yours = [], []
        while i < len(a_bytes) or j < len(b_bytes):
            if x <= y:
                x, i, mine = x + len(a_bytes[i]), i + 1, [*mine, a.ids[i]]
            else:
                y, j, yours = y + len(b_bytes[j]), j + 1, [*yours, b[j]]
            if x == y and mine and yours:
                groups.append((mine, yours))
                links.append((mine[-1], yours[-1]))
                mine, yours = [], []
        count.update(links)
        docs.append((doc_id, len(a.ids), len(b), groups, links))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(count[p] == most[p[1]] for p in links)
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def found(df):
    return [tuple(r) for r in alignment.alignments(df, A, B).collect()]


ODD = [
    (1, None), (2, ""), (None, "no id"), (3, " "), (4, "  two  spaces "), (5, "tab\there and  there"), (6, "line\nbreaks\n\nand \n more\n"), (7, "<|endoftext|> <s> </s> <0x41> <unk>"),
    (8, "a▁b is not spelled"), (9, "naïve 日本語 😀😀 ﬁ Å"), (10, "nul\x00 inside"), (11, "x" * 3000), (12, "don't can't it's"), (13, "word " * 20_000 + "end"), (4, "same id"), (12, "don't can't it's"),
    (14, "a  b"), (15, "trailing "), (16, "\nfirst"), (17, "　wide"), (18, "end.\r\nnext\r\n"), (19, ";\r ▁"), (20, "  sep"), (21, "é combining"), (22, "123 4567 89.01%"),
]


def test_equals_plain_encoding_of_odd_texts(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    assert sorted(found(df.repartition(3)), key=repr) == sorted(plain(ODD), key=repr)


def test_query_equals_plain_encoding(spark):
    rows = [tuple(r) for r in common.read(spark, SF, "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in alignment.op11_alignment(spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("memo", [0, 5])
def test_forgetting_pieces_changes_nothing(memo, monkeypatch):
    texts = [t or "" for _, t in ODD]
    want = alignment.Aligner(A, B).documents(texts)
    monkeypatch.setattr(alignment, "MEMO", memo)
    few = alignment.Aligner(A, B)
    for k, t in enumerate(texts):
        counts, shown, links = few.documents([t])
        assert counts[0].tolist() == want[0][k].tolist() and shown[0] == want[1][k] and links[0] == want[2][k]


def test_groups_as_text_and_pair_table(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, "the the dog")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in alignment.encode(df, A, B, with_groups=True).collect()}
    for r in rows.values():
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] and r["groups"].count(";") + 1 == r["n_groups"]
    encoded = alignment.encode(df, A, B).withColumn("row", F.col("doc_id"))
    pairs = alignment.pair_counts(alignment.postings(encoded)).collect()
    assert max(r["n"] for r in pairs) == 3 and all(r["best"] for r in pairs if r["n"] == 3)


def test_no_rows_and_columns_of_other_names(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
    odd = spark.createDataFrame([("hello world", 7, 1, 2, "x", 3)], "text string, doc_id int, row int, a int, m string, n_best int")
    assert found(odd) == plain([(7, "hello world")])


def test_many_equal_rows(spark):
    rows = [(k, "one common passage") for k in range(3000)] + [(9000, "one other passage")]
    assert sorted(found(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(plain(rows))
