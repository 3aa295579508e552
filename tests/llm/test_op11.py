"""Operator 11 against a plain version: encode, overlap byte ranges, count."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tillcast.llm import op11_token_alignment as op11
from tillcast.llm.op11_token_alignment import Aligner, cut, links
from tillcast.llm.tokens import load_byte_bpe, load_pieces

TEXTS = [None, "", " ", "  two  blanks ", "plain words, and more words", "naïve café 漢字 😀 z", "a\n\n\tb\r\n", "▁marker", "<|endoftext|> <s> </s> <unk> <0x41>",
         "The the the the THE", "x" * 3000, "plain words, and more words", "1234567890 + 3.14", "   odd\u0000nul", " ".join(f"w{i} again" for i in range(400)), "end "]


def brute(rows):
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    done, count = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            a = [(i, bytes(letters[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b_model.id_to_piece(i)) for i in b_model.encode(text))]
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a = b = []

        def spans(tokens):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out
        a, b = spans(a), spans(b)
        pairs, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][2] <= s:
                j += 1
            while j < len(b) and b[j][1] < e:
                pairs.append((i, b[j][0]))
                j += 1
        count.update(pairs)
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for high in common:
            groups.append(",".join(str(i) for i, s, e in a if low < e <= high) + "|" + ",".join(str(i) for i, s, e in b if low < e <= high))
            low = high
        done.append((doc_id, a, b, groups, pairs))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted((doc_id, len(a), len(b), len(groups), len(pairs), sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs),
                   hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc_id, a, b, groups, pairs in done)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [200, 1 << 20])
def test_against_brute_force(spark, most):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, 7, "x", 1) for i, t in rows], "doc_id long, text string, block long, pairs string, slot int").repartition(3)
    got = op11.align(docs, most=most)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "same text"), (1, "same text"), (None, "same text"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i or None, *r) for i, *r in brute([(i or 0, t) for i, t in rows])]
    assert sorted((tuple(r) for r in op11.align(docs).collect()), key=str) == sorted(want, key=str)
    assert op11.align(docs.limit(0)).collect() == []
    once = {(r.a, r.b): r.n for r in op11.pair_counts(docs.limit(1)).collect()}
    assert {(r.a, r.b): r.n for r in op11.pair_counts(docs).collect()} == {k: 3 * n for k, n in once.items()}


def test_groups_of_several_tokens_on_either_side():
    a, b = [2, 5, 9, 10], [3, 4, 9, 10]
    cut_a, cut_b = cut(a, b)
    assert cut_a.tolist() == [3, 4] and cut_b.tolist() == [3, 4]
    at_a, at_b = links(a, b, cut_a, cut_b)
    assert list(zip(at_a.tolist(), at_b.tolist())) == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 2), (3, 3)]


def test_long_runs_of_blanks():
    aligner = Aligner(load_byte_bpe(None), load_pieces(None))
    for text in (" " * 1_200_000, "\n" * 1_200_000 + "end"):
        a, b, cut_a, cut_b, at_a, _ = aligner(text)
        assert sum(aligner.length_a[a]) == sum(aligner.length_b[b]) == len(text) + 1
        assert len(at_a) == len(a) + len(b) - len(cut_a)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op11.query(spark, "/root/testdata/sf0.001").select(COLUMNS).collect()) == brute(rows)
