import random

import pytest
import sentencepiece

from keyloom.llm import pieces as P


@pytest.fixture(scope="module")
def both():
    path = P.model_path()
    return P.Codec(P.load(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def same(both, texts):
    codec, library = both
    for text, (ids, back) in zip(texts, codec.block([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_eos=True)
        assert [int(x) for x in ids.split()] == want, repr(text[:80])
        assert back.decode() == library.decode(want), repr(text[:80])


def test_odd_texts(both):
    same(both, ["", " ", "  ", "a", " a", "the cat", "a▁b", "▁", "x ▁ y", "<s> </s> <unk> <0x41>", "»,« —\" ’. …", "é,è.", "日本語 🙂🙂", "\x00\r\n\t", "12345 67", "aaaaaaaaaa", "====" * 9, ".”", "(“a”)"])


@pytest.mark.parametrize("n", [*range(1, 70), 100, 1000, 4001])
def test_runs_of_spaces(both, n):
    same(both, [" " * n, " " * n + "the", "a" + " " * n + "(", "x" + " " * n + "\n", " " * n + "é", " " * n + "不"])


def test_random_texts(both):
    rng = random.Random(1)
    pools = ["abcdefghijklmnopqrstuvwxyz ", "ab ", "éèçñüß aeo,.\n", " .,;:!?()[]{}'\"-=_/\\\r\n\t", "»«—”“’²–…† ,.\"'[]()a", "0123456789 .", "".join(map(chr, range(32, 1200)))]
    texts = ["".join(rng.choice(p) for _ in range(rng.randint(1, 200))) for p in pools for _ in range(300)]
    same(both, texts)


def test_very_long(both):
    rng = random.Random(2)
    same(both, ["".join(rng.choice("etaoinsh") for _ in range(30000)), "word " * 20000, "=-" * 10000])


def test_table(spark, both):
    rows = [(1, "a b", 1), (1, "a b", 2), (2, None, 3), (None, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = P.encode_documents(docs, both[0].pieces).collect()
    want = both[1].encode("a b", add_eos=True)
    assert sorted([(r.doc_id is None, list(r.ids), r.decoded) for r in got]) == sorted([(False, want, "a b")] * 2 + [(False, [2], ""), (True, [2], "")])
    assert P.encode_documents(docs.limit(0), both[0].pieces, True).count() == 0
