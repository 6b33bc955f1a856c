"""Very long runs of one kind of character, and caches that are full."""

import random
import re
import time

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from feuillet.llm import bytebpe, packing, pieces, pii, tokencounts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ids = lambda b: np.frombuffer(b, "<u4").tolist()


def test_long_white_space_equals_the_library(spark, monkeypatch):
    t, w = Tokenizer.from_file(BPE), bytebpe.encoder(BPE)
    long = ["a" + " " * 50_000 + "b", "\n" * 30_000, "x" + " \t" * 20_000 + "\n<|endoftext|> y" + "　" * 5000 + "z", " " * 999 + "a", " " * 1000 + "a", " " * 1001]
    for text in long:
        assert ids(w.encode(text)) == t.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bytebpe, "RUN", re.compile(bytebpe.RUN.pattern.replace("1000", "2")))
    random.seed(11)
    texts = ["".join(random.choice("a. \n\t\x85\xa0\x1f1é") for _ in range(random.randint(0, 15))) for _ in range(4000)]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(w.encode(text)) == e.ids, text
    monkeypatch.undo()
    rows = packing.pack(spark.createDataFrame([(1, "a" + " " * 2_000_000 + "b"), (2, "\t" * 1_500_000)], "doc_id long, text string"), BPE).collect()
    assert {r.doc_id for r in rows} == {1, 2}


def test_long_runs_of_digits_take_linear_time():
    start = time.time()
    for text in ("7" * 2_000_000, "1." * 500_000, "+1" * 300_000, "12 " * 500_000, "1.2.3.4" * 100_000):
        pii.base_spans(text)
        pii.candidates(text)
    assert time.time() - start < 60


def test_ip_rule_equals_the_plain_pattern():
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    random.seed(12)
    for _ in range(20_000):
        text = "".join(random.choice("12..  +-3") for _ in range(random.randint(6, 24)))
        assert [m.span() for m in pii.RULES["ip"].finditer(text)] == [m.span() for m in plain.finditer(text)], text


def test_cards_side_by_side_are_proposed():
    text = "paid with 7536784127813050 4845168114407329 today"
    assert pii.base_spans(text) == []
    found = {text[a:b]: label for a, b, kind, label in pii.candidates(text) if kind == "card"}
    assert found["7536784127813050"] == found["4845168114407329"] == -1
    assert pii.parts("1" * 40, 0, 40) == []


def test_long_words_are_counted_alone(monkeypatch):
    t = tokencounts.Trie({"a": -1.0, "ab": -1.5, "ba": -1.2, "abab": -2.0, "b": -3.0})
    random.seed(13)
    for _ in range(500):
        word = "".join(random.choice("abc") for _ in range(random.randint(1, 30)))
        assert t.alone(word) == t.count(word)
    nodes = len(t.best)
    assert t.count("ab" * 1_000_000) > 0 and len(t.best) == nodes
    monkeypatch.setattr(tokencounts, "MOST_NODES", 50)
    for k in range(200):
        t.count("ab" + str(k) * 10)
    assert len(t.best) < 50 + 40


def test_pieces_of_odd_texts():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    m = pieces.Model(PIECES)
    random.seed(14)
    texts = ["", " ", "  a", "a ", "x" * 300_000, " " * 200_000 + "a", "1" * 100_000]
    texts += ["".join(random.choice("aeé日😀x  \n▁\0.") for _ in range(random.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        got, begins, ends = m.encode(text)
        assert got.tolist() == sp.encode(text)
        assert (begins.tolist(), ends.tolist()) == tuple(map(list, m.spans(text, got.tolist())))
        assert not len(ends) or ends[-1] == len(text.encode())
