"""Operators on texts, against the libraries and plain versions; nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from feuillet.llm import backoff, bytebpe, packing, pieces, pii, tokencounts, toxicity

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a  b", " x ", "\n\n a\n", "don't stop", "日本 語x", "🙂 ok ▁ y", "\x00z", "été à Noël " * 900, "one", "one"]
SCHEMA = "doc_id long, text string, length int, `offset` string, leaf int, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(None if i == 3 else i, t, i, "o", i, i) for i, t in enumerate(ODD)] + [(12, "one", 1, "o", 1, 1)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_byte_bpe_words_equal_the_library():
    t, w = Tokenizer.from_file(BPE), bytebpe.encoder(BPE)
    random.seed(1)
    texts = [x or "" for x in ODD] + ["".join(random.choice("ab \n\t'sé1.日_") for _ in range(random.randint(0, 12))) for _ in range(3000)]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(w.encode(text), "<u4").tolist() == e.ids, text


def test_added_tokens_in_texts_equal_the_library(spark):
    t, w = Tokenizer.from_file(BPE), bytebpe.encoder(BPE)
    random.seed(7)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext|", "<|ENDOFTEXT|>", "\n<|endoftext|>\n"]
    texts += ["".join(random.choice(["a", " ", "\n", "'s", "<|", "|>", "<|endoftext|>", "é1"]) for _ in range(random.randint(0, 12))) for _ in range(2000)]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(w.encode(text), "<u4").tolist() == e.ids, text
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts[:6])), "doc_id long, text string"), BPE).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(texts[:6])}


def packed_well(rows, window):
    by_sequence, by_doc = {}, Counter()
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc[r.doc_id] += r.length
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return by_sequence, by_doc


def test_packing(spark, odd):
    for window in (1024, 16):
        rows = packing.pack(odd, BPE, window).collect()
        _, by_doc = packed_well(rows, window)
        t = Tokenizer.from_file(BPE)
        expected = Counter()
        for r in odd.collect():
            expected[r.doc_id] += len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
        assert by_doc == expected
    ids = np.array(t.encode(ODD[10], add_special_tokens=False).ids + [0], "<u4")
    for r in rows:
        if r.doc_id == 10:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
    assert packing.pack(empty(spark), BPE).count() == 0


def test_packing_leaves_little_open():
    random.seed(2)
    for lengths in ([700] * 500, [random.randint(1, 1023) for _ in range(3000)], [3] * 10, [1023, 1, 512, 512, 512]):
        plan, seen, filled = packing.Plan(dict(Counter(lengths))), Counter(), Counter()
        for n in lengths:
            got = plan.pieces(n, seen[n])
            seen[n] += 1
            assert sum(b - a for a, b, *_ in got) == n
            for a, b, sequence, _ in got:
                filled[sequence] += b - a
        assert max(filled.values()) <= 1024 and len(filled) == plan.sequences
        assert sum(filled.values()) >= 1024 * (len(filled) - 1) * 0.98


def test_pieces_equal_the_library(spark, odd):
    sp, m = sentencepiece.SentencePieceProcessor(model_file=SP), pieces.model(SP)
    random.seed(3)
    for text in [x or "" for x in ODD] + ["".join(random.choice(" a▁\né日🙂b,.\0<s>") for _ in range(random.randint(0, 9))) for _ in range(4000)]:
        ids, begins, ends = m.encode(text)
        assert ids.tolist() == sp.encode(text), text
        assert (begins[1:] == ends[:-1]).all() and (not len(ids) or (begins[0], ends[-1]) == (0, len(text.encode())))
    coded = pieces.encode(odd, SP, begin=True, end=True)
    back = {(r.doc_id, r.text) for r in pieces.decode(coded, SP).collect()}
    assert back == {(r.doc_id, sp.decode([1, *sp.encode(r.text or ""), 2])) for r in odd.collect()}
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in pieces.digest(odd, SP).collect()}
    assert got == {(r.doc_id, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for r in odd.collect() for i in [[1, *sp.encode(r.text or ""), 2]]}
    spans = {(r.doc_id, r.spans_sha256) for r in pieces.digest(odd, SP).collect()}
    assert spans == {(r.doc_id, hashlib.sha256(np.array([x for pair in zip(r.begins, r.ends, strict=True) for x in pair], "<u4").tobytes()).hexdigest()) for r in coded.collect()}
    assert pieces.digest(empty(spark), SP).count() == 0


def test_character_map_takes_the_longest_prefix():
    """A hand-made trie with a -> x and ab -> y."""
    leaf = lambda value: value | 1 << 31
    units = [0] * 512
    link = lambda offset, label, has_leaf=0: offset << 10 | has_leaf << 8 | label
    root, a, b = 256, 256 ^ ord("a"), 0
    units[0] = root << 10
    node_a = a
    units[node_a] = link(8, ord("a"), 1)  # its leaf and children at node_a ^ 8
    base = node_a ^ 8
    units[base] = leaf(0)
    b = base ^ ord("b")
    units[b] = link(16, ord("b"), 1)
    units[b ^ 16] = leaf(2)
    blob = np.array([4 * len(units)], "<u4").tobytes() + np.array(units, "<u4").tobytes() + "x\0yé\0".encode()
    m = pieces.CharMap(blob)
    assert m.normalise("caab") == [("c", 0, 1), ("x", 1, 2), ("y", 2, 4), ("é", 2, 4)]


def test_token_counts_against_plain_dynamic_programming(spark, odd):
    scores = tokencounts.zipf_scores(SP)
    t = tokencounts.Trie(scores)
    random.seed(4)
    for word in ["▁" + "".join(random.choice("theaonré日") for _ in range(random.randint(1, 12))) for _ in range(500)]:
        best = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            ways = [(best[d - 1][0] + t.unknown, -(-best[d - 1][1] + len(word[d - 1].encode())))]
            ways += [(best[d - k][0] + scores[word[d - k : d]], best[d - k][1] - 1) for k in range(1, min(d, 16) + 1) if word[d - k : d] in scores]
            best.append(max(ways))
        assert t.count(word) == -best[-1][1], word
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokencounts.token_counts(odd, SP).collect()}
    assert got[0] == got[1] == (0, 0) and got[11][0] == 1
    assert tokencounts.token_counts(empty(spark), SP).count() == 0


def brute_spans(text):
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    return pii.order([(m.start(), m.end(), k) for k, p in rules for m in re.finditer(p, text) if pii.passes(k, m[0])])


def test_personal_data(spark, odd, data):
    random.seed(5)
    for _ in range(20000):
        text = "".join(random.choice(["a", "@", "b.", "1", "22", "4111111111111111", "+", " ", "-", "(", ")", ".", "é", "255", "x@y.z", "\n"]) for _ in range(random.randint(0, 25)))
        assert brute_spans(text) == pii.base_spans(text), text
    docs = spark.read.parquet(f"{data}/documents.parquet")
    detector = pii.fit(docs)
    for r, text in zip(sorted(pii.detect(docs, detector).collect()), [r.text for r in docs.orderBy("doc_id").collect()], strict=True):
        base = brute_spans(text or "")
        assert r.base_sha256 == hashlib.sha256(pii.said(base).encode()).hexdigest()
        assert set(pii.said(base).split(",")) - {""} <= set(r.spans.split(","))
    secret = spark.createDataFrame([(1, "mail to a.b@c.org, or 4111 1111 1111 1111", 40, "x"), (2, None, None, None)], "doc_id long, text string, n_chars long, kind string")
    assert sorted(map(tuple, pii.redact(secret, detector).collect())) == [(1, "mail to [EMAIL], or [CARD]", 26, "x"), (2, None, None, None)]
    assert pii.detect(empty(spark), pii.fit(empty(spark))).count() == 0
    assert pii.detect(odd, pii.Detector()).count() == odd.count()


def test_personal_data_of_a_sorted_table(spark):
    """A source with one kind comes first and fills the bound: the kinds after it get thresholds all the same."""
    random.seed(8)
    digits = lambda n: "".join(random.choice("0123456789") for _ in range(n))
    first = [f"mail a{digits(3)}@b.org, or {random.choice(['10.0.0.' + digits(1), '999.1.2.' + digits(2)])}" for _ in range(300)]
    then = [f"call +{digits(2)} {digits(3)} {digits(4)} {digits(3)} or +{digits(1)} {digits(4)}" for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(first + then)), "doc_id long, text string").coalesce(1)
    detector = pii.fit(docs, max_candidates=80)
    assert "phone" in detector.thresholds and "ip" in detector.thresholds
    call = spark.createDataFrame([(1, f"call ({digits(3)}) {digits(3)}-{digits(4)} or +{digits(2)} {digits(3)} {digits(4)} {digits(3)}")], "doc_id long, text string")
    assert pii.detect(call, detector).first()["n_phone"] == 1


def test_personal_data_that_no_rule_settles(spark):
    """Telephone numbers without +, in texts that the trees haven't seen, and what only looks like them."""
    random.seed(9)
    digits = lambda n: "".join(random.choice("0123456789") for _ in range(n))
    phone = lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"
    known = [f"word call +1 {phone()} now" for _ in range(150)] + [f"part no x{digits(3)}-{digits(3)}-{digits(4)} here" for _ in range(150)]
    detector = pii.fit(spark.createDataFrame(list(enumerate(known)), "doc_id long, text string"))
    new = [f"word call {phone()} now" for _ in range(40)] + [f"part no x{digits(3)}-{digits(3)}-{digits(4)} here" for _ in range(40)]
    rows = sorted(pii.detect(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), detector).collect())
    assert [r.spans for r in rows] == ["phone:10:24"] * 40 + [""] * 40 and not any(r.n_phone for r in rows)


def test_numbers_too_long_to_be_read():
    assert pii.base_spans("1" * 5000 + ".1.1.1") == []
    assert [s[2] for s in pii.base_spans("0" * 5000 + "1.2.3.4")] == ["ip"]


def test_toxicity_on_held_out_labels(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.fit(docs, labels.where("doc_id % 3 > 0"))
    held = toxicity.score(docs, chain).join(labels.where("doc_id % 3 = 0").selectExpr("doc_id", "toxic as truth"), "doc_id").collect()
    right = sum(r.toxic == bool(r.truth) for r in held)
    assert right >= 0.92 * len(held) and sum(r.toxic and not r.truth for r in held) <= 0.02 * len(held)  # from 275 labels
    assert toxicity.without_toxic(docs, chain).count() == toxicity.score(docs, chain).where("not toxic").count()


def test_toxicity_without_anything_to_learn(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(odd, labels) is None
    assert not any(r.toxic for r in toxicity.score(odd, None).collect())
    assert toxicity.without_toxic(odd, None).count() == odd.count()


def test_stupid_backoff_against_sql(spark, odd, data):
    import duckdb

    got = sorted(map(tuple, backoff.op3_stupid_backoff(spark, data).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    wanted = sorted(con.execute(backoff.ORACLE).fetchall())
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, wanted, strict=True)) < 2e-4
    rows = backoff.scores(odd).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert backoff.scores(empty(spark)).count() == 0
