"""Vector codes, language identification and the audit of sources against plain versions."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from feuillet.llm import divergence, languages, walshcodes


def plain_codes(rows, parts, entries, rounds):
    """rows (vec_id, embedding, label) -> the result's rows, by plain loops over Python integers."""
    good = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = parts * max(1, -(-max((len(r[1]) for r in good), default=0) // parts))
    width = length // parts
    whole = [[math.floor(Fraction(v) * 1024) for v in r[1]] + [0] * (length - len(r[1])) for r in good]
    cut = [[x[k * width : (k + 1) * width] for k in range(parts)] for x in whole]
    books = [[x[k] for x in cut[:entries]] for k in range(parts)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda j: (far(x, book[j]), j))
    for _ in range(rounds):
        for k in range(parts):
            to = [near(x[k], books[k]) for x in cut]
            for j in range(len(books[k])):
                own = [x[k] for x, t in zip(cut, to, strict=True) if t == j]
                if own:
                    books[k][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = [[near(x[k], books[k]) for k in range(parts)] for x in cut]
    errors = [sum(far(x[k], books[k][c[k]]) for k in range(parts)) for x, c in zip(cut, codes, strict=True)]
    by = {}
    for r, e in zip(good, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for row in b for v in row).encode()).hexdigest()
    fits = lambda e: e if e < 2**63 else None
    labels = {r[2]: all(e < 2**63 for q, e in zip(good, errors, strict=True) if q[2] == r[2]) for r in good}
    return sorted(((r[0], r[2], "".join(f"{c:02x}" for c in code), fits(e), fits(by[r[2]]) if labels[r[2]] else None, digest) for r, code, e in zip(good, codes, errors, strict=True)), key=str)


@pytest.mark.parametrize("case", ["even", "odd", "huge", "few"])
def test_codes_against_plain_loops(spark, case):
    rng = random.Random(len(case))
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(12)], rng.choice([None, 1, 2])) for k in range(90)]
    if case != "even":
        rows += [(200, None, 1), (201, [0.1] * 11 + [math.nan], 1), (202, [None] + [0.5] * 11, 2), (203, [math.inf] * 12, 2), (204, [0.0] * 12, None), (None, [0.25] * 12, 2)]
        rows += [(5, [-0.5] * 12, 1), rows[7], rows[7], (205, [0.1] * 10, 1), (206, [], 2)]  # an id again, a row again, other lengths
    if case == "huge":
        rows += [(2, [1e30] + [0.0] * 11, 1), (207, [-1e300] * 12, 2), (208, [1e6, -1e6] * 6, 3)]
    rows = rows[:3] if case == "few" else rows
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "vec_id long, embedding array<double>, label int, code string, error double").repartition(5)
    got = walshcodes.encode(df, entries=8, rounds=3)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(rows, 4, 8, 3)
    assert walshcodes.encode(df.limit(0)).count() == 0


def test_transform_keeps_distances_and_order():
    x = np.random.default_rng(1).integers(-9, 9, (5, 13))
    turned = walshcodes.walsh(x)
    assert ((turned**2).sum(axis=1) == 16 * (x**2).sum(axis=1)).all()
    signs = walshcodes.walsh(np.eye(16, dtype=np.int64)).T
    assert [(np.diff(s) != 0).sum() for s in signs] == list(range(16))


def plain_scores(model, text):
    chars = "".join(chr(languages.fold()[ord(c)]) for c in f" {text} ")
    while "  " in chars:
        chars = chars.replace("  ", " ")
    out = list(model.prior)
    for n in range(1, languages.ORDERS + 1):
        for at in range(len(chars) - n + 1):
            g = chars[at : at + n]
            if g != " ":
                h = 0
                for c in g:
                    h = h * 0x01000193 % 2**32 ^ ord(c)
                h = (h + n * 0x7F4A7C15) * 0x9E3779B1 % 2**32
                h = (h ^ h >> 15) * 0x85EBCA77 % 2**32 >> 32 - model.bits
                out = [s + p for s, p in zip(out, model.matrix[h], strict=True)]
    return out


def test_languages(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = languages.fit(docs.select("text", "lang"))
    values = ["", "Été, été!", "  a\t\tb  ", "ÎLE 12 x-y", "ﬀ𝒳 İ", "The quick  brown fox " * 40, "퟿ मैं"]
    whole = model.scores(values)
    assert np.allclose(whole, [plain_scores(model, v) for v in values])
    monkeypatch.setattr(languages, "PIECE", 7)  # pieces end inside texts
    assert np.allclose(model.scores(values), whole)


def test_languages_on_held_out_documents(spark, data):
    rows = languages.op12_naive_bayes(spark, data).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held) > 0


def test_languages_of_odd_rows(spark):
    rows = [(None, None, "fr"), (1, "", "fr"), (2, "12 — 34 …", "en"), (3, "le chat et la souris " * 9, "fr"), (4, "the cat and the mouse " * 9, "en"), (4, "the cat and the mouse " * 9, "en"), (5, "la souris", None), (6, "the mouse " * 200_000, None)]
    docs = spark.createDataFrame([(*r, 0.5, "z") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = languages.fit(docs)
    got = languages.identify(docs, model)
    assert set(got.columns) == set(docs.columns)
    found = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in got.collect())
    assert [(i, lang) for i, lang, _ in found] == [(0, "und"), (1, "und"), (2, "und"), (3, "fr"), (4, "en"), (4, "en"), (5, "fr"), (6, "en")]
    assert all(s == 0 if lang == "und" else 0.5 < s <= 1 for _, lang, s in found)
    assert languages.identify(docs.limit(0), model).count() == 0
    nothing = languages.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in languages.identify(docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize("least", [1, 2])
def test_audit_against_sql(spark, monkeypatch, least):
    rng = random.Random(3)
    words = ["w%d" % k for k in range(12)] + ["Été", "été", "ÀÀ", "zz’y", "日本", "a", "A", "𝒳"]
    words = [w.strip("0123456789") * (k % 3 + 1) + "x" * (k // 3) for k, w in enumerate(words)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 40))), rng.choice(["fr", "en", None]), rng.choice(["s1", "s2", "s3", "É", None])) for k in range(60)]
    rows += [(1, None, "fr", "empty"), (2, "", None, "s1"), (2, "12 -- 3", "nl", "only"), (3, "solo solo", "de", "one"), rows[4], rows[4], (None, "x" * 300_000 + " a" * 5000, "en", "long")]
    rows += [(4, "", "xx", "p"), (5, None, "xx", "q")]  # a language without terms
    docs = spark.createDataFrame([(*r, 7, "t") for r in rows], "doc_id long, text string, lang string, source string, n int, term string").repartition(3)
    monkeypatch.setattr(divergence, "PIECE", 64)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    want = con.execute(divergence.ORACLE.replace(">= 10", f">= {least}")).fetchall()
    got = divergence.audit(docs, least_docs=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_terms_sent_in_several_turns(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MOST", 5)  # in this process only
    docs = spark.createDataFrame([("fr", "s", "a b c a"), ("fr", "s", "a d e f g"), ("fr", None, "H h \x80é")], "lang string, source string, text string")
    got = {(r.source, r.term): (r.n, r.docs) for r in divergence.term_counts(docs).collect()}
    assert got[("s", "a")] == (3, 2) and got[("", "h")] == (2, 1) and got[("", "\x80é")] == (1, 1)
    assert got[("s", "")][0] == 0 and len(got) == 11
