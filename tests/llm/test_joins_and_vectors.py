"""Near copies, vectors and transcripts against brute force; the pipeline against a plain version."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feuillet.llm import chosenpath, kmeanstree, pcatiles, transcripts


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_components(ids, linked):
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.fixture(scope="module")
def copies():
    random.seed(6)
    words = ["w%d" % k for k in range(400)]
    base = [random.choice(words) for _ in range(120)]
    texts = [None, "", " \n", "one two", "ONE  two", "one two three four five", " ".join(base), " ".join(base)]
    for k in range(60):
        changed = list(base)
        for _ in range(k % 5):
            changed[random.randrange(120)] = random.choice(words)
        texts.append(" ".join(changed))
    texts += [" ".join(base[:40] + [random.choice(words) for _ in range(80)]) for _ in range(30)]  # a passage in common only
    texts += [" ".join(random.choice(words) for _ in range(60)) for _ in range(40)]
    return dict(enumerate(texts))


def test_near_duplicates_against_all_pairs(spark, copies):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in copies.items()] + [(None, "null id", 1, 2), (6, copies[6], 1, 2)], "doc_id long, text string, node long, rep long")
    sets = {i: sets_of(t) for i, t in copies.items()}
    label = plain_components(sets, plain_links(sets))
    for r in chosenpath.near_duplicates(docs).collect():
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    kept = [r.doc_id for r in chosenpath.without_copies(docs).collect()]
    assert Counter(kept) == Counter([i for i in sets if label[i] == i] + [None] + [6] * (label[6] == 6))
    assert chosenpath.near_duplicates(docs.limit(0)).count() == 0


def plain_links(sets):
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def classes_of(signed):
    return chosenpath.stash(signed.where("n_shingles > 0").groupBy(F.col("k1").alias("rep")).agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n_shingles", "sig", "roots"), "doc_id").alias("f")).select("rep", "doc_id", "f.*"))


@pytest.mark.parametrize(("small", "most"), [(3, 3), (50, 1)])
def test_near_duplicates_in_large_nodes(spark, copies, small, most, monkeypatch):
    """Nodes that are large from three members on, so that blocks and branches take part; with one pair for each document, the rest meets in blocks of full sets."""
    monkeypatch.setattr(chosenpath.met_in_blocks, "__defaults__", (300,))
    docs = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    classes = classes_of(chosenpath.signatures(docs))
    sets = {i: sets_of(t) for i, t in copies.items()}
    label = plain_components(sets, plain_links(sets))
    by_rep = {r.rep: r.doc_id for r in classes.collect()}
    got = {by_rep[r.id]: by_rep[r.component_id] for r in chosenpath.joined(docs, classes, None, small, 5, 2, most).collect()}
    assert {len({label[i] for i in got if got[i] == g}) for g in got.values()} <= {1}  # no group has two of the true ones
    assert Counter(Counter(label[i] for i in got).values()) == Counter(n for n in Counter(label[i] for i in by_rep.values()).values() if n > 1)
    assert len(set(got.values())) == len({label[i] for i in got})


def test_documents_with_several_texts_are_one(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, c), (5, None), (5, c + " d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in chosenpath.near_duplicates(docs).collect()) == [(1, 36, 1, True), (2, 36, 1, False), (2, 36, 1, False), (3, 36, 1, False), (4, 36, 4, True), (5, 0, 5, True), (5, 37, 4, False)]


def test_near_duplicates_of_very_long_texts(spark):
    long = " ".join(f"w{k * k % 7919}" for k in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id long, text string")
    sets = {r.doc_id: sets_of(r.text) for r in docs.collect()}
    label = plain_components(sets, plain_links(sets))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in chosenpath.near_duplicates(docs).collect()} == {i: (len(sets[i]), label[i]) for i in sets}


def vectors(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in row], i % 3, 1) for i, row in enumerate(x)] + list(extra), "vec_id long, embedding array<float>, leaf int, cell int")


BAD = [(900, None, 0, 0), (901, [0.0] * 8, 0, 0), (902, [float("nan")] + [1.0] * 7, 0, 0), (903, [None] + [1.0] * 7, 0, 0), (904, [1.0], 0, 0), (None, [1.0] * 8, 0, 0)]


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 8)).astype("f4")
    x[100:160] = x[100]  # equal vectors: ties go to the smaller id
    got = kmeanstree.search(vectors(spark, x, BAD), every=50).collect()
    hits = 0
    for q in range(0, 800, 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(800), d))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(true.tolist()))
    assert hits >= 0.9 * 160
    assert kmeanstree.search(vectors(spark, [], BAD)).count() == 0
    assert kmeanstree.search(vectors(spark, x[:1])).count() == 0


def test_search_goes_on_where_leaves_hold_few(spark):
    """Leaves of about three vectors, one to visit by the calibration, and a vector far from all others."""
    x = np.random.default_rng(3).normal(size=(400, 8)).astype("f4")
    x[0] = 1000
    got = kmeanstree.search(vectors(spark, x, BAD), every=50, recall=0.01, leaf_size=3).collect()
    assert {q: sorted(r.rank for r in got if r.query_id == q) for q in range(0, 400, 50)} == {q: list(range(1, 11)) for q in range(0, 400, 50)}
    few = kmeanstree.search(vectors(spark, x[:7], BAD), every=1, recall=0.01, leaf_size=1).collect()
    assert len(few) == 7 * 6


@pytest.mark.parametrize("tile", [16, 4096])
def test_tiles_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(pcatiles, "TILE", tile)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(60, 8)), rng.normal(size=8) + 0.08 * rng.normal(size=(60, 8)), np.repeat(rng.normal(size=(1, 8)), 40, axis=0) * rng.uniform(1, 3, (40, 1))]).astype("f4").astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = plain_components(range(160), [(int(a), int(b)) for a, b in zip(*np.nonzero(link), strict=True)])
    rows = pcatiles.links(vectors(spark, x, BAD)).collect()
    assert len(rows) == 166
    for r in rows:
        if r.vec_id is not None:
            wanted = (int(link[r.vec_id].sum()), label[r.vec_id]) if r.vec_id < 160 else (0, r.vec_id)
            assert (r.n_links, r.component_id, r.kept) == (*wanted, wanted[1] == r.vec_id)
    assert pcatiles.links(vectors(spark, [], BAD)).count() == len(BAD)


def test_transcripts(spark, data, monkeypatch):
    lines = transcripts.lines_of(spark.read.parquet(f"{data}/conversations.parquet"), transcripts.as_transcribed)
    model = transcripts.fit(lines)
    found = transcripts.roles_of(lines, model)
    truth = {(r.conv_id, r.turn, r.line_no): r.role for r in lines.collect()}
    whole = sorted((r.conv_id, r.turn, r.line_no, r.role, r.first) for r in found.collect())
    assert sum(truth[w[:3]] == w[3] for w in whole) >= 0.8 * len(whole)
    for conv in sorted({w[0] for w in whole})[:5]:  # the path is the best of all: forward by brute force over prefixes of short ones
        seen = model.seen([r.line for r in sorted((r for r in lines.collect() if r.conv_id == conv), key=lambda r: (r.turn, r.line_no))])[:4]
        n = len(model.start)
        score = lambda p, seen=seen: model.start[p[0]] + seen[0][p[0]] + sum(model.step[a, b] + e[b] for a, b, e in zip(p, p[1:], seen[1:], strict=False))
        best = max(score(p) for p in itertools.product(range(n), repeat=len(seen)))
        assert abs(score(model.viterbi(seen)) - best) < 1e-9
    monkeypatch.setattr(transcripts, "CHUNK", 2)
    assert whole == sorted((r.conv_id, r.turn, r.line_no, r.role, r.first) for r in transcripts.roles_of(lines, model).collect())
    turns = transcripts.render(found).collect()
    assert all(t.rendered.startswith(f"<|{t.role}|>\n") and t.rendered.endswith("\n<|end|>") for t in turns)
    assert sum(t.n_lines for t in turns) == len(whole)
    block = [(7, 0, k, f"line {k}", "x") for k in range(9)] + [(8, 0, 0, "User: what is this?", "x"), (8, 1, 0, "Assistant: a list.", "x"), (8, 1, 1, "A> one", "x")]  # a turn with many lines
    rendered = [r.rendered for r in transcripts.parse(spark.createDataFrame(block, "conv_id long, turn long, line_no int, line string, chunk string"), model).orderBy("conv_id", "turn_no").collect()]
    assert "what is this?" in rendered[-2] and sum(t.count("line ") for t in rendered) == 9
    odd = spark.createDataFrame([(1, 0, 0, None, "x"), (None, 0, 0, "a", "x"), (2, None, 0, "b", "x"), (3, 1, 0, "User: hi", "x"), (3, 1, 0, "User: hi", "x")], "conv_id long, turn long, line_no int, line string, chunk string")
    assert sum(t.n_lines for t in transcripts.parse(odd, model).collect()) == 3
    assert transcripts.parse(odd.limit(0), model).count() == 0
    assert transcripts.fit(spark.createDataFrame([], "conv_id long, turn long, line_no int, line string, role string, first boolean, marked boolean")) is None


def test_stages_on_odd_tables(spark, data):
    """Nulls, empty texts, repeated rows, no rows, and columns with names that operators use inside."""
    import corpus_pipeline

    rows = [(1, None, 0, "x"), (2, "", 0, None), (3, "a plain text of some words", 26, "y"), (3, "a plain text of some words", 26, "y"), (None, "no id", 5, "z"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, node string").selectExpr("*", "1 AS rep", "2 AS toxic", "3 AS length", "4 AS bucket")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name == "packing":
            assert sorted(out.groupBy("doc_id").count().collect(), key=str) == sorted([(None, 2), (1, 1), (2, 1), (3, 2)], key=str)
            assert out.agg(F.countDistinct("sequence_id", "offset")).first()[0] == 6
        else:
            assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect())), name
        assert stage(spark, docs.limit(0), data).count() == 0


def test_pipeline_against_a_plain_version(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from feuillet.llm import pii, toxicity
    from feuillet.llm.common import table

    docs = table(spark, data, "documents")
    chain = toxicity.fit(docs, table(spark, data, "labels"))
    left = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.score(docs, chain).where("toxic").collect()}
    left = {i: t for i, t in left.items() if i not in toxic}
    sets = {i: sets_of(t) for i, t in left.items()}
    label = plain_components(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    left = {i: t for i, t in left.items() if label[i] == i}
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter()
    for r in corpus_pipeline.run(spark, data).collect():
        got[r.doc_id] += r.length
    assert got.keys() == left.keys()
    kept = spark.createDataFrame(docs.where(F.col("doc_id").isin(*left)).collect(), docs.schema)
    found = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.detect(kept, pii.fit(kept)).collect()}
    for i, t in left.items():
        spans, at, out = [(int(a), int(b), kind) for kind, a, b in found[i]], 0, ""
        assert {*pii.base_spans(t or "")} <= {*spans}
        for a, b, kind in spans:
            if a >= at:
                out += (t or "")[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert got[i] == len(tokens.encode(out + (t or "")[at:], add_special_tokens=False).ids) + 1
