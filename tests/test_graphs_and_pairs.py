"""Iterated and paired operators against brute force: lines of descent, classes of persons, posting lists, exports, state."""

import difflib
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from feuillet.operators import family as G
from feuillet.operators import matching
from feuillet.operators import resolve as R
from feuillet.sources import sinks as S
from feuillet.sources.fixtures import Tables
from feuillet.sources.gedcom import GedcomSource
from feuillet.streaming import streams


def relations(spark, edges):
    """edges (parent, child)."""
    return spark.createDataFrame([(a, b, "parent") for a, b in edges], "person1_id long, person2_id long, relation_type string")


def persons_of(spark, edges, more=()):
    return spark.createDataFrame([(i,) for i in sorted({x for e in edges for x in e} | set(more))], "person_id long")


def climbed(edges):
    up = {}
    for parent, child in edges:
        up.setdefault(child, set()).add(parent)
    out = {}
    for start in up:
        queue, seen = deque([(start, 0)]), set()
        while queue:
            at, d = queue.popleft()
            for parent in up.get(at, ()):
                if parent not in seen:
                    seen.add(parent)
                    out[start, parent] = d + 1
                    queue.append((parent, d + 1))
    return out


def levels(edges, ids):
    parents = {c for _, c in edges}
    out = {i: 0 for i in ids if i not in parents}
    queue = deque(out)
    while queue:
        at = queue.popleft()
        for a, b in edges:
            if a == at and b not in out:
                out[b] = out[at] + 1
                queue.append(b)
    return {i: out.get(i) for i in ids}


LINE = [(i, i + 1) for i in range(1000)]


def test_ancestors_of_a_long_line(spark):
    got = G.ancestors(relations(spark, LINE)).where("person_id = 1000 or person_id = 37").collect()
    assert {(r.person_id, r.ancestor_id): r.distance for r in got} == {(p, a): p - a for p in (37, 1000) for a in range(p)}


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestors_and_circles_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]  # circles, and one that is its own parent
    edges += [(100 + i, 101 + i) for i in range(19)] + [(119, 100), (105, 105)]
    wanted = climbed(edges)
    every = relations(spark, [*edges, edges[0]])
    assert {(r.person_id, r.ancestor_id): r.distance for r in G.ancestors(every).collect()} == wanted
    few = spark.createDataFrame([(3,), (107,), (107,), (999,)], "person_id long")
    assert {(r.person_id, r.ancestor_id): r.distance for r in G.ancestors(every, few).collect()} == {k: v for k, v in wanted.items() if k[0] in (3, 107)}
    assert {r.person_id: r.steps for r in G.descent_circles(every).collect()} == {a: d for (a, b), d in wanted.items() if a == b}


def test_generations_of_a_long_line(spark):
    got = {r.person_id: r.generation for r in G.generations(persons_of(spark, LINE, [5000]), relations(spark, LINE)).collect()}
    assert got == {**{i: i for i in range(1001)}, 5000: 0}


@pytest.mark.parametrize("affordable", [None, 30, 0])
def test_generations_against_brute_force(spark, affordable):
    rng = random.Random(5)
    edges = [(rng.randrange(c), c) for c in range(1, 60) for _ in range(rng.randrange(3))] + [(59 + i, 60 + i) for i in range(25)]
    edges += [(200, 201), (201, 202), (202, 200), (202, 203)]  # nobody leads to these
    edges += [(2, 300), (303, 300), (300, 301), (301, 302), (302, 303)]  # a circle that someone leads to
    ids = {x for e in edges for x in e}
    got = {r.person_id: r.generation for r in G.generations(persons_of(spark, edges), relations(spark, edges), affordable).collect()}
    assert got == levels(edges, ids) and got[203] is None and got[302] is not None


def people(spark, rows):
    return spark.createDataFrame(rows, "person_id long, prenom string, nom string, naissance int, lieu_naissance string")


def test_one_name_held_by_all_is_a_star(spark):
    persons = people(spark, [(i, "Jean", "Martin", 1600 + i % 7, "Caen") for i in range(500)] + [(900, "Jean", "Martim", 1600, "Caen"), (901, None, None, 1600, "Caen"), (902, None, "", 1600, "Caen")])
    star = R.similar_pairs(persons, 0.85).collect()
    assert {(r.id_a, r.id_b) for r in star} == {(0, i) for i in range(1, 500)} | {(0, 900)}
    assert R.all_similar_pairs(persons, 0.85).count() == 500 * 499 // 2 + 500
    clusters = {r.person_id: r.cluster_id for r in R.duplicate_clusters(persons, 0.85).collect()}
    assert clusters == {**{i: i % 7 for i in range(500)}, 900: 0}
    assert R.duplicate_births(persons).where("key_a = 'jean martin'").count() == 7 * 7  # names and births, whatever the number of persons


def test_duplicate_clusters_against_all_pairs(spark):
    rng = random.Random(8)
    names = [("Jean", "Martin"), ("Jean", "Martim"), ("Jeanne", "Martin"), ("Paul", "Le Roy"), ("Paul", "Roy"), ("Anne", "Picot")]
    for sparse in (0.15, 0.6):
        some = lambda v: None if rng.random() < sparse else v
        rows = [(i, *rng.choice(names), some(rng.choice([1600, 1601, 1640])), some(rng.choice(["Caen", "caen", "Rouen", "Lyon"]))) for i in range(1, 45)]
        fit = lambda a, b: a is None or b is None or a == b
        lower = {r[0]: r[4] and r[4].lower() for r in rows}
        persons = people(spark, rows)
        near = {(r.id_a, r.id_b) for r in R.all_similar_pairs(persons, 0.85).collect()}
        born = {r[0]: r[3] for r in rows}
        links = [(a, b) for a, b in near if fit(born[a], born[b]) and fit(lower[a], lower[b])]
        label = {i: i for i in born}
        moved = True
        while moved:
            moved = False
            for a, b in links:
                low = min(label[a], label[b])
                moved |= label[a] != low or label[b] != low
                label[a] = label[b] = low
        linked = {x for e in links for x in e}
        assert {r.person_id: r.cluster_id for r in R.duplicate_clusters(persons, 0.85).collect()} == {i: label[i] for i in linked}


def test_posting_lists(spark):
    persons = people(spark, [(i, "Jean", "Martin", 1600, "Caen") for i in range(990, 3010)] + [(5, "Anne", "Picot", None, None)])
    rows = sorted((r.key, r.chunk, r.n, len(r.ids.split(","))) for r in R.homonym_groups(persons).collect())
    assert rows == [("jean martin", 0, 2020, 10), ("jean martin", 1, 2020, 1000), ("jean martin", 2, 2020, 1000), ("jean martin", 3, 2020, 10)]


def test_gedcom_file_read_back(spark, data, tmp_path):
    t = Tables(spark, data)
    more = t.persons.limit(1).select(*[F.lit(v).cast(f.dataType).alias(f.name) if (v := {"person_id": 9001, "sexe": "F", "nom": "D'Alleurs\nBis", "prenom": None}.get(f.name, 0)) != 0 else F.lit(None).cast(f.dataType).alias(f.name) for f in t.persons.schema])
    persons = t.persons.unionByName(more)
    lines = S.gedcom_lines(persons).cache()
    path = str(tmp_path / "ged")
    for _ in range(2):  # the second takes the place of the first
        S.write_gedcom(lines, path, 5)
    files = sorted(p for p in (tmp_path / "ged").iterdir() if p.suffix == ".ged")
    assert (tmp_path / "ged/_SUCCESS").exists() and not [p for p in (tmp_path / "ged").iterdir() if p.name.startswith("_unfinished")]
    whole = "".join(p.read_text("utf-8") for p in files).splitlines()
    assert whole[0] == "0 HEAD" and whole[-1] == "0 TRLR" and all(line[0] in "0123" for line in whole)
    records = {}
    for line in whole:
        if line.startswith("0 "):
            records[line] = own = []
        own.append(line)
    heads = {r.line: [x.line for x in sorted(group, key=lambda x: x.line_no)] for r, group in by_record(lines.collect())}
    assert {k: v for k, v in records.items() if k.startswith("0 @")} == heads
    assert {p.read_text("utf-8").startswith("0 ") for p in files} == {True}
    assert records["0 @I009001@ INDI"] == ["0 @I009001@ INDI", "1 NAME Unknown /D'ALLEURS BIS/", "1 SEX F"]
    spark.dataSource.register(GedcomSource)
    back = spark.read.format("gedcom").load(path)
    assert back.count() == len(whole) and back.where("tag = 'INDI'").count() == persons.count()
    one = back.where("tag = 'FAM'").join(back.select("file", "record", F.col("tag").alias("t"), "level").where("level = 1"), ["file", "record"]).groupBy("xref").agg(F.sum((F.col("t") == "HUSB").cast("int")).alias("h"), F.sum((F.col("t") == "WIFE").cast("int")).alias("w"), F.sum((F.col("t") == "CHIL").cast("int")).alias("c"))
    alone = one.where("h + w = 1").collect()
    assert alone and all(r.c > 0 for r in alone)
    children = back.where("tag = 'CHIL'").count()
    assert children == persons.where("pere_id is not null or mere_id is not null").count()


def by_record(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r.section, r.record_key, r.other_key), []).append(r)
    return [(min(g, key=lambda r: r.line_no), g) for g in groups.values()]


def test_registry_state_survives_a_restart(spark, data, tmp_path):
    events = Tables(spark, data).read("events")
    entries = lambda df: df.select("ts", F.col("event_type").alias("full_name"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("s"), F.col("user_id") % 5)).alias("source"))
    odd = spark.createDataFrame([(None, "Click"), ("2021-01-01 00:00:00", None), ("2021-01-01 00:00:00", "CLICK"), ("2021-01-01 00:00:00", "Apple")], "ts string, event_type string").select(*[(F.col(f.name).cast(f.dataType) if f.name in ("ts", "event_type") else F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema])
    folder, check = str(tmp_path / "events"), str(tmp_path / "check")
    (tmp_path / "events").mkdir()
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    seen = {}

    def keep(batch, number):
        seen.update({r["key"]: r for r in batch.collect()})

    for k, part in enumerate(events.randomSplit([0.4, 0.6], 3)):
        part.repartition(2).write.mode("append").parquet(folder)
        streams.registry_upsert_stream(entries(live), check, keep).awaitTermination()
        if k == 0:
            streams.registry_upsert_stream(entries(live), check, keep).awaitTermination()  # nothing new: nothing counts again
            assert sorted(map(str, streams.registry_of(spark, check).collect())) == sorted(map(str, streams.registry_counts(entries(spark.read.parquet(folder))).collect()))
    odd.coalesce(1).write.mode("append").parquet(folder)
    streams.registry_upsert_stream(entries(live), check, keep).awaitTermination()
    whole = sorted(map(str, streams.registry_counts(entries(events.unionByName(odd))).collect()))
    assert sorted(map(str, streams.registry_of(spark, check).collect())) == whole
    assert sorted(map(str, seen.values())) == whole


def test_ratios_equal_difflib():
    rng = random.Random(4)
    texts = ["", "a", "jean", "Jean Martin", "martin jean", "x" * 150, "x" * 199, "ab" * 130, None]
    texts += ["".join(rng.choice("abcé ") for _ in range(rng.randrange(25))) for _ in range(150)]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(9000)]
    got = matching.ratios([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), r in zip(pairs, got, strict=True):
        assert r != r if a is None or b is None else r == difflib.SequenceMatcher(None, a, b).ratio()


def test_every_two_rows_of_a_frequent_key_meet_once(spark):
    rng = random.Random(6)
    rows = [(i, "hot" if i % 2 else rng.choice("abc")) for i in range(300)]
    a = spark.createDataFrame(rows, "x long, key string")
    b = spark.createDataFrame([(i + 1000, k) for i, k in rows[:150]], "y long, key string")
    wanted = sorted((x, y + 1000) for x, k in rows for y, m in rows[:150] if k == m)
    for size in (10, 1000):
        assert sorted((r.x, r.y) for r in matching.meet(a, b, "key", size).collect()) == wanted


def test_jaccard_pairs_against_all_pairs(spark):
    rng = random.Random(7)
    words = ["jean", *("w%d" % k for k in range(14))]
    names = {i: " ".join(rng.choices(words, weights=[20, *[2] * 14], k=rng.randint(1, 6))) for i in range(150)}
    names[150], names[151] = "", None
    sets = {i: set((n or "").split()) for i, n in names.items()}
    for t in (0.4, 0.6, 0.75):
        wanted = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > t}
        for size in (5, 2000):
            assert {(r.id_a, r.id_b): r.score for r in R.jaccard_pairs(spark.createDataFrame(list(names.items()), "id long, name string"), t, size).collect()} == wanted
