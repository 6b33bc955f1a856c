"""Every query of the package against its SQL, and operators on small cases."""

import glob
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from feuillet.functions import automata
from feuillet.functions import dates as D
from feuillet.functions import names as N
from feuillet.functions import text as X
from feuillet.operators import acts as A
from feuillet.operators import extract as E
from feuillet.operators import family as G
from feuillet.operators import resolve as R
from feuillet.operators.config import Config, known_place, registry_checks, with_abbreviations
from feuillet.plans.registry import ORACLES, QUERIES
from feuillet.sources import pages as P
from feuillet.sources import sinks as S
from feuillet.sources.fixtures import Tables
from feuillet.streaming import streams


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    return (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    rows = [tuple(map(plain, r)) for r in df.select(*names).collect()]
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    at = [c[0] for c in found.description]
    assert sorted(at) == names
    wanted = [tuple(plain(r[at.index(c)]) for c in names) for r in found.fetchall()]
    assert sorted(rows, key=str) == sorted(wanted, key=str)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_text_and_names(spark):
    assert one(spark, X.normalize_punctuation, "  Jean   Le  Boucher,,,   éc.  ") == "Jean Le Boucher, éc."
    full = one(spark, lambda c: X.expand_abbreviations(c)["text"], "bapt. le 15 janv., inh. le 20 fév.")
    assert all(w in full for w in ("baptême", "inhumation", "février"))
    assert one(spark, X.ocr_correct_name, "Dom Th") == "Dom Thomas"
    assert one(spark, lambda c: N.normalize_person_name(c)["name"], "Messire Jaeques Adam, curé de Caen") == "Jacques Adam"
    assert one(spark, X.clean_text, None) is None


def test_dates(spark):
    assert str(one(spark, D.parse_french_date, "le 13 février 1646")) == "1646-02-13"
    assert str(one(spark, D.parse_french_date, "1646, 13 fév.")) == "1646-02-13"
    assert one(spark, D.parse_french_date, "29 février 1646") is None
    assert one(spark, lambda c: D.parse_republican_date(c)["year"], "12 brumaire l'an VII") == 1799


def test_relations_in_a_sentence(spark):
    docs = spark.createDataFrame([(1, "Charlotte, fille de Jean Boucher et de Françoise Varin; parrain: Charles Boucher"), (2, "Françoise Picot, épouse de Charles Le Boucher"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.type): (r.a, r.b, r.c) for r in E.extract_relations(docs).collect()}
    assert got[1, "filiation"] == ("Charlotte", "Jean Boucher", "Françoise Varin")
    assert got[2, "marriage"] == ("Françoise Picot", "Charles Le Boucher", None)
    assert got[1, "godfather"] == ("Charles Boucher", None, None)


def test_relations_with_titles_between_the_parents(spark):
    act = """
        1651, 23 janv., inh., dans l'église, de Françoise Picot, épouse de Charles Le Boucher, 
        éc., sr du Hausey; 24 oct., naissance, bapt. de Charlotte, fille de Jean Le Boucher 
        et de Françoise Varin; marr.: Perrette Dupré; parr.: Charles Le Boucher.
        """
    texts = ["Charlotte, fille de Jean Le Boucher, éc., sr de La Granville, et de Françoise Varin", "Françoise Picot, épouse de Charles Le Boucher", "marr.: Perrette Dupré; parr.: Charles Le Boucher", act, "Anne, fille de Jean Martin, laboureur; et de Paris", "Anne, fille de Jean Martin. Louis Petit, sieur, et de Paris"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.select("doc_id", F.when(F.col("doc_id") == 3, F.trim(X.normalize_punctuation(F.regexp_replace("text", r"\s+", " ")))).otherwise(F.col("text")).alias("text"))
    got = {(r.doc_id, r.type): (r.a, r.b, r.c) for r in E.extract_relations(docs).collect()}
    assert got[0, "filiation"] == ("Charlotte", "Jean Le Boucher", "Françoise Varin")
    assert got[1, "marriage"] == ("Françoise Picot", "Charles Le Boucher", None)
    assert got[2, "godmother"][0] == "Perrette Dupré" and got[2, "godfather"][0] == "Charles Le Boucher"
    assert {k[1] for k in got if k[0] == 3} == {"filiation", "marriage", "godfather", "godmother"} and got[3, "filiation"] == ("Charlotte", "Jean Le Boucher", "Françoise Varin")
    assert got[4, "filiation"] == ("Anne", "Jean Martin", None) and got[5, "filiation"] == ("Anne", "Jean Martin", None)


def test_spacing_and_inferred_spouses(spark):
    people = spark.createDataFrame([(1, None, None, 1600, None, "M"), (2, None, None, 1600, None, "F"), (3, 1, 2, 1620, None, "M"), (4, 1, 2, 1620, None, "F"), (5, 1, 2, 1640, None, "F")], "person_id long, pere_id long, mere_id long, naissance int, conjoint_id long, sexe string")
    warned = {r.person_id: r.warning for r in G.child_spacing(people).collect()}
    assert warned == {4: "trop rapprochés", 5: "trop espacés"}
    none = spark.createDataFrame([], "person1_id long, person2_id long, relation_type string, confidence double, evidence string")
    assert [(r.person1_id, r.person2_id) for r in G.infer_spouses(people, none).collect()] == [(1, 2)]
    assert sorted(map(tuple, G.connected(spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7)], "a long, b long")).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_blocking_loses_no_similar_pair(spark, data):
    names = {r.n for r in Tables(spark, data).persons.select(R.folded(R.full_name()).alias("n")).distinct().collect()}
    sim = lambda a, b: sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))
    for t in (0.85, 0.6):
        wanted = {(a, b) for a in names for b in names if a < b and sim(a, b) >= t - 1e-9}
        got = {(r.name_a, r.name_b) for r in R.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), t).collect()}
        assert got == wanted


def test_name_matches_against_all_pairs(spark):
    random.seed(9)
    base = [("Yvry", "Jean"), ("Ivri", "Jean"), ("Lefebvre", "Marie"), ("Iefebvra", "Marie"), ("de la Rue", "Anne"), ("dela Rue", "Anne"), ("Rue", "Anne"), ("Mallet", "Carl"), ("Malet", "Charles"), ("Picot", "Maria"), ("Varin", "Marie"), ("Hébert", "Hélène"), ("Hebert", "Helene"), ("", "Jean"), ("", "Jeanne"), (None, "Jean"), ("Yvry", None)]
    misread = lambda w: "".join(random.choice("aeilnt") if random.random() < 0.12 else c for c in w)
    base += [(misread("Boucher"), random.choice(["Jean", "Jehan", "Jeanne"])) for _ in range(90)]
    names = spark.createDataFrame([(i, *n) for i, n in enumerate(dict.fromkeys(base))], "person_id long, nom string, prenom string").cache()
    a, b = (names.select(F.col("nom").alias(f"nom_{k}"), F.col("prenom").alias(f"prenom_{k}")) for k in "ab")
    every = [(tuple(r)[:4], r.similarity) for r in R.score_name_pairs(a.crossJoin(b)).collect() if r.similarity is not None]
    for t in (0.9, 0.85, 0.7):
        wanted = {k: v for k, v in every if v >= t}
        assert {tuple(r)[:4]: r.similarity for r in R.name_matches(names, names, t).collect()} == wanted
    ids = {(r.nom, r.prenom): r.person_id for r in names.collect()}
    best = {}
    for (na, pa, nb, pb), v in every:
        if v >= 0.85 and (na, pa) != (nb, pb):
            best.setdefault(ids[na, pa], []).append((-v, ids[nb, pb]))
    got = {(r.target_id, r.rank): (-r.score, r.candidate_id) for r in R.find_best_matches(names, names, 0.85, 3).collect()}
    assert got == {(i, n + 1): x for i, found in best.items() for n, x in enumerate(sorted(found)[:3])}
    group = {r.key: r.group for r in R.merge_name_groups(names, 0.85).collect()}
    assert group["jean yvry"] == group["jean ivri"] and group["marie lefebvre"] == group["marie iefebvra"]


def test_duplicates_by_word_sets_and_births(spark):
    random.seed(10)
    people = [(1, "Jean Pierre", "Martin", 1600), (2, "Jean Pierre Louis", "Martin", 1600), (3, "Jean Pierre", "Martin", 1607), (4, "Martin", "Jean Pierre", None)]
    people += [(i, " ".join(random.sample(["Jean", "Pierre", "Louis", "Marie", "Anne"], random.randint(2, 4))), random.choice(["Martin", "Le Boucher"]), random.choice([1600, 1601, 1605, None])) for i in range(5, 90)]
    sets = {i: (set(f"{a} {b}".lower().split()), n) for i, a, b, n in people}
    wanted = {}
    for a, (x, m) in sets.items():
        for b, (y, n) in sets.items():
            score = round(0.7 * len(x & y) / len(x | y) + (0.3 * max(0, 1 - abs(m - n) / 10) if m and n else 0), 4)
            if a < b and score > 0.8:
                wanted[a, b] = score
    got = {(r.id_a, r.id_b): r.score for r in R.detect_duplicates(spark.createDataFrame(people, "person_id long, prenom string, nom string, naissance int")).collect()}
    assert wanted[1, 2] == 0.825 and got == pytest.approx(wanted, abs=2e-4)


def test_number_rows_keeps_null_partitions(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, None), (5, "b")], "acte_id long, lieu string")
    got = A.number_rows(rows, "acte_id", "lieu")
    assert got.columns == ["acte_id", "lieu", "number"]
    assert [r.acte_id for r in got.orderBy("number").collect()] == [2, 4, 3, 1, 5] and {r.number for r in got.collect()} == {1, 2, 3, 4, 5}


def test_exports_and_files(spark, data, tmp_path):
    t = Tables(spark, data)
    S.write_csv_export(S.filiation_rows(t.persons), t.persons, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/filiations")).count() == t.persons.where("pere_id is not null").count()
    S.write_json_export(t.persons, t.actes, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/persons")).count() == t.persons.count()
    grown = t.persons.select(*((F.col(c) + 1_234_567_890 if c in ("person_id", "pere_id", "mere_id", "conjoint_id") else F.col(c)).alias(c) for c in t.persons.columns))
    heads = S.gedcom_lines(grown).where("line_no = 0 and section <> 'SOUR'")
    assert heads.count() == heads.select("line").distinct().count() == heads.where("line like '%1234%'").count()
    S.write_gedcom(S.gedcom_lines(t.persons), str(tmp_path / "ged"))
    S.write_gedcom(S.gedcom_lines(t.persons), str(tmp_path / "ged"))
    assert spark.read.text(str(tmp_path / "ged")).where("value like '0 @I%'").count() == t.persons.count()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Jean Boucher")
    assert [(r.text, r.file_type) for r in P.read_documents(spark, str(tmp_path / "in")).collect()] == [("Jean Boucher", "txt")]
    with pytest.raises(ValueError):
        P.page_range(P.split_pages(t.books), bounds=(3, 2))


def test_documents_many_to_a_file(spark, tmp_path):
    """Names and texts come back as they were, whatever signs they hold and wherever files are split."""
    signs = "\x1b\x1e\x1fabc\n\r\ufeffé"
    random.seed(4)
    docs = [(f"{i}.{random.choice(['txt', 'MD', 'a.rtf'])}", "".join(random.choices(signs, k=random.choice([0, 1, 5, 300])))) for i in range(400)]
    docs += [(signs, "x"), ("", ""), ("no kind", "\n"), ("null.txt", None)]
    P.write_documents(spark.createDataFrame(docs, "file_name string, text string").repartition(3), str(tmp_path / "many"))
    assert len(list((tmp_path / "many").glob("part-*"))) == 3
    most, whole = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (whole, "997b"):
            spark.conf.set(most, size)
            got = P.read_documents(spark, str(tmp_path / "many"), many=True).collect()
            assert sorted((r.file_name, r.text) for r in got) == sorted((n, x or "") for n, x in docs)
            assert all(r.size_mb == round(len(r.text.encode()) / 1e6, 6) for r in got) and len({r.doc_id for r in got}) == len(docs)
            assert {r.file_type for r in got if r.file_name[:1].isdigit()} == {"txt", "md", "rtf"}
    finally:
        spark.conf.set(most, whole)
    P.write_documents(spark.createDataFrame([], "file_name string, text string"), str(tmp_path / "none"))
    assert P.read_documents(spark, str(tmp_path / "none"), many=True).count() == 0


def test_streams_equal_batches(spark, data, tmp_path):
    docs = Tables(spark, data).lines.limit(200)
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        streams.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    read = spark.read.parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == E.extract_persons_basic(read).agg(F.sum("occurrences")).first()[0]
    events = Tables(spark, data).read("events")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    entries = lambda df: df.select("ts", F.col("event_type").alias("full_name"), F.concat(F.lit("s"), F.col("user_id") % 5).alias("source"))
    whole = sorted(map(str, streams.registry_counts(entries(events)).collect()))
    few = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    for _ in range(2):  # a second run finds nothing new
        streams.registry_upsert_stream(entries(few), str(tmp_path / "check2")).awaitTermination()
    assert sorted(map(str, streams.registry_of(spark, str(tmp_path / "check2")).collect())) == whole
    once = streams.dedup_source_stream(live.select("ts", F.col("event_type").alias("text")), "40 days")
    q = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "check3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == events.select("event_type").distinct().count()
    stats = streams.running_stats(live)
    q = stats.writeStream.format("memory").queryName("stats").option("checkpointLocation", str(tmp_path / "check4")).trigger(availableNow=True).start()
    q.awaitTermination()
    whole = set(map(tuple, streams.running_stats(events).collect()))
    assert set(map(tuple, spark.table("stats").collect())) <= whole


def test_mentions_of_odd_texts(spark):
    line = "3 mai 1650, Charlotte Boucher, fille de Jean Le Boucher, éc., et de Françoise Varin. "
    docs = spark.createDataFrame([(1, "Jean Martin, 1650", "a"), (1, "le curé Paul Durand", "b"), (1, "le curé Paul Durand", "b"), (2, None, "c"), (3, "", "d"), (None, "Marie Varin", "e"), (4, line * 5000, "f")], "doc_id long, text string, near string")
    found = E.mentions(docs.where("near <> 'f'"), E.NAMES, 8).collect()
    assert sorted((r.doc_id or 0, r.kind, r.start, r.end, r.hit, r.near) for r in found) == [(0, "full", 0, 11, "Marie Varin", "Marie Varin"), (1, "full", 0, 11, "Jean Martin", "Jean Martin, 1650"), *[(1, "full", 8, 19, "Paul Durand", "le curé Paul Durand")] * 2]
    assert E.name_context(docs.where("near = 'b'")).select("start", "n_clerical").collect() == [(8, 1)]  # not what another text of that id has around it
    long = E.mentions(docs.where("near = 'f'"), E.NAMES)
    assert {tuple(r) for r in long.groupBy("hit").count().collect()} == {(n, 5000) for n in ("Charlotte Boucher", "Jean Le Boucher", "Françoise Varin")}
    assert E.mentions(docs.limit(0), E.DATES).count() == 0
    assert {(r.kind, r.n) for r in E.combine_extractors(docs.where("doc_id = 2")).collect()} == {(k, 0) for k in ("names", "dates", "professions", "relations")}


def test_configuration(spark, data, tmp_path):
    mine = Config(gender_validation=False, abbreviations={"sgr": "seigneur"}, known_places=("Bréville",))
    mine.write(spark, str(tmp_path / "config"))
    assert Config.read(spark, str(tmp_path / "config")) == mine
    (tmp_path / "some.json").write_text('{"homonym_threshold": 0.9, "cache_size": 1000, "known_places": null}', encoding="utf-8")
    assert Config.read(spark, str(tmp_path / "some.json")) == Config(homonym_threshold=0.9)
    assert one(spark, lambda c: with_abbreviations(c, mine), "Jean sgr de X") == "Jean seigneur de X" and one(spark, lambda c: with_abbreviations(c, Config()), "a b") == "a b"
    assert one(spark, lambda c: known_place(c, mine), "bréville") and not one(spark, lambda c: known_place(c, Config()), "Caen")
    persons = Tables(spark, data).persons
    assert {r.check for r in registry_checks(persons, mine).select("check").distinct().collect()} == {"chronology"}
    assert registry_checks(persons, Config(chronology_validation=False, gender_validation=False)).count() == 0


def test_nearest_homonym_against_all_pairs(spark):
    random.seed(12)
    rows = [(i, random.choice(["Jean Martin", "martin  jean", "Anne Picot"]), random.choice([None, *(f"16{y}-0{m}-11" for y in range(50, 54) for m in (1, 6))])) for i in range(120)]
    rows.append(rows[3])  # a repeated row
    people = spark.createDataFrame(rows, "id long, name string, born string").withColumn("born", F.to_date("born"))
    days = {i: b and day_number(b) for i, _, b in rows}
    words = {i: frozenset(n.lower().split()) for i, n, _ in rows}
    for most in (365, 20):
        wanted = {}
        for i in days:
            near = [(abs(days[i] - days[j]) if days[i] else 0, j) for j in days if j != i and words[i] == words[j] and (not days[i] and not days[j] or days[i] and days[j] and abs(days[i] - days[j]) <= most)]
            if near:
                wanted[i] = min(near)[1]
        assert {r.id: r.match_id for r in R.match_existing_person(people, people, most).collect()} == wanted


def day_number(text):
    import datetime

    return datetime.date.fromisoformat(text).toordinal()


def test_ordered_replacements_equal_one_after_the_other():
    random.seed(15)
    lists = [tuple(X.LIGATURES.items()) + tuple(X.CORRECTIONS.items()), (("ab", "ba"), ("a", ""), ("bb", "ab"), ("b", "aa"), ("aab", "b"), ("c", "ab")), (("aa", "a"), ("xa", "ax"), ("a", "xa"))]
    for rules in lists:
        change = automata.replacer(rules)
        parts = [x for pair in rules for x in pair if x] + [" ", "-", "de"]
        for _ in range(3000):
            text = "".join(w if random.random() < 0.7 else w[: random.randint(0, len(w))] for w in random.choices(parts, k=random.randint(0, 9)))
            plain = text
            for a, b in rules:
                plain = plain.replace(a, b)
            assert change(text) == plain, text


def test_words_counted_in_one_pass(spark):
    random.seed(16)
    words = ("aa", "ab", "aba", "b", "é", "citoyen", "citoyenne", "an")
    texts = ["", None, "aaaa", "ababa", "citoyennes de l'an", *("".join(random.choice("abén ") for _ in range(30)) for _ in range(300))]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(automata.word_counts(F.col("t"), words).alias("n")).collect()]
    assert got == [t if t is None else [t.count(w) for w in words] for t in texts]
