"""Reports: outcomes, summaries, search, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feuillet.operators.acts import create_actes
from feuillet.operators.resolve import full_name, grouping_key, posting_lists


def document_outcome(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, a count for each stage, success_rate over four stages, issues: counts (doc_id, kind, n)."""
    kinds = ("names", "dates", "relations")
    n = counts.groupBy("doc_id").agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])
    x = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("len")).join(n, "doc_id", "left").fillna(0, list(kinds))
    rate = ((F.col("len") > 0).cast("int") + sum(((F.col(k) > 0).cast("int") for k in kinds), F.lit(0))) / 4
    said = {"names": "aucun nom", "dates": "aucune date", "relations": "aucune relation"}
    return x.select("doc_id", *kinds, F.round(rate, 4).alias("success_rate"), F.array_join(F.array_compact(F.array(*[F.when(F.col(k) == 0, said[k]) for k in kinds])), ";").alias("issues"))


def processing_rollup(outcomes: DataFrame, *by: str) -> DataFrame:
    return outcomes.rollup(*by).agg(F.count("*").alias("documents"), F.sum("names").alias("names"), F.round(F.avg("success_rate"), 4).alias("success_rate"))


def persons_summary(persons: DataFrame) -> DataFrame:
    """kind, value, n: by status and sex, and how many have a birth, a death, a profession."""
    by = lambda c, k: persons.groupBy(F.coalesce(c, F.lit("inconnu")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "value", "n")
    has = persons.agg(*[F.sum(w.cast("long")).alias(k) for k, w in (("naissance", F.col("naissance").isNotNull()), ("deces", F.col("deces").isNotNull()), ("profession", F.size("professions") > 0))])
    has = has.select(F.explode(F.array(*[F.struct(F.lit(k).alias("value"), F.col(k).alias("n")) for k in ("naissance", "deces", "profession")])).alias("x")).select(F.lit("avec").alias("kind"), "x.value", "x.n")
    return by("statut", "statut").unionByName(by("sexe", "sexe")).unionByName(has)


def top_names(persons: DataFrame, k: int = 20) -> DataFrame:
    top = lambda c: persons.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k).select(F.lit(c).alias("kind"), "name", "n")
    return top("nom").unionByName(top("prenom"))


def top_professions(persons: DataFrame, k: int = 5) -> DataFrame:
    return persons.select(F.explode("professions").alias("profession")).groupBy("profession").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "profession").limit(k)


def registry_statistics(registry: DataFrame) -> DataFrame:
    """registry (raw_name, name, ocr_corrections, variants, confidence) -> totals and rates."""
    rate = lambda w: F.round(100 * F.avg(w.cast("int")), 2)
    return registry.agg(F.count("*").alias("total"), rate(F.col("raw_name") != F.col("name")).alias("normalized_rate"), rate(F.col("ocr_corrections") > 0).alias("correction_rate"), F.round(F.avg("confidence"), 4).alias("confidence"))


def export_statistics(persons: DataFrame, actes: DataFrame) -> DataFrame:
    """kind, value, n for professions, statuses, act types, and the span of years."""
    count = lambda df, k: df.groupBy("value").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "value", "n")
    typed = create_actes(actes)
    span = typed.agg(F.concat_ws("-", F.min("year"), F.max("year")).alias("value"), F.countDistinct("year").alias("n")).select(F.lit("années").alias("kind"), "value", "n")
    return count(persons.select(F.explode("professions").alias("value")), "profession").unionByName(count(persons.where("statut is not null").select(F.col("statut").alias("value")), "statut")).unionByName(count(typed.select(F.col("type_acte").alias("value")), "type")).unionByName(span)


def export_indexes(persons: DataFrame, actes: DataFrame) -> DataFrame:
    """index, key, n, ids (joined in order): persons by name and birth year, acts by type and year."""
    by = lambda df, name, key, i: df.where(key.isNotNull()).groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n"), F.sum(i).alias("ids")).select(F.lit(name).alias("index"), "key", "n", "ids")
    typed = create_actes(actes)
    return by(persons, "nom", full_name(), "person_id").unionByName(by(persons, "naissance", F.col("naissance"), "person_id")).unionByName(by(typed, "type", F.col("type_acte"), "acte_id")).unionByName(by(typed, "année", F.col("year"), "acte_id"))


def index_ids(persons: DataFrame, size: int = 1000) -> DataFrame:
    """name, chunk, n, ids: the ids under each name, in order, in chunks of ``size`` consecutive numbers."""
    return posting_lists(persons, full_name(), "person_id", size).withColumnRenamed("key", "name")


def distinct_places(persons: DataFrame, actes: DataFrame) -> DataFrame:
    return persons.select(F.col("lieu_naissance").alias("place")).union(persons.select(F.explode("terres"))).union(actes.select("lieu")).where("place is not null").distinct()


def list_persons(persons: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return persons.orderBy("person_id").offset(offset).limit(limit)


def search_persons(persons: DataFrame, nom: str | None = None, prenom: str | None = None, lieu: str | None = None, lo: int | None = None, hi: int | None = None, limit: int = 50) -> DataFrame:
    """Persons whose names and place contain what is asked, in any case, born and dead within a period."""
    for c, v in (("nom", nom), ("prenom", prenom), ("lieu_naissance", lieu)):
        if v:
            persons = persons.where(F.lower(c).contains(v.lower()))
    if lo is not None:
        persons = persons.where(F.col("naissance") >= lo)
    if hi is not None:
        persons = persons.where(F.coalesce("deces", "naissance") <= hi)
    return persons.orderBy("nom", "prenom", "person_id").limit(limit)


def get_person(persons: DataFrame, person_id: int) -> DataFrame:
    return persons.where(F.col("person_id") == person_id)


def life(birth: Column, death: Column) -> Column:
    parts = F.concat_ws("-", F.concat(F.lit("*"), birth), F.concat(F.lit("†"), death))
    return F.when(parts != "", F.concat(F.lit("("), parts, F.lit(")"))).otherwise("")


def person_report(persons: DataFrame) -> DataFrame:
    """person_id, line, homonym: name, life, professions and titles of each person."""
    p = persons.withColumn("key", grouping_key())
    twins = p.groupBy("key").agg((F.count("*") > 1).alias("homonym"))
    line = F.concat_ws(" ", full_name(), life(F.col("naissance"), F.col("deces")), F.nullif(F.array_join("professions", ", "), F.lit("")), F.col("statut"), F.when(F.size("terres") > 0, F.concat(F.lit("de "), F.array_join("terres", ", "))))
    return p.join(twins, "key").select("person_id", line.alias("line"), "homonym")


def final_report(persons: DataFrame, actes: DataFrame) -> dict[str, DataFrame]:
    """A DataFrame for each section."""
    from feuillet.operators import acts, family

    return {"actes": acts.acte_summary(actes), "personnes": person_report(persons), "filiations": acts.filiation_report(persons), "parrainages": acts.godparent_report(persons, actes), "statistiques": export_statistics(persons, actes), "qualite": family.chronology_report(persons, actes)}


def report_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """section, ord, line: sections (key, line) one after the other, each under its title; order by section and ord to write it."""
    out = None
    for k, (title, df) in enumerate(sections.items()):
        spark = df.sparkSession
        head = spark.createDataFrame([(f"{k + 1:02d} {title}", "", f"== {title} ==")], "section string, ord string, line string")
        body = df.select(F.lit(f"{k + 1:02d} {title}").alias("section"), F.col("key").cast("string").alias("ord"), F.concat(F.lit("- "), "line").alias("line"))
        out = head.unionByName(body) if out is None else out.unionByName(head).unionByName(body)
    return out


def correction_count(made: DataFrame) -> DataFrame:
    return made.agg(F.sum(F.col("ocr_corrections") + F.col("variants")).cast("long").alias("corrections"), F.sum((F.col("ocr_corrections") > 0).cast("long")).alias("misread"), F.count("*").alias("names"))


