"""Acts: typing, participants, validation against persons, lookups and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feuillet.functions.dates import extract_year, parse_french_date

TYPES = ("baptême", "mariage", "inhumation")
ROLES = {"principal": "personne_principale_id", "pere": "pere_id", "mere": "mere_id", "conjoint": "conjoint_id", "parrain": "parrain_id", "marraine": "marraine_id"}


def create_actes(raw: DataFrame) -> DataFrame:
    """Typed acts: an unknown type counts as a baptism; the year and the date as far as the text has them."""
    kind = F.when(F.col("type_acte").isin(*TYPES), F.col("type_acte")).otherwise("baptême")
    return raw.withColumns({"type_acte": kind, "year": extract_year("date", None), "date_parsed": parse_french_date("date")})


def acte_participants(actes: DataFrame) -> DataFrame:
    """(acte_id, role, person_id), without the empty roles."""
    scalar = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("person_id")) for r, c in ROLES.items()])
    witnesses = F.transform("temoin_ids", lambda x: F.struct(F.lit("temoin").alias("role"), x.alias("person_id")))
    return actes.select("acte_id", F.explode(F.concat(scalar, witnesses)).alias("x")).select("acte_id", "x.role", "x.person_id").where("person_id is not null")


def person_actes(actes: DataFrame, persons: DataFrame) -> DataFrame:
    return acte_participants(actes).join(persons.select("person_id"), "person_id", "left_semi")


def actes_by_year(actes: DataFrame, year: int) -> DataFrame:
    return create_actes(actes).where(F.col("year") == year)


def actes_by_type(actes: DataFrame, kind: str) -> DataFrame:
    return create_actes(actes).where(F.col("type_acte") == kind)


def family_actes(actes: DataFrame, persons: DataFrame) -> DataFrame:
    """(person_id, kind, acte_id): a person's own acts, those naming them as a parent, and their spouse's."""
    parts = acte_participants(actes)
    own = parts.join(persons.select("person_id"), "person_id", "left_semi").select("person_id", F.lit("own").alias("kind"), "acte_id")
    children = parts.where(F.col("role").isin("pere", "mere")).join(persons.select("person_id"), "person_id", "left_semi").select("person_id", F.lit("children").alias("kind"), "acte_id")
    wed = persons.select(F.col("person_id").alias("one"), F.col("conjoint_id").alias("person_id")).where("person_id is not null")
    spouse = wed.join(parts, "person_id").select(F.col("one").alias("person_id"), F.lit("spouse").alias("kind"), "acte_id")
    return own.unionByName(children).unionByName(spouse).distinct()


def acte_after_death(actes: DataFrame, persons: DataFrame, roles: tuple[str, ...] = ("principal", "pere", "mere")) -> DataFrame:
    dated = create_actes(actes).select("acte_id", F.col("year").alias("acte_year"))
    parts = acte_participants(actes).where(F.col("role").isin(*roles)).join(dated, "acte_id")
    return parts.join(persons.select("person_id", F.col("deces").alias("death_year")), "person_id").where("acte_year > death_year").select("person_id", "acte_id", "role", "acte_year", "death_year")


def validate_acte(actes: DataFrame, persons: DataFrame) -> DataFrame:
    """acte_id, is_valid, n_errors, n_warnings, confidence: penalties for what is missing and for the dead who take part."""
    typed = create_actes(actes)
    dead = acte_after_death(actes, persons).groupBy("acte_id").agg(F.count("*").alias("dead"))
    x = typed.join(dead, "acte_id", "left").fillna(0, ["dead"])
    no = lambda c: F.col(c).isNull()
    no_date, no_year = no("date"), F.col("date").isNotNull() & no("year")
    no_parents = (F.col("type_acte") == "baptême") & no("pere_id") & no("mere_id")
    no_spouses = (F.col("type_acte") == "mariage") & (no("personne_principale_id") | no("conjoint_id"))
    no_dead = (F.col("type_acte") == "inhumation") & no("personne_principale_id")
    n = lambda c: c.cast("int")
    errors = F.col("dead") + n(no_spouses) + n(no_dead)
    left = 1.0 - 0.1 * n(no_date) - 0.2 * n(no_year) - 0.4 * F.col("dead") - 0.1 * n(no_parents) - 0.3 * n(no_spouses) - 0.3 * n(no_dead)
    return x.select("acte_id", (errors == 0).alias("is_valid"), errors.cast("long").alias("n_errors"), (n(no_date) + n(no_year) + n(no_parents)).cast("long").alias("n_warnings"), F.round(F.greatest(F.lit(0.0), left), 4).alias("confidence"))


def redirect_to_living_homonym(actes: DataFrame, persons: DataFrame, lo: int = 15, hi: int = 65) -> DataFrame:
    """Acts whose father was dead or of no age to be one: the first other person of his name who was alive then, else uncorrected.

    Of persons with one name, birth and death only the first two can be wanted, and of all who were alive in a year too:
    what is compared within a name is bounded by the calendar, not by how many have that name.
    """
    year = create_actes(actes).where("type_acte = 'baptême' and year is not null and pere_id is not null").select("acte_id", "pere_id", "year")
    father = persons.select(F.col("person_id").alias("pere_id"), "nom", "prenom", F.col("naissance").alias("born"), F.col("deces").alias("died"))
    wrong = year.join(father, "pere_id").where(f"year > died or year - born < {lo} or year - born > {hi}")
    first_two = lambda df, *by: df.withColumn("k", F.dense_rank().over(Window.partitionBy("nom", "prenom", *by).orderBy("other"))).where("k <= 2").drop("k")
    other = first_two(persons.select(F.col("person_id").alias("other"), "nom", "prenom", "naissance", "deces"), "naissance", "deces")
    alive = wrong.select("nom", "prenom", "year").distinct().join(other, ["nom", "prenom"]).where(alive_at(F.col("naissance"), F.col("deces"), F.col("year")))
    two = first_two(alive.select("nom", "prenom", "year", "other"), "year")
    best = wrong.join(two, ["nom", "prenom", "year"]).where("other <> pere_id").groupBy("acte_id").agg(F.min("other").alias("new_father_id"))
    return wrong.join(best, "acte_id", "left").select("acte_id", F.col("pere_id").alias("old_father_id"), "new_father_id", F.when(F.col("new_father_id").isNull(), "uncorrected").otherwise("redirected").alias("status"))


def alive_at(birth: Column, death: Column, year: Column) -> Column:
    """Not dead, and of an age from 0 to 100; what is unknown passes."""
    return F.coalesce(death > year, F.lit(True)) & F.coalesce((year - birth).between(0, 100), F.lit(True))


def unknown_refs(actes: DataFrame, persons: DataFrame) -> DataFrame:
    return acte_participants(actes).join(persons.select("person_id"), "person_id", "left_anti")


def acte_statistics(actes: DataFrame) -> DataFrame:
    """One row for each type, those without acts too, with the years of all."""
    spark, typed = actes.sparkSession, create_actes(actes)
    types = F.broadcast(spark.createDataFrame([(t,) for t in (*TYPES, "acte_vente")], "type_acte string"))  # a fixed list
    n = typed.groupBy("type_acte").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("year").alias("years_covered"))
    return types.join(n, "type_acte", "left").fillna(0, ["n", "years_covered"])


def acte_summary(actes: DataFrame) -> DataFrame:
    typed = create_actes(actes)
    kinds = [F.sum((F.col("type_acte") == t).cast("long")).alias(name) for t, name in zip(TYPES, ("baptemes", "mariages", "inhumations"), strict=True)]
    return typed.groupBy("lieu").agg(F.concat_ws("-", F.min("year"), F.max("year")).alias("periode"), *kinds, F.lit(0).cast("long").alias("ventes"), F.count("*").alias("total"))


def chronology(actes: DataFrame) -> DataFrame:
    """One line for each year: the kinds of acts in it."""
    labels = F.create_map(*[F.lit(x) for x in ("baptême", "Baptême", "mariage", "Mariage", "inhumation", "Inhumation")])
    by = create_actes(actes).where("year is not null").groupBy("year").agg(F.array_sort(F.collect_set(F.element_at(labels, F.col("type_acte")))).alias("kinds"))
    return by.select("year", F.concat(F.lit("- "), "year", F.lit(" : "), F.array_join("kinds", " + ")).alias("line"))


def export_relationships(persons: DataFrame, actes: DataFrame) -> DataFrame:
    """kind, a, b, name_a, name_b: parents and children, marriages once for each pair, godparents."""
    parents = persons.where("pere_id is not null").select(F.lit("father").alias("kind"), F.col("pere_id").alias("a"), F.col("person_id").alias("b")).unionByName(persons.where("mere_id is not null").select(F.lit("mother").alias("kind"), F.col("mere_id").alias("a"), F.col("person_id").alias("b")))
    wed = persons.where("conjoint_id is not null").select(F.lit("marriage").alias("kind"), F.least("person_id", "conjoint_id").alias("a"), F.greatest("person_id", "conjoint_id").alias("b")).distinct()
    god = [create_actes(actes).where(f"type_acte = 'baptême' and personne_principale_id is not null and {c} is not null").select(F.lit(kind).alias("kind"), F.col(c).alias("a"), F.col("personne_principale_id").alias("b")) for kind, c in (("godfather", "parrain_id"), ("godmother", "marraine_id"))]
    name = lambda k: persons.select(F.col("person_id").alias(k), F.concat_ws(" ", "prenom", "nom").alias(f"name_{k}"))
    return parents.unionByName(wed).unionByName(god[0]).unionByName(god[1]).join(name("a"), "a", "left").join(name("b"), "b", "left").select("kind", "a", "b", "name_a", "name_b")


def filiation_report(persons: DataFrame) -> DataFrame:
    """Couples with children: names, children in order of birth, and the year before the first birth."""
    name = lambda k: persons.select(F.col("person_id").alias(k), F.concat_ws(" ", "prenom", "nom").alias(k.replace("_id", "")))
    kids = persons.where("pere_id is not null and mere_id is not null").groupBy("pere_id", "mere_id").agg(F.array_sort(F.collect_list(F.struct("naissance", "person_id", F.concat_ws(" ", "prenom", "nom").alias("n")))).alias("k"), F.min("naissance").alias("first_birth"))
    return kids.join(name("pere_id"), "pere_id").join(name("mere_id"), "mere_id").select("pere_id", "mere_id", "pere", "mere", F.array_join(F.transform("k", lambda x: x["n"]), ", ").alias("enfants"), (F.col("first_birth") - 1).cast("int").alias("mariage_avant"))


def godparent_report(persons: DataFrame, actes: DataFrame) -> DataFrame:
    name = lambda key, out: persons.select(F.col("person_id").alias(key), F.concat_ws(" ", "prenom", "nom").alias(out))
    b = create_actes(actes).where("type_acte = 'baptême' and (parrain_id is not null or marraine_id is not null)")
    return b.join(name("personne_principale_id", "filleul"), "personne_principale_id").join(name("parrain_id", "parrain"), "parrain_id", "left").join(name("marraine_id", "marraine"), "marraine_id", "left").select("acte_id", "filleul", "parrain", "marraine")


def global_counts(persons: DataFrame, actes: DataFrame, families: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(persons, "persons").unionByName(count(actes, "actes")).unionByName(count(families, "families"))


def number_rows(df: DataFrame, order: str, partition: str) -> DataFrame:
    """``number`` from 1 in ``order`` over the whole table, by counts of the partitions first: no single task sorts everything."""
    counts = df.groupBy(F.col(partition).alias("at")).agg(F.count("*").alias("n"))
    before = counts.select("at", (F.sum("n").over(Window.orderBy("at")) - F.col("n")).alias("before"))  # one row for each partition value, null first
    own = F.row_number().over(Window.partitionBy(partition).orderBy(order))
    return df.withColumn("own", own).join(before, F.col(partition).eqNullSafe(F.col("at"))).withColumn("number", (F.col("before") + F.col("own")).cast("long")).drop("own", "before", "at")
