"""Exports: JSON, CSV, GEDCOM lines and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feuillet.operators.acts import number_rows
from feuillet.operators.family import family_units, written
from feuillet.operators.resolve import inferred_sex
from feuillet.sources.gedcom import GedcomSource


def export_rows(persons: DataFrame) -> DataFrame:
    """One nested row for each person, as the JSON export has it."""
    return persons.select("person_id", F.to_json(F.struct(F.struct("prenom", "nom").alias("name"), F.struct("naissance", "deces").alias("life"), "professions")).alias("json"))


def write_json_export(persons: DataFrame, actes: DataFrame, path: str) -> None:
    persons.write.mode("overwrite").json(f"{path}/persons")
    actes.write.mode("overwrite").json(f"{path}/actes")


def filiation_rows(persons: DataFrame) -> DataFrame:
    """ID, Child, Father, Mother, Confidence as the CSV export has them."""
    name = lambda key, out: persons.select(F.col("person_id").alias(key), F.concat_ws(" ", "prenom", "nom").alias(out))
    kids = persons.where("pere_id is not null").select(F.col("person_id").alias("ID"), F.concat_ws(" ", "prenom", "nom").alias("Child"), "pere_id", "mere_id")
    return kids.join(name("pere_id", "Father"), "pere_id", "left").join(name("mere_id", "Mother"), "mere_id", "left").select("ID", "Child", "Father", "Mother", F.lit(0.95).alias("Confidence"))


def write_csv_export(filiations: DataFrame, persons: DataFrame, path: str) -> None:
    filiations.write.mode("overwrite").option("header", True).csv(f"{path}/filiations")
    persons.select("person_id", "prenom", "nom", "sexe", "naissance", "deces").write.mode("overwrite").option("header", True).csv(f"{path}/personnes")


def padded(c: Column) -> Column:
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), 6 - F.length(c.cast("string")))), c.cast("string"))


def pointer(letter: str, c: Column) -> Column:
    return F.concat(F.lit(f"@{letter}"), padded(c), F.lit("@"))


def text_of(c: Column) -> Column:
    """A value in one line: line breaks within it are spaces."""
    return F.regexp_replace(c, "[\\r\\n]+", " ")


def event(tag: str, year: Column, place: Column | None = None) -> Column:
    """Lines of an event; none where the year is unknown."""
    lines = F.array(F.lit(f"1 {tag}"), F.concat(F.lit("2 DATE "), year.cast("string")), *([F.concat(F.lit("2 PLAC "), text_of(place))] if place is not None else []))
    return F.when(year.isNotNull(), F.array_compact(lines)).otherwise(F.array().cast("array<string>"))


def source_records(persons: DataFrame) -> DataFrame:
    """source, number (from 1, in order of the text): the distinct sources of all persons."""
    distinct = persons.select(F.explode("sources").alias("source")).where("source is not null").distinct()
    ranged = written(distinct.repartitionByRange("source").withColumn("range_no", F.spark_partition_id()))
    return number_rows(ranged, "source", "range_no").select("source", "number")


def gedcom_lines(persons: DataFrame) -> DataFrame:
    """section, record_key, other_key, line_no, line: INDI, FAM and SOUR records, one line of the file in each row.

    persons may have variantes (other forms of the name) and lieu_deces. A person's id is the own number, at least six
    digits; a family's is made of its parents' numbers, X for one that isn't known; both differ whatever the size. Sources
    are records of their own, numbered by counts of partitions, and persons point to them. The sex is inferred from
    professions and titles, and the person's own where these don't tell. A family with one known parent names that one.
    """
    none = F.array().cast("array<string>")
    extra = lambda c, kind: F.col(c) if c in persons.columns else F.lit(None).cast(kind)
    records = source_records(persons)
    cited = persons.select("person_id", F.posexplode("sources").alias("at", "source")).where("source is not null").join(records, "source")
    cited = cited.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("at", "number", "source"))).alias("cited"))
    aka = F.coalesce(F.transform(F.filter(extra("variantes", "array<string>"), lambda v: v.isNotNull()), lambda v: F.array(F.concat(F.lit("1 NAME "), text_of(v)), F.lit("2 TYPE aka"))), F.array().cast("array<array<string>>"))
    note = F.concat(F.lit("2 NOTE Source: "), text_of(F.col("cited")[0]["source"]))
    trades = F.coalesce(F.transform("professions", lambda v: F.array_compact(F.array(F.concat(F.lit("1 OCCU "), text_of(v)), note))), F.array().cast("array<array<string>>"))
    sources = F.coalesce(F.transform("cited", lambda c: F.array(F.concat(F.lit("1 SOUR "), pointer("S", c["number"])), F.lit("2 PAGE Acte de référence"), F.lit("2 DATA"), F.concat(F.lit("3 TEXT "), text_of(c["source"])))), F.array().cast("array<array<string>>"))
    named = F.concat(F.lit("1 NAME "), F.coalesce(text_of(F.col("prenom")), F.lit("Unknown")), F.lit(" /"), F.upper(F.coalesce(text_of(F.col("nom")), F.lit("Unknown"))), F.lit("/"))
    sex = F.concat(F.lit("1 SEX "), F.coalesce(inferred_sex(), "sexe"))
    p = persons.join(cited, "person_id", "left").select("person_id", F.concat(
        F.array(F.concat(F.lit("0 "), pointer("I", F.col("person_id")), F.lit(" INDI")), named), F.flatten(aka), F.array_compact(F.array(sex)),
        event("BIRT", F.col("naissance"), F.col("lieu_naissance")), event("DEAT", F.col("deces"), extra("lieu_deces", "string")), F.flatten(trades), F.flatten(sources),
    ).alias("ls"))
    indi = p.select(F.lit("INDI").alias("section"), F.col("person_id").alias("record_key"), F.lit(None).cast("long").alias("other_key"), F.posexplode("ls").alias("line_no", "line"))
    kids = persons.where("pere_id is not null or mere_id is not null").groupBy(F.col("pere_id").alias("h"), F.col("mere_id").alias("w")).agg(F.array_sort(F.collect_list("person_id")).alias("kids"))
    units = family_units(persons).join(kids, F.col("husband").eqNullSafe(F.col("h")) & F.col("wife").eqNullSafe(F.col("w")), "left")
    part = lambda c: F.coalesce(padded(F.col(c)), F.lit("X"))
    f = units.select("husband", "wife", F.concat(
        F.array_compact(F.array(F.concat(F.lit("0 @F"), part("husband"), F.lit("_"), part("wife"), F.lit("@ FAM")), F.concat(F.lit("1 HUSB "), pointer("I", F.col("husband"))), F.concat(F.lit("1 WIFE "), pointer("I", F.col("wife"))))),
        F.coalesce(F.transform("kids", lambda k: F.concat(F.lit("1 CHIL "), pointer("I", k))), none), event("MARR", F.col("marriage")),
    ).alias("ls"))
    fam = f.select(F.lit("FAM").alias("section"), F.coalesce("husband", "wife").alias("record_key"), F.col("wife").alias("other_key"), F.posexplode("ls").alias("line_no", "line"))
    sour = records.select(F.lit("SOUR").alias("section"), F.col("number").cast("long").alias("record_key"), F.lit(None).cast("long").alias("other_key"), F.posexplode(F.array(F.concat(F.lit("0 "), pointer("S", F.col("number")), F.lit(" SOUR")), F.concat(F.lit("1 TITL "), text_of(F.col("source"))))).alias("line_no", "line"))
    return indi.unionByName(fam).unionByName(sour)


#: fixed values: what a file begins and ends with
HEAD = ("0 HEAD", "1 DEST ANY", "1 GEDC", "2 VERS 5.5.1", "2 FORM LINEAGE-LINKED", "1 CHAR UTF-8", "1 LANG French")
TRAILER = ("0 TRLR",)
SECTIONS = ("HEAD", "INDI", "FAM", "SOUR", "TRLR")


def write_gedcom(lines: DataFrame, path: str, files: int = 8) -> None:
    """The lines as numbered files under ``path``, which read one after the other are a GEDCOM file; a record is within one file.

    Written by the ``gedcom`` data source, so that a failed or repeated task leaves nothing behind. What was there goes.
    """
    spark = lines.sparkSession
    spark.dataSource.register(GedcomSource)
    ends = spark.createDataFrame([(s, n, x) for s, ls in (("HEAD", HEAD), ("TRLR", TRAILER)) for n, x in enumerate(ls)], "section string, line_no int, line string")
    every = lines.unionByName(ends, allowMissingColumns=True).withColumn("at", F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")))
    order = ["at", "record_key", "other_key"]
    every.repartitionByRange(files, *order).sortWithinPartitions(*order, "line_no").select("line").write.format("gedcom").mode("overwrite").save(path)
