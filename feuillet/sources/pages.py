"""Documents and pages: reading, splitting, page sources and features, choosing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feuillet.functions.text import words

MARKER = r"(?:---|===) PAGE ([0-9]+) (?:---|===)"
#: fixed values: what a register page says, and the file kinds that are let in
PARISH = "baptême|bapt\\.|mariage|mar\\.|inhumation|inh\\.|registres? paroissiaux?|curé|prêtre|église|paroisse"
KINDS = {"txt": 10, "md": 10, "rtf": 10, "pdf": 100}
#: in files of many documents: after a name, after a document, and what stands for these signs (and for its own first) within them
UNIT, RECORD = "\x1f", "\x1e"
SIGNS = {"\x1b": "\x1ba", UNIT: "\x1bb", RECORD: "\x1bc"}


def read_documents(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """doc_id, text, file_name, file_type, size_mb of text files: each a whole document, or with ``many`` as ``write_documents`` makes them."""
    f = F.input_file_name()
    if many:
        name, text = (signs_back(F.substring_index("value", UNIT, k)) for k in (1, -1))
        x = spark.read.text(path, lineSep=RECORD).select(f.alias("f"), name.alias("file_name"), text.alias("text")).withColumn("doc_id", F.xxhash64("f", "file_name"))
    else:
        x = spark.read.text(path, wholetext=True).select(F.xxhash64(f).alias("doc_id"), F.col("value").alias("text"), F.regexp_extract(f, "([^/]+)$", 1).alias("file_name"))
    return x.select("doc_id", "text", "file_name", F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1)).alias("file_type"), F.round(F.octet_length("text") / 1e6, 6).alias("size_mb"))


def write_documents(docs: DataFrame, path: str) -> None:
    """docs (file_name, text) as text files, one for each task and not for each document: a million files take hours to make, list and open."""
    name, text = (signs_out(F.coalesce(c, F.lit(""))) for c in ("file_name", "text"))
    docs.select(F.concat(name, F.lit(UNIT), text)).write.text(path, lineSep=RECORD)


def signs_out(c: Column) -> Column:
    for sign, code in SIGNS.items():
        c = F.replace(c, F.lit(sign), F.lit(code))
    return c


def signs_back(c: Column) -> Column:
    for sign, code in reversed(SIGNS.items()):
        c = F.replace(c, F.lit(code), F.lit(sign))
    return c


def split_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_number, text; blank pages and what stands before the first marker are left out."""
    text = F.coalesce("text", F.lit(""))
    parts, numbers = F.split(text, MARKER, -1), F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    pages = F.arrays_zip(numbers.alias("number"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))).alias("text"))
    x = docs.select("doc_id", F.explode(pages).alias("p")).select("doc_id", F.col("p.number").cast("int").alias("page_number"), F.trim(F.regexp_replace("p.text", r"^\n|\n$", "")).alias("text"))
    return x.where("text <> '' and page_number is not null")


def page_range(pages: DataFrame, max_pages: int | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Pages lo to hi, from 1, both included; or the first ``max_pages``."""
    lo, hi = bounds or (1, max_pages or 2**31 - 1)
    if lo < 1 or hi < lo:
        raise ValueError(f"no such page range: {lo} to {hi}")
    return pages.where(F.col("page_number").between(lo, hi))


def is_register_page(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit(PARISH)) >= 2


def extract_page_source(pages: DataFrame) -> DataFrame:
    """+ archive, collection, year_range, source_reference, is_register: from the first ten lines, or the usual for a register page."""
    head = F.array_join(F.slice(F.split("text", "\n", -1), 1, 10), "\n")
    p = r"([A-ZÀ-ÖØ-Þ][A-Za-zà-öø-ÿ' -]+)[.,] *(BMS|B[aâ]pt?\.|Mar?\.|Inh?\.|[A-Z]{2,4}) *([0-9]{4}[-–][0-9]{4})"
    own, reg = head.rlike(p), is_register_page(F.col("text"))
    part = lambda k, usual: F.when(own, F.trim(F.regexp_extract(head, p, k))).when(reg, usual)
    x = pages.withColumns({"archive": part(1, "Archive départementale"), "collection": part(2, "Registres paroissiaux"), "year_range": part(3, "XVIIe-XVIIIe siècle"), "is_register": reg})
    return x.withColumn("source_reference", F.concat("archive", F.lit(", "), "collection", F.lit(" "), "year_range", F.lit(", p."), "page_number"))


def page_features(pages: DataFrame) -> DataFrame:
    """doc_id, page_number and counts of persons, relations, dates and parish terms, language, words, score, preview."""
    text = F.col("text")
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("int")
    persons = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+ [A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+"), F.lit(0))))
    french = sum((F.lower(text).contains(w).cast("int") for w in ("de", "le", "la", "du", "des", "et", "dans", "avec")), F.lit(0)) >= 3
    x = pages.select("doc_id", "page_number", text, persons.alias("person_count"), n("fils|fille|épouse|parrain|marraine").alias("relationship_count"), n("[0-9]{4}").alias("date_count"), F.regexp_count(F.lower(text), F.lit(PARISH)).cast("int").alias("parish_count"), F.when(french, "français").otherwise("other").alias("language"), F.size(words(text)).alias("word_count"))
    score = F.col("parish_count") * 3.0 + F.col("relationship_count") * 2.5 + F.col("date_count") * 1.5 + F.col("person_count") * 0.8 + F.when(F.col("language") == "français", 2.0).otherwise(0.5) + F.when(F.col("word_count") > 50, 0.5).otherwise(0.0) - F.when((F.col("parish_count") == 0) & (F.col("relationship_count") == 0), 2.0).otherwise(0.0)
    return x.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), score), 4)).withColumn("preview", F.substring(F.regexp_replace(text, r"\s+", " "), 1, 150)).drop("text")


def page_summary(features: DataFrame) -> DataFrame:
    return features.groupBy("doc_id").agg(F.count("*").alias("pages"), F.round(100 * F.avg((F.col("language") == "français").cast("int")), 2).alias("french"), F.round(F.avg("quality_score"), 4).alias("mean_score"), F.sum((F.col("quality_score") > 5).cast("long")).alias("promising"))


def recommend_pages(features: DataFrame) -> DataFrame:
    """doc_id, page_number, threshold: pages over a threshold from their document's best and mean score; a looser one where fewer than 3 are."""
    full = features.where("word_count > 10")
    by = full.groupBy("doc_id").agg(F.max("quality_score").alias("top"), F.avg("quality_score").alias("mean"))
    least = F.when(F.col("top") > 10, F.greatest(F.lit(4.0), F.col("mean") * 0.6)).when(F.col("top") > 5, F.greatest(F.lit(2.5), F.col("mean") * 0.5)).otherwise(F.greatest(F.lit(1.0), F.col("mean") * 0.3))
    x = full.join(by.select("doc_id", least.alias("threshold")), "doc_id")
    strict = (F.col("quality_score") >= F.col("threshold")) & (F.col("parish_count") > 0) & (F.col("language") == "français")
    loose = (F.col("quality_score") >= F.col("threshold") * 0.7) & (F.col("word_count") > 20)
    x = x.withColumn("n", F.sum(strict.cast("int")).over(Window.partitionBy("doc_id"))).where(F.when(F.col("n") < 3, loose).otherwise(strict))
    return x.select("doc_id", "page_number", F.round("threshold", 4).alias("threshold"))


def assemble_selected_pages(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text: the chosen pages in order under their markers."""
    p = pages.join(chosen.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_semi")
    one = F.concat(F.lit("=== PAGE "), "page_number", F.lit(" ===\n"), "text")
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", one.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def extract_marriages_with_source(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, husband, wife, source_reference for the marriages of each page."""
    name = "[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'-]+(?: [A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'-]+)*"
    p = f"mariage de ({name}) (?:avec|à|et) ({name})"
    src = extract_page_source(pages)
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("husband"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("wife"))
    return src.select("doc_id", "page_number", "source_reference", F.explode(both).alias("x")).select("doc_id", "page_number", "x.husband", "x.wife", "source_reference")


def nearest_page(hits: DataFrame, markers: DataFrame) -> DataFrame:
    """hits (doc_id, at) with the page of the last marker (doc_id, at, page_number) at or before them."""
    both = hits.select("doc_id", "at", F.lit(None).cast("int").alias("page_number"), F.lit(1).alias("hit")).unionByName(markers.select("doc_id", "at", "page_number", F.lit(0).alias("hit")))
    w = Window.partitionBy("doc_id").orderBy("at", "hit").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("page_number", F.last("page_number", ignorenulls=True).over(w)).where("hit = 1").drop("hit")


def landing_gate(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, size, sha256, accepted, reason: names, kinds, sizes and first bytes."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind, size = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), F.octet_length("content")
    most = F.element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), kind)
    reason = F.when(name.rlike(r'[<>:"|?*\x00]') | F.col("path").contains(".."), "nom interdit").when(F.length(name) > 255, "nom trop long").when(most.isNull(), "type refusé").when(size == 0, "fichier vide").when(size > most * 1_000_000, "fichier trop gros").when((kind == "pdf") & (F.hex(F.substring("content", 1, 4)) != "25504446"), "signature fausse")
    return files.select("path", size.cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), reason.isNull().alias("accepted"), reason.alias("reason"))
