"""Personal names: normalisation, parts, sex, status and professions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feuillet.functions.text import CORRECTIONS, col, lookup, words

#: fixed values: misread given names beside those of the text dictionary
NAME_CORRECTIONS = {k: v for k, v in CORRECTIONS.items() if k[0].isupper() and " " not in k} | {"Aiine": "Anne", "Amfr-": "Amfreville", "An-": "Anne", "Ame-": "Amélie", "Alal-": "Alain", "Alau-": "Alain", "Aimée-": "Aimée", "Aimép": "Aimée", "Padelaine": "Madeleine", "Cardinne": "Catherine", "Gabi-iel": "Gabriel", "Eléonore": "Éléonore", "Guilleaume": "Guillaume", "Magdaleine": "Madeleine", "Françoys": "François"}
#: fixed values: historical spellings by standard form
VARIANTS = {
    "François": ("Francois", "Fraisois", "Françoys", "Franchois"), "Jacques": ("Jaques", "Jaque", "Jacque"), "Catherine": ("Katerine", "Katharine", "Catarine"), "Guillaume": ("Guilleaume", "Guillame", "Guilhaume"), "Madeleine": ("Magdeleine", "Magdaleine", "Maudeleine"),
    "Antoine": ("Anthoine", "Anthoyne", "Antoinne"), "Marie": ("Mairie", "Mary", "Maria"), "Anne": ("Anna", "Ann", "Ane"), "Jean": ("Jehan", "Jhan", "Jan"), "Pierre": ("Piarre", "Pier", "Piere"), "Nicolas": ("Nicollas", "Nichollas", "Nycollas"), "Michel": ("Michell", "Mychel", "Myquel"), "Marguerite": ("Margueritte", "Marguarite", "Margrite"),
}
#: fixed values: titles before a name
TITLES = {"messire": "Messire", "damoiselle": "Damoiselle", "sieur": "sieur", "sr": "sieur", "seigneur": "seigneur", "sgr": "seigneur", "écuyer": "écuyer", "éc.": "écuyer", "ec.": "écuyer", "monsieur": "Monsieur", "mr": "Monsieur", "madame": "Madame", "mme": "Madame", "dom": "Dom", "père": "Père", "frère": "Frère", "sœur": "Sœur"}
PARTICLES = ("de", "du", "des", "le", "la", "les", "von", "van", "di", "da")
#: fixed values: what may follow a name after a comma
SUFFIXES = ("écuyer", "seigneur", "sieur", "prêtre", "curé", "marchand", "laboureur", "notable", "bourgeois", "artisan", "maître")
#: fixed values: given names by sex
MALE = ("jean", "pierre", "jacques", "françois", "antoine", "louis", "nicolas", "charles", "guillaume", "michel", "philippe", "henri", "claude", "andré")
FEMALE = ("marie", "anne", "catherine", "marguerite", "françoise", "jeanne", "louise", "madeleine", "michelle", "nicole", "claire", "brigitte", "monique", "sylvie")
#: fixed values: what a status may be called, in the order of trial
STATUS = {"seigneur": "seigneur", "sgr": "seigneur", "messire": "seigneur", "ecuyer": "écuyer", "écuyer": "écuyer", "éc.": "écuyer", "ec.": "écuyer", "sieur": "sieur", "sr": "sieur", "damoiselle": "damoiselle", "bourgeois": "bourgeois", "marchand": "marchand", "laboureur": "laboureur", "prêtre": "prêtre", "pretre": "prêtre", "curé": "prêtre", "cure": "prêtre"}
#: fixed values: professions and their spellings
PROFESSIONS = {"curé": ("curé", "curés", "cure"), "prêtre": ("prestre", "prestres", "prêtre", "prêtres"), "avocat": ("avocat", "avocats"), "conseiller": ("conseiller", "conseillers"), "trésorier": ("trésorier", "trésoriers"), "notaire": ("notaire", "notaires", "tabellion"), "marchand": ("marchand", "marchands", "marchant"), "laboureur": ("laboureur", "laboureurs"), "chirurgien": ("chirurgien", "chirurgiens"), "maître": ("maître", "maîtres", "maistre"), "procureur": ("procureur", "procureurs"), "greffier": ("greffier", "greffiers"), "sergent": ("sergent", "sergents"), "huissier": ("huissier", "huissiers")}


def lits(values) -> Column:
    return F.array(*map(F.lit, values))


def normalize_person_name(c, ocr: bool = True) -> Column:
    """struct(name, ocr_corrections, variants, title, particles): misreadings, title, particles, suffixes, spellings and capitals set right, word by word."""
    fixes = lookup(NAME_CORRECTIONS)
    spelled = lookup({v.lower(): k for k, vs in VARIANTS.items() for v in vs})
    start = words(col(c))
    read = F.transform(start, lambda w: F.coalesce(F.element_at(fixes, w), w)) if ocr else start
    n_ocr = F.size(F.filter(start, lambda w: F.element_at(fixes, w).isNotNull())) if ocr else F.lit(0)
    title = F.element_at(lookup(TITLES), F.lower(F.get(read, F.lit(0))))
    rest = F.when(title.isNotNull() & (F.size(read) > 1), F.slice(read, 2, 1000)).otherwise(read)
    text = F.regexp_replace(F.array_join(rest, " "), rf"(?iu),\s*({'|'.join(SUFFIXES)}).*$", "")
    ws = words(F.regexp_replace(text, "[,;.]+$", ""))
    bare = lambda w: F.lower(w)
    std = F.transform(ws, lambda w: F.coalesce(F.element_at(spelled, bare(w)), w))
    cap = F.transform(std, lambda w, i: F.when(bare(w).isin(*PARTICLES) & (i > 0), bare(w)).otherwise(F.initcap(w)))
    return F.struct(F.array_join(cap, " ").alias("name"), n_ocr.alias("ocr_corrections"), F.size(F.filter(ws, lambda w: F.element_at(spelled, bare(w)).isNotNull())).alias("variants"), title.alias("title"), F.array_join(F.transform(F.filter(ws, lambda w: bare(w).isin(*PARTICLES)), bare), " ").alias("particles"))


def normalization_confidence(original, made: Column) -> Column:
    """From a name and what ``normalize_person_name`` made of it."""
    a, b = F.length(F.trim(col(original))), F.length(made["name"])
    changes = made["ocr_corrections"] + made["variants"]
    score = 1.05 - F.least(F.abs(b - a) / F.greatest(a, F.lit(1)) * 0.15, F.lit(0.25)) + F.least(made["ocr_corrections"] * 0.05, F.lit(0.15)) + F.least(made["variants"] * 0.03, F.lit(0.10)) - F.when(changes > 5, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.3), F.least(F.lit(1.0), score))


def split_name_registry(c) -> Column:
    """struct(first_names, family_name, particle): the last word without particles is the family name."""
    ws = words(col(c))
    own = F.filter(ws, lambda w: ~F.lower(w).isin(*PARTICLES))
    return F.struct(F.array_join(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), " ").alias("first_names"), F.coalesce(F.try_element_at(own, F.lit(-1)), col(c)).alias("family_name"), F.array_join(F.transform(F.filter(ws, lambda w: F.lower(w).isin(*PARTICLES)), F.lower), " ").alias("particle"))


def split_name_mention(c) -> Column:
    """struct(first_names, family_name): from the first particle on it is the family name, else the last word."""
    ws = words(col(c))
    at = F.array_position(F.transform(ws, lambda w: F.lower(w).isin(*PARTICLES).cast("int")), 1).cast("int")
    cut = F.when(at > 1, at).otherwise(F.size(ws))
    return F.struct(F.array_join(F.slice(ws, 1, F.greatest(cut - 1, F.lit(0))), " ").alias("first_names"), F.array_join(F.slice(ws, F.greatest(cut, F.lit(1)), 1000), " ").alias("family_name"))


def split_fullname(c) -> Column:
    """struct(prenom, nom): the first word and the rest."""
    ws = words(col(c))
    return F.struct(F.coalesce(F.get(ws, F.lit(0)), F.lit("")).alias("prenom"), F.array_join(F.slice(ws, 2, 1000), " ").alias("nom"))


def parse_prenoms(c) -> Column:
    """The words that begin with a capital, up to the first that doesn't."""
    ws = words(col(c))
    stop = F.array_position(F.transform(ws, lambda w: w.rlike("^[A-ZÀ-ÖØ-Þ]").cast("int")), 0).cast("int")
    return F.when(stop > 0, F.slice(ws, 1, stop - 1)).otherwise(ws)


def infer_gender_from_prenom(prenoms: Column) -> Column:
    known = F.filter(F.transform(prenoms, F.lower), lambda p: p.isin(*MALE, *FEMALE))
    first = F.get(known, F.lit(0))
    return F.when(first.isin(*MALE), "M").when(first.isin(*FEMALE), "F").otherwise("?")


def gender_from_ending(c) -> Column:
    low = F.lower(col(c))
    return F.when(low.rlike("(ette|elle|oise|ine|anne)$"), "F").when(low.rlike("(ard|ert|aud|oux)$"), "M")


def parse_status(c) -> Column:
    low = F.lower(F.trim(col(c)))
    return reduce(lambda rest, p: F.when(low.contains(p[0]), p[1]).otherwise(rest), reversed(STATUS.items()), F.lit(None).cast("string"))


def parse_gender(c) -> Column:
    low = F.lower(F.trim(col(c)))
    return F.when(low.isin("m", "masculin", "homme", "h"), "M").when(low.isin("f", "féminin", "feminin", "femme"), "F").otherwise("?")


def standardize_profession(df: DataFrame, column: str) -> DataFrame:
    """+ standard: the profession that a spelling belongs to, or the lower-cased word itself."""
    table = df.sparkSession.createDataFrame([(v, k) for k, vs in PROFESSIONS.items() for v in vs], "variant string, std string")  # a fixed list
    return df.join(F.broadcast(table), F.lower(column) == table["variant"], "left").select(*[df[c] for c in df.columns], F.coalesce("std", F.lower(df[column])).alias("standard"))


def canonical_variant(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, canonical: the longest form of each key, the first in order among equals."""
    return df.groupBy(key).agg(F.min_by(column, F.struct(-F.length(column), F.col(column))).alias("canonical"))


def add_kin(persons: DataFrame, edges: DataFrame) -> DataFrame:
    """persons + n_<relation> kin, each id once: edges (person_id, kin_id, relation)."""
    kin = edges.groupBy("person_id").agg(F.countDistinct(F.when(F.col("relation") == "enfant", F.col("kin_id"))).alias("enfants"), F.countDistinct(F.when(F.col("relation") == "frere_soeur", F.col("kin_id"))).alias("freres_soeurs"))
    return persons.join(kin, "person_id", "left").fillna(0, ["enfants", "freres_soeurs"])


def dedup_best(df: DataFrame, keys: list[str], by: str = "confidence", then: str = "start") -> DataFrame:
    """One row for each key: the most confident, the earliest of equals."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), then))).where("rn = 1").drop("rn")
