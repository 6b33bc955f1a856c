"""Mentions from register text: names, dates, professions, relations, periods, with their spans and confidence.

Positions of matches have no SQL function that is linear in their number, so ``mentions`` finds them in Arrow batches: one
pass for each pattern, a mask of what is taken, the surroundings cut on the spot. Texts are neither shuffled nor joined
back. Where patterns overlap, the one of the first priority and then the first position is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from feuillet.functions import dates as D
from feuillet.functions.automata import weighted_counts
from feuillet.functions.names import PROFESSIONS, dedup_best, split_name_mention
from feuillet.functions.text import WORD, words
from feuillet.operators.matching import spread

NAME = "[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'-]{1,25}"
FULL = f"{NAME}(?: {NAME})*"
MONTH = "|".join([*D.MONTHS, *D.SHORT_MONTHS])
#: fixed values: given names and family names that a validator knows
FIRST_NAMES = ("Jean", "Pierre", "Jacques", "Nicolas", "François", "Louis", "Antoine", "Michel", "Guillaume", "Charles", "Philippe", "Gabriel", "Thomas", "André", "Claude", "Henri", "Paul", "Denis", "Étienne", "Martin", "Barthélemy", "Laurent", "Julien", "Gilles", "Robert", "Christophe", "Marie", "Jeanne", "Catherine", "Marguerite", "Anne", "Françoise", "Madeleine", "Louise", "Élisabeth", "Marthe", "Agnès", "Nicole", "Barbe", "Suzanne", "Michelle", "Jacqueline", "Antoinette", "Jehan", "Michiel", "Guillemette", "Mahieu", "Anthoine", "Robinet", "Pérot", "Perrin", "Colin", "Robin", "Noël", "Mathieu", "Mathurin", "Raoul", "Renaud", "Regnault", "Thibault", "Arnaud", "Bertrand", "Germain", "Sébastien", "Vincent", "Yves", "Yvon")
FAMILY_NAMES = ("Le Roy", "Le Comte", "Le Baron", "Le Boucher", "Le Barbier", "Le Charpentier", "Martin", "Bernard", "Thomas", "Petit", "Robert", "Richard", "Durand", "Dubois", "Moreau", "Laurent", "Simon", "Michel", "Lefebvre", "Leroy", "Roux", "David", "Bertrand", "Morel", "Fournier", "Girard", "Bonnet", "Dupont", "Lambert", "Fontaine", "Rousseau", "Vincent", "Muller", "Mercier", "Boyer", "Blanc", "Guerin", "Boucher", "Fernandez")
#: fixed values: words that no name has, and words before places, in acts of kinship and before names
FORBIDDEN = ("archives", "calvados", "registre", "paroisse", "page", "folio", "acte", "baptême", "mariage", "décès", "inhumation", "témoin", "inventaire", "sommaire", "table", "index", "document", "fichier")
PLACES = ("paroisse", "église", "chapelle", "cathédrale", "abbaye", "clos", "champ", "pré", "jardin", "verger", "rue", "place")
KIN_TERMS = ("fils", "fille", "épouse", "mari", "père", "mère", "baptême", "mariage", "décès")
TITLE_WORDS = ("sieur", "sr", "seigneur", "sgr", "écuyer", "éc", "noble", "damoiselle", "dame")
#: fixed values: vocabulary, date patterns and phrases by period, the earliest first
PERIODS = {
    "ancien_regime": (("bapt.", "inh.", "curé", "prestre", "chapelle", "paroisse", "sieur", "escuyer", "conseiller du roi", "sr de", "sgr de", "pris possession", "bénéfice", "cure", "filz", "feu", "défunt", "grâce", "nostre seigneur"), (r"l'an (?:de )?(?:grâce )?[0-9]{4}", r"(?:janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre) [0-9]{4}", r"[0-9]{4}(?:[-–][0-9]{4})?"), ("registre des baptesmes et inhumations", "paroisse de nostre dame", "en présence de"), 1500, 1789),
    "revolution": ((*D.REPUBLICAN, "citoyen", "citoyenne", "commune", "république", "directoire", "an", "liberté", "égalité", "déclaration"), (r"l'an [IVX]+ de la république", rf"[0-9]{{1,2}} (?:{'|'.join(D.REPUBLICAN)}) an [IVX]+"), ("registre des actes de naissance", "commune de", "république française"), 1789, 1815),
    "etat_civil_ancien": (("maire", "adjoint", "officier d'état civil", "commune", "arrondissement", "département", "préfecture", "sous-préfecture", "légitimé", "reconnu", "naturel", "adoption"), (r"[0-9]{1,2} (?:janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre) (?:18|19)[0-9]{2}", r"(?:18|19)[0-9]{2}[-/][0-9]{1,2}[-/][0-9]{1,2}"), ("registres de l'état civil", "mairie de", "en présence des témoins"), 1815, 1900),
    "moderne": (("prénom", "nom de famille", "profession", "domicile", "nationalité", "carte d'identité", "passeport", "code civil", "livret de famille"), (r"(?:19|20)[0-9]{2}[-/][0-9]{1,2}[-/][0-9]{1,2}", r"[0-9]{1,2}[-/][0-9]{1,2}[-/](?:19|20)[0-9]{2}"), ("service de l'état civil", "code de la famille", "convention internationale"), 1900, 2000),
}


def resolve_overlaps(text: str, patterns: list[tuple[str, re.Pattern]]) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the matches without those that overlap one of an earlier pattern; code points from 0."""
    taken = bytearray(len(text))
    for kind, pattern in patterns:
        for m in pattern.finditer(text):
            start, end = m.span()
            if start < end and taken.find(1, start, end) < 0:
                taken[start:end] = b"\1" * (end - start)
                yield kind, start, end


FOUND_AT_ONCE = 10_000  # mentions in one batch that goes out


def _mentions(batches: Iterator[pa.RecordBatch], patterns: list[tuple[str, str]], window: int, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    compiled = [(kind, re.compile(p)) for kind, p in patterns]
    for batch in batches:
        of, found = [], []

        def out(batch=batch):
            at = pa.array(of, pa.int64())
            kinds, starts, ends, hits, near = zip(*found, strict=True)
            new = {"kind": pa.array(kinds, pa.string()), "start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32()), "hit": pa.array(hits, pa.string()), "near": pa.array(near, pa.string())}
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(at), **new, **{c: batch.column(c).take(at) for c in keep}})

        for row, value in enumerate(batch.column("text")):
            text = value.as_py() or ""
            for kind, start, end in resolve_overlaps(text, compiled):
                left = max(start - window, 0)
                of.append(row), found.append((kind, start, end, text[start:end], text[left : left + 2 * window + end - start]))
                if len(of) == FOUND_AT_ONCE:
                    yield out()
                    of.clear(), found.clear()
        if of:
            yield out()


def mentions(docs: DataFrame, patterns: list[tuple[str, str]], window: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kind, start, end, hit, and the columns ``keep`` of docs: the matches of patterns in their order of priority, without overlaps.

    With ``window`` also near: the match and so many characters before it and after it (more after it at a text's
    beginning). Each row is searched for itself, whatever its doc_id; null and empty texts have no mentions.
    """
    of = {f.name: f.dataType for f in docs.schema.fields}
    new = [StructField(n, t) for n, t in (("kind", StringType()), ("start", IntegerType()), ("end", IntegerType()), ("hit", StringType()), ("near", StringType()))]
    schema = StructType([StructField("doc_id", of["doc_id"]), *new, *[StructField(c, of[c]) for c in keep]])
    found = docs.select("doc_id", "text", *keep).mapInArrow(partial(_mentions, patterns=patterns, window=window, keep=keep), schema)
    return found if window else found.drop("near")


DATES = [("republican", rf"[0-9]{{1,2}} (?:{'|'.join(D.REPUBLICAN)}) (?:de )?l'an [IVX]+"), ("standard", rf"[0-9]{{1,2}} (?:{MONTH}) [0-9]{{4}}"), ("year_first", rf"[0-9]{{4}},? [0-9]{{1,2}} (?:{MONTH})"), ("year_only", rf"(?<![{WORD}])1[5-8][0-9]{{2}}(?![{WORD}])")]


#: what makes two mentions of a document one
KEYS = {"names": ["full_name"], "dates": ["text"], "professions": ["profession"], "relations": ["type", "a", "b"], "segments": []}


def best_of(kind: str, found: DataFrame) -> DataFrame:
    """The best of each mention in its document."""
    keys = ["doc_id", *KEYS[kind]]
    return dedup_best(spread(found, *keys), keys)


def _dates(docs: DataFrame) -> DataFrame:
    m = mentions(docs, DATES)
    rep = D.parse_republican_date("hit")
    month = F.element_at(D.month_map(), F.nullif(F.regexp_extract("hit", f"({MONTH})", 1), F.lit("")))
    day = F.when(F.col("kind") == "standard", F.regexp_extract("hit", "^([0-9]{1,2})", 1).try_cast("int")).when(F.col("kind") == "year_first", F.regexp_extract("hit", " ([0-9]{1,2}) ", 1).try_cast("int"))
    x = m.withColumns({"year": F.coalesce(rep["year"], D.extract_year("hit", None)).cast("int"), "month": F.coalesce(rep["month"], month).cast("int"), "day": F.coalesce(rep["day"], day)})
    conf = D.date_confidence(F.col("year"), F.col("month"), F.col("day"), F.col("kind"))
    out = x.select("doc_id", F.col("hit").alias("text"), "day", "month", "year", F.col("kind").alias("type"), F.round(conf, 4).alias("confidence"), (F.col("day").isNotNull() & F.col("month").isNotNull()).alias("is_complete"), D.date_era(F.col("year")).alias("era"), "start", "end")
    return out


def extract_dates(docs: DataFrame) -> DataFrame:
    """doc_id, text, day, month, year, type, confidence, is_complete, era, start, end; one row for each text, the surest."""
    return best_of("dates", _dates(docs))


def date_ranges(dates: DataFrame) -> DataFrame:
    """Pairs of dates of one document 1 to 100 years apart, both surer than a half."""
    d = dates.where("confidence > 0.5 and year is not null")
    a, b = (d.select("doc_id", F.col("year").alias(f"year_{k}"), F.col("start").alias(f"s{k}"), F.col("confidence").alias(f"c{k}")) for k in "ab")
    gap = F.col("year_b") - F.col("year_a")
    return a.join(b, "doc_id").where((F.col("sa") != F.col("sb")) & gap.between(1, 100)).select("doc_id", "year_a", "year_b", F.round(0.8 * F.least("ca", "cb"), 4).alias("confidence")).distinct()


def validate_name(name: Column, context: Column | None = None) -> Column:
    """struct(is_valid, confidence, n_errors): what a name is made of, and what no name has in it."""
    ws = words(name)
    low = F.transform(ws, F.lower)
    bad = sum((name.rlike(p).cast("int") for p in ("[0-9]{3,}", "^[^A-ZÀ-ÖØ-Þß]", "[<>@#$%^&*()]", "^.{1,2}$", "^.{80,}$", "^[A-Z]{3,}$", "^[0-9]+$")), F.lit(0))
    errors = bad + F.size(F.filter(low, lambda w: w.isin(*FORBIDDEN))) + F.size(F.filter(low, lambda w: w.isin(*PLACES)))
    titled = F.get(low, F.lit(0)).isin(*TITLE_WORDS, "dom", "père", "abbé", "prieur", "frère", "sœur", "mère")
    rest = F.when(titled, F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(1)))).otherwise(ws)
    part = F.array_join(rest, " ").rlike(r"(?i)(^|\s)(de|du|des|le|la|les|d'|von|van)(\s|$)")
    both = split_name_mention(F.array_join(rest, " "))
    first, family = F.get(F.split(both["first_names"], " "), F.lit(0)), both["family_name"]
    has_first = (both["first_names"] != "") & (F.size(rest) > 1)
    score = F.when(has_first, F.when(first.isin(*FIRST_NAMES), 0.4).when(first.rlike("^[A-ZÀ-ÖØ-Þ].{1,14}$"), 0.2).otherwise(0.1)).otherwise(0.0)
    score = score + F.when(family == "", 0.0).when(family.isin(*FAMILY_NAMES), 0.3).when(family.rlike("^[A-ZÀ-ÖØ-Þ]."), 0.2).otherwise(0.1)
    score = score + F.when(F.size(ws) >= 2, 0.2).otherwise(0.0) + F.when(titled, 0.1).otherwise(0.0) + F.when(part, 0.1).otherwise(0.0) + F.when(name.rlike("[A-ZÀ-ÖØ-Þ]"), 0.05).otherwise(0.0) + F.when(name.rlike("[à-öø-ÿÀ-ÖØ-Þ]"), 0.05).otherwise(0.0) + F.when(name.contains("-"), 0.05).otherwise(0.0)
    score = score - F.when(F.length(F.regexp_replace(name, "[^0-9]", "")) > 0.1 * F.length(name), 0.3).otherwise(0.0)
    if context is not None:
        c = F.lower(context)
        any_ = lambda ts: reduce(lambda a, t: a | c.contains(t), ts, F.lit(False))
        score = score + F.when(any_(KIN_TERMS), 0.15).otherwise(0.0) + F.when(any_(("curé", "prêtre", "vicaire", "abbé", "église", "paroisse")), 0.1).otherwise(0.0) - F.when(any_(("rue", "place", "chemin", "clos", "champ")), 0.2).otherwise(0.0) + F.when(context.rlike("[0-9]{4}"), 0.05).otherwise(0.0)
    confidence = F.least(score, F.lit(1.0))
    return F.struct(((errors == 0) & (confidence > 0.3)).alias("is_valid"), F.round(confidence, 4).alias("confidence"), errors.cast("int").alias("n_errors"))


def name_false_positive(name: Column) -> Column:
    return name.rlike("(?i)^(paroisse|église|chapelle|cathédrale|abbaye|clos|champ|pré|jardin|verger|familles?|rue|place|chemin|route) ") | F.lower(name).rlike("archives|registre|folio|page|acte|document|inventaire|sommaire|table|index") | name.rlike("^[A-Z]{2,}$") | name.rlike("(^| )[A-Za-z]{1,2}$") | (F.length(name) > 80) | (F.length(F.regexp_replace(name, "[^0-9]", "")) > 0.2 * F.length(name))


BONUS = {"title": 0.15, "particle": 0.1, "compound": 0.1, "full": 0.05, "basic": 0.0}


def name_confidence(name: Column, kind: Column, base: Column, context: Column) -> Column:
    n = F.size(words(name))
    score = base + F.element_at(F.create_map(*[F.lit(x) for p in BONUS.items() for x in p]), kind) + F.when(name.contains("-"), 0.05).otherwise(0.0) + F.when(n == 2, 0.1).when(n == 3, 0.05).when(n > 4, -0.05).otherwise(0.0)
    score = score + F.when(reduce(lambda a, t: a | F.lower(context).contains(t), KIN_TERMS, F.lit(False)), 0.1).otherwise(0.0) - F.when(F.lower(name).rlike("ii|rn|cl|vv|nn"), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


NAMES = [("title", f"(?:sieur|seigneur|écuyer|noble|damoiselle|dame) (?:de )?{FULL}"), ("particle", f"{NAME}(?: (?:de|du|des|le|la) {NAME})+"), ("compound", f"{NAME}-{NAME}(?: {NAME})*"), ("full", f"{NAME}(?: {NAME})+"), ("basic", NAME)]


def _names(docs: DataFrame, least: float = 0.4, window: int = 50) -> DataFrame:
    m = mentions(docs, NAMES, window).where(~name_false_positive(F.col("hit")))
    y = m.withColumn("v", validate_name(F.col("hit"), F.col("near"))).where("v.n_errors = 0")
    confidence = F.round(name_confidence(F.col("hit"), F.col("kind"), F.col("v.confidence"), F.col("near")), 4)
    out = y.select("doc_id", F.col("hit").alias("full_name"), split_name_mention("hit").alias("s"), F.col("kind").alias("source_pattern"), confidence.alias("confidence"), "start", "end", "near")
    return out.select("doc_id", "full_name", "s.first_names", "s.family_name", "source_pattern", "confidence", "start", "end", "near").where(F.col("confidence") >= least)


def extract_names(docs: DataFrame, least: float = 0.4, window: int = 50) -> DataFrame:
    """doc_id, full_name, first_names, family_name, source_pattern, confidence, start, end: the best of each name in a text."""
    return best_of("names", _names(docs, least, window)).drop("near")


CONTEXT = {"filiation": ("fils", "fille"), "marriage": ("mariage", "épouse"), "godparent": ("parrain", "marraine"), "clerical": ("curé", "prêtre", "vicaire")}


def name_context(docs: DataFrame, least: float = 0.4, window: int = 50) -> DataFrame:
    """doc_id, start + n_<kind> for the terms around each name of ``extract_names``, and n_years."""
    near = F.lower("near")
    counts = [sum((F.regexp_count(near, F.lit(t)) for t in ts), F.lit(0)).cast("int").alias(f"n_{k}") for k, ts in CONTEXT.items()]
    return best_of("names", _names(docs, least, window)).select("doc_id", "start", *counts, F.regexp_count(near, F.lit("[0-9]{4}")).cast("int").alias("n_years"))


TRADE_WORDS = "|".join(sorted((v for vs in PROFESSIONS.values() for v in vs), key=len, reverse=True))
TRADES = [("office", "(?:conseiller|trésorier|avocat|procureur|greffier) du (?:roi|roy)"), ("ecclesiastical", f"(?:curé|prestre|prêtre|vicaire|chapelain) de {FULL}"), ("title_land", "(?:sieur|sr|seigneur|sgr) de [A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ]+"), ("basic", f"(?<![{WORD}])(?:{TRADE_WORDS})(?![{WORD}])")]
TRADE_CONFIDENCE = {"office": 0.9, "ecclesiastical": 0.85, "title_land": 0.85, "basic": 0.7}


def _professions(docs: DataFrame) -> DataFrame:
    m = mentions(docs, TRADES)
    category = F.when(F.col("kind") == "title_land", "title").when(F.col("hit").rlike("curé|prestre|prêtre|vicaire|chapelain"), "ecclesiastical").when(F.col("kind") == "office", "royal").otherwise("secular")
    return m.select("doc_id", F.col("hit").alias("profession"), F.col("kind").alias("subcategory"), category.alias("category"), F.element_at(F.create_map(*[F.lit(x) for p in TRADE_CONFIDENCE.items() for x in p]), F.col("kind")).alias("confidence"), "start", "end")


def extract_professions(docs: DataFrame) -> DataFrame:
    return best_of("professions", _professions(docs))


RELATIONS = [("filiation", rf"({FULL}),? (?:fils|fille|filz) de ({FULL})(?:(?:, [^,;.]{{1,40}}\.?){{0,4}}?,? et (?:de )?({FULL}))?"), ("marriage", rf"({FULL}),? (?:épouse|femme|veuve) de ({FULL})"), ("godfather", rf"(?:parrain|parr\.?) ?:? ?({FULL})"), ("godmother", rf"(?:marraine|marr\.?) ?:? ?({FULL})")]
ROLES = {"filiation": ("child", "father", "mother"), "marriage": ("wife", "husband"), "godfather": ("godfather",), "godmother": ("godmother",)}


def _relations(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    m = mentions(docs, RELATIONS, keep=keep)
    part = lambda k: reduce(lambda rest, r: F.when(F.col("kind") == r[0], F.nullif(F.regexp_extract("hit", r[1], k), F.lit(""))).otherwise(rest) if k <= len(ROLES[r[0]]) else rest, RELATIONS, F.lit(None).cast("string"))
    x = m.withColumns({"a": part(1), "b": part(2), "c": part(3)})
    two = lambda c: F.coalesce((F.size(words(F.col(c))) >= 2).cast("int"), F.lit(0))
    score = F.when(F.col("kind") == "filiation", 0.6 + 0.2 + 0.1 * two("a") + 0.1 * two("b") + 0.1 * two("c")).when(F.col("kind") == "marriage", 0.85 + 0.1 * two("a") * two("b")).otherwise(0.65 + 0.2 * two("a"))
    return x.select("doc_id", F.col("kind").alias("type"), "a", "b", "c", F.round(F.least(F.lit(1.0), score), 4).alias("confidence"), "start", "end", *keep)


def extract_relations(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, type, a, b, c (child, father, mother; wife, husband; godparent), confidence: by pattern and how full the names are.

    Up to four titles or lands of the father may stand between him and the mother. Line breaks are for ``normalize_text``.
    ``keep``: columns of docs to go along.
    """
    return best_of("relations", _relations(docs, keep))


def extract_relations_context(docs: DataFrame) -> DataFrame:
    """The same relations with fixed base scores, one more tenth where the text around is that of an act, and tags."""
    low = F.lower("text")
    count = lambda ts: sum((low.contains(t).cast("int") for t in ts), F.lit(0))
    dated = F.col("text").rlike("[0-9]{4}")
    context = F.least(F.lit(1.0), 0.5 + 0.1 * count(("baptême", "église", "curé", "paroisse", "mariage", "inhumation")) + F.when(dated, 0.2).otherwise(0.0) + 0.1 * count(("sieur", "écuyer", "seigneur", "comte", "baron", "dame")))
    tags = F.array_compact(F.array(F.when(low.contains("bapt"), "baptism_context"), F.when(low.contains("mariage"), "marriage_context"), F.when(low.rlike("curé|prêtre"), "clerical_context"), F.when(dated, "dated_context")))
    base = F.when(F.col("type") == "filiation", 0.75).when(F.col("type") == "marriage", 0.80).otherwise(0.70)
    told = docs.select("doc_id", "text", F.when(context > 0.8, 0.1).otherwise(0.0).alias("more"), F.array_join(tags, ",").alias("indicators"))
    x = extract_relations(told, ("more", "indicators"))
    return x.select("doc_id", "type", "a", "b", F.round(F.least(F.lit(1.0), base + F.col("more")), 4).alias("confidence"), "indicators")


def validate_relation(relations: DataFrame) -> DataFrame:
    """doc_id, type, a, is_valid, confidence: each name by itself, the same name twice, a known mother."""
    v = {c: validate_name(F.coalesce(F.col(c), F.lit(""))) for c in "abc"}
    has = {c: F.col(c).isNotNull().cast("int") for c in "abc"}
    good = {c: (v[c]["is_valid"] & F.col(c).isNotNull()).cast("int") for c in "abc"}
    score = sum((good[c] * v[c]["confidence"] * 0.3 for c in "abc"), F.lit(0.0)) + 0.4 * sum(good.values(), F.lit(0)) / F.greatest(F.lit(1), sum(has.values(), F.lit(0)))
    same = (F.lower("a") == F.lower("b")).cast("int")
    score = score - 0.3 * F.coalesce(same, F.lit(0)) + F.when(F.col("type") == "filiation", 0.2 * has["c"]).when(F.col("type") == "marriage", 0.1).otherwise(0.0)
    missing = F.col("a").isNull() | (F.col("type").isin("filiation", "marriage") & F.col("b").isNull())
    return relations.select("doc_id", "type", "a", "b", (~missing & (score > 0.5)).alias("is_valid"), F.round(F.least(F.lit(1.0), score), 4).alias("confidence"))


STRICT = {"Cliarles": "Charles", "Jeau": "Jean"}


def extract_filiations_strict(docs: DataFrame) -> DataFrame:
    """doc_id, child, father, mother, confidence, rejection_reason (null: accepted); what is rejected stays, with the first reason."""
    f = extract_relations(docs).where("type = 'filiation'").select("doc_id", F.col("a").alias("child"), F.col("b").alias("father"), F.col("c").alias("mother"))
    ws = words(F.col("child"))
    first = F.get(ws, F.lit(0))
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in STRICT.items() for x in p]), first), first)
    score = 0.2 + F.when(F.size(ws).between(2, 4), 0.2).otherwise(0.0) + F.when(known.isin(*FIRST_NAMES), 0.4).otherwise(0.0) + F.when(F.element_at(ws, -1).isin(*FAMILY_NAMES), 0.2).otherwise(0.0)
    reason = F.when(F.length("child") < 4, "trop court").when(F.col("child").rlike("[0-9]{3,}|[<>@#$%^&*()]"), "motif rejeté").when(F.exists(ws, lambda w: F.lower(w).isin(*FORBIDDEN)), "mot interdit").when(F.exists(ws, lambda w: F.lower(w).rlike("^(arch|reg|par|doc|img|scan|pdf)")), "préfixe interdit").when(~known.isin(*FIRST_NAMES), "prénom inconnu").when(score < 0.5, "score insuffisant").when(F.lower("child") == F.lower("father"), "même nom")
    two = lambda c: F.coalesce((F.size(words(F.col(c))) >= 2).cast("int"), F.lit(0))
    confidence = F.least(F.lit(1.0), 0.4 + 0.2 * two("child") + 0.2 * known.isin(*FIRST_NAMES).cast("int") + 0.1 * two("father") + 0.1 * two("mother"))
    return f.select("doc_id", "child", "father", "mother", F.round(confidence, 4).alias("confidence"), F.round(score, 4).alias("score"), reason.alias("rejection_reason"))


def strict_statistics(filiations: DataFrame) -> DataFrame:
    by = filiations.groupBy(F.coalesce("rejection_reason", F.lit("validées")).alias("what")).agg(F.count("*").alias("n"))
    rate = filiations.agg(F.count("*").alias("n"), F.round(100 * F.avg(F.col("rejection_reason").isNull().cast("int")), 2).alias("rate"))
    grade = F.when(F.col("rate") >= 80, "Excellente").when(F.col("rate") >= 60, "Bonne").when(F.col("rate") >= 40, "Moyenne").otherwise("Faible")
    return by.unionByName(rate.select(F.concat(F.lit("examinées, qualité "), grade).alias("what"), "n"))


def extract_segments(docs: DataFrame) -> DataFrame:
    """doc_id, index, text, length, type, word_count, quality_score."""
    s = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.;]\s+", -1)).alias("index", "t")).withColumn("text", F.trim("t")).where(F.length("text") > 10)
    return s.select("doc_id", "index", "text", F.length("text").alias("length"), classify_segment(F.col("text")).alias("type"), F.size(words(F.col("text"))).alias("word_count"), F.round(segment_quality(F.col("text")), 4).alias("quality_score"))


def classify_segment(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("bapt|naissance|né"), "bapteme").when(low.rlike("mariage|épouse|mari|époux"), "mariage").when(low.rlike("inh|décès|mort|décédé|défunt"), "deces").otherwise("general")


def segment_quality(c: Column) -> Column:
    n = lambda p: F.regexp_count(c, F.lit(p))
    return F.least(F.lit(1.0), F.when(F.length(c) > 20, 0.2).otherwise(0.0) + F.least(n(NAME) * 0.15, F.lit(0.4)) + F.least(n("1[5-8][0-9]{2}") * 0.2, F.lit(0.3)) + F.least(n("(?i)(fils|fille|épouse|mari|parrain|marraine)") * 0.1, F.lit(0.2)))


def from_the_year(pattern: str) -> str:
    """A month and a year, looked for by the year, which is rarer than what months begin with."""
    return re.sub(r"^(\(\?:[^()]*\)) \[0-9\]\{4\}$", r"[0-9](?<=\1 [0-9])[0-9]{3}", pattern)


def detect_period(docs: DataFrame) -> DataFrame:
    """doc_id, period, confidence, year_lo, year_hi: the period with most vocabulary (2 each), dates (3) and phrases (5); the earliest of equals.

    Vocabulary and phrases of all periods are found in one pass over a text.
    """
    text = F.coalesce("text", F.lit(""))
    words_ = weighted_counts(F.lower(text), [dict.fromkeys(p[0], 2) for p in PERIODS.values()], [dict.fromkeys(p[2], 5) for p in PERIODS.values()])
    told = docs.select("doc_id", text.alias("t"), words_.alias("n"))
    rows = []
    for k, (name, (vocabulary, dates, _, lo, hi)) in enumerate(PERIODS.items()):
        score = F.get("n", F.lit(k)) + sum((3 * F.regexp_count("t", F.lit(f"(?i){from_the_year(p)}")) for p in dates), F.lit(0))
        rows.append(F.struct((-score).cast("int").alias("s"), F.lit(k).alias("k"), F.lit(name).alias("period"), F.lit(2 * len(vocabulary) + 30).alias("most"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))
    x = told.select("doc_id", F.array_min(F.array(*rows)).alias("x"))
    return x.select("doc_id", "x.period", F.when(F.col("x.s") == 0, 0.3).otherwise(F.round(F.least(F.lit(1.0), -F.col("x.s") / F.col("x.most")), 4)).alias("confidence"), F.col("x.lo").alias("year_lo"), F.col("x.hi").alias("year_hi"))


def period_features(docs: DataFrame) -> DataFrame:
    """doc_id, feature, value: act numbers, INSEE codes, and whether citizens or communes are named, where the text has them."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit("(?i)acte n°? ?([0-9]+)"), F.lit(1)), lambda v: F.struct(F.lit("acte").alias("feature"), v.alias("value"))), F.transform(F.regexp_extract_all(text, F.lit("(?<![0-9])([0-9]{5})(?![0-9])"), F.lit(1)), lambda v: F.struct(F.lit("insee").alias("feature"), v.alias("value"))), F.transform(F.regexp_extract_all(F.lower(text), F.lit("(citoyenn?e?|commune)"), F.lit(1)), lambda v: F.struct(F.lit("republicain").alias("feature"), v.alias("value"))))
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


def parse_by_period(docs: DataFrame, forced: str | None = None) -> DataFrame:
    """doc_id, period, kind, n: each text by its period's extractors; republican texts give no godparents."""
    period = docs.select("doc_id", F.lit(forced).alias("period")) if forced else detect_period(docs).select("doc_id", "period")
    counts = combine_extractors(docs, ("names", "dates", "relations"))
    return period.join(counts.where("n > 0"), "doc_id").where("not (period = 'revolution' and kind = 'relations')").select("doc_id", "period", "kind", "n")


def combine_extractors(docs: DataFrame, kinds: tuple[str, ...] = ("names", "dates", "professions", "relations")) -> DataFrame:
    """doc_id, kind, n, success: what each chosen extractor found in each document; one row for each doc_id and kind."""
    run = {"names": _names, "dates": _dates, "professions": _professions, "relations": _relations, "segments": extract_segments}
    mine = lambda kind: F.array(*[F.col(c).cast("string") for c in KEYS[kind]]).cast("array<string>")
    found = docs.select("doc_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("array<string>").alias("key"))
    for kind in kinds:
        found = found.unionByName(run[kind](docs).select("doc_id", F.lit(kind).alias("kind"), mine(kind).alias("key")))
    each = spread(found, "doc_id").groupBy("doc_id", "kind", "key").agg(F.count("*").alias("n"))
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, F.lit(1) if KEYS[kind] else F.col("n")).otherwise(0)).cast("long")
    by = each.groupBy("doc_id").agg(*[n(kind).alias(kind) for kind in kinds])
    out = by.select("doc_id", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("n")) for kind in kinds])).alias("x"))
    return out.select("doc_id", "x.kind", "x.n").withColumn("success", F.col("n") > 0)


def extract_persons_basic(docs: DataFrame) -> DataFrame:
    """doc_id, full_name, occurrences, confidence: two or more capitalised words in a row."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{NAME}(?: {NAME})+"), F.lit(0))).alias("full_name"))
    return found.groupBy("doc_id", "full_name").agg(F.count("*").alias("occurrences")).withColumn("confidence", F.lit(0.7))


def cross_validate(relations: DataFrame, persons: DataFrame) -> DataFrame:
    """doc_id, rate, mean_confidence, grade: persons found that relations also name."""
    named = relations.select("doc_id", F.explode(F.array("a", "b", "c")).alias("full_name")).where("full_name is not null").distinct().withColumn("hit", F.lit(1))
    mean = relations.groupBy("doc_id").agg(F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    rate = persons.join(named, ["doc_id", "full_name"], "left").groupBy("doc_id").agg(F.round(100 * F.count("hit") / F.count("*"), 2).alias("rate"))
    grade = F.when(F.col("rate") >= 80, "Excellente").when(F.col("rate") >= 60, "Bonne").when(F.col("rate") >= 40, "Moyenne").otherwise("Faible")
    return rate.join(mean, "doc_id", "left").select("doc_id", "rate", "mean_confidence", grade.alias("grade"))


def min_confidence(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("confidence") >= least)


