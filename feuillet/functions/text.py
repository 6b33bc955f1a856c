"""Text normalisation as column expressions.

Letter classes are written out and no word boundary is used, so that the same text comes out of any engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feuillet.functions.automata import in_turn, replaced, word_counts

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = f"0-9_{LETTER}"
#: fixed values: accented letters and their plain forms
ACCENTS = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")
#: fixed values: misread ligatures
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "œ": "oe", "æ": "ae", "ß": "ss", "ſ": "s", "ĳ": "ij"}
#: fixed values: what is misread and what it stands for, in the order of application
CORRECTIONS = {
    "Aiicelle": "Ancelle", "Aiiber": "Auber", "Aiigotin": "Antigotin", "Aiimont": "Aumont", "Aiivray": "Auvray", "Aii-": "Anne", "Aiil": "Anil", "Aiine-": "Anne-", "Aiieelle": "Ancelle",
    "Jaeques": "Jacques", "Franteois": "François", "Catlierhie": "Catherine", "Guillaïune": "Guillaume", "Nicollas": "Nicolas", "Muiiie": "Marie", "Cliarles": "Charles", "Jeau": "Jean", "Vietoire": "Victoire",
    "Iagdeleine": "Madeleine", "Pi-ançois": "François", "Toussaiut": "Toussaint", "Jlagdeleiue": "Madeleine", "Marie- An": "Marie-Anne", "Ade-": "Adeline", "Alexandre-": "Alexandre", "Adrienne-": "Adrienne", "Agnès-": "Agnès",
    "Tliomas": "Thomas", "Iichel": "Michel", "Hetiri": "Henri", "Charlotle": "Charlotte", "Qaiesnel": "Quesnel", "Dumesiiil": "Dumesnil", "Lefè": "Lefèvre", "Jehan": "Jean", "Jacobum": "Jacques", "Sancti": "Saint", "Martini": "Martin", "Reué": "René",
    "Dbm": "Dom", "Pliil": "Philippe", "Luee": "Luce", "Apvrille": "Aurville", "Apvi": "Aubin", "Tartvenu": "Taillevenu",
    "épous de": "épouse de", "fils d ": "fils de ", "fille d ": "fille de ", "parr ain": "parrain", "marr aine": "marraine", "mar riage": "mariage", "bapt ême": "baptême", "inhum ation": "inhumation", "décèz": "décès",
    "ï": "i", "ÿ": "y", "œ": "oe", "æ": "ae",
    "Dom Fi": "Dom Philippe", "Dom Et": "Dom Étienne", "Dom Th": "Dom Thomas", "Dom Pr": "Dom Pierre", "Denis Per": "Denis Perrin", "Henri Bi": "Henri Billard", "Gilles Ai": "Gilles Aimé", "Angélique Cha": "Angélique Charles",
    "Le Paultonnier": "Le Pautonnier", "Pauthonnier": "Pautonnier", "Dumesiiil Le Bastard": "Dumesnil Le Bastard",
    "le roy": "Le Roy", "le baron": "Le Baron", "le comte": "Le Comte", "le barbier": "Le Barbier", "le boucher": "Le Boucher", "Michiel": "Michel", "Mahieu": "Mathieu", "Anthoine": "Antoine", "Robinet": "Robin",
}
#: fixed values: phrases that were split, in any case
PHRASES = {"sieur d e": "sieur de", "seigneur d e": "seigneur de", "écuyer d e": "écuyer de", "fils d e": "fils de", "fille d e": "fille de", "épouse d e": "épouse de", "dame d e": "dame de", "comte d e": "comte de"}
#: fixed values: letters misread as words of their own
MISREAD = {"ii": "n", "rn": "m", "vv": "w", "nn": "n"}
#: fixed values: abbreviations
ABBREVIATIONS = {"bapt.": "baptême", "mar.": "mariage", "inh.": "inhumation", "sr": "sieur", "sgr": "seigneur", "éc.": "écuyer", "ec.": "écuyer", "fév.": "février", "sept.": "septembre", "oct.": "octobre", "nov.": "novembre", "déc.": "décembre", "janv.": "janvier", "parr.": "parrain", "marr.": "marraine", "épse": "épouse"}
#: fixed values: words that come from the archive, not from the register
PARASITES = ("archives", "calvados", "registre", "paroisse", "page", "folio", "acte", "vue", "image", "scan", "document", "fichier")
#: fixed values: short forms of given names, and of family names
GIVEN = {"Th": "Thomas", "Ph": "Philippe", "Fr": "François", "Ch": "Charles", "Gu": "Guillaume", "Ni": "Nicolas", "Pi": "Pierre", "Mi": "Michel", "An": "Antoine", "Je": "Jean", "Ja": "Jacques", "Ma": "Marie", "Ca": "Catherine", "Lo": "Louis", "He": "Henri", "Et": "Étienne"}
FAMILY = {"Le": "Le Roy", "Gu": "Guérin", "Ma": "Martin", "Ro": "Robert"}
#: fixed values: names that may stand before a stray hyphen
HYPHENED = ("Adeline", "Alexandre", "Adrienne", "Agnès", "Antoine", "André")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub(c: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, *r), rules, c)


def literal(c: Column, pairs: dict[str, str]) -> Column:
    """Ordered literal replacement: each rule all over the text, one after the other. See ``automata.replaced``."""
    return replaced(c, pairs)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def misread(c: Column) -> Column:
    """Letters misread as words of their own; a rule is tried where its letters are."""
    return reduce(lambda x, r: bound(x, lambda v: F.when(v.contains(r[0]), F.regexp_replace(v, alone(r[0]), r[1])).otherwise(v)), MISREAD.items(), c)


def lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\x20\t\n\r\f\x0b]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def clean_text(c) -> Column:
    return sub(squeeze(F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\u0084\u0086-\u009f]", "")), ('[“”‘’`]', '"'), ("…", "..."))


def clean_page_text(c) -> Column:
    return squeeze(F.replace(F.translate(col(c), " “”‘’–—\x00﻿", " \"\"''--"), F.lit("…"), F.lit("...")))


def alone(word: str) -> str:
    """A word with nothing of a word on both sides, as look-arounds."""
    return f"(?<![{WORD}]){word}(?![{WORD}])"


def clean_ocr_text(c) -> Column:
    text = literal(sub(col(c), (alone("[l1]"), "I"), (alone("0"), "O")), LIGATURES)
    return squeeze(sub(text, ("([a-zà-öø-ÿ])([A-ZÀ-ÖØ-Þ])", "$1 $2"), (f"([.,;:])([{LETTER}])", "$1 $2")))


def remove_accents(c) -> Column:
    return F.translate(col(c), *ACCENTS)


def comparison_key(c) -> Column:
    return F.regexp_replace(remove_accents(F.lower(col(c))), "[^0-9A-Za-z_]", "")


def normalize_particles(c) -> Column:
    return sub(col(c), *[(rf"(?i)(?<![{WORD}]){p}\s+", f"{p} ") for p in ("de", "du", "des", "Le", "La")])


def extract_words(c, min_length: int = 3) -> Column:
    found = F.regexp_extract_all(col(c), F.lit(f"(?<![{WORD}])[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?![{WORD}])"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= min_length))


def tidy(c: Column) -> Column:
    return sub(squeeze(c), (r"\x20+([,.;:])", "$1"), ("([,.;:])\x20*([A-ZÀ-ÖØ-Þ])", "$1 $2"), ("[“”„‚‘’]", '"'), ("[–—―]", "-"))


def ocr_correct_text(c, corrections: dict[str, str] = CORRECTIONS) -> Column:
    text = literal(col(c), in_turn(LIGATURES, corrections))
    phrases = sub(text, *[(f"(?iu){a}", b) for a, b in PHRASES.items()])
    text = F.when(text.rlike("(?i) d e"), phrases).otherwise(text)
    return F.trim(tidy(sub(misread(text), (r"\s+([,.;:])", "$1"))))


def ocr_correct_name(c, corrections: dict[str, str] = CORRECTIONS) -> Column:
    name = ocr_correct_text(c, corrections)
    first, last = F.regexp_extract(name, r"^(\S+) (\S+)$", 1), F.regexp_extract(name, r"^(\S+) (\S+)$", 2)
    base = lambda w: F.substring(w, 1, F.length(w) - 1)
    stray = lambda w: w.endswith("-") & (F.length(w) > 3) & F.exists(F.array(*map(F.lit, HYPHENED)), lambda n: n.startswith(base(w)))
    by_word = F.array_join(F.transform(words(name), lambda w: F.coalesce(F.element_at(lookup(corrections), w), F.when(stray(w), base(w)).otherwise(w))), " ")
    return (
        F.when(name.rlike("^Dom [A-Z][a-z]{1,2}$") & F.element_at(lookup(GIVEN), last).isNotNull(), F.concat(F.lit("Dom "), F.element_at(lookup(GIVEN), last)))
        .when(name.rlike("^[A-Z][a-zà-ÿ]+ [A-Z][a-z]{1,2}$") & F.element_at(lookup(FAMILY), last).isNotNull(), F.concat(first, F.lit(" "), F.element_at(lookup(FAMILY), last)))
        .when(F.element_at(lookup(GIVEN), name).isNotNull(), F.element_at(lookup(GIVEN), name))
        .otherwise(by_word)
    )


def with_bare(c: Column, kept: str) -> Column:
    """array of (w, b): the words, and what is left of each of letters, digits and ``kept``, in lower case. The text is cleaned once, not word by word: spaces stay, so both have the same places."""
    bare = lambda text: F.split(F.lower(F.regexp_replace(text, f"[^{WORD}{kept}\\x20]", "")), " ")
    both = lambda text: F.zip_with(F.split(text, " "), bare(text), lambda w, b: F.struct(w.alias("w"), b.alias("b")))
    return F.filter(bound(squeeze(c), both), lambda x: x["w"] != "")


def expand_abbreviations(c) -> Column:
    """struct(text, changes): each token that is an abbreviation, whatever else clings to it, in full."""
    full = lambda x: F.struct(x["w"].alias("w"), F.replace(x["w"], x["b"], F.element_at(lookup(ABBREVIATIONS), x["b"])).alias("full"))
    changed = lambda found: F.transform(F.filter(found, lambda x: x["full"].isNotNull()), lambda x: F.concat(x["w"], F.lit(" → "), x["full"]))
    return bound(F.transform(with_bare(col(c), "."), full), lambda found: F.struct(F.array_join(F.transform(found, lambda x: F.coalesce(x["full"], x["w"])), " ").alias("text"), changed(found).alias("changes")))


def normalize_punctuation(c) -> Column:
    return F.trim(sub(squeeze(col(c)), (f"([.,;:])([{LETTER}])", "$1 $2"), (r"\x20+([.,;:])", "$1"), ("[,;.]{2,}", ","), (rf"([{WORD}])\x20*-\x20*([{WORD}])", "$1-$2")))


def drop_parasitic_tokens(c, stopwords=PARASITES) -> Column:
    keep = F.filter(with_bare(col(c), ""), lambda x: (F.length(x["b"]) > 1) & ~x["b"].isin(*stopwords) & x["b"].rlike(f"[{LETTER}]"))
    return F.array_join(F.transform(keep, lambda x: x["w"]), " ")


def normalize_text(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    x = docs.withColumn("e", expand_abbreviations(ocr_correct_text(text)))
    x = x.withColumn("normalized", drop_parasitic_tokens(normalize_punctuation(F.col("e.text"))))
    return x.select(*docs.columns, "normalized", F.size("e.changes").alias("abbreviations_expanded"), F.length(text).alias("original_length"), F.length("normalized").alias("final_length"), F.round(F.length("normalized") / F.greatest(F.length(text), F.lit(1)), 4).alias("compression_ratio"))


def ocr_suggest(docs: DataFrame) -> DataFrame:
    """doc_id, pos, word, suggested, confidence for words that look misread and have another reading."""
    w = F.col("word")
    odd = w.rlike("[il1]{2,}|rn[a-z]|cl[aeiou]|[A-Z]{3,}|[0-9]")
    rules = sub(misread(w), ("([,.;:])([A-Z])", "$1 $2"))
    found = docs.select("doc_id", F.posexplode(words(F.coalesce("text", F.lit("")))).alias("pos", "word")).where(odd)
    known = F.element_at(lookup(CORRECTIONS), w)
    made = found.withColumn("known", known).withColumn("suggested", F.coalesce("known", rules)).where("suggested <> word")
    alike = 1 - F.levenshtein("word", "suggested") / F.greatest(F.length("word"), F.length("suggested"))
    return made.select("doc_id", "pos", "word", "suggested", F.round(F.when(F.col("known").isNotNull(), 0.95).otherwise(F.least(F.lit(0.9), F.greatest(F.lit(0.3), alike))), 4).alias("confidence"))


#: word lengths and the share of digits that a profile lets through
PROFILES = {"default": (1, 40, 0.5), "strict": (2, 30, 0.2), "tolerant": (1, 60, 0.8)}


def ocr_preprocess(docs: DataFrame, profile: str = "default") -> DataFrame:
    """+ corrected, rejected_words, quality_score, compression_ratio: a profile's words only."""
    lo, hi, digits = PROFILES[profile]
    text = F.coalesce("text", F.lit(""))
    good = lambda w: F.length(w).between(lo, hi) & (F.length(F.regexp_replace(w, "[^0-9]", "")) <= digits * F.length(w))
    x = docs.withColumn("ws", words(ocr_correct_text(text))).withColumn("kept", F.filter("ws", good))
    share = F.size("kept") / F.greatest(F.size("ws"), F.lit(1))
    score = 0.5 + 0.2 * share + F.when(F.size("kept") > 10, 0.2).otherwise(0.0) + F.when(F.array_join("kept", " ").rlike("[.;]"), 0.1).otherwise(0.0)
    return x.select(*docs.columns, F.array_join("kept", " ").alias("corrected"), (F.size("ws") - F.size("kept")).alias("rejected_words"), F.round(score, 4).alias("quality_score"), F.round(F.length(F.array_join("kept", " ")) / F.greatest(F.length(text), F.lit(1)), 4).alias("compression_ratio"))


def text_stats(docs: DataFrame) -> DataFrame:
    text, ls = F.coalesce("text", F.lit("")), F.split(F.coalesce("text", F.lit("")), "\n", -1)
    w = words(text)
    return docs.select("doc_id", F.length(text).alias("length"), F.size(ls).alias("lines"), F.size(w).alias("words"), F.size(F.array_distinct(F.transform(w, F.lower))).alias("unique_words"), F.round(F.aggregate(ls, F.lit(0), lambda a, x: a + F.length(x)) / F.size(ls), 4).alias("avg_line_length"))


def text_quality(docs: DataFrame) -> DataFrame:
    """doc_id, score, is_valid: length, five indicators, variety of letters, sentences, less a penalty for misreadings."""
    text = F.coalesce("text", F.lit(""))
    hits = lambda p: F.regexp_count(text, F.lit(p))
    counts = [hits(p) for p in ("[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+", "(1[5-9][0-9][0-9])", "(?i)(fils|fille|parrain|marraine)", "(?i)(bapt|mariage|inhum)", "(?i)(sieur|seigneur|dame)")]
    score = F.when(F.length(text).between(50, 10000), 0.2).otherwise(0.1) + sum((F.least(n * 0.1, F.lit(0.3)) for n in counts), F.lit(0.0))
    score = score + F.when(F.size(F.array_distinct(F.split(text, ""))) > 20, 0.2).otherwise(0.0) + F.when(hits("[.!?]") > 0, 0.1).otherwise(0.0) - F.least(hits("[0-9][A-Za-z]|[|]") * 0.05, F.lit(0.3))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return docs.select("doc_id", F.round(score, 4).alias("score"), (score > 0.3).alias("is_valid"), hits("[0-9][A-Za-z]|[|]").cast("int").alias("ocr_errors"))


#: fixed values: words of acts and kinship
KEYWORDS = ("fils", "fille", "filz", "épouse", "époux", "femme", "mari", "veuve", "parrain", "marraine", "parr", "marr", "père", "mère", "baptême", "mariage", "inhumation", "bapt", "inh", "naissance", "décès", "sieur", "seigneur", "dame")


def keyword_counts(docs: DataFrame, keywords=KEYWORDS) -> DataFrame:
    """doc_id, keyword, n for the keywords that a text has, in any case; all are found in one pass."""
    counts = word_counts(F.lower(F.coalesce("text", F.lit(""))), tuple(keywords))
    return docs.select("doc_id", F.posexplode(counts).alias("k", "n")).where("n > 0").select("doc_id", F.element_at(F.array(*map(F.lit, keywords)), F.col("k") + 1).alias("keyword"), "n")


def diagnose_document(docs: DataFrame) -> DataFrame:
    """doc_id, issues, recommendations (joined by ;)."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    few = F.aggregate(word_counts(low, KEYWORDS), F.lit(0), lambda a, n: a + n) < 10
    odd = F.regexp_count(text, F.lit(f"[^{WORD}\\s.,;:!?'\"()-]")) > 0.01 * F.length(text)
    glued = F.regexp_count(text, F.lit("[a-zà-öø-ÿ][A-ZÀ-ÖØ-Þ]")) > 20
    loose = (F.length(text) > 5000) & (F.regexp_count(text, F.lit("\n")) < 10)
    rules = ((few, "peu de mots-clés", "vérifier le type de document"), (odd, "caractères inhabituels", "nettoyer l'OCR"), (glued, "mots collés", "séparer les mots"), (loose, "texte sans structure", "découper le texte"))
    join = lambda k: F.array_join(F.array_compact(F.array(*[F.when(r[0], r[k]) for r in rules])), ";")
    return docs.select("doc_id", join(1).alias("issues"), join(2).alias("recommendations"))


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))


def line_context(lines: DataFrame) -> DataFrame:
    """+ before, after: the lines around."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumns({"before": F.lag("line").over(w), "after": F.lead("line").over(w)})


def sample_cutoff(lines: DataFrame, size: int) -> DataFrame:
    """Lines until ``size`` characters are reached."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("had", F.coalesce(F.sum(F.length("line")).over(w), F.lit(0))).where(F.col("had") < size).drop("had")


def relation_sample(docs: DataFrame, sample_size: int = 2000) -> DataFrame:
    """doc_id, sample: the lines with relation keywords and those around them, up to a size."""
    marked = line_context(lines_of(docs).withColumn("hit", F.lower("line").rlike("|".join(KEYWORDS))))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    near = marked.withColumn("near", F.col("hit") | F.coalesce(F.lag("hit").over(w), F.lit(False)) | F.coalesce(F.lead("hit").over(w), F.lit(False))).where("near")
    return sample_cutoff(near, sample_size).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("sample"))
