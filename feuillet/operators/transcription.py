"""Corrections of transcriptions by rules with a confidence, and lookups that users extend."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feuillet.functions.text import CORRECTIONS, WORD

#: fixed values: category, what is written, what is meant, confidence, and the context that the rule needs
RULES = (
    ("abbreviation", "sr", "sieur", 0.95, None), ("abbreviation", "sgr", "seigneur", 0.95, None), ("abbreviation", r"éc\.", "écuyer", 0.90, None), ("abbreviation", r"bapt\.", "baptême", 0.95, None), ("abbreviation", r"mar\.", "mariage", 0.90, None), ("abbreviation", r"inh\.", "inhumation", 0.95, None), ("abbreviation", "prestre", "prêtre", 0.95, None),
    ("abbreviation", r"fév\.", "février", 0.95, None), ("abbreviation", r"sept\.", "septembre", 0.95, None), ("abbreviation", r"oct\.", "octobre", 0.95, None), ("abbreviation", r"nov\.", "novembre", 0.95, None), ("abbreviation", r"déc\.", "décembre", 0.95, None),
    ("spelling", "y", "i", 0.75, "sieur|seigneur|écuyer|noble"), ("spelling", r"([a-z])\1{2,}", "$1$1", 0.70, "ll|nn|mm|tt"), ("spelling", "ph", "f", 0.60, "philosophe|théologie|mathématiques"), ("spelling", "th", "t", 0.65, "philosophe|théologie|mathématiques"),
    ("particle", "De([A-Z][a-z]+)", "de $1", 0.90, None), ("particle", "Du([A-Z][a-z]+)", "du $1", 0.90, None), ("particle", "Le([A-Z][a-z]+)", "Le $1", 0.85, None),
    ("date", r"([0-9]+)e\s+jour\s+de\s+([a-zà-ÿ]+)", "$1 $2", 0.85, None), ("date", r"l'an\s+de\s+grâce\s+([0-9]{4})", "$1", 0.95, None),
    ("mistake", "moy", "moi", 0.80, None), ("mistake", r"ay(?=\s+[a-z])", "ai", 0.75, None), ("mistake", r"lesd\.", "lesdits", 0.90, None), ("mistake", r"lad\.", "ladite", 0.90, None), ("mistake", r"desd\.", "décédé", 0.85, None),
)


def pattern_of(rule: tuple) -> str:
    """Whole words, in any case but for particles; spelling rules that name letters hold within words."""
    inner = rule[0] == "spelling" and rule[1] != "y"
    flags = "" if rule[0] == "particle" else "(?iu)"
    return flags + (rule[1] if inner else f"(?<![{WORD}]){rule[1]}" + ("" if rule[1].endswith(r"\.") else f"(?![{WORD}])"))


def transcription_suggest(docs: DataFrame, rules=RULES, context: str | None = None) -> DataFrame:
    """doc_id, original, corrected, confidence, rule: one row for each distinct suggestion; ``context`` names a column."""
    text, low = F.coalesce("text", F.lit("")), F.lower(F.coalesce(F.col(context), F.lit(""))) if context else F.lit("")

    def one(rule: tuple) -> Column:
        p = pattern_of(rule)
        hits = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        made = F.transform(hits, lambda h: F.struct(h.alias("original"), F.regexp_replace(h, p.replace(r"(?=\s+[a-z])", ""), rule[2]).alias("corrected"), F.lit(rule[3]).alias("confidence"), F.lit(f"{rule[0]}:{rule[1]}").alias("rule")))
        return F.when(low.rlike(rule[4]), made).otherwise(F.slice(made, 1, 0)) if rule[4] else made

    x = docs.select("doc_id", F.explode(F.array_distinct(F.concat(*map(one, rules)))).alias("x"))
    return x.select("doc_id", "x.*").where("original <> corrected")


def transcription_apply(docs: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """docs + corrected_text, n_applied: the suggestions at a confidence or more, the surest first."""
    s = transcription_suggest(docs).where(F.col("confidence") >= min_confidence)
    s = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "original", "corrected"))).alias("s"))
    x = docs.join(s, "doc_id", "left")
    done = F.aggregate("s", F.coalesce("text", F.lit("")), lambda t, r: F.replace(t, r["original"], r["corrected"]))
    return x.select(*[docs[c] for c in docs.columns], F.coalesce(done, "text").alias("corrected_text"), F.coalesce(F.size("s"), F.lit(0)).alias("n_applied"))


def validate_correction(pairs: DataFrame) -> DataFrame:
    """pairs (original, corrected, context) + confidence: a half, three tenths for each category with a rule that does just this, two where the context bears it."""
    a, b, c = F.col("original"), F.col("corrected"), F.lower("context")
    score = F.lit(0.5)
    for category in dict.fromkeys(r[0] for r in RULES):
        hit = F.lit(False)
        for r in RULES:
            if r[0] == category:
                p = pattern_of(r)
                hit = hit | (a.rlike(p) & (F.lower(F.regexp_replace(a, p, r[2])) == F.lower(b)))
        score = score + F.when(hit, 0.3).otherwise(0.0)
    bears = F.when(a.contains("prestre") & b.contains("prêtre"), c.rlike("église|curé|bénéfice")).when(a.contains("sr") & b.contains("sieur"), c.rlike("de|terre|seigneurie")).otherwise(True)
    return pairs.withColumn("confidence", F.round(F.least(F.lit(1.0), score + F.when(bears, 0.2).otherwise(0.0)), 4))


def with_corrections(lookup: dict[str, str] = CORRECTIONS, rows: dict[str, str] | None = None) -> dict[str, str]:
    """A dictionary with a user's entries, to be given to ``ocr_correct_text``; theirs come first and win."""
    rows = rows or {}
    return rows | {k: v for k, v in lookup.items() if k not in rows}


def expand_patterns(patterns: dict[str, str], variables: dict[str, str]) -> dict[str, str]:
    """{full_name} and the like in patterns, filled in; what comes out must be a pattern."""
    made = {}
    for name, p in patterns.items():
        for k, v in variables.items():
            p = p.replace("{" + k + "}", v)
        re.compile(p)
        made[name] = p
    return made


def with_pattern(patterns: list[tuple[str, str]], name: str, regex: str, priority: int | None = None) -> list[tuple[str, str]]:
    """Patterns for ``extract.mentions`` with one more, at a place in the order of priority."""
    re.compile(regex)
    at = len(patterns) if priority is None else priority
    return [*patterns[:at], (name, regex), *patterns[at:]]


def correction_log(used: DataFrame, lookup: dict[str, str] = CORRECTIONS) -> DataFrame:
    """original, n: how often each entry of a dictionary has hits in texts (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    each = F.array(*[F.struct(F.lit(k).alias("original"), F.floor((F.length(text) - F.length(F.replace(text, F.lit(k), F.lit("")))) / len(k)).alias("n")) for k in lookup])
    return used.select(F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("x")).groupBy(F.col("x.original").alias("original")).agg(F.sum("x.n").cast("long").alias("n"))
