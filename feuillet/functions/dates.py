"""Dates of register acts: free text to years and calendar dates, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: months and their abbreviations
MONTHS = {"janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12}
SHORT_MONTHS = {"janv": 1, "fév": 2, "avr": 4, "juil": 7, "sept": 9, "oct": 10, "nov": 11, "déc": 12}
REPUBLICAN = ("vendémiaire", "brumaire", "frimaire", "nivôse", "pluviôse", "ventôse", "germinal", "floréal", "prairial", "messidor", "thermidor", "fructidor")
GEDCOM = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_map() -> Column:
    return F.create_map(*[F.lit(x) for p in (MONTHS | SHORT_MONTHS).items() for x in p])


def extract_year(c: Column | str, lo: int | None = 1400, hi: int | None = 1900) -> Column:
    """The first number of exactly four digits, if it is within lo and hi (None: any)."""
    found = F.nullif(F.regexp_extract(col(c), r"(?:^|[^0-9A-Za-zÀ-ÿ_])([0-9]{4})(?:[^0-9A-Za-zÀ-ÿ_]|$)", 1), F.lit("")).cast("int")
    return found if lo is None else F.when(found.between(lo, hi), found)


def parse_french_date(c: Column | str) -> Column:
    """"13 février 1646" or "1646, 13 fév." as a date; null if there is none or it is impossible."""
    text = F.lower(F.trim(col(c)))
    names, short = "|".join(MONTHS), "|".join([*MONTHS, *SHORT_MONTHS])
    a, b = rf"([0-9]{{1,2}})\s+({names})\s+([0-9]{{4}})", rf"([0-9]{{4}}),?\s+([0-9]{{1,2}})\s+({short})"
    made = lambda p, y, m, d: F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(text, p, y), F.element_at(month_map(), F.regexp_extract(text, p, m)), F.regexp_extract(text, p, d)), F.lit("yyyy-M-d")).cast("date")
    return F.coalesce(F.when(text.rlike(a), made(a, 3, 2, 1)), F.when(text.rlike(b), made(b, 1, 3, 2)))


def roman(c: Column) -> Column:
    """A Roman numeral's value; a letter before a greater one counts against."""
    values = F.create_map(*[F.lit(x) for p in ROMAN.items() for x in p])
    step = lambda acc, x: F.struct((acc["sum"] + F.when(values[x] < acc["last"], -values[x]).otherwise(values[x])).alias("sum"), values[x].alias("last"))
    return F.aggregate(F.reverse(F.split(F.upper(c), "")), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step)["sum"]


def parse_republican_date(c: Column | str) -> Column:
    """Day, month (1 to 13) and Gregorian year of "12 brumaire l'an VII": struct(day, month, year), or null."""
    text = F.lower(col(c))
    p = rf"([0-9]{{1,2}})\s+({'|'.join(REPUBLICAN)})\s+(?:de\s+)?l'an\s+([ivx]+)"
    get = lambda k: F.regexp_extract(text, p, k)
    return F.when(text.rlike(p), F.struct(get(1).cast("int").alias("day"), F.array_position(F.array(*map(F.lit, REPUBLICAN)), get(2)).cast("int").alias("month"), (roman(get(3)) + 1792).alias("year")))


def validate_date(y: Column, m: Column, d: Column) -> Column:
    """struct(score, warnings): a half for a year in 1500 to 1950, a quarter each for a possible month and day."""
    good_y, good_m, good_d = (F.coalesce(c.between(*r), F.lit(False)) for c, r in ((y, (1500, 1950)), (m, (1, 12)), (d, (1, 31))))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    warn = F.array_compact(F.array(F.when(m.isin(4, 6, 9, 11) & (d > 30), "jour impossible"), F.when((m == 2) & (d > 29), "jour impossible"), F.when((m == 2) & (d == 29) & ~leap, "année non bissextile")))
    score = good_y.cast("int") * 0.5 + good_m.cast("int") * 0.25 + good_d.cast("int") * 0.25
    return F.struct(score.alias("score"), warn.alias("warnings"))


def date_confidence(y: Column, m: Column, d: Column, kind: Column) -> Column:
    bonus = F.when(kind == "standard", 0.1).when(kind.isin("year_first", "republican"), 0.05).when(kind == "year_only", -0.3).otherwise(0.0)
    complete = F.when(m.isNotNull() & d.isNotNull(), 0.2).when(m.isNotNull(), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), validate_date(y, m, d)["score"] + bonus + complete + F.when(y.between(1600, 1800), 0.1).otherwise(0.0)))


def date_era(y: Column) -> Column:
    return F.when(y.isNull(), "inconnue").when(y < 1789, "ancien_regime").when(y < 1815, "revolution_empire").when(y < 1870, "restauration").when(y < 1940, "moderne").otherwise("contemporain")


def age_at(birth: Column, target: Column) -> Column:
    return extract_year(target) - extract_year(birth)


def is_coherent(earlier: Column, later: Column) -> Column:
    return F.coalesce(extract_year(earlier) <= extract_year(later), F.lit(True))


def format_date_range(start: Column, end: Column) -> Column:
    a, b = start.cast("string"), end.cast("string")
    return F.when(a.isNull() & b.isNull(), "période inconnue").when(a == b, a).otherwise(F.concat(F.coalesce(a, F.lit("?")), F.lit("-"), F.coalesce(b, F.lit("?"))))


def birth_from_age(death: Column, age: Column) -> Column:
    return F.try_to_timestamp(F.concat((F.year(death) - age).cast("string"), F.lit("-6-15")), F.lit("yyyy-M-d")).cast("date")


def estimate_marriage_date(child_birth: Column, first: bool = True) -> Column:
    return F.try_to_timestamp(F.concat((F.year(child_birth) - (1 if first else 2)).cast("string"), F.lit("-5-1")), F.lit("yyyy-M-d")).cast("date")


def gedcom_date(c: Column | str) -> Column:
    """Day, month and year that a text has, in GEDCOM's order and month names."""
    text = F.lower(col(c))
    month = F.element_at(month_map(), F.nullif(F.regexp_extract(text, "(" + "|".join([*MONTHS, *SHORT_MONTHS]) + ")", 1), F.lit("")))
    day = F.nullif(F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{1,2})(?:[^0-9]|$)", 1), F.lit(""))
    return F.concat_ws(" ", day, F.when(month.isNotNull(), F.element_at(F.array(*map(F.lit, GEDCOM)), month)), extract_year(c, None).cast("string"))


def infer_birth_year(events: DataFrame) -> DataFrame:
    """events (person_id, event_type, year) -> person_id, birth_year: the middle of what marriage, first child and death leave possible."""
    spans = {"mariage": (40, 16), "premier_enfant": (45, 18), "deces": (80, 30)}
    low = high = F.lit(None).cast("int")
    for kind, (a, b) in spans.items():
        low = F.when(F.col("event_type") == kind, F.col("year") - a).otherwise(low)
        high = F.when(F.col("event_type") == kind, F.col("year") - b).otherwise(high)
    out = events.select("person_id", low.alias("lo"), high.alias("hi")).groupBy("person_id").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")).where("lo is not null")
    return out.select("person_id", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int").alias("birth_year"))


def source_reference(archive: Column, collection: Column, years: Column, page: Column) -> Column:
    return F.concat(archive, F.lit(", "), collection, F.lit(" "), years, F.lit(", p."), page)


def parse_source_reference(c: Column) -> Column:
    p = r"^(.*), (.*) ([0-9]{4}-[0-9]{4}), p\.([0-9]+)$"
    get = lambda k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    return F.struct(get(1).alias("archive"), get(2).alias("collection"), get(3).alias("years"), get(4).cast("int").alias("page"))
