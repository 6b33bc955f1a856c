"""Queries over extraction, with their SQL on register text."""

from pyspark.sql import functions as F

from feuillet.functions import dates as D
from feuillet.operators import extract as E
from feuillet.plans.acts import MONTHS
from feuillet.plans.registry import query
from feuillet.functions.text import normalize_text
from feuillet.plans.text import NORMAL, q


def s_find(source, p):
    p = q(p)
    return f"""(SELECT doc_id, text, hit, start::INTEGER AS start, (start + length(hit))::INTEGER AS "end" FROM (SELECT doc_id, text, h[i] AS hit, list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda v: length(v))), 0) AS start
    FROM (SELECT doc_id, text, g, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, text, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS h FROM {source}))))"""


def in_list(values):
    return "(" + ", ".join(f"'{q(v)}'" for v in values) + ")"


def best(sql, keys):
    return f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY confidence DESC, start) AS rn FROM ({sql})) WHERE rn = 1"


NAMES2 = f"{E.NAME}(?: {E.NAME})+"
STD = rf"[0-9]{{1,2}} (?:{E.MONTH}) [0-9]{{4}}"
DATED = f"d0 AS (SELECT doc_id, hit AS text, regexp_extract(hit, '^([0-9]+)', 1)::INTEGER AS day, regexp_extract(hit, ' ([^ ]+) ', 1) AS m, right(hit, 4)::INTEGER AS year, start, \"end\" FROM {s_find('lines', STD)}), d1 AS (SELECT *, ({MONTHS})::INTEGER AS month FROM d0)"
DATES = f"{DATED}, dates AS ({best('''SELECT doc_id, text, day, month, year, 'standard' AS type, round(least(1.0, (year BETWEEN 1500 AND 1950)::INT * 0.5 + 0.25 + 0.25 + 0.1 + 0.2 + CASE WHEN year BETWEEN 1600 AND 1800 THEN 0.1 ELSE 0 END), 4)::DOUBLE AS confidence, true AS is_complete, CASE WHEN year < 1789 THEN 'ancien_regime' WHEN year < 1815 THEN 'revolution_empire' WHEN year < 1870 THEN 'restauration' WHEN year < 1940 THEN 'moderne' ELSE 'contemporain' END AS era, start, \"end\" FROM d1''', 'doc_id, text')})"


@query("ext0_resolve_overlaps", f"""SELECT doc_id, CASE WHEN length(hit) = 4 THEN 'four' ELSE 'any' END AS kind, start, "end", hit FROM {s_find('lines', '[0-9]+')}""")
def _(t):
    return E.mentions(t.lines, [("four", "(?<![0-9])[0-9]{4}(?![0-9])"), ("any", "[0-9]+")])


@query("ext8_extract_dates", f"WITH {DATES} SELECT * FROM dates")
def _(t):
    return E.extract_dates(t.lines)


@query("joi16_date_ranges", f"WITH {DATED.replace('FROM (SELECT doc_id, text, h[i]', 'FROM (SELECT doc_id, text, h[i]').replace('lines)', 'books)')}, ds AS (SELECT DISTINCT ON (doc_id, text) doc_id, text, year, start FROM d1 ORDER BY doc_id, text, start) SELECT DISTINCT a.doc_id, a.year AS year_a, b.year AS year_b, 0.8::DOUBLE AS confidence FROM ds a JOIN ds b ON a.doc_id = b.doc_id AND a.start <> b.start AND b.year - a.year BETWEEN 1 AND 100")
def _(t):
    return E.date_ranges(E.extract_dates(t.books))


NEAR = "substring(text, greatest(start - 49, 1), 100 + \"end\" - start)"
KIN = "|".join(E.KIN_TERMS)


def s_score(name, ctx=None):
    first, last = f"string_split({name}, ' ')[1]", f"string_split({name}, ' ')[-1]"
    s = f"CASE WHEN {first} IN {in_list(E.FIRST_NAMES)} THEN 0.4 ELSE 0.2 END::DOUBLE + CASE WHEN array_to_string(string_split({name}, ' ')[-1:], ' ') IN {in_list(E.FAMILY_NAMES)} THEN 0.3 ELSE 0.2 END + 0.2 + 0.05 + CASE WHEN regexp_matches({name}, '[à-öø-ÿÀ-ÖØ-Þ]') THEN 0.05 ELSE 0 END"
    if ctx:
        s += f" + CASE WHEN regexp_matches(lower({ctx}), '{KIN}') THEN 0.15 ELSE 0 END - CASE WHEN regexp_matches(lower({ctx}), 'rue|place|chemin|clos|champ') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches({ctx}, '[0-9]{{4}}') THEN 0.05 ELSE 0 END"
    return f"round(least(1.0, {s.replace(last, last)}), 4)"


FOUND = f"nf AS (SELECT *, {NEAR} AS ctx FROM {s_find('lines', NAMES2)}), names AS (" + best(f"""SELECT doc_id, hit AS full_name, string_split(hit, ' ')[1] AS first_names, string_split(hit, ' ')[2] AS family_name, 'full' AS source_pattern, round(greatest(0.0, least(1.0, {s_score('hit', 'ctx')}::DOUBLE + 0.05 + 0.1 + CASE WHEN regexp_matches(lower(ctx), '{KIN}') THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(lower(hit), 'ii|rn|cl|vv|nn') THEN 0.1 ELSE 0 END)), 4)::DOUBLE AS confidence, start, "end" FROM nf""", "doc_id, full_name") + ")"


@query("ext4_extract_names", f"WITH {FOUND} SELECT * FROM names")
def _(t):
    return E.extract_names(t.lines)


FALSE = "regexp_matches(w, '(?i)^(paroisse|église|chapelle|cathédrale|abbaye|clos|champ|pré|jardin|verger|familles?|rue|place|chemin|route) ') OR regexp_matches(lower(w), 'archives|registre|folio|page|acte|document|inventaire|sommaire|table|index') OR regexp_matches(w, '^[A-Z]{2,}$') OR regexp_matches(w, '(^| )[A-Za-z]{1,2}$') OR length(w) > 80 OR length(regexp_replace(w, '[^0-9]', '', 'g')) > 0.2 * length(w)"


@query("ext5_name_false_positive", f"SELECT doc_id, i::INTEGER AS pos, w AS line, {FALSE} AS false_positive FROM (SELECT doc_id, i, l[i + 1] AS w FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))")
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    return lines.withColumn("false_positive", E.name_false_positive(F.col("line")))


@query("ext6_name_confidence", f"WITH {FOUND} SELECT full_name, count(*) AS n, round(sum(confidence), 3)::DOUBLE AS confidence FROM names GROUP BY full_name")
def _(t):
    return E.extract_names(t.lines).groupBy("full_name").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 3).alias("confidence"))


N_ = lambda ts: " + ".join(f"(length(near) - length(replace(near, '{v}', ''))) // {len(v)}" for v in ts)


@query("ext7_name_context", f"WITH {FOUND}, c AS (SELECT n.doc_id, start, lower(substring(text, greatest(start - 49, 1), 100 + \"end\" - start)) AS near FROM names n JOIN lines USING (doc_id)) SELECT doc_id, start, {', '.join(f'({N_(ts)})::INTEGER AS n_{k}' for k, ts in E.CONTEXT.items())}, len(regexp_extract_all(near, '[0-9]{{4}}'))::INTEGER AS n_years FROM c")
def _(t):
    return E.name_context(t.lines)


@query("ext9_extract_professions", f"SELECT DISTINCT doc_id, hit AS profession, CASE WHEN starts_with(hit, 'sieur') THEN 'title_land' ELSE 'basic' END AS subcategory, CASE WHEN starts_with(hit, 'sieur') THEN 'title' ELSE 'secular' END AS category, CASE WHEN starts_with(hit, 'sieur') THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence, start, \"end\" FROM {s_find('lines', 'sieur de [A-Z][A-Za-z]+|laboureur')}")
def _(t):
    return E.extract_professions(t.lines)


def s_groups(p, n):
    return ", ".join(f"nullif(regexp_extract(hit, '{q(p)}', {k}), '') AS {'abc'[k - 1]}" for k in range(1, n + 1)) + "".join(f", NULL::VARCHAR AS {c}" for c in "abc"[n:])


TWO = lambda c: f"coalesce(({c} LIKE '% %')::INT, 0)"
PAT = dict(E.RELATIONS)
RELS = (
    "r0 AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, {s_groups(PAT[k], len(E.ROLES[k]))}, start, \"end\" FROM {s_find('lines', PAT[k])}" for k in PAT) + "), rels AS ("
    + best(f"SELECT *, round(least(1.0, CASE type WHEN 'filiation' THEN 0.8 + 0.1 * {TWO('a')} + 0.1 * {TWO('b')} + 0.1 * {TWO('c')} WHEN 'marriage' THEN 0.85 + 0.1 * {TWO('a')} * {TWO('b')} ELSE 0.65 + 0.2 * {TWO('a')} END), 4)::DOUBLE AS confidence FROM r0", "doc_id, type, a, b") + ")"
)


@query("ext10_extract_relations", f"WITH {RELS} SELECT * FROM rels")
def _(t):
    return E.extract_relations(t.lines)


@query("ext10_relations_of_normalized_books", f"WITH {NORMAL.replace('lines', 'books')}, cleaned AS (SELECT doc_id, normalized AS text FROM norm), {RELS.replace('lines', 'cleaned')} SELECT * FROM rels")
def _(t):
    """The way a text goes: pages with line breaks are corrected and made one line, then relations are found."""
    return E.extract_relations(normalize_text(t.books).select("doc_id", F.col("normalized").alias("text")))


HAS = lambda ts: " + ".join(f"contains(low, '{v}')::INT" for v in ts)


@query("ext11_extract_relations_context", f"""WITH {RELS}, c AS (SELECT r.*, lower(text) AS low, regexp_matches(text, '[0-9]{{4}}') AS dated FROM rels r JOIN lines USING (doc_id)), s AS (SELECT *, least(1.0::DOUBLE, 0.5::DOUBLE + 0.1 * ({HAS(('baptême', 'église', 'curé', 'paroisse', 'mariage', 'inhumation'))}) + CASE WHEN dated THEN 0.2 ELSE 0 END + 0.1 * ({HAS(('sieur', 'écuyer', 'seigneur', 'comte', 'baron', 'dame'))})) AS ctx FROM c)
  SELECT doc_id, type, a, b, round(least(1.0, CASE type WHEN 'filiation' THEN 0.75 WHEN 'marriage' THEN 0.80 ELSE 0.70 END + CASE WHEN ctx > 0.8 THEN 0.1 ELSE 0 END), 4)::DOUBLE AS confidence, array_to_string(list_filter([CASE WHEN contains(low, 'bapt') THEN 'baptism_context' END, CASE WHEN contains(low, 'mariage') THEN 'marriage_context' END, CASE WHEN regexp_matches(low, 'curé|prêtre') THEN 'clerical_context' END, CASE WHEN dated THEN 'dated_context' END], lambda v: v IS NOT NULL), ',') AS indicators FROM s""")
def _(t):
    return E.extract_relations_context(t.lines)


KNOWN = "CASE split_part(child, ' ', 1) WHEN 'Cliarles' THEN 'Charles' WHEN 'Jeau' THEN 'Jean' ELSE split_part(child, ' ', 1) END"
STRICT = f"""{RELS}, f0 AS (SELECT doc_id, a AS child, b AS father, c AS mother FROM rels WHERE type = 'filiation'), f1 AS (SELECT *, {KNOWN} IN {in_list(E.FIRST_NAMES)} AS known, len(string_split(child, ' ')) AS n, string_split(child, ' ')[-1] IN {in_list(E.FAMILY_NAMES)} AS fam FROM f0),
  f2 AS (SELECT *, 0.2::DOUBLE + CASE WHEN n BETWEEN 2 AND 4 THEN 0.2 ELSE 0 END + CASE WHEN known THEN 0.4 ELSE 0 END + CASE WHEN fam THEN 0.2 ELSE 0 END AS s FROM f1), strict AS (SELECT doc_id, child, father, mother, round(least(1.0, 0.4 + 0.2 * (n >= 2)::INT + 0.2 * known::INT + 0.1 * {TWO('father')} + 0.1 * {TWO('mother')}), 4)::DOUBLE AS confidence, round(s, 4)::DOUBLE AS score,
  CASE WHEN length(child) < 4 THEN 'trop court' WHEN regexp_matches(child, '[0-9]{{3,}}|[<>@#$%^&*()]') THEN 'motif rejeté' WHEN len(list_filter(string_split(child, ' '), lambda w: lower(w) IN {in_list(E.FORBIDDEN)})) > 0 THEN 'mot interdit' WHEN len(list_filter(string_split(child, ' '), lambda w: regexp_matches(lower(w), '^(arch|reg|par|doc|img|scan|pdf)'))) > 0 THEN 'préfixe interdit' WHEN NOT known THEN 'prénom inconnu' WHEN s < 0.5 THEN 'score insuffisant' WHEN lower(child) = lower(father) THEN 'même nom' END AS rejection_reason FROM f2)"""


@query("ext12_filiations_strict", f"WITH {STRICT} SELECT * FROM strict")
def _(t):
    return E.extract_filiations_strict(t.lines)


@query("agg10_strict_statistics", f"WITH {STRICT}, r AS (SELECT count(*) AS n, 100 * avg((rejection_reason IS NULL)::INT) AS rate FROM strict) SELECT coalesce(rejection_reason, 'validées') AS what, count(*) AS n FROM strict GROUP BY 1 UNION ALL SELECT 'examinées, qualité ' || CASE WHEN rate >= 80 THEN 'Excellente' WHEN rate >= 60 THEN 'Bonne' WHEN rate >= 40 THEN 'Moyenne' ELSE 'Faible' END, n FROM r")
def _(t):
    return E.strict_statistics(E.extract_filiations_strict(t.lines))


@query("val1_validate_name", f"SELECT person_id, {s_score('name')} > 0.3 AS is_valid, {s_score('name')}::DOUBLE AS confidence, 0 AS n_errors FROM (SELECT person_id, prenom || ' ' || nom AS name FROM persons)")
def _(t):
    return t.persons.select("person_id", E.validate_name(F.concat_ws(" ", "prenom", "nom")).alias("v")).select("person_id", "v.*")


def s_part(c):
    return f"CASE WHEN {c} IS NOT NULL THEN {s_score(c)} * 0.3 ELSE 0 END"


SCORE2 = f"({s_part('a')} + {s_part('b')} + {s_part('c')} + 0.4 - 0.3 * coalesce((lower(a) = lower(b))::INT, 0) + CASE WHEN type = 'filiation' THEN 0.2 * (c IS NOT NULL)::INT WHEN type = 'marriage' THEN 0.1 ELSE 0 END)::DOUBLE"


@query("val2_validate_relation", f"WITH {RELS} SELECT doc_id, type, a, b, {SCORE2} > 0.5 AND a IS NOT NULL AND (b IS NOT NULL OR type NOT IN ('filiation', 'marriage')) AS is_valid, round(least(1.0, {SCORE2}), 4)::DOUBLE AS confidence FROM rels")
def _(t):
    return E.validate_relation(E.extract_relations(t.lines))


SEG = f"""sg AS (SELECT doc_id, i::INTEGER AS index, trim(s[i + 1], ' ') AS text FROM (SELECT doc_id, s, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split_regex(text, '[.;]\\s+') AS s FROM books)) WHERE length(trim(s[i + 1], ' ')) > 10),
  seg AS (SELECT doc_id, index, text, length(text)::INTEGER AS length, CASE WHEN regexp_matches(lower(text), 'bapt|naissance|né') THEN 'bapteme' WHEN regexp_matches(lower(text), 'mariage|épouse|mari|époux') THEN 'mariage' WHEN regexp_matches(lower(text), 'inh|décès|mort|décédé|défunt') THEN 'deces' ELSE 'general' END AS type,
  len(list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> ''))::INTEGER AS word_count, round(least(1.0, CASE WHEN length(text) > 20 THEN 0.2 ELSE 0 END + least(len(regexp_extract_all(text, '{q(E.NAME)}')) * 0.15, 0.4) + least(len(regexp_extract_all(text, '1[5-8][0-9]{{2}}')) * 0.2, 0.3) + least(len(regexp_extract_all(text, '(?i)(fils|fille|épouse|mari|parrain|marraine)')) * 0.1, 0.2)), 4)::DOUBLE AS quality_score FROM sg)"""


@query("ext1_extract_segments", f"WITH {SEG} SELECT * FROM seg")
def _(t):
    return E.extract_segments(t.books)


@query("ext2_classify_segment", f"WITH {SEG} SELECT type, count(*) AS n FROM seg GROUP BY type")
def _(t):
    return E.extract_segments(t.books).groupBy("type").agg(F.count("*").alias("n"))


@query("agg11_segment_report", f"WITH {SEG} SELECT type, count(*) AS n, round(avg(length), 4)::DOUBLE AS avg_length, count(*) FILTER (quality_score >= 0.8) AS excellent, count(*) FILTER (quality_score >= 0.6 AND quality_score < 0.8) AS good, count(*) FILTER (quality_score >= 0.4 AND quality_score < 0.6) AS fair, count(*) FILTER (quality_score < 0.4) AS poor FROM seg GROUP BY type")
def _(t):
    s = F.col("quality_score")
    n = lambda w: F.sum(w.cast("long"))
    return E.extract_segments(t.books).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("length"), 4).alias("avg_length"), n(s >= 0.8).alias("excellent"), n((s >= 0.6) & (s < 0.8)).alias("good"), n((s >= 0.4) & (s < 0.6)).alias("fair"), n(s < 0.4).alias("poor"))


@query("ext14_extract_persons_basic", f"SELECT doc_id, hit AS full_name, count(*) AS occurrences, 0.7::DOUBLE AS confidence FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{q(NAMES2)}')) AS hit FROM books) GROUP BY ALL")
def _(t):
    return E.extract_persons_basic(t.books)


@query("val15_cross_validate", f"""WITH {RELS}, p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{q(NAMES2)}')) AS full_name FROM lines), nm AS (SELECT DISTINCT doc_id, unnest([a, b, c]) AS full_name FROM rels),
  r AS (SELECT p.doc_id, round(100 * count(nm.full_name) / count(*), 2)::DOUBLE AS rate FROM p LEFT JOIN nm USING (doc_id, full_name) GROUP BY p.doc_id), m AS (SELECT doc_id, round(avg(confidence), 4)::DOUBLE AS mean_confidence FROM rels GROUP BY doc_id) SELECT doc_id, rate, mean_confidence, CASE WHEN rate >= 80 THEN 'Excellente' WHEN rate >= 60 THEN 'Bonne' WHEN rate >= 40 THEN 'Moyenne' ELSE 'Faible' END AS grade FROM r LEFT JOIN m USING (doc_id)""")
def _(t):
    return E.cross_validate(E.extract_relations(t.lines), E.extract_persons_basic(t.lines))


@query("val14_min_confidence", f"WITH {FOUND} SELECT doc_id, full_name FROM names WHERE confidence >= 0.95")
def _(t):
    return E.min_confidence(E.extract_names(t.lines), 0.95).select("doc_id", "full_name")


def s_period(src):
    low = "lower(coalesce(text, ''))"
    parts = []
    for k, (name, (voc, dates, phrases, lo, hi)) in enumerate(E.PERIODS.items()):
        s = " + ".join([*(f"2 * ((length({low}) - length(replace({low}, '{q(w)}', ''))) // {len(w)})" for w in voc), *(f"3 * len(regexp_extract_all(coalesce(text, ''), '(?i){q(p)}'))" for p in dates), *(f"CASE WHEN contains({low}, '{q(p)}') THEN 5 ELSE 0 END" for p in phrases)])
        parts.append(f"{{'s': (-({s}))::INTEGER, 'k': {k}, 'period': '{name}', 'most': {2 * len(voc) + 30}, 'lo': {lo}, 'hi': {hi}}}")
    return f"per AS (SELECT doc_id, list_min([{', '.join(parts)}]) AS x FROM {src})"


PER = "SELECT doc_id, x.period, CASE WHEN x.s = 0 THEN 0.3 ELSE round(least(1.0::DOUBLE, -x.s / x.most), 4) END::DOUBLE AS confidence, x.lo::INTEGER AS year_lo, x.hi::INTEGER AS year_hi FROM per"


@query("ext17_detect_period", f"WITH {s_period('documents')} {PER}")
def _(t):
    return E.detect_period(t.documents)


@query("ext18_period_features", "WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents) SELECT doc_id, 'acte' AS feature, unnest(regexp_extract_all(x, '(?i)acte n°? ?([0-9]+)', 1)) AS value FROM t UNION ALL SELECT doc_id, 'insee', v FROM (SELECT doc_id, unnest(list_filter(string_split_regex(x, '[^0-9]+'), lambda w: length(w) = 5)) AS v FROM t) UNION ALL SELECT doc_id, 'republicain', unnest(regexp_extract_all(lower(x), '(citoyenn?e?|commune)', 1)) FROM t")
def _(t):
    return E.period_features(t.documents)


COUNTS = f"counts AS (SELECT doc_id, 'names' AS kind, count(*) AS n FROM names GROUP BY 1 UNION ALL SELECT doc_id, 'dates', count(*) FROM dates GROUP BY 1 UNION ALL SELECT doc_id, 'relations', count(*) FROM rels GROUP BY 1)"


@query("ext19_parse_by_period", f"WITH {FOUND}, {DATES}, {RELS}, {COUNTS}, {s_period('lines')} SELECT doc_id, x.period, kind, n FROM counts JOIN per USING (doc_id) WHERE NOT (x.period = 'revolution' AND kind = 'relations')")
def _(t):
    return E.parse_by_period(t.lines)


@query("ext21_combine_extractors", f"WITH {FOUND}, {DATES}, {RELS}, {COUNTS}, k AS (SELECT doc_id, unnest(['names', 'dates', 'relations']) AS kind FROM lines) SELECT doc_id, kind, coalesce(n, 0) AS n, coalesce(n, 0) > 0 AS success FROM k LEFT JOIN counts USING (doc_id, kind)")
def _(t):
    return E.combine_extractors(t.lines, ("names", "dates", "relations"))


@query("win1_dedup_best", f"WITH {FOUND} SELECT full_name, first(doc_id ORDER BY confidence DESC, doc_id) AS doc_id, max(confidence) AS confidence FROM names GROUP BY full_name")
def _(t):
    return E.dedup_best(E.extract_names(t.lines), ["full_name"], then="doc_id").select("full_name", "doc_id", "confidence")


BAND = lambda hi, mid: f"count(*) FILTER (confidence >= {hi}) AS high, count(*) FILTER (confidence >= {mid} AND confidence < {hi}) AS good"


def bands(df, by, hi, mid):
    c = F.col("confidence")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum((c >= hi).cast("long")).alias("high"), F.sum(((c >= mid) & (c < hi)).cast("long")).alias("good"), F.round(F.avg(c), 4).alias("mean"))


@query("agg6_name_statistics", f"WITH {FOUND} SELECT source_pattern, count(*) AS n, {BAND(0.85, 0.7)}, round(avg(confidence), 4)::DOUBLE AS mean FROM names GROUP BY 1")
def _(t):
    return bands(E.extract_names(t.lines), ["source_pattern"], 0.85, 0.7)


@query("agg7_date_statistics", f"WITH {DATES} SELECT type, era, count(*) AS n, round(avg(confidence), 4)::DOUBLE AS mean, min(year) AS first_year, max(year) AS last_year FROM dates GROUP BY GROUPING SETS ((type), (era))")
def _(t):
    d = E.extract_dates(t.lines)
    return d.groupingSets([[F.col("type")], [F.col("era")]], F.col("type"), F.col("era")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("agg8_profession_statistics", f"WITH p AS (SELECT DISTINCT doc_id, CASE WHEN starts_with(hit, 'sieur') THEN 'title' ELSE 'secular' END AS category, CASE WHEN starts_with(hit, 'sieur') THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence FROM {s_find('lines', 'sieur de [A-Z][A-Za-z]+|laboureur')}) SELECT category, count(*) AS n, {BAND(0.8, 0.6)}, round(avg(confidence), 4)::DOUBLE AS mean FROM p GROUP BY 1")
def _(t):
    return bands(E.extract_professions(t.lines), ["category"], 0.8, 0.6)


@query("agg9_relation_statistics", f"WITH {RELS} SELECT type, count(*) AS n, {BAND(0.8, 0.6)}, round(avg(confidence), 4)::DOUBLE AS mean FROM rels GROUP BY 1")
def _(t):
    return bands(E.extract_relations(t.lines), ["type"], 0.8, 0.6)


@query("agg12_name_report", f"WITH {FOUND} SELECT count(*) AS total, count(*) FILTER (regexp_matches(full_name, 'Jeau|Cliarles')) AS misread, count(*) FILTER (confidence > 0.8) AS high, round(avg(confidence), 4)::DOUBLE AS mean FROM names")
def _(t):
    n = E.extract_names(t.lines)
    return n.agg(F.count("*").alias("total"), F.sum(F.col("full_name").rlike("Jeau|Cliarles").cast("long")).alias("misread"), F.sum((F.col("confidence") > 0.8).cast("long")).alias("high"), F.round(F.avg("confidence"), 4).alias("mean"))


_OUT = f"{FOUND}, {DATES}, {RELS}, {COUNTS}, oc AS (SELECT doc_id, length(text) AS len, coalesce(max(n) FILTER (kind = 'names'), 0) AS names, coalesce(max(n) FILTER (kind = 'dates'), 0) AS dates, coalesce(max(n) FILTER (kind = 'relations'), 0) AS relations FROM lines LEFT JOIN counts USING (doc_id) GROUP BY ALL), outcome AS (SELECT doc_id, names, dates, relations, round(((len > 0)::INT + (names > 0)::INT + (dates > 0)::INT + (relations > 0)::INT) / 4, 4)::DOUBLE AS success_rate, array_to_string(list_filter([CASE WHEN names = 0 THEN 'aucun nom' END, CASE WHEN dates = 0 THEN 'aucune date' END, CASE WHEN relations = 0 THEN 'aucune relation' END], lambda v: v IS NOT NULL), ';') AS issues FROM oc)"


def outcome(t):
    from feuillet.operators.reports import document_outcome

    return document_outcome(t.lines, E.combine_extractors(t.lines, ("names", "dates", "relations")))


@query("agg13_document_outcome", f"WITH {_OUT} SELECT * FROM outcome")
def _(t):
    return outcome(t)


@query("agg14_processing_rollup", f"WITH {_OUT} SELECT type_acte, lieu, count(*) AS documents, sum(names)::BIGINT AS names, round(avg(success_rate), 4)::DOUBLE AS success_rate FROM outcome JOIN actes ON acte_id = doc_id GROUP BY ROLLUP (type_acte, lieu)")
def _(t):
    from feuillet.operators.reports import processing_rollup

    return processing_rollup(outcome(t).join(t.actes.select(F.col("acte_id").alias("doc_id"), "type_acte", "lieu"), "doc_id"), "type_acte", "lieu")


for _name, _f, _sql in (
    ("dat1_extract_year", lambda c: D.extract_year(c, 1646, 1900), "CASE WHEN try_cast(nullif(regexp_extract(date, '([0-9]{4})', 1), '') AS INTEGER) BETWEEN 1646 AND 1900 THEN try_cast(nullif(regexp_extract(date, '([0-9]{4})', 1), '') AS INTEGER) END"),
    ("dat6_date_era", lambda c: D.date_era(D.extract_year(c, None)), "CASE WHEN regexp_extract(date, '([0-9]{4})', 1) = '' OR date IS NULL THEN 'inconnue' ELSE 'ancien_regime' END"),
    ("dat10_gedcom_date", D.gedcom_date, f"concat_ws(' ', nullif(regexp_extract(date, '^([0-9]+)', 1), ''), {str(list(D.GEDCOM))}[{MONTHS.replace('CASE m', "CASE regexp_extract(date, '[0-9]+ ([^ 0-9]+)', 1)")}], nullif(regexp_extract(date, '([0-9]{{4}})', 1), ''))"),
):

    @query(_name, f"SELECT acte_id, {_sql} AS out FROM actes")
    def _(t, f=_f):
        return t.actes.select("acte_id", f(F.col("date")).alias("out"))


@query("dat2_parse_french_date", f"WITH x AS (SELECT acte_id, date, regexp_extract(date, '[0-9]+ ([^ ]+) [0-9]{{4}}', 1) AS m FROM actes) SELECT acte_id, try_cast(regexp_extract(date, '([0-9]{{4}})', 1) || '-' || lpad(({MONTHS})::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(date, '^([0-9]+)', 1), 2, '0') AS DATE)::VARCHAR AS out FROM x")
def _(t):
    return t.actes.select("acte_id", D.parse_french_date("date").cast("string").alias("out"))


@query("dat3_parse_republican_date", f"SELECT acte_id, (acte_id % 30 + 1)::INTEGER AS day, (acte_id % 12 + 1)::INTEGER AS month, (1793 + acte_id % 12)::INTEGER AS year FROM actes")
def _(t):
    k = F.col("acte_id")
    rom = F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"))), (k % 12 + 1).cast("int"))
    text = F.concat(k % 30 + 1, F.lit(" "), F.element_at(F.array(*map(F.lit, D.REPUBLICAN)), (k % 12 + 1).cast("int")), F.lit(" l'an "), rom)
    return t.actes.select("acte_id", D.parse_republican_date(text).alias("d")).select("acte_id", "d.*")


@query("dat4_validate_date", "WITH x AS (SELECT acte_id, (1400 + acte_id % 700) AS y, (acte_id % 14) AS m, (acte_id % 33) AS d FROM actes) SELECT acte_id, ((y BETWEEN 1500 AND 1950)::INT * 0.5 + (m BETWEEN 1 AND 12)::INT * 0.25 + (d BETWEEN 1 AND 31)::INT * 0.25)::DOUBLE AS score, ((m IN (4, 6, 9, 11) AND d > 30)::INT + (m = 2 AND d > 29)::INT + (m = 2 AND d = 29 AND NOT (y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0)))::INT)::INTEGER AS warnings FROM x")
def _(t):
    k = F.col("acte_id")
    v = D.validate_date(1400 + k % 700, k % 14, k % 33)
    return t.actes.select("acte_id", v["score"].alias("score"), F.size(v["warnings"]).alias("warnings"))


@query("dat5_date_confidence", f"WITH {DATES} SELECT type, confidence, count(*) AS n FROM dates GROUP BY ALL")
def _(t):
    return E.extract_dates(t.lines).groupBy("type", "confidence").agg(F.count("*").alias("n"))


@query("dat7_age_and_ranges", "SELECT person_id, deces - naissance AS age, coalesce(naissance <= deces, true) AS coherent, CASE WHEN deces = naissance THEN naissance::VARCHAR ELSE naissance || '-' || coalesce(deces::VARCHAR, '?') END AS range FROM persons")
def _(t):
    a, b = F.col("naissance").cast("string"), F.col("deces").cast("string")
    return t.persons.select("person_id", D.age_at(a, b).alias("age"), D.is_coherent(a, b).alias("coherent"), D.format_date_range(a, b).alias("range"))


@query("dat8_infer_birth_year", "WITH e AS (SELECT person_id, mariage - 40 AS lo, mariage - 16 AS hi FROM persons WHERE mariage IS NOT NULL UNION ALL SELECT person_id, deces - 80, deces - 30 FROM persons WHERE deces IS NOT NULL UNION ALL SELECT pere_id, min(naissance) - 45, min(naissance) - 18 FROM persons WHERE pere_id IS NOT NULL GROUP BY pere_id) SELECT person_id, ((max(lo) + min(hi)) // 2)::INTEGER AS birth_year FROM e GROUP BY person_id")
def _(t):
    wed = t.persons.where("mariage is not null").select("person_id", F.lit("mariage").alias("event_type"), F.col("mariage").alias("year"))
    dead = t.persons.where("deces is not null").select("person_id", F.lit("deces").alias("event_type"), F.col("deces").alias("year"))
    first = t.persons.where("pere_id is not null").groupBy(F.col("pere_id").alias("person_id")).agg(F.lit("premier_enfant").alias("event_type"), F.min("naissance").alias("year"))
    return D.infer_birth_year(wed.unionByName(dead).unionByName(first))


@query("dat9_birth_from_age", "SELECT person_id, (deces - 40) || '-06-15' AS born, (naissance - 1) || '-05-01' AS wed FROM persons WHERE deces IS NOT NULL")
def _(t):
    day = lambda c: F.make_date(F.col(c), F.lit(3), F.lit(1))
    return t.persons.where("deces is not null").select("person_id", D.birth_from_age(day("deces"), F.lit(40)).cast("string").alias("born"), D.estimate_marriage_date(day("naissance")).cast("string").alias("wed"))


@query("dat11_source_reference", "SELECT person_id, lieu_naissance || ', BMS 1643-1687, p.' || (person_id % 50) AS reference, lieu_naissance AS archive, 'BMS' AS collection, '1643-1687' AS years, (person_id % 50)::INTEGER AS page FROM persons")
def _(t):
    ref = D.source_reference(F.col("lieu_naissance"), F.lit("BMS"), F.lit("1643-1687"), (F.col("person_id") % 50).cast("string"))
    return t.persons.select("person_id", ref.alias("reference"), D.parse_source_reference(ref).alias("x")).select("person_id", "reference", "x.*")
