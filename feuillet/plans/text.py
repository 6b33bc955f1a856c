"""Queries over text normalisation, with their SQL (RE2 has no look-around: a rule for whole words is applied twice there)."""

from pyspark.sql import functions as F

from feuillet.functions import text as X
from feuillet.plans.registry import query

W, L = X.WORD, X.LETTER
q = lambda s: s.replace("'", "''")


def s_sub(x, *rules):
    for a, b in rules:
        b = q(b).replace("$", "\\")
        x = f"regexp_replace({x}, '{q(a)}', '{b}', 'g')"
    return x


def s_alone(x, a, b):
    return s_sub(x, *[(f"(^|[^{W}]){a}($|[^{W}])", f"$1{b}$2")] * 2)


def s_literal(x, pairs):
    for a, b in pairs.items():
        x = f"replace({x}, '{q(a)}', '{q(b)}')"
    return x


def s_squeeze(x):
    return f"trim(regexp_replace({x}, '[\\x20\\t\\n\\r\\f\\x0b]+', ' ', 'g'))"


def s_words(x):
    return f"list_filter(string_split({s_squeeze(x)}, ' '), lambda w: w <> '')"


def s_map(pairs):
    return "MAP {" + ", ".join(f"'{q(a)}': '{q(b)}'" for a, b in pairs.items()) + "}"


T = "coalesce(text, '')"


def s_tidy(x):
    return s_sub(s_squeeze(x), ("\\x20+([,.;:])", "$1"), ("([,.;:])\\x20*([A-ZÀ-ÖØ-Þ])", "$1 $2"), ("[“”„‚‘’]", '"'), ("[–—―]", "-"))


def s_ocr(x, added=None):
    x = s_sub(s_literal(s_literal(x, X.LIGATURES), (added or {}) | X.CORRECTIONS), *[(f"(?i){a}", b) for a, b in X.PHRASES.items()])
    for a, b in X.MISREAD.items():
        x = s_alone(x, a, b)
    return f"trim({s_tidy(s_sub(x, ('[ \\t\\n\\r\\f]+([,.;:])', '$1')))})"


def text_query(name, f, sql, source="documents"):
    """A column function over whole texts."""

    @query(name, f"SELECT doc_id, {sql} AS out FROM {source}")
    def _(t):
        return getattr(t, source).select("doc_id", f(F.coalesce("text", F.lit(""))).alias("out"))


text_query("txt1_clean_text", X.clean_text, s_sub(s_squeeze(s_sub(T, (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{84}\x{86}-\x{9f}]", ""))), ("[“”‘’`]", '"'), ("…", "...")))
text_query("txt2_clean_page_text", X.clean_page_text, s_squeeze(f"replace(translate({T}, ' “”‘’–—' || chr(65279), ' \"\"''''--'), '…', '...')"))
text_query("txt3_clean_ocr_text", X.clean_ocr_text, s_squeeze(s_sub(s_literal(s_alone(s_alone(T, "[l1]", "I"), "0", "O"), X.LIGATURES), ("([a-zà-öø-ÿ])([A-ZÀ-ÖØ-Þ])", "$1 $2"), (f"([.,;:])([{L}])", "$1 $2"))))
text_query("txt4_remove_accents", X.remove_accents, f"translate({T}, '{X.ACCENTS[0]}', '{X.ACCENTS[1]}')")
text_query("txt5_comparison_key", X.comparison_key, s_sub(f"translate(lower({T}), '{X.ACCENTS[0]}', '{X.ACCENTS[1]}')", ("[^0-9A-Za-z_]", "")))
text_query("txt6_ocr_correct_text", X.ocr_correct_text, s_ocr(T), "lines")
text_query("txt11_normalize_punctuation", X.normalize_punctuation, "trim(" + s_sub(s_squeeze(T), (f"([.,;:])([{L}])", "$1 $2"), ("\\x20+([.,;:])", "$1"), ("[,;.]{2,}", ","), (f"([{W}])\\x20*-\\x20*([{W}])", "$1-$2")) + ")")
BARE = f"lower(regexp_replace(w, '[^{W}]', '', 'g'))"
DROP = lambda x: f"array_to_string(list_filter({s_words(x)}, lambda w: {BARE} NOT IN ({', '.join(repr(p) for p in X.PARASITES)}) AND length({BARE}) > 1 AND regexp_matches(w, '[{L}]')), ' ')"
text_query("txt12_drop_parasitic_tokens", X.drop_parasitic_tokens, DROP(T))
text_query("txt17_normalize_particles", X.normalize_particles, s_sub(T, *[(rf"(?i)(^|[^{W}]){p}\s+", f"$1{p} ") for p in ("de", "du", "des", "Le", "La") for _ in (0, 1)]), "lines")
text_query("txt22_extract_words", lambda c: F.array_join(F.array_sort(X.extract_words(c)), " "), f"array_to_string(list_sort(list_distinct(list_filter(string_split_regex({T}, '[^{W}]+'), lambda w: regexp_full_match(w, '[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+') AND length(w) >= 3))), ' ')")
BAREDOT = f"lower(regexp_replace(w, '[^{W}.]', '', 'g'))"
ABBR = s_map(X.ABBREVIATIONS)
EXPAND = lambda x: f"array_to_string(list_transform({s_words(x)}, lambda w: coalesce(replace(w, {BAREDOT}, {ABBR}[{BAREDOT}]), w)), ' ')"
CHANGES = lambda x: f"len(list_filter({s_words(x)}, lambda w: {ABBR}[{BAREDOT}] IS NOT NULL))"


@query("txt10_expand_abbreviations", f"SELECT doc_id, {EXPAND(T)} AS text, {CHANGES(T)}::INTEGER AS n FROM lines")
def _(t):
    e = X.expand_abbreviations(F.coalesce("text", F.lit("")))
    return t.lines.select("doc_id", e["text"].alias("text"), F.size(e["changes"]).alias("n"))


GIVEN, FAMILY = s_map(X.GIVEN), s_map(X.FAMILY)


@query("txt7_ocr_correct_name", f"""WITH n AS (SELECT person_id, {s_ocr("prenom || ' ' || nom[:2]")} AS name FROM persons), p AS (SELECT *, regexp_extract(name, '^(\\S+) (\\S+)$', 1) AS a, regexp_extract(name, '^(\\S+) (\\S+)$', 2) AS b FROM n)
  SELECT person_id, CASE WHEN regexp_full_match(name, '[A-Z][a-zà-ÿ]+ [A-Z][a-z]{{1,2}}') AND {FAMILY}[b] IS NOT NULL THEN a || ' ' || {FAMILY}[b] ELSE name END AS name FROM p""")
def _(t):
    return t.persons.select("person_id", X.ocr_correct_name(F.concat("prenom", F.lit(" "), F.substring("nom", 1, 2))).alias("name"))


PUNCT = lambda x: "trim(" + s_sub(s_squeeze(x), (f"([.,;:])([{L}])", "$1 $2"), ("\\x20+([.,;:])", "$1"), ("[,;.]{2,}", ","), (f"([{W}])\\x20*-\\x20*([{W}])", "$1-$2")) + ")"
NORMAL = f"n0 AS (SELECT *, {s_ocr(T)} AS c FROM lines), n1 AS (SELECT *, {EXPAND('c')} AS e, {CHANGES('c')} AS ch FROM n0), n2 AS (SELECT *, {PUNCT('e')} AS p FROM n1), norm AS (SELECT doc_id, {DROP('p')} AS normalized, ch::INTEGER AS abbreviations_expanded, length({T})::INTEGER AS original_length FROM n2)"


@query("txt13_normalize_text", f"WITH {NORMAL} SELECT *, length(normalized)::INTEGER AS final_length, round(length(normalized) / greatest(original_length, 1), 4)::DOUBLE AS compression_ratio FROM norm")
def _(t):
    return X.normalize_text(t.lines).drop("text")


RULES = "w"
for a_, b_ in X.MISREAD.items():
    RULES = s_alone(RULES, a_, b_)
RULES = s_sub(RULES, ("([,.;:])([A-Z])", "$1 $2"))


@query("txt8_ocr_suggest", f"""WITH w AS (SELECT doc_id, i, ws[i + 1] AS w FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM (SELECT doc_id, {s_words(T)} AS ws FROM lines))),
  s AS (SELECT *, {s_map(X.CORRECTIONS)}[w] AS k, {RULES} AS r FROM w WHERE regexp_matches(w, '[il1]{{2,}}|rn[a-z]|cl[aeiou]|[A-Z]{{3,}}|[0-9]')), c AS (SELECT *, coalesce(k, r) AS suggested FROM s)
  SELECT doc_id, i::INTEGER AS pos, w AS word, suggested, round(CASE WHEN k IS NOT NULL THEN 0.95 ELSE least(0.9::DOUBLE, greatest(0.3::DOUBLE, 1 - levenshtein(w, suggested) / greatest(length(w), length(suggested)))) END, 4)::DOUBLE AS confidence FROM c WHERE suggested <> w""")
def _(t):
    return X.ocr_suggest(t.lines)


@query("txt9_ocr_preprocess", f"""WITH a AS (SELECT doc_id, {T} AS text, {s_words(s_ocr(T))} AS ws FROM lines), b AS (SELECT *, list_filter(ws, lambda w: length(w) BETWEEN 2 AND 30 AND length(regexp_replace(w, '[^0-9]', '', 'g')) <= 0.2 * length(w)) AS kept FROM a), c AS (SELECT *, array_to_string(kept, ' ') AS corrected FROM b)
  SELECT doc_id, corrected, (len(ws) - len(kept))::INTEGER AS rejected_words, round(0.5 + 0.2 * (len(kept) / greatest(len(ws), 1)) + CASE WHEN len(kept) > 10 THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(corrected, '[.;]') THEN 0.1 ELSE 0 END, 4)::DOUBLE AS quality_score, round(length(corrected) / greatest(length(text), 1), 4)::DOUBLE AS compression_ratio FROM c""")
def _(t):
    return X.ocr_preprocess(t.lines, "strict").drop("text")


@query("txt19_text_stats", f"WITH w AS (SELECT doc_id, {T} AS x, {s_words(T)} AS ws, string_split({T}, chr(10)) AS ls FROM documents) SELECT doc_id, length(x)::INTEGER AS length, len(ls)::INTEGER AS lines, len(ws)::INTEGER AS words, len(list_distinct(list_transform(ws, lambda v: lower(v))))::INTEGER AS unique_words, round(coalesce(list_sum(list_transform(ls, lambda v: length(v))), 0) / len(ls), 4)::DOUBLE AS avg_line_length FROM w")
def _(t):
    return X.text_stats(t.documents)


N = lambda p: f"len(regexp_extract_all(x, '{p}'))"
INDICATORS = ("[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+", "(1[5-9][0-9][0-9])", "(?i)(fils|fille|parrain|marraine)", "(?i)(bapt|mariage|inhum)", "(?i)(sieur|seigneur|dame)")


@query("txt18_text_quality", f"""WITH t AS (SELECT doc_id, {T} AS x FROM documents), s AS (SELECT doc_id, {N("[0-9][A-Za-z]|[|]")} AS e, (CASE WHEN length(x) BETWEEN 50 AND 10000 THEN 0.2 ELSE 0.1 END)::DOUBLE + {" + ".join(f"least({N(p)} * 0.1, 0.3)::DOUBLE" for p in INDICATORS)}
  + CASE WHEN len(list_distinct(string_split(x, ''))) > 20 THEN 0.2 ELSE 0 END + CASE WHEN {N("[.!?]")} > 0 THEN 0.1 ELSE 0 END - least({N("[0-9][A-Za-z]|[|]")} * 0.05, 0.3)::DOUBLE AS s FROM t)
  SELECT doc_id, round(least(1.0, greatest(0.0, s)), 4)::DOUBLE AS score, s > 0.3 AS is_valid, e::INTEGER AS ocr_errors FROM s""")
def _(t):
    return X.text_quality(t.documents)


KEY = "[" + ", ".join(f"'{k}'" for k in X.KEYWORDS) + "]"


@query("ext20_keyword_counts", f"WITH k AS (SELECT doc_id, unnest({KEY}) AS keyword, lower({T}) AS x FROM lines), c AS (SELECT doc_id, keyword, ((length(x) - length(replace(x, keyword, ''))) // length(keyword))::INTEGER AS n FROM k) SELECT * FROM c WHERE n > 0")
def _(t):
    return X.keyword_counts(t.lines)


@query("txt20_diagnose_document", f"""WITH t AS (SELECT doc_id, {T} AS x FROM documents), r AS (SELECT doc_id, len(regexp_extract_all(lower(x), 'a^')) AS z, list_sum(list_transform({KEY}, lambda k: (length(lower(x)) - length(replace(lower(x), k, ''))) // length(k))) < 10 AS few,
  {N(f"[^{W}" + chr(92) + "s.,;:!?''" + '"' + "()-]")} > 0.01 * length(x) AS odd, {N("[a-zà-öø-ÿ][A-ZÀ-ÖØ-Þ]")} > 20 AS glued, length(x) > 5000 AND length(x) - length(replace(x, chr(10), '')) < 10 AS loose FROM t)
  SELECT doc_id, array_to_string(list_filter([CASE WHEN few THEN 'peu de mots-clés' END, CASE WHEN odd THEN 'caractères inhabituels' END, CASE WHEN glued THEN 'mots collés' END, CASE WHEN loose THEN 'texte sans structure' END], lambda v: v IS NOT NULL), ';') AS issues,
  array_to_string(list_filter([CASE WHEN few THEN 'vérifier le type de document' END, CASE WHEN odd THEN 'nettoyer l''OCR' END, CASE WHEN glued THEN 'séparer les mots' END, CASE WHEN loose THEN 'découper le texte' END], lambda v: v IS NOT NULL), ';') AS recommendations FROM r""")
def _(t):
    return X.diagnose_document(t.documents)


LINES = "ls AS (SELECT doc_id, i::INTEGER AS line_no, l[i + 1] AS line FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM books)))"
NEXT = "OVER (PARTITION BY doc_id ORDER BY line_no)"


@query("win4_line_context", f"WITH {LINES} SELECT doc_id, line_no, lag(line) {NEXT} AS before, line, lead(line) {NEXT} AS after FROM ls")
def _(t):
    return X.line_context(X.lines_of(t.books))


@query("win6_sample_cutoff", f"WITH {LINES}, s AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM ls) SELECT doc_id, line_no, line FROM s WHERE had < 500")
def _(t):
    return X.sample_cutoff(X.lines_of(t.books), 500)


@query("txt21_relation_sample", f"""WITH {LINES}, h AS (SELECT *, regexp_matches(lower(line), '{"|".join(X.KEYWORDS)}') AS hit FROM ls), n AS (SELECT *, hit OR coalesce(lag(hit) {NEXT}, false) OR coalesce(lead(hit) {NEXT}, false) AS near FROM h),
  s AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM n WHERE near) SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS sample FROM s WHERE had < 800 GROUP BY doc_id""")
def _(t):
    return X.relation_sample(t.books, 800)
