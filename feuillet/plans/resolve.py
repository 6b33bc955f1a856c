"""Queries over names, resolution and sex, with their SQL."""

from functools import reduce

from pyspark.sql import functions as F

from feuillet.functions import names as N
from feuillet.operators.config import Config, registry_checks
from feuillet.operators import resolve as R
from feuillet.operators.matching import meet, string_ratio
from feuillet.operators.acts import acte_participants
from feuillet.plans.family import CHRONOLOGY
from feuillet.plans.acts import PARTS
from feuillet.plans.registry import query
from feuillet.plans.text import s_map, s_squeeze, s_words
from feuillet.functions.text import ACCENTS

NAME = "(prenom || ' ' || nom)"
FOLD = f"lower({s_squeeze(NAME)})"
PARTICLES = "(" + ", ".join(f"'{p}'" for p in N.PARTICLES) + ")"
READ = s_map(N.NAME_CORRECTIONS)
SPELLED = s_map({v.lower(): k for k, vs in N.VARIANTS.items() for v in vs})
TITLES = s_map(N.TITLES)
SUFFIX = "|".join(N.SUFFIXES)
#: names as a register may have them: titles, particles, misreadings, suffixes
RAW = "raw AS (SELECT person_id, CASE WHEN person_id % 5 = 0 THEN 'sieur ' ELSE '' END || CASE WHEN person_id % 7 = 0 THEN replace(prenom, 'Jean', 'Jehan') WHEN person_id % 11 = 0 THEN 'Cliarles' ELSE prenom END || CASE WHEN person_id % 3 = 0 THEN ' De ' ELSE ' ' END || upper(nom) || CASE WHEN person_id % 4 = 0 THEN ', curé de Caen' ELSE '' END AS name FROM persons)"
NORM = rf"""{RAW}, r1 AS (SELECT *, {s_words('name')} AS ws FROM raw), r2 AS (SELECT *, list_transform(ws, lambda w: coalesce({READ}[w], w)) AS rd, len(list_filter(ws, lambda w: {READ}[w] IS NOT NULL)) AS n_ocr FROM r1),
  r3 AS (SELECT *, {TITLES}[lower(rd[1])] AS title FROM r2), r4 AS (SELECT *, regexp_replace(regexp_replace(array_to_string(CASE WHEN title IS NOT NULL AND len(rd) > 1 THEN rd[2:] ELSE rd END, ' '), '(?i),\s*({SUFFIX}).*$', ''), '[,;.]+$', '') AS t FROM r3),
  r5 AS (SELECT *, {s_words('t')} AS w2 FROM r4), norm AS (SELECT person_id, name AS raw_name, array_to_string(list_transform(w2, lambda w, i: CASE WHEN lower(w) IN {PARTICLES} AND i > 1 THEN lower(w) ELSE upper(coalesce({SPELLED}[lower(w)], w)[1]) || lower(coalesce({SPELLED}[lower(w)], w)[2:]) END), ' ') AS name,
  n_ocr::INTEGER AS ocr_corrections, len(list_filter(w2, lambda w: {SPELLED}[lower(w)] IS NOT NULL))::INTEGER AS variants, title, array_to_string(list_transform(list_filter(w2, lambda w: lower(w) IN {PARTICLES}), lambda w: lower(w)), ' ') AS particles FROM r5)"""


def raw(t):
    k = F.col("person_id")
    first = F.when(k % 7 == 0, F.replace("prenom", F.lit("Jean"), F.lit("Jehan"))).when(k % 11 == 0, "Cliarles").otherwise(F.col("prenom"))
    return t.persons.select("person_id", "sexe", F.concat(F.when(k % 5 == 0, "sieur ").otherwise(""), first, F.when(k % 3 == 0, " De ").otherwise(" "), F.upper("nom"), F.when(k % 4 == 0, ", curé de Caen").otherwise("")).alias("name"))


@query("nam1_normalize_person_name", f"WITH {NORM} SELECT person_id, name, ocr_corrections, variants, title, particles FROM norm")
def _(t):
    return raw(t).select("person_id", N.normalize_person_name("name").alias("x")).select("person_id", "x.*")


@query("nam2_normalization_confidence", f"WITH {NORM} SELECT person_id, round(greatest(0.3::DOUBLE, least(1.0::DOUBLE, 1.05::DOUBLE - least(abs(length(name) - length(raw_name)) / greatest(length(raw_name), 1) * 0.15, 0.25::DOUBLE) + least(ocr_corrections * 0.05, 0.15)::DOUBLE + least(variants * 0.03, 0.10)::DOUBLE - CASE WHEN ocr_corrections + variants > 5 THEN 0.15 ELSE 0 END)), 4)::DOUBLE AS confidence FROM norm")
def _(t):
    return raw(t).select("person_id", F.round(N.normalization_confidence("name", N.normalize_person_name("name")), 4).alias("confidence"))


OWN = f"list_filter({s_words('name')}, lambda w: lower(w) NOT IN {PARTICLES})"


@query("nam3_split_name_registry", f"WITH {RAW}, o AS (SELECT *, {OWN} AS o FROM raw) SELECT person_id, array_to_string(o[:-2], ' ') AS first_names, o[-1] AS family_name, array_to_string(list_transform(list_filter({s_words('name')}, lambda w: lower(w) IN {PARTICLES}), lambda w: lower(w)), ' ') AS particle FROM o")
def _(t):
    return raw(t).select("person_id", N.split_name_registry("name").alias("x")).select("person_id", "x.*")


@query("nam4_split_name_mention", f"WITH {RAW}, o AS (SELECT *, {s_words('name')} AS ws FROM raw), p AS (SELECT *, list_position(list_transform(ws, lambda w: lower(w) IN {PARTICLES}), true) AS k FROM o), c AS (SELECT *, CASE WHEN k > 1 THEN k ELSE len(ws) END AS cut FROM p) SELECT person_id, array_to_string(ws[:cut - 1], ' ') AS first_names, array_to_string(ws[cut:], ' ') AS family_name FROM c")
def _(t):
    return raw(t).select("person_id", N.split_name_mention("name").alias("x")).select("person_id", "x.*")


@query("nam5_split_fullname", f"WITH {RAW}, o AS (SELECT *, {s_words('name')} AS ws FROM raw), p AS (SELECT *, list_position(list_transform(ws, lambda w: regexp_matches(w, '^[A-ZÀ-ÖØ-Þ]')), false) AS stop FROM o) SELECT person_id, ws[1] AS prenom, array_to_string(ws[2:], ' ') AS nom, array_to_string(CASE WHEN stop > 0 THEN ws[:stop - 1] ELSE ws END, ' ') AS capitalised FROM p")
def _(t):
    return raw(t).select("person_id", N.split_fullname("name").alias("x"), F.array_join(N.parse_prenoms("name"), " ").alias("capitalised")).select("person_id", "x.*", "capitalised")


MALE, FEMALE = ("(" + ", ".join(f"'{p}'" for p in v) + ")" for v in (N.MALE, N.FEMALE))


@query("nam6_gender_from_prenom", f"SELECT person_id, CASE WHEN lower(prenom) IN {MALE} THEN 'M' WHEN lower(prenom) IN {FEMALE} THEN 'F' ELSE '?' END AS gender FROM persons")
def _(t):
    return t.persons.select("person_id", N.infer_gender_from_prenom(F.array("prenom")).alias("gender"))


@query("nam7_gender_from_ending", "SELECT person_id, CASE WHEN regexp_matches(lower(prenom), '(ette|elle|oise|ine|anne)$') THEN 'F' WHEN regexp_matches(lower(prenom), '(ard|ert|aud|oux)$') THEN 'M' END AS gender FROM persons")
def _(t):
    return t.persons.select("person_id", N.gender_from_ending("prenom").alias("gender"))


@query("nam8_parse_status", f"WITH {RAW} SELECT person_id, CASE {' '.join(f'''WHEN contains(lower(name), '{k}') THEN '{v}' ''' for k, v in N.STATUS.items())} END AS status, CASE sexe WHEN 'M' THEN 'M' ELSE 'F' END AS gender FROM raw JOIN persons USING (person_id)")
def _(t):
    return raw(t).select("person_id", N.parse_status("name").alias("status"), N.parse_gender("sexe").alias("gender"))


@query("nam9_canonical_variant", f"WITH {NORM} SELECT prenom AS key, first(name ORDER BY -length(name), name) AS canonical FROM norm JOIN persons USING (person_id) GROUP BY prenom")
def _(t):
    n = raw(t).select("person_id", N.normalize_person_name("name")["name"].alias("name")).join(t.persons.select("person_id", F.col("prenom").alias("key")), "person_id")
    return N.canonical_variant(n, "key", "name")


@query("nam10_standardize_profession", f"SELECT person_id, p || 's' AS spelling, coalesce({s_map({v: k for k, vs in N.PROFESSIONS.items() for v in vs})}[p || 's'], p || 's') AS standard FROM (SELECT person_id, unnest(professions) AS p FROM persons)")
def _(t):
    return N.standardize_profession(t.persons.select("person_id", F.explode("professions").alias("p")).select("person_id", F.concat("p", F.lit("s")).alias("spelling")), "spelling")


@query("nam11_add_kin", "WITH kids AS (SELECT pere_id AS id, person_id AS kid FROM persons WHERE pere_id IS NOT NULL UNION SELECT mere_id, person_id FROM persons WHERE mere_id IS NOT NULL), sib AS (SELECT DISTINCT a.kid AS id, b.kid FROM kids a JOIN kids b ON a.id = b.id AND a.kid <> b.kid) SELECT person_id, (SELECT count(*) FROM kids WHERE id = person_id) AS enfants, (SELECT count(*) FROM sib WHERE id = person_id) AS freres_soeurs FROM persons")
def _(t):
    kids = t.persons.select(F.explode(F.array("pere_id", "mere_id")).alias("person_id"), F.col("person_id").alias("kin_id")).where("person_id is not null")
    sib = kids.select("person_id", F.col("kin_id").alias("a")).join(kids, "person_id").where("a <> kin_id").select(F.col("a").alias("person_id"), "kin_id")
    edges = kids.withColumn("relation", F.lit("enfant")).unionByName(sib.withColumn("relation", F.lit("frere_soeur")))
    return N.add_kin(t.persons.select("person_id"), edges)


CORE = lambda x: f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w NOT IN {PARTICLES}), ' ')"
POS = "list_sum(list_transform(range(1, least(length(a.n), length(b.n)) + 1), lambda i: (a.n[i] = b.n[i])::INT)) / greatest(length(a.n), length(b.n))"
SIM = lambda th: f"nm AS (SELECT DISTINCT {FOLD} AS n FROM persons), sim AS (SELECT * FROM (SELECT a.n AS name_a, b.n AS name_b, round(CASE WHEN {CORE('a.n')} = {CORE('b.n')} THEN 1.0 ELSE {POS} END, 6)::DOUBLE AS score FROM nm a JOIN nm b ON a.n < b.n) WHERE score >= {th} - 1e-9)"
IDS = lambda th: f"{SIM(th)}, both_ AS (SELECT * FROM sim UNION ALL SELECT name_b, name_a, score FROM sim UNION ALL SELECT n, n, 1.0 FROM nm), pn AS (SELECT person_id, {FOLD} AS n, naissance, lieu_naissance FROM persons), idp AS (SELECT x.person_id AS id_a, y.person_id AS id_b, score, x.naissance AS na, y.naissance AS nb, x.lieu_naissance AS la, y.lieu_naissance AS lb FROM both_ JOIN pn x ON x.n = name_a JOIN pn y ON y.n = name_b AND x.person_id < y.person_id)"


@query("joi11_similar_pairs", f"WITH {SIM(0.7)}, heads AS (SELECT {FOLD} AS n, min(person_id) AS head FROM persons GROUP BY 1) SELECT head AS id_a, person_id AS id_b, 1.0::DOUBLE AS score FROM persons JOIN heads ON n = {FOLD} WHERE person_id <> head UNION ALL SELECT least(a.head, b.head), greatest(a.head, b.head), score FROM sim JOIN heads a ON a.n = name_a JOIN heads b ON b.n = name_b")
def _(t):
    return R.similar_pairs(t.persons, 0.7)


#: how a clerk may write a name: a particle, an accent, a double letter, y for i, another language's form
MISSPELT = {0: ("concat", "de "), 1: ("e", "é"), 2: ("r", "rr"), 3: ("i", "y")}
FOREIGN = {"Jean": "John", "Guillaume": "William", "Charles": "Karol", "Marie": "Mary", "François": "Francis"}
S_NOM = "CASE person_id % 5 " + " ".join(f"WHEN {k} THEN " + (f"'{b}' || nom" if a == "concat" else f"replace(nom, '{a}', '{b}')") for k, (a, b) in MISSPELT.items()) + " ELSE nom END"
S_PRENOM = "CASE " + " ".join(f"WHEN person_id % 3 = 0 AND prenom = '{a}' THEN '{b}'" for a, b in FOREIGN.items()) + " ELSE prenom END"
PAIR = f"pr AS (SELECT a.nom AS nom_a, a.prenom AS prenom_a, b.nom AS nom_b, b.prenom AS prenom_b FROM (SELECT DISTINCT {S_NOM} AS nom, {S_PRENOM} AS prenom, lower(nom[1]) AS k FROM persons) a JOIN (SELECT DISTINCT nom, prenom, lower(nom[1]) AS k FROM persons) b USING (k))"


def misspelt_pairs(t):
    """Names as a clerk may write them against those of the same first letter as they are."""
    k, nom, prenom = F.col("person_id"), F.col("nom"), F.col("prenom")
    for rest, (a, b) in MISSPELT.items():
        nom = F.when(k % 5 == rest, F.concat(F.lit(b), "nom") if a == "concat" else F.replace("nom", F.lit(a), F.lit(b))).otherwise(nom)
    for a, b in FOREIGN.items():
        prenom = F.when((k % 3 == 0) & (F.col("prenom") == a), b).otherwise(prenom)
    first = F.lower(F.substring("nom", 1, 1)).alias("k")
    return meet(t.persons.select(nom.alias("nom_a"), prenom.alias("prenom_a"), first).distinct(), t.persons.select(F.col("nom").alias("nom_b"), F.col("prenom").alias("prenom_b"), first).distinct(), "k").drop("k")


SINGLE = lambda c: reduce(lambda x, d: f"replace({x}, '{d * 2}', '{d}')", "lnmtsr", f"lower({c})")
PLAIN = lambda c: f"translate(lower({c}), '{ACCENTS[0]}', '{ACCENTS[1]}')"
YI = lambda c: f"replace(lower(translate({c}, '{ACCENTS[0]}', '{ACCENTS[1]}')), 'y', 'i')"
FIRST = " OR ".join(f"(lower(prenom_a) = '{x}' AND lower(prenom_b) = '{y}')" for v in R.FIRST_VARIANTS for x, y in (v, v[::-1]))
RULES = {"de_prefix_correction": 0.95, "y_i_variation": 0.90, "accent_loss": 0.92, "consonant_variation": 0.88, "firstname_variant": 0.85}


RULED = f"""k AS (SELECT *, replace(lower(nom_a), ' ', '') AS ga, replace(lower(nom_b), ' ', '') AS gb FROM pr), r AS (SELECT *, (ga = gb AND starts_with(ga, 'de')) OR lower(replace(nom_a, 'de ', '')) = lower(nom_b) OR lower(replace(nom_b, 'de ', '')) = lower(nom_a) AS r0, {YI('nom_a')} = {YI('nom_b')} AS r1, {PLAIN('nom_a')} = {PLAIN('nom_b')} AS r2, {SINGLE('nom_a')} = {SINGLE('nom_b')} AS r3, {FIRST} AS r4 FROM k),
  ruled AS (SELECT nom_a, prenom_a, nom_b, prenom_b, greatest(0.0, {', '.join(f'CASE WHEN r{i} THEN {s} ELSE 0 END' for i, s in enumerate(RULES.values()))})::DOUBLE AS boost, array_to_string(list_filter([{', '.join(f"CASE WHEN r{i} THEN '{n}' END" for i, n in enumerate(RULES))}], lambda v: v IS NOT NULL), ',') AS rules FROM r)"""
#: the longest common block of a stretch of both names, of equals the first in a and then in b, and so on before and after it
BLOCK = "list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: [len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda k: name_a[i:i + k - 1] = name_b[j:j + k - 1])), -i, -j]))))"
RATIOS = f"""stretch AS (SELECT name_a, name_b, alo, ahi, blo, bhi, {BLOCK} AS m FROM (SELECT *, 1::BIGINT AS alo, length(name_a) + 1 AS ahi, 1::BIGINT AS blo, length(name_b) + 1 AS bhi FROM need)
  UNION ALL SELECT name_a, name_b, alo, ahi, blo, bhi, {BLOCK} AS m FROM (SELECT name_a, name_b, s.alo AS alo, s.ahi AS ahi, s.blo AS blo, s.bhi AS bhi FROM (SELECT name_a, name_b, unnest([{{'alo': alo, 'ahi': -m[2], 'blo': blo, 'bhi': -m[3]}}, {{'alo': m[1] - m[2], 'ahi': ahi, 'blo': m[1] - m[3], 'bhi': bhi}}]) AS s FROM stretch WHERE m[1] > 0)) WHERE alo < ahi AND blo < bhi),
  ratios AS (SELECT name_a, name_b, 2 * sum(m[1]) / (length(name_a) + length(name_b)) AS ratio FROM stretch GROUP BY name_a, name_b)"""
NEED = "need AS (SELECT DISTINCT lower(nom_a) AS name_a, lower(nom_b) AS name_b FROM pr UNION SELECT lower(prenom_a), lower(prenom_b) FROM pr)"
SCORED = f"{RULED}, {NEED}, {RATIOS}, scored AS (SELECT nom_a, prenom_a, nom_b, prenom_b, rules, 0.6::DOUBLE * greatest(x.ratio, boost) + 0.4::DOUBLE * y.ratio AS s FROM ruled JOIN ratios x ON x.name_a = lower(nom_a) AND x.name_b = lower(nom_b) JOIN ratios y ON y.name_a = lower(prenom_a) AND y.name_b = lower(prenom_b))"


@query("joi12_name_rules", f"WITH {PAIR}, {RULED} SELECT * FROM ruled")
def _(t):
    return misspelt_pairs(t).withColumn("r", R.rule_boost(F.col("nom_a"), F.col("nom_b"), F.col("prenom_a"), F.col("prenom_b"))).select("nom_a", "prenom_a", "nom_b", "prenom_b", "r.*")


@query("joi12_score_name_pairs", f"WITH RECURSIVE {PAIR}, {SCORED} SELECT nom_a, prenom_a, nom_b, prenom_b, round(s, 4) AS similarity, round(least(1.0::DOUBLE, s + CASE WHEN rules <> '' THEN 0.05 ELSE 0 END), 4) AS confidence, rules FROM scored")
def _(t):
    return R.score_name_pairs(misspelt_pairs(t))


@query("udx4_string_ratio", f"WITH RECURSIVE n AS (SELECT DISTINCT lower({NAME}) AS n FROM persons), ends AS (SELECT n, unnest([n[1:3], '…' || n[-3:]]) AS key FROM n), need AS (SELECT DISTINCT a.n AS name_a, b.n AS name_b FROM ends a JOIN ends b ON a.key = b.key AND a.n < b.n), {RATIOS} SELECT name_a, name_b, round(ratio, 6) AS ratio FROM ratios")
def _(t):
    """All names against those that begin alike or end alike."""
    n = t.persons.select(F.lower(R.full_name()).alias("n")).distinct()
    a, b = (n.select(F.col("n").alias(f"name_{k}"), F.explode(F.array(F.substring("n", 1, 3), F.concat(F.lit("…"), F.substring("n", -3, 3)))).alias("key")) for k in "ab")
    pairs = meet(a, b, "key").where("name_a < name_b").select("name_a", "name_b").distinct()
    return pairs.withColumn("ratio", F.round(string_ratio("name_a", "name_b"), 6))


EVERY = lambda source: f"pr AS (SELECT a.nom AS nom_a, a.prenom AS prenom_a, b.nom AS nom_b, b.prenom AS prenom_b FROM (SELECT DISTINCT nom, prenom FROM {source}) a, (SELECT DISTINCT nom, prenom FROM {source}) b)"


@query("joi13_find_best_matches", f"""WITH RECURSIVE {EVERY('persons')}, {SCORED}, met AS (SELECT a.person_id AS target_id, b.person_id AS candidate_id, round(s, 4) AS score FROM scored JOIN persons a ON a.nom = nom_a AND a.prenom = prenom_a JOIN persons b ON b.nom = nom_b AND b.prenom = prenom_b WHERE round(s, 4) >= 0.85 AND a.person_id <> b.person_id)
  SELECT target_id, candidate_id, score, (row_number() OVER (PARTITION BY target_id ORDER BY score DESC, candidate_id))::INTEGER AS rank FROM met QUALIFY rank <= 3""")
def _(t):
    return R.find_best_matches(t.persons, t.persons, 0.85, 3)


@query("joi14_jaccard_pairs", f"WITH nm AS (SELECT min(person_id) AS id, {NAME} || ' ' || lieu_naissance AS name FROM persons GROUP BY 2), s AS (SELECT id, list_distinct({s_words('lower(name)')}) AS ws FROM nm) SELECT a.id AS id_a, b.id AS id_b, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 6)::DOUBLE AS score FROM s a JOIN s b ON a.id < b.id WHERE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) > 0.4")
def _(t):
    named = t.persons.groupBy(F.concat_ws(" ", "prenom", "nom", "lieu_naissance").alias("name")).agg(F.min("person_id").alias("id"))
    return R.jaccard_pairs(named, 0.4)


@query("joi15_match_existing_person", f"WITH p AS (SELECT person_id AS id, {FOLD} AS n, CASE WHEN person_id % 10 <> 0 THEN make_date(naissance, 1, 1) END AS born FROM persons) SELECT a.id, arg_min(b.id, (coalesce(abs(date_diff('day', a.born, b.born)), 0), b.id)) AS match_id FROM p a JOIN p b ON a.n = b.n AND a.id <> b.id AND (abs(date_diff('day', a.born, b.born)) <= 365 OR (a.born IS NULL AND b.born IS NULL)) GROUP BY a.id")
def _(t):
    p = t.persons.select(F.col("person_id").alias("id"), R.full_name().alias("name"), F.when(F.col("person_id") % 10 != 0, F.make_date("naissance", F.lit(1), F.lit(1))).alias("born"))
    return R.match_existing_person(p, p)


KEY = f"translate({FOLD}, '{ACCENTS[0]}', '{ACCENTS[1]}')"


@query("joi17_rewrite_ids", f"WITH m AS (SELECT person_id, min(person_id) OVER (PARTITION BY {KEY}) AS new_id FROM persons) SELECT p.person_id, f.new_id AS pere_id, g.new_id AS mere_id FROM persons p LEFT JOIN m f ON f.person_id = pere_id LEFT JOIN m g ON g.person_id = mere_id")
def _(t):
    keyed = t.persons.select("person_id", R.grouping_key().alias("key"))
    ids = keyed.join(keyed.groupBy("key").agg(F.min("person_id").alias("new_id")), "key").select(F.col("person_id").alias("old_id"), "new_id")
    return R.rewrite_ids(t.persons.select("person_id", "pere_id", "mere_id"), ids, ["pere_id", "mere_id"])


@query("joi10_recurring_persons", f"WITH {PARTS} SELECT person_id, nom FROM persons WHERE person_id IN (SELECT person_id FROM parts WHERE role = 'parrain')")
def _(t):
    god = acte_participants(t.actes).where("role = 'parrain'").select("person_id")
    return t.persons.select("person_id", "nom").join(god, "person_id", "left_semi")


@query("agg17_homonym_groups", f"SELECT key, person_id // 1000 AS chunk, n, string_agg(person_id::VARCHAR, ',' ORDER BY person_id) AS ids FROM (SELECT person_id, {KEY} AS key, count(*) OVER (PARTITION BY {KEY}) AS n FROM persons) WHERE n > 1 GROUP BY ALL")
def _(t):
    return R.homonym_groups(t.persons)


FACTORS = f"""hp AS (SELECT *, {KEY} AS key FROM persons), land AS (SELECT key, count(DISTINCT person_id) AS landed, count(DISTINCT l) AS lands, count(DISTINCT (person_id, l)) AS holdings FROM (SELECT key, person_id, unnest(terres) AS l FROM hp) GROUP BY key),
  g AS (SELECT key, count(*) AS n, count(deces) AS deaths, min(deces) AS fd, max(naissance) AS lb, bool_or(list_has_any(professions, ['curé', 'prêtre', 'vicaire'])) AS clergy, bool_or(list_has_any(professions, ['avocat', 'marchand', 'laboureur'])) AS secular, count(DISTINCT statut) AS st, sum(len(professions) + len(terres) + (naissance IS NOT NULL)::INT + (deces IS NOT NULL)::INT + (statut IS NOT NULL)::INT) AS infos FROM hp GROUP BY key HAVING count(*) > 1),
  fl AS (SELECT key, n, infos, coalesce(landed, 0) > 1 AND lands = holdings AS f1, deaths > 1 AND fd < lb AS f2, clergy AND secular AS f3, st > 1 AS f4 FROM g LEFT JOIN land USING (key)),
  factors AS (SELECT key, n, array_to_string(list_filter([CASE WHEN f1 THEN 'terres_distinctes' END, CASE WHEN f2 THEN 'chronologie_distincte' END, CASE WHEN f3 THEN 'professions_incompatibles' END, CASE WHEN f4 THEN 'statuts_differents' END], lambda v: v IS NOT NULL), ',') AS factors,
    round(greatest(0.0, least(1.0, 0.5::DOUBLE + CASE WHEN f1 THEN 0.3 ELSE 0 END + CASE WHEN f2 THEN 0.4 ELSE 0 END + CASE WHEN f3 THEN 0.3 ELSE 0 END + CASE WHEN f4 THEN 0.1 ELSE 0 END - CASE WHEN infos < 2 * n THEN 0.2 ELSE 0 END)), 4)::DOUBLE AS confidence FROM fl)"""


@query("agg18_homonym_factors", f"WITH {FACTORS} SELECT key, n, factors FROM factors")
def _(t):
    return R.homonym_factors(t.persons).drop("confidence")


@query("agg19_homonym_confidence", f"WITH {FACTORS} SELECT key, confidence FROM factors WHERE confidence >= 0.7")
def _(t):
    return R.homonym_factors(t.persons).where("confidence >= 0.7").select("key", "confidence")


@query("agg20_homonym_resolution", f"""WITH {FACTORS}, w AS (SELECT person_id, list_filter([CASE WHEN contains(factors, 'terres_distinctes') AND len(terres) > 0 THEN 'Distinguer par terres: sr de ' || array_to_string(terres, ', ') END, CASE WHEN contains(factors, 'chronologie_distincte') THEN coalesce('Distinguer par chronologie: †' || deces, 'Distinguer par chronologie: *' || naissance) END,
  CASE WHEN contains(factors, 'professions_incompatibles') AND len(professions) > 0 THEN 'Distinguer par profession: ' || array_to_string(professions, ', ') END], lambda v: v IS NOT NULL) AS w FROM hp JOIN factors USING (key) WHERE confidence >= 0.7) SELECT person_id, CASE WHEN len(w) > 0 THEN array_to_string(w, ' | ') ELSE 'Ajouter un identifiant numérique' END AS strategy FROM w""")
def _(t):
    return R.homonym_resolution(t.persons)


DUP = f"{IDS(0.90)}, dup AS (SELECT id_a, id_b FROM idp WHERE na = nb AND la = lb), de AS (SELECT id_a AS a, id_b AS b FROM dup UNION SELECT id_b, id_a FROM dup), walk AS (SELECT DISTINCT a AS id, a AS g FROM de UNION SELECT de.b, g FROM walk JOIN de ON de.a = walk.id), clusters AS (SELECT id AS person_id, min(g) AS cluster_id FROM walk GROUP BY id)"


@query("grf10_duplicate_clusters", f"WITH RECURSIVE {DUP} SELECT * FROM clusters")
def _(t):
    return R.duplicate_clusters(t.persons)


@query("grf11_merge_name_groups", f"""WITH RECURSIVE folded_ AS (SELECT DISTINCT {PLAIN('nom')} AS nom, {PLAIN('prenom')} AS prenom FROM persons), {EVERY('folded_')}, {SCORED}, near AS (SELECT prenom_a || ' ' || nom_a AS a, prenom_b || ' ' || nom_b AS b FROM scored WHERE round(s, 4) >= 0.9 UNION SELECT prenom_b || ' ' || nom_b, prenom_a || ' ' || nom_a FROM scored WHERE round(s, 4) >= 0.9),
  walk AS (SELECT prenom || ' ' || nom AS id, prenom || ' ' || nom AS g FROM folded_ UNION SELECT near.b, g FROM walk JOIN near ON near.a = walk.id) SELECT id AS key, min(g) AS first_key FROM walk GROUP BY id""")
def _(t):
    """Each name with the first in order of those that go together with it."""
    groups = R.merge_name_groups(t.persons, 0.9)
    return groups.join(groups.groupBy("group").agg(F.min("key").alias("first_key")), "group").select("key", "first_key")


@query("agg21_merge_records", f"WITH RECURSIVE {DUP}, x AS (SELECT * FROM persons JOIN clusters USING (person_id)) SELECT cluster_id, count(*) AS n, first(naissance ORDER BY person_id) AS naissance, first(lieu_naissance ORDER BY person_id) AS lieu_naissance, (SELECT string_agg(DISTINCT s, ',' ORDER BY s) FROM (SELECT unnest(sources) AS s FROM x y WHERE y.cluster_id = x.cluster_id)) AS sources, coalesce((SELECT string_agg(DISTINCT s, ',' ORDER BY s) FROM (SELECT unnest(professions) AS s FROM x y WHERE y.cluster_id = x.cluster_id)), '') AS professions FROM x GROUP BY cluster_id")
def _(t):
    return R.merge_records(t.persons, R.duplicate_clusters(t.persons))


@query("agg22_person_confidence", "SELECT person_id, round(least(1.0::DOUBLE, 1.0 - 0.5 + 0.1 + 0.05 + CASE WHEN len(professions) > 0 THEN 0.05 ELSE 0 END + CASE WHEN len(sources) > 1 THEN 0.1 ELSE 0 END), 4)::DOUBLE AS confidence FROM persons")
def _(t):
    return R.person_confidence(t.persons)


@query("grf12_find_or_create", f"""WITH RECURSIVE {NORM}, nn AS (SELECT DISTINCT name AS normalized, sexe, lower(name) AS key FROM norm JOIN persons USING (person_id)), nm AS (SELECT DISTINCT key AS n FROM nn), sim AS (SELECT a.n AS name_a, b.n AS name_b FROM nm a JOIN nm b ON a.n <> b.n WHERE {CORE('a.n')} = {CORE('b.n')} OR {POS} >= 0.85 - 1e-9),
  ed AS (SELECT a.key AS a, b.key AS b, a.sexe FROM sim JOIN nn a ON a.key = name_a JOIN nn b ON b.key = name_b AND a.sexe = b.sexe), walk AS (SELECT key AS id, sexe, key AS g FROM nn UNION SELECT ed.b, walk.sexe, g FROM walk JOIN ed ON ed.a = walk.id AND ed.sexe = walk.sexe) SELECT normalized, nn.sexe, sha256(min(g) || '_' || nn.sexe)[:16] AS person_key FROM nn JOIN walk ON walk.id = nn.key AND walk.sexe = nn.sexe GROUP BY normalized, nn.sexe""")
def _(t):
    return R.find_or_create(raw(t).select("name", "sexe"))


@query("grf13_revalidate_registry", f"WITH RECURSIVE {DUP} SELECT 'persons' AS what, count(*) AS n FROM persons UNION ALL SELECT 'renamed', 0 UNION ALL SELECT 'merged', count(*) FROM clusters WHERE person_id <> cluster_id")
def _(t):
    return R.revalidate_registry(t.persons)


@query("grf14_detect_duplicates", f"WITH p AS (SELECT person_id, {FOLD} AS k, naissance FROM persons), d AS (SELECT a.person_id AS id_a, b.person_id AS id_b, round(0.7::DOUBLE + 0.3 * greatest(0.0, 1 - abs(a.naissance - b.naissance) / 10), 4)::DOUBLE AS score FROM p a JOIN p b ON a.k = b.k AND a.person_id < b.person_id) SELECT * FROM d WHERE score > 0.8")
def _(t):
    return R.detect_duplicates(t.persons)


@query("set4_relation_person_overlap", f"WITH {PARTS} SELECT DISTINCT lower({NAME}) AS name FROM persons JOIN parts USING (person_id) WHERE role = 'marraine' INTERSECT SELECT lower({NAME}) FROM persons WHERE statut IS NOT NULL")
def _(t):
    one = acte_participants(t.actes).where("role = 'marraine'").join(t.persons, "person_id").select(F.lower(R.full_name()).alias("name"))
    return one.intersect(t.persons.where("statut is not null").select(F.lower(R.full_name()).alias("name")))


@query("set5_unmentioned_persons", f"WITH {PARTS} SELECT person_id FROM persons EXCEPT SELECT person_id FROM parts WHERE role = 'parrain'")
def _(t):
    return t.persons.select("person_id").exceptAll(acte_participants(t.actes).where("role = 'parrain'").select("person_id").distinct())


CTX = "ctx AS (SELECT a.personne_principale_id AS person_id, r.text FROM register r JOIN actes a USING (acte_id)), one AS (SELECT person_id, text FROM ctx)"
COUNT = lambda ps: " + ".join(f"contains(near, '{p}')::INT" for p in ps)
GENDER = f"{CTX}, hit AS (SELECT person_id, lower(text) AS t, {FOLD} AS n, strpos(lower(text), {FOLD}) AS p FROM one JOIN persons USING (person_id)), nr AS (SELECT person_id, t[greatest(p - 100, 1):p + length(n) + 99] AS near FROM hit WHERE p > 0), gen AS (SELECT person_id, CASE WHEN {COUNT(R.FEMININE)} > {COUNT(R.MASCULINE)} THEN 'F' WHEN {COUNT(R.FEMININE)} < {COUNT(R.MASCULINE)} THEN 'M' END AS gender FROM nr)"


def contexts(t):
    return t.register.join(t.actes.select("acte_id", F.col("personne_principale_id").alias("person_id")), "acte_id").select("person_id", "text")


@query("val9_gender_from_context", f"WITH {GENDER} SELECT * FROM gen")
def _(t):
    return R.gender_from_context(t.persons, contexts(t))


WOMEN = "wv AS (SELECT person_id, unnest(list_filter([CASE WHEN statut IN ('sieur', 'seigneur', 'écuyer') THEN {'rule': 'titre masculin', 'severity': 'error', 'penalty': 0.4::DOUBLE} END, CASE WHEN statut IN ('sieur', 'seigneur', 'écuyer') THEN {'rule': 'titre hérité', 'severity': 'warning', 'penalty': 0.1::DOUBLE} END, CASE WHEN list_has_any(professions, ['curé', 'prêtre']) THEN {'rule': 'profession masculine', 'severity': 'error', 'penalty': 0.3::DOUBLE} END], lambda x: x IS NOT NULL)) AS v FROM persons WHERE sexe = 'F')"


@query("udx5_configuration", f"WITH {WOMEN} SELECT person_id, 'gender' AS \"check\", v.rule, v.severity, v.penalty FROM wv UNION ALL SELECT person_id, 'chronology', rule, severity, penalty FROM ({CHRONOLOGY})")
def _(t):
    return registry_checks(t.persons, Config())


@query("val10_validate_gender", f"WITH {WOMEN} SELECT person_id, v.rule, v.severity, v.penalty FROM wv")
def _(t):
    return R.validate_gender(t.persons, t.persons.select("person_id", F.col("sexe").alias("gender")))


@query("val11_correct_gender_titles", "SELECT person_id, CASE WHEN sexe = 'F' AND statut IN ('sieur', 'seigneur', 'écuyer') THEN NULL ELSE statut END AS statut, CASE WHEN sexe = 'F' AND statut IN ('sieur', 'seigneur', 'écuyer') THEN statut END AS old_statut FROM persons")
def _(t):
    fixed, changes = R.correct_gender_titles(t.persons, t.persons.select("person_id", F.col("sexe").alias("gender")))
    return fixed.select("person_id", "statut").join(changes, "person_id", "left")


@query("val12_gender_from_relations", f"WITH {PARTS}, t AS (SELECT acte_id, person_id, CASE role WHEN 'pere' THEN 'M' WHEN 'mere' THEN 'F' WHEN 'parrain' THEN 'M' WHEN 'marraine' THEN 'F' END AS g FROM parts) SELECT person_id, arg_min(g, (acte_id, g)) AS gender FROM t WHERE g IS NOT NULL GROUP BY person_id")
def _(t):
    return R.gender_from_relations(acte_participants(t.actes).withColumnRenamed("acte_id", "order"))


@query("rep5_gedcom_gender", "SELECT person_id, CASE WHEN list_has_any(professions, ['curé', 'prêtre', 'laboureur', 'maçon', 'charpentier']) THEN 'M' WHEN list_has_any(professions, ['fileuse', 'couturière', 'ménagère']) THEN 'F' WHEN statut IN ('sieur', 'seigneur', 'écuyer') THEN 'M' WHEN statut IN ('dame', 'demoiselle') THEN 'F' END AS sex FROM persons")
def _(t):
    return R.gedcom_gender(t.persons)
