"""Queries over acts, with their SQL."""

from pyspark.sql import functions as F

from feuillet.functions import dates as D
from feuillet.operators import acts as A
from feuillet.operators import family as G
from feuillet.plans.registry import query

MONTHS = "CASE m " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in (D.MONTHS | D.SHORT_MONTHS).items()) + " END"
TYPED = r"""typed AS (SELECT * REPLACE (CASE WHEN type_acte IN ('baptême', 'mariage', 'inhumation') THEN type_acte ELSE 'baptême' END AS type_acte),
  try_cast(nullif(regexp_extract(date, '([0-9]{4})', 1), '') AS INTEGER) AS year FROM actes)"""
PARTS = """parts AS (SELECT acte_id, r.role, r.person_id FROM (SELECT acte_id, unnest([{'role': 'principal', 'person_id': personne_principale_id}, {'role': 'pere', 'person_id': pere_id}, {'role': 'mere', 'person_id': mere_id},
  {'role': 'conjoint', 'person_id': conjoint_id}, {'role': 'parrain', 'person_id': parrain_id}, {'role': 'marraine', 'person_id': marraine_id}]) AS r FROM actes
  UNION ALL SELECT acte_id, unnest([{'role': 'temoin', 'person_id': t} for t in temoin_ids]) FROM actes) WHERE r.person_id IS NOT NULL)"""
AFTER = f"{TYPED}, {PARTS}, late AS (SELECT person_id, acte_id, role, year AS acte_year, deces AS death_year FROM parts JOIN typed USING (acte_id) JOIN persons USING (person_id) WHERE role IN ('principal', 'pere', 'mere') AND year > deces)"
NAME = "prenom || ' ' || nom"


@query("rep2_create_actes", rf"WITH {TYPED}, m AS (SELECT *, regexp_extract(lower(date), '[0-9]+ ([^ ]+) [0-9]{{4}}', 1) AS m FROM typed) SELECT acte_id, type_acte, date, year, try_cast(CASE WHEN {MONTHS} IS NOT NULL THEN year || '-' || lpad(({MONTHS})::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(date, '^([0-9]+)', 1), 2, '0') END AS DATE)::VARCHAR AS date_parsed FROM m")
def _(t):
    return A.create_actes(t.actes).select("acte_id", "type_acte", "date", "year", F.col("date_parsed").cast("string").alias("date_parsed"))


@query("joi1_acte_participants", f"WITH {PARTS} SELECT * FROM parts")
def _(t):
    return A.acte_participants(t.actes)


@query("joi2_person_actes", f"WITH {PARTS} SELECT parts.* FROM parts WHERE person_id IN (SELECT person_id FROM persons)")
def _(t):
    return A.person_actes(t.actes, t.persons)


@query("joi2_actes_by_year", f"WITH {TYPED} SELECT acte_id, type_acte FROM typed WHERE year = 1646")
def _(t):
    return A.actes_by_year(t.actes, 1646).select("acte_id", "type_acte")


@query("joi2_actes_by_type", f"WITH {TYPED} SELECT acte_id, year FROM typed WHERE type_acte = 'mariage'")
def _(t):
    return A.actes_by_type(t.actes, "mariage").select("acte_id", "year")


@query("joi3_family_actes", f"WITH {PARTS} SELECT person_id, 'own' AS kind, acte_id FROM parts JOIN persons USING (person_id) UNION SELECT person_id, 'children', acte_id FROM parts JOIN persons USING (person_id) WHERE role IN ('pere', 'mere') UNION SELECT p.person_id, 'spouse', acte_id FROM persons p JOIN parts ON parts.person_id = p.conjoint_id")
def _(t):
    return A.family_actes(t.actes, t.persons)


@query("joi7_acte_after_death", f"WITH {AFTER} SELECT * FROM late")
def _(t):
    return A.acte_after_death(t.actes, t.persons)


@query("val3_validate_acte", f"""WITH {AFTER}, x AS (SELECT typed.*, coalesce(dead, 0) AS dead, (date IS NULL)::INT AS nd, (date IS NOT NULL AND year IS NULL)::INT AS ny, (type_acte = 'baptême' AND typed.pere_id IS NULL AND typed.mere_id IS NULL)::INT AS np,
  (type_acte = 'mariage' AND (personne_principale_id IS NULL OR conjoint_id IS NULL))::INT AS ns, (type_acte = 'inhumation' AND personne_principale_id IS NULL)::INT AS nx FROM typed LEFT JOIN (SELECT acte_id, count(*) AS dead FROM late GROUP BY 1) USING (acte_id))
  SELECT acte_id, dead + ns + nx = 0 AS is_valid, (dead + ns + nx)::BIGINT AS n_errors, (nd + ny + np)::BIGINT AS n_warnings, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.1 * nd - 0.2 * ny - 0.4 * dead - 0.1 * np - 0.3 * ns - 0.3 * nx), 4)::DOUBLE AS confidence FROM x""")
def _(t):
    return A.validate_acte(t.actes, t.persons)


@query("joi8_redirect_to_living_homonym", f"""WITH {TYPED}, wrong AS (SELECT acte_id, a.pere_id, year, nom, prenom FROM typed a JOIN persons f ON f.person_id = a.pere_id WHERE type_acte = 'baptême' AND year IS NOT NULL AND (year > deces OR year - naissance < 15 OR year - naissance > 65)),
  best AS (SELECT acte_id, min(o.person_id) AS new_father_id FROM wrong w JOIN persons o USING (nom, prenom) WHERE o.person_id <> w.pere_id AND coalesce(o.deces > year, true) AND coalesce(year - o.naissance BETWEEN 0 AND 100, true) GROUP BY 1)
  SELECT acte_id, pere_id AS old_father_id, new_father_id, CASE WHEN new_father_id IS NULL THEN 'uncorrected' ELSE 'redirected' END AS status FROM wrong LEFT JOIN best USING (acte_id)""")
def _(t):
    return A.redirect_to_living_homonym(t.actes, t.persons)


@query("joi9_unknown_refs", f"WITH {PARTS} SELECT person_id, acte_id, role FROM parts WHERE person_id NOT IN (SELECT person_id FROM persons)")
def _(t):
    return A.unknown_refs(t.actes, t.persons)


@query("agg1_acte_statistics", f"WITH {TYPED} SELECT t.type_acte, count(acte_id) AS n, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS years_covered FROM (SELECT unnest(['baptême', 'mariage', 'inhumation', 'acte_vente']) AS type_acte) t LEFT JOIN typed USING (type_acte) GROUP BY 1")
def _(t):
    return A.acte_statistics(t.actes)


@query("agg24_acte_summary", f"WITH {TYPED} SELECT lieu, concat_ws('-', min(year), max(year)) AS periode, count(*) FILTER (type_acte = 'baptême') AS baptemes, count(*) FILTER (type_acte = 'mariage') AS mariages, count(*) FILTER (type_acte = 'inhumation') AS inhumations, 0::BIGINT AS ventes, count(*) AS total FROM typed GROUP BY lieu")
def _(t):
    return A.acte_summary(t.actes)


@query("top5_chronology", f"WITH {TYPED} SELECT year, '- ' || year || ' : ' || string_agg(DISTINCT upper(type_acte[1]) || type_acte[2:], ' + ' ORDER BY upper(type_acte[1]) || type_acte[2:]) AS line FROM typed WHERE year IS NOT NULL GROUP BY year")
def _(t):
    return A.chronology(t.actes)


@query("joi4_export_relationships", f"""WITH {TYPED}, e AS (SELECT 'father' AS kind, pere_id AS a, person_id AS b FROM persons WHERE pere_id IS NOT NULL UNION ALL SELECT 'mother', mere_id, person_id FROM persons WHERE mere_id IS NOT NULL
  UNION ALL (SELECT DISTINCT 'marriage', least(person_id, conjoint_id), greatest(person_id, conjoint_id) FROM persons WHERE conjoint_id IS NOT NULL)
  UNION ALL SELECT 'godfather', parrain_id, personne_principale_id FROM typed WHERE type_acte = 'baptême' AND personne_principale_id IS NOT NULL AND parrain_id IS NOT NULL
  UNION ALL SELECT 'godmother', marraine_id, personne_principale_id FROM typed WHERE type_acte = 'baptême' AND personne_principale_id IS NOT NULL AND marraine_id IS NOT NULL)
  SELECT kind, a, b, x.prenom || ' ' || x.nom AS name_a, y.prenom || ' ' || y.nom AS name_b FROM e LEFT JOIN persons x ON x.person_id = a LEFT JOIN persons y ON y.person_id = b""")
def _(t):
    return A.export_relationships(t.persons, t.actes)


@query("joi5_filiation_report", f"SELECT k.pere_id, k.mere_id, f.prenom || ' ' || f.nom AS pere, m.prenom || ' ' || m.nom AS mere, enfants, mariage_avant FROM (SELECT pere_id, mere_id, string_agg({NAME}, ', ' ORDER BY naissance, person_id) AS enfants, (min(naissance) - 1)::INTEGER AS mariage_avant FROM persons WHERE pere_id IS NOT NULL AND mere_id IS NOT NULL GROUP BY ALL) k JOIN persons f ON f.person_id = k.pere_id JOIN persons m ON m.person_id = k.mere_id")
def _(t):
    return A.filiation_report(t.persons)


@query("joi6_godparent_report", f"WITH {TYPED} SELECT acte_id, c.prenom || ' ' || c.nom AS filleul, g.prenom || ' ' || g.nom AS parrain, h.prenom || ' ' || h.nom AS marraine FROM typed a JOIN persons c ON c.person_id = a.personne_principale_id LEFT JOIN persons g ON g.person_id = a.parrain_id LEFT JOIN persons h ON h.person_id = a.marraine_id WHERE type_acte = 'baptême' AND (parrain_id IS NOT NULL OR marraine_id IS NOT NULL)")
def _(t):
    return A.godparent_report(t.persons, t.actes)


@query("agg23_global_counts", "SELECT 'persons' AS what, count(*) AS n FROM persons UNION ALL SELECT 'actes', count(*) FROM actes UNION ALL SELECT 'families', count(*) FROM (SELECT DISTINCT pere_id, mere_id FROM persons WHERE pere_id IS NOT NULL OR mere_id IS NOT NULL)")
def _(t):
    return A.global_counts(t.persons, t.actes, G.parent_pairs(t.persons))


@query("win2_number_rows", "SELECT acte_id, row_number() OVER (ORDER BY lieu NULLS FIRST, acte_id) AS number FROM actes")
def _(t):
    return A.number_rows(t.actes, "acte_id", "lieu").select("acte_id", "number")
