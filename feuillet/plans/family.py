"""Queries over the family network, with their SQL."""

from pyspark.sql import functions as F

from feuillet.operators import family as G
from feuillet.plans.acts import AFTER, TYPED
from feuillet.plans.registry import query

DECLARED = f"""{TYPED}, declared AS (SELECT pere_id AS person1_id, person_id AS person2_id, 'parent' AS relation_type, 0.95::DOUBLE AS confidence, 'père' AS evidence FROM persons WHERE pere_id IS NOT NULL
  UNION ALL SELECT mere_id, person_id, 'parent', 0.95, 'mère' FROM persons WHERE mere_id IS NOT NULL UNION ALL SELECT person_id, conjoint_id, 'spouse', 0.90, 'conjoint' FROM persons WHERE conjoint_id IS NOT NULL
  UNION ALL SELECT parrain_id, personne_principale_id, 'godparent', 0.85, 'parrain, acte ' || acte_id FROM typed WHERE type_acte = 'baptême' AND personne_principale_id IS NOT NULL AND parrain_id IS NOT NULL
  UNION ALL SELECT marraine_id, personne_principale_id, 'godparent', 0.85, 'marraine, acte ' || acte_id FROM typed WHERE type_acte = 'baptême' AND personne_principale_id IS NOT NULL AND marraine_id IS NOT NULL),
  par AS (SELECT person1_id AS parent, person2_id AS child FROM declared WHERE relation_type = 'parent')"""
SIBLINGS = "SELECT a.child AS person1_id, b.child AS person2_id, 'sibling' AS relation_type, 0.85::DOUBLE AS confidence, 'parent ' || a.parent AS evidence FROM par a JOIN par b ON a.parent = b.parent AND a.child < b.child"
SPOUSES = "SELECT a AS person1_id, b AS person2_id, 'spouse' AS relation_type, 0.80::DOUBLE AS confidence, n || ' enfants' AS evidence FROM (SELECT least(pere_id, mere_id) AS a, greatest(pere_id, mere_id) AS b, count(*) AS n FROM persons WHERE pere_id IS NOT NULL AND mere_id IS NOT NULL GROUP BY ALL) ANTI JOIN (SELECT least(person1_id, person2_id) AS a, greatest(person1_id, person2_id) AS b FROM declared WHERE relation_type = 'spouse') USING (a, b)"
GRAND = "SELECT x.parent AS person1_id, y.child AS person2_id, 'grandparent' AS relation_type, 0.75::DOUBLE AS confidence, 'par ' || x.child AS evidence FROM par x JOIN par y ON y.parent = x.child"
GEN = f"RECURSIVE {DECLARED}, down AS (SELECT person_id, 0 AS generation FROM persons WHERE person_id NOT IN (SELECT child FROM par) UNION SELECT child, generation + 1 FROM down JOIN par ON parent = person_id), gen AS (SELECT person_id, min(generation)::INTEGER AS generation FROM (SELECT person_id FROM persons UNION SELECT person2_id FROM declared WHERE relation_type = 'parent' UNION SELECT person1_id FROM declared WHERE relation_type = 'parent') LEFT JOIN down USING (person_id) GROUP BY person_id)"
UP = f"RECURSIVE {DECLARED}, climb AS (SELECT child AS person_id, parent AS ancestor_id, 1 AS distance FROM par UNION SELECT person_id, parent, distance + 1 FROM climb JOIN par ON child = ancestor_id), up AS (SELECT person_id, ancestor_id, min(distance)::INTEGER AS distance FROM climb GROUP BY ALL)"
GROUPS = "kin AS (SELECT person1_id AS a, person2_id AS b FROM declared WHERE relation_type IN ('parent', 'spouse') UNION SELECT person2_id, person1_id FROM declared WHERE relation_type IN ('parent', 'spouse')), reach AS (SELECT DISTINCT a AS id, a AS g FROM kin UNION SELECT kin.b, g FROM reach JOIN kin ON kin.a = reach.id), groups AS (SELECT id AS person_id, min(g) AS group_id FROM reach GROUP BY id)"
PAIRS = "(SELECT person_id AS a, person_id + 2 AS b FROM persons)"


def pairs(t):
    return t.persons.select(F.col("person_id").alias("a"), (F.col("person_id") + 2).alias("b"))


def declared(t):
    return G.extract_all_relations(t.persons, t.actes)


@query("set1_extract_all_relations", f"WITH {DECLARED} SELECT * FROM declared")
def _(t):
    return declared(t)


@query("set2_build_network", f"WITH {DECLARED}, every AS (SELECT * FROM declared UNION ALL {SIBLINGS} UNION ALL {SPOUSES} UNION ALL {GRAND}) SELECT relation_type, confidence, count(*) AS n, sum(person1_id)::BIGINT AS ids1, sum(person2_id)::BIGINT AS ids2 FROM every GROUP BY ALL")
def _(t):
    return G.build_network(t.persons, t.actes).groupBy("relation_type", "confidence").agg(F.count("*").alias("n"), F.sum("person1_id").alias("ids1"), F.sum("person2_id").alias("ids2"))


@query("grf1_generations", f"WITH {GEN} SELECT * FROM gen")
def _(t):
    return G.generations(t.persons, declared(t))


@query("grf2_family_groups", f"WITH RECURSIVE {DECLARED}, {GROUPS} SELECT * FROM groups")
def _(t):
    return G.family_groups(t.persons, declared(t))


@query("grf3_infer_siblings", f"WITH {DECLARED} {SIBLINGS}")
def _(t):
    return G.infer_siblings(declared(t))


@query("grf4_infer_spouses", f"WITH {DECLARED} {SPOUSES}")
def _(t):
    return G.infer_spouses(t.persons, declared(t))


@query("grf5_infer_grandparents", f"WITH {DECLARED} {GRAND}")
def _(t):
    return G.infer_grandparents(declared(t))


@query("grf6_ancestors", f"WITH {UP} SELECT * FROM up")
def _(t):
    return G.ancestors(declared(t))


@query("grf7_common_ancestors", f"WITH {UP} SELECT a, b, x.ancestor_id, x.distance AS d1, y.distance AS d2, (x.distance + y.distance)::INTEGER AS distance FROM {PAIRS} p JOIN up x ON x.person_id = a JOIN up y ON y.person_id = b AND y.ancestor_id = x.ancestor_id")
def _(t):
    return G.common_ancestors(declared(t), pairs(t))


@query("grf8_ego_network", f"WITH RECURSIVE {DECLARED}, every AS (SELECT person1_id AS a, person2_id AS b FROM declared UNION SELECT person2_id, person1_id FROM declared), walk AS (SELECT 40::BIGINT AS person_id, 0 AS hops UNION SELECT b, hops + 1 FROM walk JOIN every ON a = person_id WHERE hops < 2) SELECT person_id, min(hops)::INTEGER AS hops FROM walk GROUP BY person_id")
def _(t):
    return G.ego_network(declared(t), 40, 2)


@query("grf9_relationship_between", f"""WITH {UP}, own AS (SELECT * FROM up UNION ALL SELECT DISTINCT unnest([a, b]), unnest([a, b]), 0 FROM {PAIRS}),
  best AS (SELECT a, b, min((x.distance + y.distance, x.ancestor_id, x.distance, y.distance)) AS m FROM {PAIRS} p JOIN own x ON x.person_id = a JOIN own y ON y.person_id = b AND y.ancestor_id = x.ancestor_id GROUP BY ALL),
  d AS (SELECT p.a, p.b, m[1] AS d, least(m[3], m[4]) AS low, greatest(m[3], m[4]) AS high FROM {PAIRS} p LEFT JOIN best USING (a, b))
  SELECT a, b, CASE WHEN d IS NULL THEN 'Inconnue' WHEN high = 0 THEN 'identique' WHEN low = 0 AND high = 1 THEN 'parent' WHEN low = 0 AND high = 2 THEN 'grand-parent' WHEN low = 0 THEN 'ancêtre' WHEN high = 1 THEN 'frère/sœur' WHEN low = 1 AND high = 2 THEN 'oncle/neveu' WHEN low = 1 THEN 'grand-oncle' WHEN low = 2 AND high = 2 THEN 'cousin' ELSE 'parenté' END AS label, coalesce(d, -1)::INTEGER AS distance FROM d""")
def _(t):
    return G.relationship_between(declared(t), pairs(t))


@query("agg16_network_patterns", f"""WITH {GEN}, {GROUPS} SELECT 'relations ' || relation_type AS metric, count(*)::DOUBLE AS value FROM declared GROUP BY relation_type UNION ALL SELECT 'groups', count(DISTINCT group_id) FROM groups UNION ALL SELECT 'depth', max(generation) FROM gen
  UNION ALL SELECT 'largest group', max(n) FROM (SELECT count(*) AS n FROM groups GROUP BY group_id) UNION ALL SELECT 'children to a couple', round(avg(n), 4) FROM (SELECT count(*) AS n FROM persons WHERE pere_id IS NOT NULL AND mere_id IS NOT NULL GROUP BY pere_id, mere_id)""")
def _(t):
    return G.network_patterns(t.persons, declared(t))


@query("agg25_family_units", """WITH kids AS (SELECT pere_id AS husband, mere_id AS wife, count(*) AS n FROM persons WHERE pere_id IS NOT NULL OR mere_id IS NOT NULL GROUP BY ALL),
  wed AS (SELECT DISTINCT CASE WHEN sexe = 'M' THEN person_id ELSE conjoint_id END AS husband, CASE WHEN sexe = 'M' THEN conjoint_id ELSE person_id END AS wife FROM persons WHERE conjoint_id IS NOT NULL)
  SELECT husband, wife, coalesce(n, 0) AS n_children, greatest(h.mariage, w.mariage) AS marriage FROM kids FULL JOIN wed USING (husband, wife) LEFT JOIN persons h ON h.person_id = husband LEFT JOIN persons w ON w.person_id = wife""")
def _(t):
    return G.family_units(t.persons)


CHILD = "par2 AS (SELECT c.person_id AS child_id, c.naissance AS child_birth, 'pere' AS role, p.person_id AS parent_id, p.naissance AS parent_birth, p.deces AS parent_death, c.pere_id, c.mere_id FROM persons c JOIN persons p ON p.person_id = c.pere_id UNION ALL SELECT c.person_id, c.naissance, 'mere', p.person_id, p.naissance, p.deces, c.pere_id, c.mere_id FROM persons c JOIN persons p ON p.person_id = c.mere_id)"


@query("agg26_estimate_parent_birth", "SELECT id AS person_id, (make_date(min(naissance), 1, 1) - (365 * y)::INTEGER)::VARCHAR AS estimated_birth, 0.6::DOUBLE AS confidence FROM (SELECT naissance, pere_id AS id, 25 AS y FROM persons UNION ALL SELECT naissance, mere_id, 22 FROM persons) WHERE id IS NOT NULL GROUP BY id, y")
def _(t):
    return G.estimate_parent_birth(t.persons).withColumn("estimated_birth", F.col("estimated_birth").cast("string"))


GAPS = "gaps AS (SELECT person_id, pere_id, mere_id, naissance - lag(naissance) OVER (PARTITION BY pere_id, mere_id ORDER BY naissance, person_id) AS gap FROM persons WHERE pere_id IS NOT NULL AND mere_id IS NOT NULL)"


@query("win3_child_spacing", f"WITH {GAPS} SELECT person_id, gap, CASE WHEN gap < 1 THEN 'trop rapprochés' WHEN gap > 15 THEN 'trop espacés' END AS warning FROM gaps WHERE gap IS NOT NULL")
def _(t):
    return G.child_spacing(t.persons)


CHRONOLOGY = """SELECT person_id, r.rule, r.severity, r.penalty FROM (SELECT person_id, unnest(list_filter([CASE WHEN deces - naissance <= 0 THEN {'rule': 'mort avant naissance', 'severity': 'error', 'penalty': 0.4::DOUBLE} END, CASE WHEN deces - naissance > 100 THEN {'rule': 'plus de 100 ans', 'severity': 'warning', 'penalty': 0.1::DOUBLE} END,
  CASE WHEN mariage - naissance < 12 THEN {'rule': 'marié avant 12 ans', 'severity': 'error', 'penalty': 0.3::DOUBLE} END, CASE WHEN mariage - naissance > 60 THEN {'rule': 'marié après 60 ans', 'severity': 'warning', 'penalty': 0.1::DOUBLE} END], lambda x: x IS NOT NULL)) AS r FROM persons)"""


@query("val4_person_chronology", CHRONOLOGY)
def _(t):
    return G.validate_person_chronology(t.persons)


@query("val5_parent_child_coherent", f"WITH {CHILD} SELECT child_id, parent_id, role, coalesce(parent_death >= child_birth, true) AND coalesce(child_birth - parent_birth BETWEEN 15 AND 65, true) AS coherent FROM par2")
def _(t):
    return G.parent_child_coherent(t.persons)


@query("val6_alive_at", "SELECT person_id, coalesce(deces > 1650, true) AND coalesce(1650 - naissance BETWEEN 0 AND 100, true) AS alive FROM persons")
def _(t):
    from feuillet.operators.acts import alive_at

    return t.persons.select("person_id", alive_at(F.col("naissance"), F.col("deces"), F.lit(1650)).alias("alive"))


@query("val7_relationship_age_gap", f"WITH {CHILD}, g AS (SELECT *, date_diff('day', make_date(parent_birth, 1, 1), make_date(child_birth, 1, 1)) / 365.25 AS gap FROM par2) SELECT child_id, parent_id, round(gap, 4)::DOUBLE AS gap, gap BETWEEN 15 AND 50 AS accepted FROM g")
def _(t):
    return G.relationship_age_gap(t.persons)


@query("val8_parent_age_warnings", f"WITH {CHILD} SELECT child_id, parent_id, role, child_birth - parent_birth AS age FROM par2 WHERE child_birth - parent_birth < 17 OR child_birth - parent_birth > 45")
def _(t):
    return G.parent_age_warnings(t.persons)


@query("val13_family_chronology", f"WITH {CHILD}, {GAPS}, e AS (SELECT pere_id, mere_id, 'age' AS kind FROM par2 WHERE child_birth - parent_birth < 17 OR child_birth - parent_birth > 45 UNION ALL SELECT pere_id, mere_id, 'spacing' FROM gaps WHERE gap < 1 OR gap > 15 UNION ALL SELECT pere_id, mere_id, 'no parents' FROM persons WHERE pere_id IS NULL AND mere_id IS NULL AND gen > 0) SELECT *, count(*) AS n FROM e GROUP BY ALL")
def _(t):
    return G.family_chronology(t.persons)


@query("rep3_chronology_report", f"""WITH {AFTER}, v AS (SELECT person_id, 'mort avant naissance' AS rule, 'error' AS s, 0.4::DOUBLE AS p FROM persons WHERE deces - naissance <= 0 UNION ALL SELECT person_id, 'plus de 100 ans', 'warning', 0.1 FROM persons WHERE deces - naissance > 100
  UNION ALL SELECT person_id, 'marié avant 12 ans', 'error', 0.3 FROM persons WHERE mariage - naissance < 12 UNION ALL SELECT person_id, 'marié après 60 ans', 'warning', 0.1 FROM persons WHERE mariage - naissance > 60 UNION ALL SELECT person_id, 'acte après décès', 'error', 0.4 FROM late)
  SELECT person_id, count(*) AS n_issues, count(*) FILTER (s = 'error') AS n_errors, string_agg(DISTINCT rule, ', ' ORDER BY rule) AS rules, round(greatest(0.0::DOUBLE, 1.0 - sum(p)), 4) AS confidence FROM v GROUP BY person_id""")
def _(t):
    return G.chronology_report(t.persons, t.actes)


@query("agg28_ancestor_facets", f"WITH {GEN} SELECT generation, count(*) AS persons, count(*) FILTER (len(terres) > 0) AS nobles, count(*) FILTER (len(sources) > 1) AS documented FROM persons JOIN gen USING (person_id) GROUP BY generation")
def _(t):
    return G.ancestor_facets(t.persons, declared(t))
