"""Register tables derived from the given star schema, by integer arithmetic and literal lists only.

``persons`` comes from customer, ``actes`` from orders, ``register`` is one line of register text for each act with a
known principal, and ``books`` joins the lines of 40 acts into a text with page markers.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feuillet.operators.matching import looked_up, spread

MALE = ("Jean", "Pierre", "Jacques", "Nicolas", "François", "Charles", "Guillaume", "Michel")
FEMALE = ("Marie", "Jeanne", "Catherine", "Marguerite", "Anne", "Françoise", "Madeleine", "Louise")
SURNAMES = ("Boucher", "Martin", "Durand", "Dubois", "Moreau", "Lefebvre", "Leroy", "Girard", "Bonnet", "Dupont")
TRADES = {"AUTOMOBILE": "avocat", "BUILDING": "curé", "FURNITURE": "laboureur", "HOUSEHOLD": "marchand", "MACHINERY": "notaire"}
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


def lits(values) -> Column:
    return F.array(*map(F.lit, values))


def pick(values, index: Column) -> Column:
    return F.element_at(lits(values), (index + 1).cast("int"))


class Tables:
    """The given tables under a folder, and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def n_orders(self) -> int:
        return self.read("orders").count()

    @cached_property
    def persons(self) -> DataFrame:
        k, e = F.col("k"), F.expr
        base = self.read("customer").withColumn("k", F.col("c_custkey")).withColumn("b", e("k div 64")).withColumn("i", e("k % 64")).withColumn("gen", e("CASE WHEN i < 8 THEN 0 WHEN i < 24 THEN 1 WHEN i < 56 THEN 2 ELSE 3 END"))
        nation = F.broadcast(self.read("nation").select("n_nationkey", "n_name"))  # 25 rows
        titled = F.when(k % 5 == 0, "sieur").when(k % 7 == 0, "écuyer")
        trade = F.element_at(F.create_map(*[F.lit(x) for p in TRADES.items() for x in p]), F.col("c_mktsegment"))
        return base.join(nation, base["c_nationkey"] == nation["n_nationkey"], "left").select(
            k.alias("person_id"),
            F.when(k % 2 == 0, "M").otherwise("F").alias("sexe"),
            e("CASE WHEN i >= 8 AND k % 53 <> 1 THEN 64 * b + 2 * ((i - 8) div 4) END").alias("pere_id"),  # some fathers aren't known
            e("CASE WHEN i = 63 AND b % 128 > 0 THEN k - 64 WHEN i >= 8 THEN 64 * b + 2 * (((i - 8) div 4) ^ 2) + 1 END").alias("mere_id"),  # the last of a family goes back to that of the one before: up to 128 generations
            e("CASE WHEN i < 28 AND i % 2 = 0 THEN 64 * b + 2 * ((i div 2) ^ 2) + 1 END").alias("conjoint_id"),
            "gen",
            e("CAST(1575 + 25 * gen + i % 7 + CASE WHEN k % 97 = 0 THEN 40 ELSE 0 END AS INT)").alias("naissance"),
            e("CAST(CASE WHEN k % 3 = 0 THEN NULL WHEN k % 101 = 0 THEN 1570 + 25 * gen ELSE 1575 + 25 * gen + i % 7 + 30 + (7 * k) % 75 END AS INT)").alias("deces"),
            e("CAST(CASE WHEN i < 28 THEN CASE WHEN k % 89 = 0 THEN 1575 + 25 * gen + 8 ELSE 1575 + 25 * gen + 20 + k % 10 END END AS INT)").alias("mariage"),
            F.when(k % 2 == 0, pick(MALE, e("(k div 2) % 8"))).otherwise(pick(FEMALE, e("(k div 2) % 8"))).alias("prenom"),
            pick(SURNAMES, e("CASE WHEN k % 3 = 1 THEN 0 ELSE (c_nationkey + b) % 10 END")).alias("nom"),  # over a third have one name
            F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(trade)).alias("professions"),
            titled.alias("statut"),
            F.when(titled.isNotNull(), F.array("n_name")).otherwise(F.array().cast("array<string>")).alias("terres"),
            F.col("n_name").alias("lieu_naissance"),
            F.when(k % 6 == 0, F.array(F.concat(F.lit("registre "), "b"), F.concat(F.lit("copie "), "b"))).otherwise(F.array(F.concat(F.lit("registre "), "b"))).alias("sources"),
        ).withColumn("variantes", F.when(F.col("person_id") % 10 == 0, F.array(F.concat_ws(" ", F.substring("prenom", 1, 3), "nom"))).otherwise(F.array().cast("array<string>")))

    @cached_property
    def actes(self) -> DataFrame:
        e = F.expr
        n = self.read("customer").count()
        base = self.read("orders").withColumn("o", F.col("o_orderkey")).withColumn("principal", e("CASE WHEN o % 43 <> 0 THEN o_custkey END")).withColumn("n", F.lit(n).cast("long"))
        p = self.persons.select(F.col("person_id").alias("p_id"), F.col("pere_id").alias("p_pere"), F.col("mere_id").alias("p_mere"), F.col("conjoint_id").alias("p_conjoint"), F.col("lieu_naissance").alias("p_lieu"))
        day = F.concat(F.dayofmonth("o_orderdate"), F.lit(" "), pick(MONTHS, F.month("o_orderdate") - 1))
        child = e("o % 4 IN (0, 3)")
        return looked_up(base, "principal", "o", p, "p_id", self.n_orders).select(
            F.col("o").alias("acte_id"),
            pick(("baptême", "mariage", "inhumation", "inconnu"), e("o % 4")).alias("type_acte"),
            F.when(e("o % 37 <> 0"), F.when(e("o % 41 = 0"), day).otherwise(F.concat(day, F.lit(" "), F.year("o_orderdate") - 350))).alias("date"),
            F.col("principal").alias("personne_principale_id"),
            F.when(child, F.col("p_pere")).alias("pere_id"),
            F.when(child, F.col("p_mere")).alias("mere_id"),
            F.when(e("o % 4 = 1"), F.col("p_conjoint")).alias("conjoint_id"),
            e("CASE WHEN o % 5 <> 0 THEN 2 * ((7 * o) % (n div 2)) END").alias("parrain_id"),
            e("CASE WHEN o % 6 <> 0 THEN 2 * ((11 * o) % (n div 2)) + 1 END").alias("marraine_id"),
            e("CASE WHEN o % 4 = 1 THEN array((13 * o) % n, (17 * o) % n) ELSE CAST(array() AS ARRAY<BIGINT>) END").alias("temoin_ids"),
            F.col("p_lieu").alias("lieu"),
            e("o % 9 = 0").alias("notable"),
        )

    @cached_property
    def register(self) -> DataFrame:
        named = self.persons.select("person_id", F.concat_ws(" ", "prenom", "nom").alias("name"), "sexe")
        df = self.actes
        for role, key in (("p", "personne_principale_id"), ("f", "pere_id"), ("m", "mere_id"), ("s", "conjoint_id"), ("gf", "parrain_id"), ("gm", "marraine_id")):
            df = looked_up(df, key, "acte_id", named.select(F.col("person_id").alias(f"{role}_id"), F.col("name").alias(role), F.col("sexe").alias(f"{role}_sexe")), f"{role}_id", self.n_orders)
        o, short = F.col("acte_id"), F.col("acte_id") % 17 == 0
        part = lambda *c: F.coalesce(F.concat(*[F.lit(x) if not isinstance(x, Column) else x for x in c]), F.lit(""))
        p, f, m, s = (F.col(c) for c in "pfms")
        when = part(F.col("date"), ", ")
        born = F.concat(when, F.when(short, "bapt.").otherwise("baptême"), F.lit(" de "), p, part(", ", F.when(F.col("p_sexe") == "M", "fils").otherwise("fille"), " de ", f, " et de ", m), part("; parrain: ", F.col("gf")), part("; marraine: ", F.col("gm")), F.lit("."))
        wed = F.concat(when, F.when(short, "mar.").otherwise("mariage"), F.lit(" de "), p, part(" avec ", s, "; ", s, ", épouse de ", p), F.lit("."))
        dead = F.concat(when, F.when(short, "inh.").otherwise("inhumation"), F.lit(" de "), p, F.lit(", sieur de "), F.col("lieu"), F.lit(", laboureur."))
        text = F.when(F.col("type_acte") == "mariage", wed).when(F.col("type_acte") == "inhumation", dead).otherwise(born)
        text = F.when(o % 11 == 0, F.replace(text, F.lit("Jean"), F.lit("Jeau"))).otherwise(text)
        text = F.when(o % 13 == 0, F.replace(text, F.lit("Charles"), F.lit("Cliarles"))).otherwise(text)
        return df.where(p.isNotNull()).select(F.expr("acte_id div 40").alias("doc_id"), "acte_id", F.expr("CAST(1 + (acte_id div 8) % 5 AS INT)").alias("page_number"), text.alias("text"))

    @cached_property
    def lines(self) -> DataFrame:
        """The register with each act as a document of its own."""
        return self.register.select(F.col("acte_id").alias("doc_id"), "text")

    @cached_property
    def books(self) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct("page_number", "acte_id", "text"))).alias("lines")
        by = spread(self.register, "doc_id", rows=self.n_orders).groupBy("doc_id").agg(lines)  # at most a line for each order
        told = lambda p: F.array_join(F.transform(F.filter("lines", lambda x: x["page_number"] == p), lambda x: x["text"]), "\n")
        page = lambda p: F.concat(F.lit("--- PAGE "), p, F.lit(" ---\n"), told(p))
        return by.select("doc_id", F.array_join(F.transform(F.array_distinct("lines.page_number"), page), "\n").alias("text"))


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same tables for the SQL of the oracles, in the order they build on each other.
SQL = {
    "persons": f"""persons AS (
  SELECT k AS person_id, CASE WHEN k % 2 = 0 THEN 'M' ELSE 'F' END AS sexe,
    CASE WHEN i >= 8 AND k % 53 <> 1 THEN 64 * b + 2 * ((i - 8) // 4) END AS pere_id,
    CASE WHEN i = 63 AND b % 128 > 0 THEN k - 64 WHEN i >= 8 THEN 64 * b + 2 * xor((i - 8) // 4, 2) + 1 END AS mere_id,
    CASE WHEN i < 28 AND i % 2 = 0 THEN 64 * b + 2 * xor(i // 2, 2) + 1 END AS conjoint_id,
    gen, (1575 + 25 * gen + i % 7 + CASE WHEN k % 97 = 0 THEN 40 ELSE 0 END)::INTEGER AS naissance,
    (CASE WHEN k % 3 = 0 THEN NULL WHEN k % 101 = 0 THEN 1570 + 25 * gen ELSE 1575 + 25 * gen + i % 7 + 30 + (7 * k) % 75 END)::INTEGER AS deces,
    (CASE WHEN i < 28 THEN CASE WHEN k % 89 = 0 THEN 1575 + 25 * gen + 8 ELSE 1575 + 25 * gen + 20 + k % 10 END END)::INTEGER AS mariage,
    CASE WHEN k % 2 = 0 THEN {sql_list(MALE)}[(k // 2) % 8 + 1] ELSE {sql_list(FEMALE)}[(k // 2) % 8 + 1] END AS prenom,
    {sql_list(SURNAMES)}[CASE WHEN k % 3 = 1 THEN 0 ELSE (c_nationkey + b) % 10 END + 1] AS nom,
    CASE WHEN k % 4 = 0 THEN []::VARCHAR[] ELSE [CASE c_mktsegment {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in TRADES.items())} END] END AS professions,
    CASE WHEN k % 5 = 0 THEN 'sieur' WHEN k % 7 = 0 THEN 'écuyer' END AS statut,
    CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN [n_name] ELSE []::VARCHAR[] END AS terres,
    n_name AS lieu_naissance,
    CASE WHEN k % 6 = 0 THEN ['registre ' || b, 'copie ' || b] ELSE ['registre ' || b] END AS sources,
    CASE WHEN k % 10 = 0 THEN [prenom[:3] || ' ' || nom] ELSE []::VARCHAR[] END AS variantes
  FROM (SELECT *, c_custkey AS k, c_custkey // 64 AS b, c_custkey % 64 AS i, CASE WHEN c_custkey % 64 < 8 THEN 0 WHEN c_custkey % 64 < 24 THEN 1 WHEN c_custkey % 64 < 56 THEN 2 ELSE 3 END AS gen FROM customer)
  LEFT JOIN nation ON c_nationkey = n_nationkey)""",
    "actes": f"""actes AS (
  SELECT o AS acte_id, ['baptême', 'mariage', 'inhumation', 'inconnu'][o % 4 + 1] AS type_acte,
    CASE WHEN o % 37 <> 0 THEN day(o_orderdate) || ' ' || {sql_list(MONTHS)}[month(o_orderdate)] || CASE WHEN o % 41 = 0 THEN '' ELSE ' ' || (year(o_orderdate) - 350) END END AS date,
    principal AS personne_principale_id,
    CASE WHEN o % 4 IN (0, 3) THEN p.pere_id END AS pere_id, CASE WHEN o % 4 IN (0, 3) THEN p.mere_id END AS mere_id, CASE WHEN o % 4 = 1 THEN p.conjoint_id END AS conjoint_id,
    CASE WHEN o % 5 <> 0 THEN 2 * ((7 * o) % (n // 2)) END AS parrain_id, CASE WHEN o % 6 <> 0 THEN 2 * ((11 * o) % (n // 2)) + 1 END AS marraine_id,
    CASE WHEN o % 4 = 1 THEN [(13 * o) % n, (17 * o) % n] ELSE []::BIGINT[] END AS temoin_ids, p.lieu_naissance AS lieu, o % 9 = 0 AS notable
  FROM (SELECT *, o_orderkey AS o, CASE WHEN o_orderkey % 43 <> 0 THEN o_custkey END AS principal, (SELECT count(*) FROM customer) AS n FROM orders) x
  LEFT JOIN persons p ON p.person_id = x.principal)""",
    "register": """register AS (
  SELECT acte_id // 40 AS doc_id, acte_id, (1 + (acte_id // 8) % 5)::INTEGER AS page_number,
    CASE WHEN acte_id % 13 = 0 THEN replace(u, 'Charles', 'Cliarles') ELSE u END AS text FROM (
  SELECT acte_id, CASE WHEN acte_id % 11 = 0 THEN replace(t, 'Jean', 'Jeau') ELSE t END AS u FROM (
  SELECT acte_id, coalesce(date || ', ', '') || CASE type_acte
      WHEN 'mariage' THEN CASE WHEN acte_id % 17 = 0 THEN 'mar.' ELSE 'mariage' END || ' de ' || p || coalesce(' avec ' || s || '; ' || s || ', épouse de ' || p, '') || '.'
      WHEN 'inhumation' THEN CASE WHEN acte_id % 17 = 0 THEN 'inh.' ELSE 'inhumation' END || ' de ' || p || ', sieur de ' || lieu || ', laboureur.'
      ELSE CASE WHEN acte_id % 17 = 0 THEN 'bapt.' ELSE 'baptême' END || ' de ' || p || coalesce(', ' || CASE WHEN sexe = 'M' THEN 'fils' ELSE 'fille' END || ' de ' || f || ' et de ' || m, '') || coalesce('; parrain: ' || gf, '') || coalesce('; marraine: ' || gm, '') || '.' END AS t
  FROM (SELECT a.*, p.prenom || ' ' || p.nom AS p, p.sexe, f.prenom || ' ' || f.nom AS f, m.prenom || ' ' || m.nom AS m, s.prenom || ' ' || s.nom AS s, gf.prenom || ' ' || gf.nom AS gf, gm.prenom || ' ' || gm.nom AS gm
    FROM actes a JOIN persons p ON p.person_id = a.personne_principale_id LEFT JOIN persons f ON f.person_id = a.pere_id LEFT JOIN persons m ON m.person_id = a.mere_id
    LEFT JOIN persons s ON s.person_id = a.conjoint_id LEFT JOIN persons gf ON gf.person_id = a.parrain_id LEFT JOIN persons gm ON gm.person_id = a.marraine_id))))""",
    "books": """books AS (
  SELECT doc_id, string_agg('--- PAGE ' || page_number || ' ---' || chr(10) || t, chr(10) ORDER BY page_number) AS text
  FROM (SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY acte_id) AS t FROM register GROUP BY ALL) GROUP BY doc_id)""",
}
SQL["lines"] = "lines AS (SELECT acte_id AS doc_id, text FROM register)"
NEEDS = {"actes": ("persons",), "register": ("persons", "actes"), "books": ("persons", "actes", "register"), "lines": ("persons", "actes", "register")}


def with_tables(sql: str) -> str:
    """``sql`` after the derived tables that it names; it may begin with WITH [RECURSIVE] of its own."""
    import re

    named = {t for t in SQL if re.search(rf"\b{t}\b", sql)}
    named |= {n for t in named for n in NEEDS.get(t, ())}
    parts = ", ".join(SQL[t] for t in SQL if t in named)
    head, recursive = sql.strip(), False
    if m := re.match(r"(?i)WITH\s+(RECURSIVE\s+)?", head):
        recursive, head = bool(m[1]), ("," if parts else "") + " " + head[m.end() :]
    elif not parts:
        return head
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{head if head.startswith(',') else ' ' + head}"
