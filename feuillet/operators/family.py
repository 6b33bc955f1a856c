"""The family network: edges, generations, groups, inferred relations, ancestors, families, and checks over them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feuillet.operators.acts import acte_after_death, create_actes


def shared_path(spark) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:  # a local session, as in tests
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="spark-feuillet-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/step-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: an iteration's lineage ends here."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing that is still to run reads it."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def relation(a: str | Column, b: str | Column, kind: str, confidence: float, evidence: Column) -> list[Column]:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return [c(a).alias("person1_id"), c(b).alias("person2_id"), F.lit(kind).alias("relation_type"), F.lit(confidence).alias("confidence"), evidence.alias("evidence")]


def extract_all_relations(persons: DataFrame, actes: DataFrame) -> DataFrame:
    """person1_id, person2_id, relation_type, confidence, evidence: parents, spouses and godparents as declared."""
    out = persons.where("pere_id is not null").select(*relation("pere_id", "person_id", "parent", 0.95, F.lit("père")))
    out = out.unionByName(persons.where("mere_id is not null").select(*relation("mere_id", "person_id", "parent", 0.95, F.lit("mère"))))
    out = out.unionByName(persons.where("conjoint_id is not null").select(*relation("person_id", "conjoint_id", "spouse", 0.90, F.lit("conjoint"))))
    b = create_actes(actes).where("type_acte = 'baptême' and personne_principale_id is not null")
    for column, said in (("parrain_id", "parrain"), ("marraine_id", "marraine")):
        out = out.unionByName(b.where(f"{column} is not null").select(*relation(column, "personne_principale_id", "godparent", 0.85, F.concat(F.lit(f"{said}, acte "), "acte_id"))))
    return out


def parents_of(relations: DataFrame) -> DataFrame:
    return relations.where("relation_type = 'parent'").select(F.col("person1_id").alias("parent"), F.col("person2_id").alias("child"))


def infer_siblings(relations: DataFrame) -> DataFrame:
    """A row for each pair and each parent they share."""
    p = parents_of(relations)
    pairs = p.select("parent", F.col("child").alias("a")).join(p.select("parent", F.col("child").alias("b")), "parent").where("a < b")
    return pairs.select(*relation("a", "b", "sibling", 0.85, F.concat(F.lit("parent "), "parent")))


def infer_spouses(persons: DataFrame, relations: DataFrame) -> DataFrame:
    """Parents of the same children who aren't declared as spouses, in either order."""
    couples = persons.where("pere_id is not null and mere_id is not null").groupBy(F.least("pere_id", "mere_id").alias("a"), F.greatest("pere_id", "mere_id").alias("b")).agg(F.count("*").alias("n"))
    declared = relations.where("relation_type = 'spouse'").select(F.least("person1_id", "person2_id").alias("a"), F.greatest("person1_id", "person2_id").alias("b")).distinct()
    return couples.join(declared, ["a", "b"], "left_anti").select(*relation("a", "b", "spouse", 0.80, F.concat("n", F.lit(" enfants"))))


def infer_grandparents(relations: DataFrame) -> DataFrame:
    p = parents_of(relations)
    return p.select(F.col("parent").alias("g"), F.col("child").alias("mid")).join(p.select(F.col("parent").alias("mid"), F.col("child").alias("c")), "mid").select(*relation("g", "c", "grandparent", 0.75, F.concat(F.lit("par "), "mid")))


def build_network(persons: DataFrame, actes: DataFrame) -> DataFrame:
    declared = extract_all_relations(persons, actes)
    return declared.unionByName(infer_siblings(declared)).unionByName(infer_spouses(persons, declared)).unionByName(infer_grandparents(declared))


def generations(persons: DataFrame, relations: DataFrame, affordable: int | None = None) -> DataFrame:
    """person_id, generation: the fewest steps down from anyone who is nobody's child; null where no such person leads to them
    (who descends from a circle only).

    Levels are settled in strides: with the pairs (person, ancestor ``stride`` steps up), those at ``stride`` steps or less
    below what is settled come next. The stride doubles by joining the pairs with themselves, while that makes no more
    than ``affordable`` pairs (some for each relation); a line of n generations takes about log n rounds, and where doubling would cost too
    much, levels go on by the stride reached. A round that settles nobody is the last: levels have no gaps.
    """
    p = written(parents_of(relations).distinct())
    ids = persons.select("person_id").unionByName(p.select(F.col("parent").alias("person_id"))).unionByName(p.select(F.col("child").alias("person_id"))).where("person_id is not null").distinct()
    known = written(ids.join(p.select(F.col("child").alias("person_id")).distinct(), "person_id", "left_anti").withColumn("generation", F.lit(0)))
    pairs, level, stride, done = p.select(F.col("child").alias("x"), F.col("parent").alias("z")), 1, 1, []
    affordable = max(1_000_000, 16 * p.count()) if affordable is None else affordable
    while True:
        new = pairs.join(known.where(F.col("generation") >= level - stride).withColumnRenamed("person_id", "z"), "z").groupBy(F.col("x").alias("person_id")).agg((F.min("generation") + stride).alias("generation"))
        new = written(new.join(known.select("person_id"), "person_id", "left_anti"))
        if not new.limit(1).count():
            return ids.join(known, "person_id", "left").select("person_id", "generation")
        older, known = known, written(known.unionByName(new))
        level += stride
        own = pairs.join(older.select(F.col("person_id").alias("x")), "x", "left_anti")  # of those settled in this round, or not yet
        ends = own.groupBy("x").agg(F.count("*").alias("up")).join(own.groupBy("z").agg(F.count("*").alias("down")), F.col("x") == F.col("z"))
        if (ends.agg(F.sum(F.col("up") * F.col("down")).alias("n")).first()["n"] or 0) <= affordable:
            below = own.join(new.select(F.col("person_id").alias("x")), "x", "left_anti").select("x", F.col("z").alias("mid"))
            pairs, stride = written(below.join(own.select(F.col("x").alias("mid"), "z"), "mid").select("x", "z").distinct()), 2 * stride
        else:
            pairs = written(own)
        forget(older, new, *done)
        done = [pairs]


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) -> id, group_id: the least id that can be reached. Labels fall to a neighbour's and then to their label's own, so long chains shorten fast."""
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    links = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    before = labels = written(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    for _ in range(rounds):
        near = links.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("next"))
        new = written(low.join(jump, "low", "left").select("id", "label", F.least("low", F.coalesce("next", "low")).alias("new")))
        forget(before)
        before, labels = new, new.select("id", F.col("new").alias("label"))
        if not new.where("new <> label").limit(1).count():
            forget(links)
            return labels.withColumnRenamed("label", "group_id")
    raise RuntimeError("connected: not stable after so many rounds")


def family_groups(persons: DataFrame, relations: DataFrame) -> DataFrame:
    """person_id, group_id: groups of two or more that parents and spouses hold together."""
    kin = relations.where("relation_type in ('parent', 'spouse')").select(F.col("person1_id").alias("a"), F.col("person2_id").alias("b"))
    return connected(kin).select(F.col("id").alias("person_id"), "group_id")


def ancestors(relations: DataFrame, person_ids: DataFrame | None = None) -> DataFrame:
    """person_id, ancestor_id, distance (the least), without any limit of depth. Who stands in a circle is an ancestor of their own.

    By doubling: a pair more than 2^k and at most 2^(k + 1) steps apart has someone exactly 2^k steps up on the way, and
    the rest of the way is known. So the pairs at 2^k steps meet all that is known so far, in about log(depth) rounds.
    """
    p = written(parents_of(relations).where("parent is not null and child is not null").distinct())
    known = reach = p.select(F.col("child").alias("person_id"), F.col("parent").alias("ancestor_id"), F.lit(1).alias("distance"))
    steps = 1
    while reach.limit(1).count():
        far = known.select(F.col("person_id").alias("mid"), F.col("ancestor_id").alias("top"), F.col("distance").alias("more"))
        up = reach.join(far, F.col("ancestor_id") == F.col("mid")).groupBy("person_id", F.col("top").alias("ancestor_id")).agg((F.min("more") + steps).alias("distance"))
        new = written(up.join(known.select("person_id", "ancestor_id"), ["person_id", "ancestor_id"], "left_anti"))
        known, steps = known.unionByName(new), 2 * steps
        reach = new.where(F.col("distance") == steps)
    return known if person_ids is None else known.join(person_ids.select("person_id").distinct(), "person_id", "left_semi")


def descent_circles(relations: DataFrame) -> DataFrame:
    """person_id, steps: persons who are their own ancestors, by the shortest way round."""
    return ancestors(relations).where("person_id = ancestor_id").select("person_id", F.col("distance").alias("steps"))


def common_ancestors(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> a, b, ancestor_id, d1, d2, distance."""
    up = ancestors(relations, pairs.select(F.explode(F.array("a", "b")).alias("person_id")))
    one, two = (up.select(F.col("person_id").alias(k), "ancestor_id", F.col("distance").alias(d)) for k, d in (("a", "d1"), ("b", "d2")))
    return pairs.select("a", "b").distinct().join(one, "a").join(two, ["b", "ancestor_id"]).select("a", "b", "ancestor_id", "d1", "d2", (F.col("d1") + F.col("d2")).alias("distance"))


def relationship_between(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, label, distance: by the nearest common ancestor, each person being their own at distance 0; Inconnue and -1 without one."""
    self_ = pairs.select(F.explode(F.array("a", "b")).alias("person_id")).distinct()
    up = ancestors(relations, self_).unionByName(self_.select("person_id", F.col("person_id").alias("ancestor_id"), F.lit(0).alias("distance")))
    one, two = (up.select(F.col("person_id").alias(k), "ancestor_id", F.col("distance").alias(d)) for k, d in (("a", "d1"), ("b", "d2")))
    best = pairs.select("a", "b").distinct().join(one, "a").join(two, ["b", "ancestor_id"]).groupBy("a", "b").agg(F.min(F.struct((F.col("d1") + F.col("d2")).alias("d"), "ancestor_id", "d1", "d2")).alias("x"))
    d1, d2 = F.col("x.d1"), F.col("x.d2")
    low, high = F.least(d1, d2), F.greatest(d1, d2)
    label = F.when(high == 0, "identique").when((low == 0) & (high == 1), "parent").when((low == 0) & (high == 2), "grand-parent").when(low == 0, "ancêtre").when(high == 1, "frère/sœur").when((low == 1) & (high == 2), "oncle/neveu").when(low == 1, "grand-oncle").when((low == 2) & (high == 2), "cousin").otherwise("parenté")
    return pairs.select("a", "b").distinct().join(best, ["a", "b"], "left").select("a", "b", F.coalesce(F.when(F.col("x").isNotNull(), label), F.lit("Inconnue")).alias("label"), F.coalesce("x.d", F.lit(-1)).alias("distance"))


def ego_network(relations: DataFrame, person_id: int, depth: int = 3) -> DataFrame:
    """person_id, hops: who is within ``depth`` relations of a person."""
    links = relations.select(F.col("person1_id").alias("a"), F.col("person2_id").alias("b"))
    links = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    known = front = relations.sparkSession.createDataFrame([(person_id, 0)], "person_id long, hops int")
    for k in range(1, depth + 1):
        front = written(front.join(links, front["person_id"] == links["a"]).select(F.col("b").alias("person_id")).distinct().join(known, "person_id", "left_anti").withColumn("hops", F.lit(k)))
        known = known.unionByName(front)
    return known


def parent_pairs(persons: DataFrame) -> DataFrame:
    return persons.where("pere_id is not null or mere_id is not null").select("pere_id", "mere_id").distinct()


def family_units(persons: DataFrame) -> DataFrame:
    """husband, wife, n_children, marriage: parents with children and couples without; the later of both spouses' marriage years."""
    kids = persons.where("pere_id is not null or mere_id is not null").groupBy(F.col("pere_id").alias("husband"), F.col("mere_id").alias("wife")).agg(F.count("*").alias("n_children"))
    wed = persons.where("conjoint_id is not null").select(F.when(F.col("sexe") == "M", F.col("person_id")).otherwise(F.col("conjoint_id")).alias("husband"), F.when(F.col("sexe") == "M", F.col("conjoint_id")).otherwise(F.col("person_id")).alias("wife")).distinct()
    every = kids.join(wed, ["husband", "wife"], "full").select("husband", "wife", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))
    year = lambda k: persons.select(F.col("person_id").alias(k), F.col("mariage").alias(f"m_{k}"))
    return every.join(year("husband"), "husband", "left").join(year("wife"), "wife", "left").select("husband", "wife", "n_children", F.greatest("m_husband", "m_wife").alias("marriage"))


def network_patterns(persons: DataFrame, relations: DataFrame) -> DataFrame:
    """metric, value: relations, groups, depth, the largest group, children to a couple."""
    groups = family_groups(persons, relations).groupBy("group_id").agg(F.count("*").alias("n"))
    depth = generations(persons, relations).agg(F.max("generation").cast("double").alias("v"))
    couples = persons.where("pere_id is not null and mere_id is not null").groupBy("pere_id", "mere_id").agg(F.count("*").alias("n"))
    row = lambda df, name: df.select(F.lit(name).alias("metric"), F.col("v").cast("double").alias("value"))
    out = relations.groupBy(F.concat(F.lit("relations "), "relation_type").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    for df, name in ((groups.agg(F.count("*").alias("v")), "groups"), (depth, "depth"), (groups.agg(F.max("n").alias("v")), "largest group"), (couples.agg(F.round(F.avg("n"), 4).alias("v")), "children to a couple")):
        out = out.unionByName(row(df, name))
    return out


def estimate_parent_birth(persons: DataFrame) -> DataFrame:
    """Parents' births from their oldest child's: 25 years of 365 days before for a father, 22 for a mother."""
    kids = persons.where("naissance is not null").select(F.make_date("naissance", F.lit(1), F.lit(1)).alias("born"), F.explode(F.array(F.struct(F.col("pere_id").alias("id"), F.lit(25).alias("y")), F.struct(F.col("mere_id").alias("id"), F.lit(22).alias("y")))).alias("p")).where("p.id is not null")
    return kids.groupBy(F.col("p.id").alias("person_id"), F.col("p.y").alias("y")).agg(F.min("born").alias("born")).select("person_id", F.expr("date_sub(born, 365 * y)").alias("estimated_birth"), F.lit(0.6).alias("confidence"))


def child_spacing(persons: DataFrame) -> DataFrame:
    """Gaps to the sibling born before, with a warning under 1 or over 15 years."""
    w = Window.partitionBy("pere_id", "mere_id").orderBy("naissance", "person_id")
    gap = F.col("naissance") - F.lag("naissance").over(w)
    return persons.where("pere_id is not null and mere_id is not null").withColumn("gap", gap).where("gap is not null").select("person_id", "gap", F.when(F.col("gap") < 1, "trop rapprochés").when(F.col("gap") > 15, "trop espacés").alias("warning"))


def with_parents(persons: DataFrame) -> DataFrame:
    """child and parent side by side: child_id, child_birth, parent_id, parent_birth, parent_death, role."""
    pairs = persons.select(F.col("person_id").alias("child_id"), F.col("naissance").alias("child_birth"), F.explode(F.array(F.struct(F.lit("pere").alias("role"), F.col("pere_id").alias("id")), F.struct(F.lit("mere").alias("role"), F.col("mere_id").alias("id")))).alias("p")).where("p.id is not null").select("child_id", "child_birth", "p.role", F.col("p.id").alias("parent_id"))
    return pairs.join(persons.select(F.col("person_id").alias("parent_id"), F.col("naissance").alias("parent_birth"), F.col("deces").alias("parent_death")), "parent_id")


def parent_child_coherent(persons: DataFrame) -> DataFrame:
    x = with_parents(persons)
    ok = F.coalesce(F.col("parent_death") >= F.col("child_birth"), F.lit(True)) & F.coalesce((F.col("child_birth") - F.col("parent_birth")).between(15, 65), F.lit(True))
    return x.select("child_id", "parent_id", "role", ok.alias("coherent"))


def relationship_age_gap(persons: DataFrame, lo: float = 15, hi: float = 50) -> DataFrame:
    """Parent and child whose births lie lo to hi years of 365.25 days apart; else rejected."""
    day = lambda c: F.make_date(c, F.lit(1), F.lit(1))
    gap = F.datediff(day(F.col("child_birth")), day(F.col("parent_birth"))) / 365.25
    return with_parents(persons).select("child_id", "parent_id", F.round(gap, 4).alias("gap"), gap.between(lo, hi).alias("accepted"))


def parent_age_warnings(persons: DataFrame, lo: int = 17, hi: int = 45) -> DataFrame:
    age = F.col("child_birth") - F.col("parent_birth")
    return with_parents(persons).select("child_id", "parent_id", "role", age.alias("age")).where((F.col("age") < lo) | (F.col("age") > hi))


def validate_person_chronology(persons: DataFrame) -> DataFrame:
    """person_id, rule, severity, penalty."""
    life, wed = F.col("deces") - F.col("naissance"), F.col("mariage") - F.col("naissance")
    row = lambda when, rule, severity, penalty: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(penalty).alias("penalty")))
    found = F.array_compact(F.array(row(life <= 0, "mort avant naissance", "error", 0.4), row(life > 100, "plus de 100 ans", "warning", 0.1), row(wed < 12, "marié avant 12 ans", "error", 0.3), row(wed > 60, "marié après 60 ans", "warning", 0.1)))
    return persons.select("person_id", F.explode(found).alias("v")).select("person_id", "v.rule", "v.severity", "v.penalty")


def chronology_report(persons: DataFrame, actes: DataFrame) -> DataFrame:
    """Persons with issues: their number, those that are errors, the rules in order, and what confidence is left."""
    own = validate_person_chronology(persons)
    late = acte_after_death(actes, persons).select("person_id", F.lit("acte après décès").alias("rule"), F.lit("error").alias("severity"), F.lit(0.4).alias("penalty"))
    both = own.unionByName(late).groupBy("person_id", "rule", "severity").agg(F.count("*").alias("n"), F.sum("penalty").alias("penalty"))
    return both.groupBy("person_id").agg(F.sum("n").alias("n_issues"), F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("n_errors"), F.array_join(F.array_sort(F.collect_list("rule")), ", ").alias("rules"), F.round(F.greatest(F.lit(0.0), 1 - F.sum("penalty")), 4).alias("confidence"))


def family_chronology(persons: DataFrame) -> DataFrame:
    """pere_id, mere_id, kind, n: families without both parents, ages and gaps that warn."""
    key = persons.select(F.col("person_id").alias("child_id"), "pere_id", "mere_id")
    ages = parent_age_warnings(persons).join(key, "child_id").select("pere_id", "mere_id", F.lit("age").alias("kind"))
    gaps = child_spacing(persons).where("warning is not null").select(F.col("person_id").alias("child_id")).join(key, "child_id").select("pere_id", "mere_id", F.lit("spacing").alias("kind"))
    lone = persons.where("pere_id is null and mere_id is null and gen > 0").select("pere_id", "mere_id", F.lit("no parents").alias("kind"))
    return ages.unionByName(gaps).unionByName(lone).groupBy("pere_id", "mere_id", "kind").agg(F.count("*").alias("n"))


def ancestor_facets(persons: DataFrame, relations: DataFrame) -> DataFrame:
    """By generation: persons, nobles, and those with documents (a source besides the register)."""
    g = generations(persons, relations)
    return persons.join(g, "person_id").groupBy("generation").agg(F.count("*").alias("persons"), F.sum((F.size("terres") > 0).cast("long")).alias("nobles"), F.sum((F.size("sources") > 1).cast("long")).alias("documented"))
