"""Entity resolution: similar names, homonyms, duplicates, the registry, and sex checks."""

from __future__ import annotations

import difflib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feuillet.functions.names import PARTICLES, normalization_confidence, normalize_person_name
from feuillet.functions.text import remove_accents, squeeze, words
from feuillet.operators.family import connected, written
from feuillet.operators.matching import meet, string_ratio


def full_name() -> Column:
    return F.concat_ws(" ", "prenom", "nom")


def folded(c: Column) -> Column:
    return F.lower(squeeze(c))


def without_particles(c: Column) -> Column:
    return F.array_join(F.filter(words(c), lambda w: ~w.isin(*PARTICLES)), " ")


def positional_similarity(a: Column, b: Column) -> Column:
    """Places with the same letter, by the greater length."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    return same / F.greatest(F.length(a), F.length(b))


def chunk_keys(s: Column, threshold: float) -> Column:
    """Keys of which two names at the threshold share one: for each greater length L that still can reach it, L places hold at most
    m = (1 - threshold) L that differ, so of m + 1 chunks one is the same in both."""
    lengths = F.sequence(F.length(s), F.floor(F.length(s) / threshold + 1e-9).cast("int"))
    parts = lambda n: F.floor((1 - threshold) * n + 1e-9).cast("int") + 1
    edge = lambda n, k: F.floor(k * n / parts(n)).cast("int")
    return F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(0), parts(n) - 1), lambda k: F.concat_ws("|", n, k, F.substring(s, edge(n, k) + 1, edge(n, k + 1) - edge(n, k))))))


def similar_names(names: DataFrame, threshold: float) -> DataFrame:
    """names (name) -> name_a < name_b, score: equal without particles, or alike place by place; lossless blocking, no all-pairs."""
    n = names.select(folded(F.col("name")).alias("n")).where("n <> ''").distinct()
    by_chunk = n.select("n", F.explode(chunk_keys(F.col("n"), threshold)).alias("key"))
    by_core = n.select("n", F.concat(F.lit("core|"), without_particles(F.col("n"))).alias("key"))
    keyed = by_chunk.unionByName(by_core)
    pairs = meet(keyed.select("key", F.col("n").alias("name_a")), keyed.select("key", F.col("n").alias("name_b")), "key").where("name_a < name_b").select("name_a", "name_b").distinct()
    score = positional_similarity(F.col("name_a"), F.col("name_b"))
    core = without_particles(F.col("name_a")) == without_particles(F.col("name_b"))
    return pairs.withColumn("score", F.round(F.when(core, 1.0).otherwise(score), 6)).where(F.col("score") >= threshold - 1e-9)


def similar_pairs(persons: DataFrame, threshold: float = 0.85) -> DataFrame:
    """id_a, id_b, score: persons with the same or a similar name, in star form.

    The persons of one name are a class, with the least person_id as its head. There is a row (head, person, 1.0) for each
    other member, and one for each two heads whose names are similar, the lesser id first: rows grow with persons and
    similar names. ``all_similar_pairs`` expands them. Empty names are like nobody's.
    """
    named = persons.select("person_id", folded(full_name()).alias("n")).where("n <> ''")
    heads = named.groupBy("n").agg(F.min("person_id").alias("head"))
    members = named.join(heads, "n").where("person_id <> head").select(F.col("head").alias("id_a"), F.col("person_id").alias("id_b"), F.lit(1.0).alias("score"))
    a, b = (heads.select(F.col("n").alias(f"name_{k}"), F.col("head").alias(k)) for k in "ab")
    links = similar_names(heads.select(F.col("n").alias("name")), threshold).join(a, "name_a").join(b, "name_b")
    return members.unionByName(links.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "score"))


def all_similar_pairs(persons: DataFrame, threshold: float = 0.85) -> DataFrame:
    """id_a < id_b, score of every two persons with the same or a similar name: as many rows as there are pairs."""
    named = persons.select("person_id", folded(full_name()).alias("n")).where("n <> ''")
    pairs = similar_names(named.select(F.col("n").alias("name")), threshold)
    both = pairs.unionByName(named.select(F.col("n").alias("name_a"), F.col("n").alias("name_b"), F.lit(1.0).alias("score")).distinct()).unionByName(pairs.select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), "score"))
    a, b = (named.select(F.col("person_id").alias(f"id_{k}"), F.col("n").alias(f"name_{k}")) for k in "ab")
    return both.join(a, "name_a").join(b, "name_b").where("id_a < id_b").select("id_a", "id_b", "score")


#: fixed values: forms of one first name
FIRST_VARIANTS = (("charles", "carl"), ("charles", "karol"), ("guillaume", "william"), ("guillaume", "willem"), ("jacques", "jacob"), ("jacques", "james"), ("jean", "john"), ("jean", "johan"), ("françois", "francis"), ("françois", "francisco"), ("marie", "maria"), ("marie", "mary"))


def glued(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit(""))


def no_de(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("de "), F.lit("")))


def y_i(c: Column) -> Column:
    return F.translate(F.lower(remove_accents(c)), "y", "i")


def plain(c: Column) -> Column:
    return remove_accents(F.lower(c))


def single(c: Column) -> Column:
    return reduce(lambda x, d: F.replace(x, F.lit(d * 2), F.lit(d)), "lnmtsr", F.lower(c))


def rule_boost(a: Column, b: Column, pa: Column, pb: Column) -> Column:
    """struct(boost, rules): equalities of derived keys that are known slips of transcription."""
    first = reduce(lambda x, v: x | ((F.lower(pa) == v[0]) & (F.lower(pb) == v[1])) | ((F.lower(pa) == v[1]) & (F.lower(pb) == v[0])), FIRST_VARIANTS, F.lit(False))
    rules = ((((glued(a) == glued(b)) & glued(a).startswith("de")) | (no_de(a) == F.lower(b)) | (no_de(b) == F.lower(a)), "de_prefix_correction", 0.95), (y_i(a) == y_i(b), "y_i_variation", 0.90), (plain(a) == plain(b), "accent_loss", 0.92), (single(a) == single(b), "consonant_variation", 0.88), (first, "firstname_variant", 0.85))
    return F.struct(F.greatest(F.lit(0.0), *[F.when(when, score).otherwise(0.0) for when, _, score in rules]).alias("boost"), F.array_join(F.array_compact(F.array(*[F.when(when, name) for when, name, _ in rules])), ",").alias("rules"))


def score_name_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (nom_a, prenom_a, nom_b, prenom_b) + similarity, confidence, rules."""
    r = rule_boost(F.col("nom_a"), F.col("nom_b"), F.col("prenom_a"), F.col("prenom_b"))
    x = pairs.withColumns({"r": r, "rn": string_ratio(F.lower("nom_a"), F.lower("nom_b")), "rp": string_ratio(F.lower("prenom_a"), F.lower("prenom_b"))})
    s = 0.6 * F.greatest("rn", F.col("r.boost")) + 0.4 * F.col("rp")
    return x.select(*pairs.columns, F.round(s, 4).alias("similarity"), F.round(F.least(F.lit(1.0), s + F.when(F.col("r.rules") != "", 0.05).otherwise(0.0)), 4).alias("confidence"), F.col("r.rules").alias("rules"))


def rule_keys(c: Column) -> Column:
    """Keys of which two family names share one if a rule of ``rule_boost`` joins them."""
    forms = {"g": glued(c), "d": no_de(c), "y": y_i(c), "p": plain(c), "s": single(c)}
    return F.array(*[F.concat(F.lit(f"{k}|"), f) for k, f in forms.items()], F.concat(F.lit("d|"), F.lower(c)))


def letters(c: Column) -> Column:
    """The letters with their occurrence, rare ones first: two words' common ones are at least those of their common blocks."""
    cs = F.filter(F.split(F.lower(c), ""), lambda x: x != "")
    rare = lambda x: F.when(F.instr(F.lit("easirtnoulcdmphgbvfqyjzxkw"), x) > 0, -F.instr(F.lit("easirtnoulcdmphgbvfqyjzxkw"), x)).otherwise(-100)
    marked = F.transform(cs, lambda x, i: F.struct(rare(x).alias("r"), x.alias("x"), F.size(F.filter(F.slice(cs, 1, i + 1), lambda y: y == x)).alias("n")))
    return F.transform(F.array_sort(marked), lambda m: F.concat(m["x"], m["n"]))


def near_words(a: DataFrame, b: DataFrame, least: float, rules: bool = False) -> DataFrame:
    """a and b (v) -> va, vb: all pairs whose ``string_ratio`` can reach ``least``, and those that a rule joins.

    A ratio of 2 M / T with M common letters leaves a word of n letters at least n * least / (2 - least) in common with
    the other, so one is among its first n - that + 1; the lengths and all common letters are compared after that.
    """

    def keyed(df: DataFrame, k: str) -> DataFrame:
        x = df.where("v is not null").distinct().select(F.col("v").alias(f"v{k}"), letters(F.col("v")).alias(f"l{k}"))
        n = F.size(f"l{k}")
        first = F.slice(f"l{k}", 1, (n - F.ceil(n * least / (2 - least) - 1e-9) + 1).cast("int"))
        keys = F.when(n == 0, F.array(F.lit(""))).otherwise(first) if least > 0 else F.array(F.lit(""))
        keys = F.concat(keys, rule_keys(F.col(f"v{k}"))) if rules else keys
        return x.select(f"v{k}", f"l{k}", F.explode(F.array_distinct(keys)).alias("key"))

    both = meet(keyed(a, "a"), keyed(b, "b"), "key")
    common = 2 * F.size(F.array_intersect("la", "lb")) >= least * (F.size("la") + F.size("lb")) - 1e-9
    return both.where(common | (F.substring("key", 2, 1) == "|") if rules else common).select("va", "vb").distinct()


def name_matches(targets: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Names of both (nom_a, prenom_a, nom_b, prenom_b, similarity): all pairs at the threshold. What the similarity asks of each part bounds the part's pairs."""
    a, b = (df.select(F.col("nom").alias(f"nom_{k}"), F.col("prenom").alias(f"prenom_{k}")).distinct() for df, k in ((targets, "a"), (candidates, "b")))
    pairs = []
    for part, weight, rules in (("nom", 0.6, True), ("prenom", 0.4, False)):
        least = (threshold - 1e-4 - (1 - weight)) / weight  # the other part gives at most its weight
        near = near_words(a.select(F.col(f"{part}_a").alias("v")), b.select(F.col(f"{part}_b").alias("v")), least, rules)
        pairs.append(near.select(F.col("va").alias(f"{part}_a"), F.col("vb").alias(f"{part}_b")))
    found = a.join(pairs[0], "nom_a").join(pairs[1], "prenom_a").join(b, ["nom_b", "prenom_b"]).select("nom_a", "prenom_a", "nom_b", "prenom_b")
    ratio = lambda v: max(difflib.SequenceMatcher(None, *w).ratio() for w in (v, v[::-1]))
    enough = [v for v in FIRST_VARIANTS if 0.6 * 0.85 + 0.4 * ratio(v) >= threshold - 1e-4]  # whatever the family names are: all these are told
    if enough:
        key = lambda c, turn: F.explode(F.array_compact(F.array(*[F.when(F.lower(c) == v[side ^ turn], f"{k} {side}") for k, v in enumerate(enough) for side in (0, 1)]))).alias("key")
        found = found.unionByName(meet(a.select("*", key("prenom_a", 0)), b.select("*", key("prenom_b", 1)), "key").select(*found.columns))
    return score_name_pairs(found.distinct()).where(F.col("similarity") >= threshold).drop("confidence", "rules")


def find_best_matches(targets: DataFrame, candidates: DataFrame, threshold: float = 0.85, k: int = 3) -> DataFrame:
    """target_id, candidate_id, score, rank: the k best of all candidates at the threshold, ties by candidate_id."""
    t = targets.select(F.col("person_id").alias("target_id"), F.col("nom").alias("nom_a"), F.col("prenom").alias("prenom_a")).distinct()
    c = candidates.select(F.col("person_id").alias("candidate_id"), F.col("nom").alias("nom_b"), F.col("prenom").alias("prenom_b")).distinct()
    own = F.row_number().over(Window.partitionBy("nom_b", "prenom_b").orderBy("candidate_id"))
    c = c.withColumn("own", own).where(F.col("own") <= k + 1).drop("own")  # of one name, no others can be among the k best
    rows = t.join(name_matches(targets, candidates, threshold), ["nom_a", "prenom_a"]).join(c, ["nom_b", "prenom_b"]).where("target_id <> candidate_id")
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("similarity"), "candidate_id"))
    return rows.select("target_id", "candidate_id", F.col("similarity").alias("score"), rank.alias("rank")).where(F.col("rank") <= k)


def jaccard_pairs(df: DataFrame, threshold: float, size: int = 2000) -> DataFrame:
    """df (id, name) -> id_a < id_b, score above ``threshold`` of word sets.

    Each set's rarest words are its keys, enough that two sets at the threshold share one. At a word that both have as a
    key, their sizes and what stands after it in both orders bound what they can have in common; only pairs that can
    reach the threshold go on to the comparison of whole sets. A word with more than ``size`` sets is dealt over cells.
    """
    sets = df.select("id", F.array_distinct(words(F.lower("name"))).alias("ws")).where(F.size("ws") > 0)
    tokens = sets.select("id", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    often = tokens.groupBy("w").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("c", "w"))
    keys = tokens.join(often, "w").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    a, b = (keys.select("w", F.col("id").alias(f"id_{k}"), F.col("n").alias(f"n_{k}"), F.col("place").alias(f"at_{k}")) for k in "ab")
    most = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # if this is the first that they share
    reach = (most * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-9) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    pairs = meet(a, b, "w", size).where((F.col("id_a") < F.col("id_b")) & reach).select("id_a", "id_b").distinct()
    sa, sb = (sets.select(F.col("id").alias(f"id_{k}"), F.col("ws").alias(f"w{k}")) for k in "ab")
    score = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    return pairs.join(sa, "id_a").join(sb, "id_b").select("id_a", "id_b", F.round(score, 6).alias("score")).where(F.col("score") > threshold)


def match_existing_person(incoming: DataFrame, registry: DataFrame, days: int = 365) -> DataFrame:
    """incoming and registry (id, name, born) -> id, match_id: the same words in the name, births within ``days`` or both unknown, the nearest and then the first.

    Distinct (name, birth) meet within reach, with the first two ids of each: bounded by the days in reach, not by how
    many have a name.
    """
    key = F.array_join(F.array_sort(F.array_distinct(words(F.lower("name")))), " ")
    slot = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / (days + 1))
    a, b = incoming.select("id", key.alias("key"), F.col("born").alias("a")), registry.select(F.col("id").alias("match_id"), key.alias("key"), F.col("born").alias("b"))
    first_two = lambda df, by, order: df.withColumn("k", F.dense_rank().over(Window.partitionBy("key", by).orderBy(*order))).where("k <= 2").drop("k")
    held = first_two(b, "b", ["match_id"]).withColumn("slot", F.coalesce(F.concat(F.lit("d"), slot("b")), F.lit("unknown")))
    reach = F.when(F.col("a").isNull(), F.array(F.lit("unknown"))).otherwise(F.array(*[F.concat(F.lit("d"), slot("a") + k) for k in (-1, 0, 1)]))
    met = a.select("key", "a").distinct().withColumn("slot", F.explode(reach)).join(held, ["key", "slot"]).withColumn("apart", F.coalesce(F.abs(F.datediff("a", "b")), F.lit(0))).where(F.col("apart") <= days)
    two = first_two(met, "a", ["apart", "match_id"]).select(F.col("key").alias("its_key"), F.col("a").alias("its_a"), "apart", "match_id")
    found = a.join(two, (F.col("key") == F.col("its_key")) & F.col("a").eqNullSafe(F.col("its_a"))).where("id <> match_id")
    return found.groupBy("id").agg(F.min_by("match_id", F.struct("apart", "match_id")).alias("match_id"))


def rewrite_ids(df: DataFrame, id_map: DataFrame, cols: list[str]) -> DataFrame:
    """id_map (old_id, new_id) applied to columns."""
    for c in cols:
        m = id_map.select(F.col("old_id").alias(c), F.col("new_id").alias("new"))
        df = df.join(m, c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    return df


def grouping_key() -> Column:
    return remove_accents(folded(full_name()))


def homonym_factors(persons: DataFrame) -> DataFrame:
    """One row for each name that several persons have: what sets them apart, and how surely they are different persons."""
    p = persons.withColumn("key", grouping_key())
    lands = p.select("key", "person_id", F.explode("terres").alias("land")).groupBy("key").agg(F.countDistinct("person_id").alias("landed"), F.countDistinct("land").alias("lands"), F.countDistinct("person_id", "land").alias("holdings"))
    has = lambda values: F.max(F.arrays_overlap("professions", F.array(*map(F.lit, values)))).alias
    g = p.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("deces").isNotNull().cast("int")).alias("deaths"), F.min("deces").alias("first_death"), F.max("naissance").alias("last_birth"), has(("curé", "prêtre", "vicaire"))("clergy"), has(("avocat", "marchand", "laboureur"))("secular"), F.countDistinct("statut").alias("statuses"), F.sum(F.size("professions") + F.size("terres") + F.col("naissance").isNotNull().cast("int") + F.col("deces").isNotNull().cast("int") + F.col("statut").isNotNull().cast("int")).alias("infos"))
    x = g.where("n > 1").join(lands, "key", "left").fillna(0, ["landed", "lands", "holdings"])
    rules = (((F.col("landed") > 1) & (F.col("lands") == F.col("holdings")), "terres_distinctes", 0.3), ((F.col("deaths") > 1) & (F.col("first_death") < F.col("last_birth")), "chronologie_distincte", 0.4), (F.col("clergy") & F.col("secular"), "professions_incompatibles", 0.3), (F.col("statuses") > 1, "statuts_differents", 0.1))
    score = sum((F.when(w, s).otherwise(0.0) for w, _, s in rules), F.lit(0.5)) - F.when(F.col("infos") < 2 * F.col("n"), 0.2).otherwise(0.0)
    return x.select("key", "n", F.array_join(F.array_compact(F.array(*[F.when(w, name) for w, name, _ in rules])), ",").alias("factors"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("confidence"))


def posting_lists(df: DataFrame, key: Column, item: str, size: int = 1000) -> DataFrame:
    """key, chunk, n (of the key, all chunks), ids: the items under each key in chunks of ``size`` consecutive numbers, so no row has more.

    Items are whole numbers; an item that stands under a key several times is listed as often.
    """
    x = df.select(key.alias("key"), F.col(item).alias("item")).where("key is not null and item is not null")
    chunks = x.groupBy("key", F.floor(F.col("item") / size).alias("chunk")).agg(F.count("*").alias("own"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("ids"))
    total = chunks.groupBy("key").agg(F.sum("own").alias("n"))
    return chunks.join(total, "key").select("key", "chunk", "n", "ids")


def homonym_groups(persons: DataFrame, size: int = 1000) -> DataFrame:
    """key, chunk, n, ids (joined): names with more than one person, their ids in chunks of ``size`` consecutive numbers."""
    return posting_lists(persons, grouping_key(), "person_id", size).where("n > 1")


def homonym_resolution(persons: DataFrame, least: float = 0.7) -> DataFrame:
    """person_id, strategy for the members of groups that are surely different persons."""
    g = homonym_factors(persons).where(F.col("confidence") >= least)
    x = persons.withColumn("key", grouping_key()).join(g.select("key", "factors"), "key")
    has = lambda f: F.col("factors").contains(f)
    ways = F.array_compact(F.array(F.when(has("terres_distinctes") & (F.size("terres") > 0), F.concat(F.lit("Distinguer par terres: sr de "), F.array_join("terres", ", "))), F.when(has("chronologie_distincte"), F.coalesce(F.concat(F.lit("Distinguer par chronologie: †"), "deces"), F.concat(F.lit("Distinguer par chronologie: *"), "naissance"))), F.when(has("professions_incompatibles") & (F.size("professions") > 0), F.concat(F.lit("Distinguer par profession: "), F.array_join("professions", ", ")))))
    return x.select("person_id", F.when(F.size(ways) > 0, F.array_join(ways, " | ")).otherwise("Ajouter un identifiant numérique").alias("strategy"))


def merge_name_groups(persons: DataFrame, threshold: float = 0.95) -> DataFrame:
    """key, group: homonym keys whose name pairs score at the threshold or more go together (all of a chain)."""
    names = persons.select(remove_accents(F.lower("nom")).alias("nom"), remove_accents(F.lower("prenom")).alias("prenom")).distinct().withColumn("person_id", F.xxhash64("nom", "prenom"))
    near = name_matches(names, names, threshold)
    groups = connected(near.select(F.xxhash64("nom_a", "prenom_a").alias("a"), F.xxhash64("nom_b", "prenom_b").alias("b")))
    return names.join(groups.withColumnRenamed("id", "person_id"), "person_id", "left").select(F.concat_ws(" ", "prenom", "nom").alias("key"), F.coalesce("group_id", "person_id").alias("group"))


def duplicate_links(classes: DataFrame, threshold: float = 0.90) -> DataFrame:
    """classes (n, born, place, head) -> a, b: heads of classes of similar names whose births and places don't differ where both are known.

    Not every such two classes are listed, but all that a chain of them joins stay joined. A class meets those that have
    its birth and place, or know less: at most four for each similar name. Where one knows only the birth and the other
    only the place, all of the two kinds fit each other, so each meets the first of the other kind.
    """
    names = classes.select(F.col("n").alias("name")).distinct()
    near = similar_names(names, threshold).select("name_a", "name_b")
    near = near.unionByName(near.select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"))).unionByName(names.select(F.col("name").alias("name_a"), F.col("name").alias("name_b")))
    a = classes.select(F.col("n").alias("name_a"), F.col("born").alias("born_a"), F.col("place").alias("place_a"), F.col("head").alias("a")).join(near, "name_a")
    less = F.array_distinct(F.array(*[F.struct((F.col("born_a") if x else F.lit(None).cast(classes.schema["born"].dataType)).alias("born"), (F.col("place_a") if y else F.lit(None).cast("string")).alias("place")) for x in (1, 0) for y in (1, 0)]))
    b = classes.select(F.col("n").alias("its_name"), F.col("born").alias("its_born"), F.col("place").alias("its_place"), F.col("head").alias("b"))
    asked = a.select("a", "name_b", F.explode(less).alias("k"))
    same = asked.join(b, (F.col("name_b") == F.col("its_name")) & F.col("k.born").eqNullSafe(F.col("its_born")) & F.col("k.place").eqNullSafe(F.col("its_place"))).select("a", "b")
    first = lambda known, k: classes.where(f"{known[0]} is not null and {known[1]} is null").groupBy(F.col("n").alias("name_b")).agg(F.min("head").alias(k))
    one = a.where("born_a is not null and place_a is null").join(first(("place", "born"), "b"), "name_b").select("a", "b")
    two = a.where("born_a is null and place_a is not null").join(first(("born", "place"), "b"), "name_b").select("a", "b")
    return same.unionByName(one).unionByName(two).where("a <> b").distinct()


def duplicate_clusters(persons: DataFrame, threshold: float = 0.90) -> DataFrame:
    """person_id, cluster_id (the least person_id): all that a chain of duplicates joins, similar names whose births and
    birth places don't differ. Persons of one name, birth and place are one node of the search, so its size doesn't
    grow with the square of their number. Empty names are like nobody's."""
    p = persons.select("person_id", folded(full_name()).alias("n"), F.col("naissance").alias("born"), F.lower("lieu_naissance").alias("place")).where("n <> ''")
    classes = written(p.groupBy("n", "born", "place").agg(F.min("person_id").alias("head"), F.count("*").alias("members")))
    groups = connected(duplicate_links(classes, threshold)).withColumnRenamed("id", "head")
    found = classes.join(groups, "head", "left").where("members > 1 or group_id is not null").select(F.col("n").alias("its_n"), F.col("born").alias("its_born"), F.col("place").alias("its_place"), F.coalesce("group_id", "head").alias("cluster_id"))
    same = (F.col("n") == F.col("its_n")) & F.col("born").eqNullSafe(F.col("its_born")) & F.col("place").eqNullSafe(F.col("its_place"))
    return p.join(found, same).select("person_id", "cluster_id")


def merge_records(persons: DataFrame, clusters: DataFrame) -> DataFrame:
    """One record for each cluster: all sources and professions, the first known birth and place in order of person_id."""
    x = persons.join(clusters, "person_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("person_id"))).alias(c)
    every = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), ",").alias(c)
    return x.groupBy("cluster_id").agg(F.count("*").alias("n"), first("naissance"), first("lieu_naissance"), every("sources"), every("professions"))


def person_confidence(persons: DataFrame) -> DataFrame:
    base = normalization_confidence(full_name(), normalize_person_name(full_name()))
    bonus = F.when(F.col("naissance").isNotNull(), 0.1).otherwise(0.0) + F.when(F.col("lieu_naissance").isNotNull(), 0.05).otherwise(0.0) + F.when(F.size("professions") > 0, 0.05).otherwise(0.0) + F.when(F.size("sources") > 1, 0.1).otherwise(0.0)
    return persons.select("person_id", F.round(F.least(F.lit(1.0), base - 0.5 + bonus), 4).alias("confidence"))


def find_or_create(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """names (name, sexe) -> normalized, sexe, person_key: a hash of the first of the names that are alike and of one sex."""
    n = names.select(normalize_person_name("name")["name"].alias("normalized"), "sexe").distinct().withColumn("key", folded(F.col("normalized"))).withColumn("id", F.xxhash64("key", "sexe"))
    pairs = similar_names(n.select(F.col("normalized").alias("name")), threshold)
    a, b = (n.select(F.col("key").alias(f"name_{k}"), "sexe", F.col("id").alias(k)) for k in "ab")
    groups = connected(pairs.join(a, "name_a").join(b, ["name_b", "sexe"]).select("a", "b"))
    grouped = n.join(groups, "id", "left").withColumn("group", F.coalesce("group_id", "id"))
    first = grouped.groupBy("group").agg(F.min("key").alias("first"))
    return grouped.join(first, "group").select("normalized", "sexe", F.substring(F.sha2(F.concat_ws("_", "first", "sexe"), 256), 1, 16).alias("person_key"))


def revalidate_registry(persons: DataFrame) -> DataFrame:
    """Counts: persons, names that change, persons that go into another record."""
    changed = persons.select((normalize_person_name(full_name())["name"] != full_name()).cast("long").alias("c")).agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    merged = duplicate_clusters(persons).where("person_id <> cluster_id").agg(F.count("*").alias("n"))
    row = lambda df, name, c: df.select(F.lit(name).alias("what"), F.col(c).alias("n"))
    return row(changed, "persons", "n").unionByName(row(changed, "renamed", "c")).unionByName(row(merged, "merged", "n"))


def duplicate_births(persons: DataFrame, threshold: float = 0.8) -> DataFrame:
    """key_a, born_a, key_b, born_b, score, each two in both orders: names (word sets, in order) with births that score more than the threshold.

    0.7 of the likeness of word sets, 0.3 of births within ten years. A threshold of 0.7 or more asks for births less than
    ten years apart, so a birth meets those of its own slot of ten years and of the two beside it only.
    """
    if threshold < 0.7:
        raise ValueError("duplicate_births: below 0.7 births don't bound the pairs")
    p = persons.where("naissance is not null").select(name_key().alias("key"), F.col("naissance").alias("born")).distinct()
    names = p.select("key").distinct()
    near = jaccard_pairs(names.select(F.col("key").alias("id"), F.col("key").alias("name")), (threshold - 0.3) / 0.7 - 1e-6)  # births give at most 0.3
    near = near.unionByName(near.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "score")).unionByName(names.select(F.col("key").alias("id_a"), F.col("key").alias("id_b"), F.lit(1.0).alias("score")))
    near = near.select(F.col("id_a").alias("key_a"), F.col("id_b").alias("key_b"), F.col("score").alias("alike"))
    slot = lambda c: F.floor(F.col(c) / 10)
    a = p.select(F.col("key").alias("key_a"), F.col("born").alias("born_a")).join(near, "key_a").withColumn("slot", F.explode(F.array(*[slot("born_a") + k for k in (-1, 0, 1)])))
    b = p.select(F.col("key").alias("key_b"), F.col("born").alias("born_b"), slot("born").alias("slot"))
    score = 0.7 * F.col("alike") + 0.3 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("born_a") - F.col("born_b")) / 10)
    return a.join(b, ["key_b", "slot"]).select("key_a", "born_a", "key_b", "born_b", F.round(score, 4).alias("score")).where(F.col("score") > threshold)


def detect_duplicates(persons: DataFrame, threshold: float = 0.8) -> DataFrame:
    """id_a, id_b, score: 0.7 of the name's word sets alike, 0.3 of births within ten years, at more than the threshold.

    Names and births meet first (``duplicate_births``); persons are put to those that do, so what is joined is what is told.
    """
    p = persons.where("naissance is not null").select("person_id", name_key().alias("key"), F.col("naissance").alias("born"))
    a, b = (p.select(F.col("key").alias(f"key_{k}"), F.col("born").alias(f"born_{k}"), F.col("person_id").alias(f"id_{k}")) for k in "ab")
    return duplicate_births(persons, threshold).join(a, ["key_a", "born_a"]).join(b, ["key_b", "born_b"]).where("id_a < id_b").select("id_a", "id_b", "score")


def name_key() -> Column:
    """The name's words, once each, in order."""
    return F.array_join(F.array_sort(F.array_distinct(words(F.lower(full_name())))), " ")


#: fixed values: phrases that mark a woman or a man
FEMININE = ("épouse de", "femme de", "veuve de", "fille de", "marraine", "dame", "demoiselle", "madame")
MASCULINE = ("époux de", "mari de", "veuf de", "fils de", "parrain", "sieur", "seigneur", "monsieur")


def gender_from_context(persons: DataFrame, contexts: DataFrame, window: int = 100) -> DataFrame:
    """contexts (person_id, text) -> person_id, gender by the phrases around the first mention; null if as many of both."""
    x = persons.select("person_id", F.lower(full_name()).alias("n")).join(contexts.select("person_id", F.lower("text").alias("t")), "person_id")
    at = F.instr(F.col("t"), F.col("n"))
    low = F.greatest(at - window, F.lit(1))
    near = F.substring("t", low, at + F.length("n") + window - low)
    count = lambda ps: sum((near.contains(p).cast("int") for p in ps), F.lit(0))
    return x.where(at > 0).select("person_id", F.when(count(FEMININE) > count(MASCULINE), "F").when(count(FEMININE) < count(MASCULINE), "M").alias("gender"))


def validate_gender(persons: DataFrame, genders: DataFrame) -> DataFrame:
    """person_id, rule, severity, penalty: titles and offices of men on women."""
    x = persons.join(genders.where("gender = 'F'").select("person_id"), "person_id", "left_semi")
    titled, priest = F.col("statut").isin("sieur", "seigneur", "écuyer"), F.arrays_overlap("professions", F.array(F.lit("curé"), F.lit("prêtre")))
    row = lambda w, rule, sev, p: F.when(w, F.struct(F.lit(rule).alias("rule"), F.lit(sev).alias("severity"), F.lit(p).alias("penalty")))
    return x.select("person_id", F.explode(F.array_compact(F.array(row(titled, "titre masculin", "error", 0.4), row(titled, "titre hérité", "warning", 0.1), row(priest, "profession masculine", "error", 0.3)))).alias("v")).select("person_id", "v.*")


def correct_gender_titles(persons: DataFrame, genders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons without the titles in error, and the corrections (person_id, old_statut)."""
    wrong = validate_gender(persons, genders).where("rule = 'titre masculin'").select("person_id").distinct()
    mark = persons.join(wrong.withColumn("wrong", F.lit(True)), "person_id", "left")
    return mark.withColumn("statut", F.when(F.col("wrong").isNull(), F.col("statut"))).drop("wrong"), mark.where("wrong").select("person_id", F.col("statut").alias("old_statut"))


def gender_from_relations(relations: DataFrame) -> DataFrame:
    """relations (order, person_id, role) -> person_id, gender by the first role that tells."""
    roles = {"pere": "M", "mere": "F", "parrain": "M", "marraine": "F", "fils": "M", "fille": "F", "epoux": "M", "epouse": "F"}
    told = relations.select("order", "person_id", F.element_at(F.create_map(*[F.lit(x) for p in roles.items() for x in p]), F.col("role")).alias("gender")).where("gender is not null")
    return told.groupBy("person_id").agg(F.min_by("gender", F.struct("order", "gender")).alias("gender"))


def inferred_sex() -> Column:
    """From professions, then titles; null where they don't tell."""
    has = lambda *v: F.arrays_overlap("professions", F.array(*map(F.lit, v)))
    return F.when(has("curé", "prêtre", "laboureur", "maçon", "charpentier"), "M").when(has("fileuse", "couturière", "ménagère"), "F").when(F.col("statut").isin("sieur", "seigneur", "écuyer"), "M").when(F.col("statut").isin("dame", "demoiselle"), "F")


def gedcom_gender(persons: DataFrame) -> DataFrame:
    return persons.select("person_id", inferred_sex().alias("sex"))
