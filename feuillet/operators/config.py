"""Settings of a run: thresholds, which checks to make, and a user's own abbreviations and places."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feuillet.operators.family import validate_person_chronology
from feuillet.operators.resolve import duplicate_clusters, similar_names, validate_gender


@dataclasses.dataclass(frozen=True)
class Config:
    """What a JSON file may set; keys it doesn't know (sizes of caches and batches) have no use in a Spark job and are ignored."""

    similarity_threshold: float = 0.85
    homonym_threshold: float = 0.95
    chronology_validation: bool = True
    gender_validation: bool = True
    abbreviations: dict[str, str] = dataclasses.field(default_factory=dict)
    known_places: tuple[str, ...] = ()

    @staticmethod
    def read(spark: SparkSession, path: str) -> Config:
        """From a JSON file, or a folder that ``write`` made, on any store that Spark reads."""
        text = spark.read.text(path, wholetext=True).agg(F.max("value")).first()[0]
        known = {f.name for f in dataclasses.fields(Config)}
        values = {k: v for k, v in json.loads(text or "{}").items() if k in known and v is not None}
        return Config(**values | {"known_places": tuple(values.get("known_places", ()))})

    def write(self, spark: SparkSession, path: str) -> None:
        text = json.dumps(dataclasses.asdict(self), ensure_ascii=False, sort_keys=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def with_abbreviations(c: Column, config: Config) -> Column:
    """The words that are a user's abbreviations in full; others, and a null text, stay."""
    words = F.split(c, " ")
    full = lambda w: F.coalesce(*[F.when(w == k, v) for k, v in config.abbreviations.items()], w)
    return F.array_join(F.transform(words, full), " ")


def known_place(c: Column, config: Config) -> Column:
    """Whether a place is among those a user knows, in any case; null for null."""
    return F.lower(c).isin(*[p.lower() for p in config.known_places])


def name_pairs(persons: DataFrame, config: Config) -> DataFrame:
    """name_a, name_b, score: the names alike by the configured similarity."""
    return similar_names(persons.select(F.concat_ws(" ", "prenom", "nom").alias("name")), config.similarity_threshold)


def homonym_clusters(persons: DataFrame, config: Config) -> DataFrame:
    """person_id, cluster_id: likely duplicates by the configured threshold."""
    return duplicate_clusters(persons, config.homonym_threshold)


def registry_checks(persons: DataFrame, config: Config) -> DataFrame:
    """person_id, check, rule, severity, penalty: the findings of the checks that are switched on; none if all are off."""
    runs = {
        "chronology": (config.chronology_validation, lambda: validate_person_chronology(persons)),
        "gender": (config.gender_validation, lambda: validate_gender(persons, persons.select("person_id", F.col("sexe").alias("gender")))),
    }
    found = [f().select("person_id", F.lit(name).alias("check"), "rule", "severity", "penalty") for name, (on, f) in runs.items() if on]
    out = found[0] if found else validate_person_chronology(persons.limit(0)).select("person_id", F.lit("").alias("check"), "rule", "severity", "penalty")
    for one in found[1:]:
        out = out.unionByName(one)
    return out
