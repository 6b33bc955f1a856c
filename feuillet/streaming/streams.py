"""Structured Streaming jobs: ingest, one pass for each source, registry counts, running statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from feuillet.operators.extract import NAME


def ingest_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """New Parquet files of documents -> their names (doc_id, full_name), appended; what was read once is not read again."""
    docs = spark.readStream.schema(schema).parquet(in_dir)
    names = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{NAME}(?: {NAME})+"), F.lit(0))).alias("full_name"))
    return names.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_source_stream(docs: DataFrame, delay: str = "1 day") -> DataFrame:
    """docs (ts, text, ...) with each text once within the watermark; later copies and late rows go."""
    return docs.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("source_id", F.substring(F.md5("text"), 1, 16)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source_id"])


def registry_counts(names: DataFrame) -> DataFrame:
    """names (full_name, ts, source) -> for each normalized name: hits, when and under what spelling it was first seen, and its sources.

    Rows without a name or a time are left out.
    """
    first = F.min(F.struct(F.col("ts").alias("first_seen"), F.col("full_name").alias("first_name"))).alias("first")
    known = names.where("full_name is not null and ts is not null")
    return known.groupBy(F.lower("full_name").alias("key")).agg(F.count("*").alias("hits"), first, F.array_sort(F.collect_set("source")).alias("sources")).select("key", "hits", "first.first_seen", "first.first_name", "sources")


ENTRY = "hits long, first_seen long, first_name string"  # first_seen in microseconds


class Registry(StatefulProcessor):
    """A name's entry as value state, its sources as list state; each batch gives out the entries that it changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", ENTRY)
        self.sources = handle.getListState("sources", "source string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hits, seen, name = self.entry.get() or (0, None, None)
        known = [s for (s,) in self.sources.get()]
        new = set()
        for part in rows:
            hits += int(part["hits"].sum())
            seen, name = min([(int(s), n) for s, n in zip(part["first_seen"], part["first_name"], strict=True)] + ([] if seen is None else [(seen, name)]))
            new.update(s for own in part["sources"] for s in own)
        new -= set(known)
        self.entry.update((hits, seen, name))
        if new:
            self.sources.appendList([(s,) for s in sorted(new)])
        yield pd.DataFrame({"key": [key[0]], "hits": [hits], "first_seen": [seen], "first_name": [name], "sources": [sorted({*known, *new})]})

    def close(self) -> None:
        pass


def _by_name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each name of a batch of rows, so that a frequent one doesn't send all its rows to one task."""
    for f in frames:
        first = f.sort_values(["first_seen", "first_name"]).drop_duplicates("key").set_index("key")[["first_seen", "first_name"]]
        groups = f.groupby("key")
        own = groups["source"].agg(lambda s: sorted(set(s.dropna())))
        yield first.assign(hits=groups.size(), sources=own).reset_index()[["key", "hits", "first_seen", "first_name", "sources"]]


def registry_updates(names: DataFrame) -> DataFrame:
    """A stream of names (full_name, ts, source) -> the entries that change, as in ``registry_counts``; output mode update."""
    rows = names.where("full_name is not null and ts is not null").select(F.lower("full_name").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("first_seen"), F.col("full_name").alias("first_name"), "source")
    schema = "key string, hits long, first_seen long, first_name string, sources array<string>"
    states = rows.mapInPandas(_by_name, schema).groupBy("key").transformWithStateInPandas(Registry(), schema, "Update", "None")
    return states.withColumn("first_seen", F.timestamp_micros("first_seen"))


def registry_upsert_stream(names: DataFrame, checkpoint: str, keep: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs ``registry_updates`` over what is there now. The registry is the state that the checkpoint keeps: a later run
    goes on from it, and a batch that runs again after a failure counts once. ``keep`` gets each batch's changed entries."""
    spark = names.sparkSession
    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind)
    spark.conf.set(kind, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # state of several kinds asks for it
    try:
        out = registry_updates(names).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return (out.foreachBatch(keep) if keep else out.format("noop")).start()
    finally:
        spark.conf.set(kind, before)


def registry_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The registry as of the last batch, read from the state itself."""
    state = lambda name: spark.read.format("statestore").option("stateVarName", name)
    entries = state("entry").load(checkpoint).select("key.key", "value.*")
    sources = state("sources").option("flattenCollectionTypes", True).load(checkpoint).select("key.key", "list_element.source").groupBy("key").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    both = entries.join(sources, "key", "left").withColumn("first_seen", F.timestamp_micros("first_seen"))
    return both.select("key", "hits", "first_seen", "first_name", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def running_stats(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling windows; as a stream, a window comes out once it is past the watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.withWatermark("ts", delay) if events.isStreaming else events
    return w.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
