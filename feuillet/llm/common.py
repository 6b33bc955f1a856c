"""Helpers that several of the operators share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and is local itself (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        set_before = context._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="spark-feuillet-")
        context.setCheckpointDir(folder)
    return folder


def stash(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: the lineage ends here, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed = path
    return out


def discard(*stashes: DataFrame) -> None:
    """Delete what ``stash`` wrote, once nothing that is still to run reads it."""
    for df in stashes:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stashed)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """To be broadcast while it has at most ``most`` rows of a few numbers; else the join is shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict | Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with ``f``: a batch in, columns by name out (or several such)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(functools.partial(_run, f, arrow), schema)


SLICE = 1024  # rows whose Python values are in memory at a time


def _run(f, arrow, batches):
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            made = f(whole.slice(at, SLICE))
            for columns in [made] if isinstance(made, dict) else made:
                arrays = [_array(columns[field.name], field.type) for field in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)


def _array(values, kind):
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null texts count as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def components(edges: DataFrame, rounds: int = 60, most: int = 1_000_000) -> DataFrame:
    """Connected components of ``edges`` (a, b): (id, component_id), the smallest id reachable; ids without an edge don't appear.

    Each round, every id takes the smallest label among its own and its neighbours', and then that label's own label,
    so stars take one round and a chain of n about log n. Nothing is collected; every round is written to the shared
    folder. Labels are broadcast while there are at most ``most``, else the joins are shuffled.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    links = stash(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    before = labels = stash(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    side = F.broadcast if labels.count() <= most else lambda df: df
    for _ in range(rounds):
        near = links.join(side(labels.select(F.col("id").alias("b"), "label")), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = near.join(side(labels), "id").select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("next"))
        new = stash(low.join(side(jump), "low", "left").select("id", "label", F.least("low", F.coalesce("next", "low")).alias("new")))
        discard(before)
        before, labels = new, new.select("id", F.col("new").alias("label"))
        if not new.where("new <> label").limit(1).count():
            discard(links)
            return labels.withColumnRenamed("label", "component_id")
    raise RuntimeError("components: not stable after so many rounds")
