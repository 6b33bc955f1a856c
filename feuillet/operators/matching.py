"""What pairs have in common: the block-matching ratio for many pairs at once, and joins whose frequent keys are dealt out."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LONG = 200  # letters from which on the measure leaves out frequent ones
AT_ONCE = 4096  # pairs in one matrix


def codes(texts: list[str], fill: int) -> np.ndarray:
    """Code points, a text to a row, filled up with ``fill``."""
    out = np.full((len(texts), max(map(len, texts), default=0)), fill, np.int64)
    for k, t in enumerate(texts):
        out[k, : len(t)] = [ord(c) for c in t]
    return out


def matched(a: list[str], b: list[str]) -> np.ndarray:
    """Letters in the common blocks of each pair: the longest block (of equals the first in a, then in b), and so on before and after it.

    All pairs go through the same steps together: per letter of a, one row of run lengths for every open stretch.
    """
    x, y = codes(a, -1), codes(b, -2)
    total = np.zeros(len(a), np.int64)
    pair = np.arange(len(a))
    alo, blo = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    ahi, bhi = np.array([len(t) for t in a], np.int64), np.array([len(t) for t in b], np.int64)
    place = np.arange(y.shape[1])
    while len(pair):
        size, at_a, at_b = (np.zeros(len(pair), np.int64) for _ in range(3))
        inside = (place >= blo[:, None]) & (place < bhi[:, None])
        runs = np.zeros((len(pair), y.shape[1] + 1), np.int64)
        rows = y[pair]
        for i in range(int(alo.min(initial=0)), int(ahi.max(initial=0))):
            same = (rows == x[pair, i][:, None]) & inside & ((alo <= i) & (i < ahi))[:, None]
            runs[:, 1:] = np.where(same, runs[:, :-1] + 1, 0)
            best = runs[:, 1:].argmax(axis=1)
            longest = runs[np.arange(len(pair)), best + 1]
            more = longest > size
            size[more], at_a[more], at_b[more] = longest[more], i + 1 - longest[more], best[more] + 1 - longest[more]
        np.add.at(total, pair, size)
        found = size > 0
        left, right = found & (alo < at_a) & (blo < at_b), found & (at_a + size < ahi) & (at_b + size < bhi)
        pair, alo, ahi, blo, bhi = (
            np.concatenate(v) for v in ((pair[left], pair[right]), (alo[left], (at_a + size)[right]), (at_a[left], ahi[right]), (blo[left], (at_b + size)[right]), (at_b[left], bhi[right]))
        )
    return total


def ratios(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """2 M / T of each pair, with M letters in common blocks and T letters in all; 1 for two empty texts, NaN where one is null."""
    out = np.full(len(a), np.nan)
    known = [k for k, (s, t) in enumerate(zip(a, b, strict=True)) if s is not None and t is not None]
    short = [k for k in known if len(a[k]) < LONG and len(b[k]) < LONG]
    for k in set(known) - set(short):
        out[k] = difflib.SequenceMatcher(None, a[k], b[k]).ratio()
    short.sort(key=lambda k: (len(b[k]), len(a[k])))  # of like lengths together: little is filled up
    for at in range(0, len(short), AT_ONCE):
        part = short[at : at + AT_ONCE]
        s, t = [a[k] for k in part], [b[k] for k in part]
        letters = np.array([len(u) + len(v) for u, v in zip(s, t, strict=True)])
        out[part] = np.where(letters > 0, 2 * matched(s, t) / np.maximum(letters, 1), 1.0)
    return out


@F.pandas_udf(DoubleType())
def string_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratios`` as a column, the one measure here that has no SQL form; nulls give null."""
    return pd.Series(ratios(a.where(a.notna(), None).tolist(), b.where(b.notna(), None).tolist()), dtype="float64")


def meet(a: DataFrame, b: DataFrame, key: str, size: int = 2000) -> DataFrame:
    """a and b joined on ``key``, the only column they share; a key with many rows is dealt over a grid of cells.

    Where a key has more than ``size`` rows on a side, both sides' rows go to blocks by hash, a's to each cell of its row
    of the grid and b's to each of its column: every two rows meet in exactly one cell. Rare keys have one cell.
    """
    counts = a.groupBy(key).agg(F.count("*").alias("rows")).unionByName(b.groupBy(key).agg(F.count("*").alias("rows")))
    heavy = counts.where(F.col("rows") > size).groupBy(F.col(key).alias("heavy_key")).agg(F.ceil(F.max("rows") / size).cast("int").alias("blocks"))
    heavy = F.broadcast(heavy) if heavy.count() <= 1_000_000 else heavy

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        columns = df.columns
        x = df.join(heavy, F.col(key) == F.col("heavy_key"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        hashed = F.pmod(F.xxhash64(*columns), F.col("blocks")).cast("int")
        return x.select(*columns, hashed.alias(own), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(other))

    return dealt(a, "cell_a", "cell_b").join(dealt(b, "cell_b", "cell_a"), [key, "cell_a", "cell_b"]).drop("cell_a", "cell_b")


AT_A_TASK = 250_000  # rows, where their number is known


def looked_up(df: DataFrame, key: str, row: str, others: DataFrame, other_key: str, rows: int = 0) -> DataFrame:
    """A left join of df's ``key`` with ``other_key``, which df does not have.

    Rows without a key match nothing and are dealt by ``row``, or all of them would be one task's. The others, which are
    fewer, are hashed, so that no task sorts its rows of df. Where df has many ``rows``, tasks are not merged by their
    compressed size: such a task may have millions, and the next shuffle gathers them in memory.
    """
    df = df.withColumn("dealt", F.coalesce(F.col(key), -1 - F.col(row)))
    if rows > AT_A_TASK * df.sparkSession.sparkContext.defaultParallelism:
        df = spread(df, "dealt", rows=rows)
    return df.join(others.hint("shuffle_hash"), (F.col("dealt") == F.col(other_key)) & F.col(key).isNotNull(), "left").drop("dealt", other_key)


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Rows of equal keys together, over as many tasks as ``spark.sql.shuffle.partitions`` says, or more for ``rows`` in all.

    A shuffle without a number may be merged to few tasks by its compressed size, and sorted texts of a register take
    over ten times that in memory.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-rows // AT_A_TASK)), *keys)
