"""Vectors as short codes: integer product quantisation with a Walsh-Hadamard transform.

A component x becomes the integer floor(1024 x); a vector is cut into equal consecutive parts, and each part becomes the
index of its nearest codebook entry. Parts and entries are padded with zeros to a power of two n and transformed by an
integer Walsh-Hadamard transform, which scales every squared distance by n. Squared differences accumulate in sequency
order (slow sign patterns first); an entry whose sum exceeds the whole distance of a first guess is out. All distances
are integers: 64 bits while they are sure to fit, Python's integers for the rows where they might not.

Every round is one pass over the table: each task adds up the parts that go to an entry, and sends one row for each entry
it used. What reaches the driver is the codebooks: parts x entries x part length, whatever the number of rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, sized, stash, table

SLICE = 512  # rows compared with all entries at a time


@functools.cache
def sequency(n: int) -> np.ndarray:
    """Where the patterns of the plain butterfly order stand by number of sign changes; n is a power of two."""
    at = np.arange(n)
    ones = lambda v: np.array([bin(x).count("1") & 1 for x in v.ravel().tolist()], int).reshape(v.shape)
    signs = ones(at[:, None] & at)
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def walsh(x: np.ndarray) -> np.ndarray:
    """The transform of the rows, padded with zeros to a power of two, in sequency order."""
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), n), x.dtype)
    out[:, : x.shape[1]] = x
    half = 1
    while half < n:
        pairs = out.reshape(len(x), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return out[:, sequency(n)]


def integers(column: pa.Array, length: int) -> np.ndarray:
    """floor(1024 x) of a list column, shorter vectors padded with zeros; objects where 64 bits might not do."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(float), column.value_lengths().to_numpy()
    x = np.zeros((len(column), length))
    x[np.arange(length) < sizes[:, None]] = values
    if np.abs(x).max(initial=0) < 2**40:
        return np.floor(x * 1024).astype(np.int64)  # a product with a power of two is exact
    return np.array([[math.floor(Fraction(v) * 1024) for v in row] for row in x.tolist()], object)


class Book:
    """The entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # Python integers
        n = 1 << max(0, entries.shape[1] - 1).bit_length()
        self.n, self.limit = n, 2**30 // n  # (2 n limit) squared is below 2**63, and so is every scaled distance
        self.small = bool(np.abs(entries).max(initial=0) <= self.limit)
        self.turned = walsh(entries.astype(np.int64) if self.small else entries)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lower one) and the squared distance, for each row."""
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        large = (np.abs(x).max(axis=1, initial=0) > self.limit).astype(bool) if self.small else np.ones(len(x), bool)
        for rows, kind in ((np.flatnonzero(~large), np.int64), (np.flatnonzero(large), object)):
            turned = self.turned.astype(kind) if len(rows) else None
            for at in range(0, len(rows), SLICE):
                part = rows[at : at + SLICE]
                index[part], distance[part] = self._nearest(walsh(x[part].astype(kind)), turned)
        return index, distance

    def _nearest(self, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lead = max(1, self.n // 4)
        sums = np.zeros((len(x), len(entries)), x.dtype)
        for j in range(lead):
            sums += (x[:, j, None] - entries[None, :, j]) ** 2
        guess = np.argmin(sums, axis=1)
        bound = ((x - entries[guess]) ** 2).sum(axis=1)
        row, entry = np.nonzero((sums <= bound[:, None]).astype(bool))  # by row, then by entry; the guess itself is among them
        left = sums[row, entry]
        for j in range(lead, self.n):
            left = left + (x[row, j] - entries[entry, j]) ** 2
            stay = (left <= bound[row]).astype(bool)
            row, entry, left = row[stay], entry[stay], left[stay]
        starts = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(left, starts)
        hits = np.flatnonzero((left == best[row]).astype(bool))
        first = hits[np.searchsorted(row[hits], np.arange(len(x)))]
        return entry[first], left[first] // self.n


def kept(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    good = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"), "label").where(good)


def first_books(good: DataFrame, parts: int, entries: int, length: int) -> list[Book]:
    """The parts of the rows with the smallest ids."""
    rows = good.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    x = integers(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), length)
    return [Book(x[:, a : a + length // parts].astype(object)) for a in range(0, length, length // parts)]


def moved(good: DataFrame, books: list[Book], length: int) -> list[Book]:
    """The books after one round: every entry at the floor of its parts' mean, unused ones where they were."""
    width = length // len(books)

    def add_up(batches):
        sums = [np.zeros(b.entries.shape, object) for b in books]
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        for batch in batches:
            x = integers(batch.column(0), length)
            for k, book in enumerate(books if len(x) else []):
                part = x[:, k * width : (k + 1) * width]
                near, _ = book.nearest(part)
                order = np.argsort(near, kind="stable")
                used, starts = np.unique(near[order], return_index=True)
                sums[k][used] += np.add.reduceat(part[order], starts, axis=0).astype(object)
                counts[k] += np.bincount(near, minlength=len(counts[k]))
        used = [(k, int(j)) for k in range(len(books)) for j in np.flatnonzero(counts[k])]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in used], pa.int32()), pa.array([j for _, j in used], pa.int32()), pa.array([int(counts[k][j]) for k, j in used], pa.int64()), pa.array([",".join(map(str, sums[k][j])) for k, j in used], pa.string())], names=["part", "entry", "n", "sums"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:  # of a few entries, a row for each task at most
        made = []
        for (k, j), own in rows.groupby(["part", "entry"]):
            n, sums = int(own["n"].sum()), [0] * width
            for s in own["sums"]:
                sums = [a + int(b) for a, b in zip(sums, s.split(","), strict=True)]
            made.append((k, j, ",".join(str(s // n) for s in sums)))
        return pd.DataFrame(made, columns=["part", "entry", "means"])

    partial = good.select("embedding").mapInArrow(add_up, "part int, entry int, n long, sums string")
    new = [b.entries.copy() for b in books]
    for r in partial.groupBy("part", F.col("entry") % 16).applyInPandas(total, "part int, entry int, means string").collect():  # parts x entries rows
        new[r["part"]][r["entry"]] = [int(v) for v in r["means"].split(",")]
    return [Book(e) for e in new]


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for each vector without null or non-finite components.

    vectors (vec_id, embedding, label) may have other columns, which are left out. Rows with a null vec_id are coded too
    and come last in the order of ids; rows that share a vec_id are coded each for itself, and stand by vector in that
    order. Vectors of several lengths, or of one that ``parts`` does not divide, count as padded with zeros to the next
    length that it does. Fewer than ``entries`` rows make smaller books; an empty table gives an empty result. An error that
    64 bits can't hold is null, and so is the sum over its label.
    """
    spark = vectors.sparkSession
    good = kept(vectors)
    longest = good.agg(F.max(F.size("embedding")).alias("n")).first()["n"]
    length = parts * max(1, -(-(longest or 0) // parts))
    books = first_books(good, parts, entries, length) if longest is not None else []
    for _ in range(rounds if books else 0):
        books = moved(good, books, length)
    width = length // parts

    def code(batch):
        x = integers(batch.column("embedding"), length)
        found = [b.nearest(x[:, k * width : (k + 1) * width]) for k, b in enumerate(books)]
        errors = [sum(int(d[j]) for _, d in found) for j in range(len(x))]
        return {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": ["".join(f"{int(near[j]):02x}" for near, _ in found) for j in range(len(x))], "error": [e if e < 2**63 else None for e in errors]}

    kind = vectors.schema["label"].dataType.simpleString()
    coded = stash(map_batches(good, code, f"vec_id long, label {kind}, code string, error long"))
    whole = F.when(F.count("error") == F.count("*"), F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)"))
    sums = coded.groupBy(F.col("label").alias("its")).agg(whole.alias("label_error"))
    digest = hashlib.sha256(",".join(str(v) for b in books for row in b.entries for v in row).encode()).hexdigest()
    return coded.join(sized(sums), F.col("label").eqNullSafe(F.col("its")), "left").select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_walsh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings")).drop("label")


def _rounds(rounds: int = 4) -> str:
    near = lambda book: f"SELECT id, part, entry, d FROM (SELECT id, part, entry, d, row_number() OVER (PARTITION BY id, part ORDER BY d, entry) AS r FROM (SELECT id, part, entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS d FROM parts p JOIN {book} b USING (part, pos) GROUP BY ALL)) WHERE r = 1"
    out = ["book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, pos, x FROM parts WHERE id <= 256)"]
    for k in range(rounds):
        out.append(f"near{k} AS MATERIALIZED ({near(f'book{k}')})")
        out.append(f"mean{k} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM parts JOIN near{k} USING (id, part) GROUP BY ALL)")
        out.append(f"book{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM book{k} LEFT JOIN mean{k} USING (part, entry, pos))")
    return ", ".join([*out, f"final AS MATERIALIZED ({near(f'book{rounds}')})"])


ORACLE = f"""WITH good AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS id FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  flat AS (SELECT id, unnest(range(len(embedding))) AS k, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x, len(embedding) AS n FROM good),
  parts AS MATERIALIZED (SELECT id, (k // (n // 4)) AS part, k % (n // 4) AS pos, x FROM flat), {_rounds()},
  coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM final GROUP BY id),
  hashed AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS h FROM book4)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM good JOIN coded USING (id), hashed"""
