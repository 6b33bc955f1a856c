"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters and marks are lower-cased, everything else is a space, runs of spaces are one. N-grams of 1 to 4 characters are
hashed into buckets. Training is one pass: each task counts its n-grams by (language, bucket) and sends its non-zero cells;
their sums make the matrix of log probabilities, which is broadcast. Its cells are bounded (``CELLS``): more languages
mean fewer buckets. Scoring takes the n-grams of many texts at once as the rows of a sparse matrix with unit entries and
sums the matrix rows they point to, text by text; long texts go piece by piece, so memory doesn't grow with a text's n-grams.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, texts

ORDERS = 4
MOST_BITS = 16  # buckets: 2**16 at most
CELLS = 1 << 22  # languages x buckets
PIECE = 1 << 16  # characters at a time
SPACE = 32


@functools.cache
def fold() -> np.ndarray:
    """Code point -> what counts for it: the lower-case letter or mark, else a space."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            out[c] = ord(chr(c).lower()[0])
    return out


def normal(text: str) -> np.ndarray:
    """Folded code points with a space before and after, and 0 as the end mark."""
    codes = fold()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")]
    stay = np.ones(len(codes), bool)
    stay[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    return np.append(codes[stay], np.uint32(0))


def pieces(values: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, text number, may an n-gram start here), about PIECE characters at a time."""
    held, size = [], 0
    for k, text in enumerate(values):
        codes = normal(text)
        for at in range(0, len(codes), PIECE):
            part = codes[at : at + PIECE + ORDERS - 1]  # the rest starts in the next piece
            held.append((part, np.full(len(part), k), np.arange(len(part)) < PIECE))
            size += len(part)
            if size >= PIECE:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def grams(values: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of all n-grams, in order of texts, one order of n-grams of one piece at a time."""
    for codes, text, starts in pieces(values):
        h, ok = np.zeros(len(codes), np.uint32), starts
        for n in range(1, ORDERS + 1):
            c = codes[n - 1 :]
            h, ok = h[: len(c)] * np.uint32(0x01000193) ^ c, ok[: len(c)] & (c != 0)
            use = ok & (codes != SPACE) if n == 1 else ok
            mixed = (h[use] + np.uint32(n * 0x7F4A7C15 % 2**32)) * np.uint32(0x9E3779B1)
            yield (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(32 - bits), text[: len(c)][use]


class Model:
    """Languages in order, and their log probabilities by bucket."""

    def __init__(self, languages: list[str], documents: np.ndarray, counts: np.ndarray, smoothing: float = 0.5):
        self.languages, self.bits = languages, int(counts.shape[1]).bit_length() - 1
        self.prior = np.log(documents / documents.sum()) if len(languages) else np.zeros(0)
        total = counts.sum(axis=1, keepdims=True) + smoothing * counts.shape[1]
        self.matrix = np.ascontiguousarray(np.log((counts + smoothing) / total).T)  # bucket x language

    def scores(self, values: list[str]) -> np.ndarray:
        """Log of prior times likelihood, text by language."""
        out = np.tile(self.prior, (len(values), 1))
        step = max(1024, (1 << 21) // len(self.languages))
        for bucket, text in grams(values, self.bits):
            for at in range(0, len(bucket), step):
                own = text[at : at + step]
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
                out[own[starts]] += np.add.reduceat(self.matrix[bucket[at : at + step]], starts, axis=0)
        return out

    def predict(self, values: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language (ties: the first by name) and its posterior probability."""
        s = self.scores(values)
        best = s.argmax(axis=1)
        return [self.languages[b] for b in best], 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)


def fit(labelled: DataFrame) -> Model:
    """Counts over all rows of labelled (text, lang); rows without lang are left out, null texts count as empty."""
    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(CELLS >> 8).collect()}
    if len(sizes) == CELLS >> 8:
        raise ValueError(f"fit: more than {(CELLS >> 8) - 1} languages")
    languages = sorted(sizes)
    bits = min(MOST_BITS, (CELLS // max(1, len(languages))).bit_length() - 1)
    number = {name: k for k, name in enumerate(languages)}

    def count(batches):
        cells = np.zeros(len(languages) << bits, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = np.array([number[v] for v in part.column(1).to_pylist()], np.int64)
                for bucket, text in grams(texts(part), bits):
                    np.add.at(cells, (own[text] << bits) + bucket, 1)
        found = np.flatnonzero(cells)
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cells[part])], names=["cell", "n"])

    sums = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    cells = np.zeros(len(languages) << bits, np.int64)
    cells[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return Model(languages, np.array([sizes[v] for v in languages], float), cells.reshape(len(languages), 1 << bits))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs + lang_pred, score: `und` with score 0 where the text is null or has no letter, or where nothing was learned."""

    keep = [f for f in docs.schema if f.name not in ("lang_pred", "score")]
    mark = "lettered" + "_" * max(len(f.name) for f in keep)  # no column's name

    def predict(batch):
        own = np.flatnonzero(batch.column(mark).to_numpy(zero_copy_only=False)) if model.languages else []
        names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
        if len(own):
            found, scores[own] = model.predict(texts(batch.take(pa.array(own))))
            for k, name in zip(own, found, strict=True):
                names[k] = name
        return {"lang_pred": names, "score": scores, **{f.name: batch.column(f.name) for f in keep}}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    plain = docs.select(*(f"`{f.name}`" for f in keep), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(mark))
    return map_batches(plain, predict, f"{fields}, lang_pred string, score double")


def op12_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents that aren't held out. A null doc_id is not held out; repeated rows are each judged alike."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    model = fit(docs.where("not held_out").select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
