"""Packing documents into sequences by non-negative least squares over the histogram of lengths.

A document's full windows fill sequences of their own; what is left of it (its tail) is shorter than a window. The
histogram of tail lengths is small whatever the corpus (one count for each length below the window), so the driver
plans on it alone: it enumerates shallow combinations of lengths that fill a window, solves for how often to repeat
each against the histogram, rounds down, packs the residual greedily by whole tails, and lays what still would leave
a gap end to end, to be cut at the window's edges. The plan says, for each length, which ranks go where. Ranks are
counted in parallel: by length and a hash of doc_id, so that a length that a third of all rows share is no hot key.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import encoder
from .common import map_batches, partitions, stash, table, texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
WINDOW = 1024
#: A greedy sequence may leave so many tokens open; with more to leave, its pieces are cut instead.
SLACK = 4


def combinations(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """Pairs that fill the window, then triples whose least part is a multiple of window / 64."""
    have, step = set(lengths), max(1, window // 64)
    found = [(window - b, b) for b in sorted(have) if 2 * b <= window and window - b in have]
    for c in range(step, window // 3 + 1, step):
        if c in have:
            found += [(window - b - c, b, c) for b in range(c, (window - c) // 2 + 1) if b in have and window - b - c in have]
    return found


def solve(combos: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = 12) -> list[float]:
    """Repeats x >= 0 with the least squares |A x - h|, by coordinate descent; A has a column for each combination."""
    columns = [list(Counter(c).items()) for c in combos]
    norms = [sum(k * k for _, k in column) for column in columns]
    x, left = [0.0] * len(combos), {n: float(c) for n, c in histogram.items()}
    for _ in range(sweeps):
        most = 0.0
        for i, column in enumerate(columns):
            new = max(0.0, x[i] + sum(k * left[n] for n, k in column) / norms[i])
            if step := new - x[i]:
                x[i] = new
                most = max(most, abs(step))
                for n, k in column:
                    left[n] -= k * step
        if most < 0.5:
            break
    return x


class Plan:
    """Where the tail of a given length and rank goes."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW, slack: int = SLACK):
        self.window, self.sequences = window, histogram.get(window, 0)
        left = {n: c for n, c in histogram.items() if n < window}
        self.runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length: (first rank, sequence, offset)
        self.used: Counter = Counter()
        combos = combinations(sorted(left), window)
        for x, combo in sorted(zip(solve(combos, left), combos, strict=True), key=lambda p: (-p[0], p[1])):
            if times := min([int(x), *(left[n] // k for n, k in Counter(combo).items())]):
                self._take(combo, times, left)
        self._greedy(left, slack)
        # what is left, longest first, end to end from a new sequence
        self.stream: dict[int, tuple[int, int]] = {}  # length: (first rank, position)
        at = 0
        for n in sorted((n for n in left if left[n]), reverse=True):
            self.stream[n] = (self.used[n], at)
            at += n * left[n]
        self.stream_from = self.sequences
        self.sequences += -(-at // window)
        self.firsts = {n: [r[0] for r in runs] for n, runs in self.runs.items()}

    def _take(self, combo: tuple[int, ...], times: int, left: dict[int, int]) -> None:
        offset = 0
        for n, k in Counter(combo).items():
            for _ in range(k):
                self.runs[n].append((self.used[n], self.sequences, offset))
                self.used[n] += times
                offset += n
            left[n] -= k * times
        self.sequences += times

    def _greedy(self, left: dict[int, int], slack: int) -> None:
        """Longest first, each time with the longest that still fit; equal sequences at once, so the loop is as short as the histogram."""
        for n in sorted(left, reverse=True):
            while left[n]:
                combo, room = [n], self.window - n
                for m in sorted((m for m in left if m <= room), reverse=True):
                    k = min(left[m] - (m == n), room // m)
                    combo += [m] * k
                    room -= k * m
                if room > slack:
                    break
                self._take(tuple(combo), min(left[m] // k for m, k in Counter(combo).items()), left)

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(from, to, sequence, offset) within the tail."""
        if length == self.window:
            return [(0, length, rank, 0)]
        if length in self.stream and rank >= self.stream[length][0]:
            first, at = self.stream[length]
            at, out, done = at + (rank - first) * length, [], 0
            while done < length:
                sequence, offset = divmod(at + done, self.window)
                step = min(length - done, self.window - offset)
                out.append((done, done + step, self.stream_from + sequence, offset))
                done += step
            return out
        first, sequence, offset = self.runs[length][bisect_right(self.firsts[length], rank) - 1]
        return [(0, length, sequence + rank - first, offset)]


def cut(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """The full windows and the tail of each document: doc_id, start, length, ids_crc32, doc_tokens, ids (of tails, 32-bit)."""

    def run(batch):
        known = encoder(tokenizer)
        rows = []
        for k, text in enumerate(texts(batch)):
            ids = known.encode(text) + bytes(4)
            n = len(ids) // 4
            for start in range(0, n, window):
                piece = ids[4 * start : 4 * (start + window)]
                short = len(piece) < 4 * window
                rows.append((k, start, len(piece) // 4, zlib.crc32(piece), n, np.frombuffer(piece, "<u4").astype("<u2" if known.ids <= 65536 else "<u4").tobytes() if short else None))
        at, start, length, crc, n, ids = zip(*rows, strict=True)
        return {"doc_id": batch.column("doc_id").take(list_to_index(at)), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": n, "ids": ids}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def list_to_index(at):
    import pyarrow as pa

    return pa.array(at, type=pa.int32())


def ranked(parts: DataFrame, buckets: int) -> DataFrame:
    """``rank`` (from 0) among the parts of one length, counted by length and bucket and then over the buckets' counts."""
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = parts.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = parts.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start")))
    return own.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("own", "before", "bucket")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text; other columns are ignored): SCHEMA.

    Each document ends with id 0. A null or empty text is that id alone. Rows that share a doc_id, or have none, are
    packed each for itself. An empty table gives an empty result. Ties in length go by bucket, doc_id and start.
    """
    spark = docs.sparkSession
    parts = stash(cut(docs, tokenizer, window))
    plan = Plan({r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}, window, slack)
    wide = "<u2" if encoder(tokenizer).ids <= 65536 else "<u4"

    def run(batch):
        rows = []
        get = lambda c: batch.column(c).to_pylist()
        for k, (start, length, crc, ids, rank) in enumerate(zip(get("start"), get("length"), get("ids_crc32"), batch.column("ids"), get("rank"), strict=True)):
            pieces = plan.pieces(length, rank)
            if len(pieces) > 1:
                ids = np.frombuffer(ids.as_py(), wide).astype("<u4")
            for a, b, sequence, offset in pieces:
                rows.append((k, start + a, b - a, crc if len(pieces) == 1 else zlib.crc32(ids[a:b].tobytes()), sequence, offset))
        at, start, length, crc, sequence, offset = zip(*rows, strict=True)
        at = list_to_index(at)
        return {"doc_id": batch.column("doc_id").take(at), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": batch.column("doc_tokens").take(at), "sequence_id": sequence, "offset": offset}

    return map_batches(ranked(parts, 8 * partitions(spark)), run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
