"""Stupid-backoff scores of documents from n-gram counts over the whole corpus.

Documents are cut into blocks, written once to the shared folder, so that every later step sees the same ones. The
n-grams of orders 1 to 3 are exploded by block and dealt by hash range: a row holds what one block has in one range,
each n-gram once, so a word that is everywhere comes once from each block. A range's table of counts is the sum over
its rows; joined back, it gives every block the corpus counts of its own n-grams. A block then scores its words:
the count of the three last words over that of their first two, where the three occur often enough; else, times 0.4,
the same one order lower; at last the word's share of the corpus. Scores are summed by document.

N-grams go by 52 bits of hash: among 100 billion different ones about one in 45,000 shares its hash with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chosenpath import MIX, mix, word_hashes
from .common import SLICE, discard, partitions, stash, table

ALPHA, LEAST = 0.4, 2
BITS = 52
BLOCK_CHARS = 14_000_000
DEALT = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def grams(h: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each word, orders 1 to 3; 0 where the document has too few words before it."""
    at = np.arange(len(h)) - np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends]))  # place in the document
    out = [(mix(h) >> np.uint64(64 - BITS)) + np.uint64(1)]
    with np.errstate(over="ignore"):
        run = h
        for order in (2, 3):
            run = mix(np.r_[np.zeros(min(1, len(h)), np.uint64), run[:-1]] * MIX + h + np.uint64(order))
            g = (run >> np.uint64(64 - BITS)) + np.uint64(1)
            g[at < order - 1] = 0
            out.append(g)
    return out


def planes(x: np.ndarray, kind: str) -> bytes:
    """Compressed bytes by significance: the planes of small numbers are mostly zero."""
    x = np.ascontiguousarray(x, kind)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def numbers(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def ids_of(rows: list) -> np.ndarray:
    return np.array([-(2**63) if i is None else i for i in rows], "<i8")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> blocks: their documents and words, the frequent words by small numbers (equally frequent ones by hash); known by their content."""

    def made(ids: list, found: list[np.ndarray]) -> pa.RecordBatch:
        ends, h = np.cumsum([len(t) for t in found]), np.concatenate(found)
        words, at, n = np.unique(h, return_inverse=True, return_counts=True)
        by = np.argsort(-n, kind="stable")
        rank = np.empty(len(by), "<u4")
        rank[by] = np.arange(len(by))
        a, b = ids_of(ids).tobytes() + ends.astype("<i8").tobytes() + planes(np.diff(words[by], prepend=np.uint64(0)), "<u8"), planes(rank[at] if len(h) else np.zeros(0, "<u4"), "<u4")
        block = int(np.uint64(xxhash.xxh3_64_intdigest(a + b)).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((block, block, 0, 0, len(ids), a, b), DEALT, strict=True)], schema=DEALT)

    ids, found, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids.append(i)
                found.append(word_hashes(text))
                size += len(text or "")
                if size >= BLOCK_CHARS:
                    yield made(ids, found)
                    ids, found, size = [], [], 0
    if ids:
        yield made(ids, found)


def opened(n: int, a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's doc_ids, where each document's words end, and the words' hashes."""
    return np.frombuffer(a[: 8 * n], "<i8"), np.frombuffer(a[8 * n : 16 * n], "<i8"), np.cumsum(numbers(a[16 * n :], "<u8"), dtype="<u8")[numbers(b, "<u4")]


def deal(ranges: int):
    """Blocks -> the n-grams of each by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, n, a, b = (batch.column(c)[k].as_py() for c in ("block", "n", "a", "b"))
                _, ends, h = opened(n, a, b)
                for order, g in enumerate(grams(h, ends), 1):
                    own, times = np.unique(g[g > 0], return_counts=True)
                    cuts = np.searchsorted(own, [((r << BITS) // ranges) + 1 for r in range(ranges + 1)])
                    rows = [(r * 3 + order - 1, block, order, r, hi - lo, planes(np.diff(own[lo:hi], prepend=np.uint64(0)), "<u8"), planes(times[lo:hi], "<u4")) for r, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DEALT, strict=True)], schema=DEALT)

    return run


def count(part: pd.DataFrame) -> pd.DataFrame:
    """A range of one order: the corpus counts of its n-grams, for each block in the block's own order."""
    keys = [np.cumsum(numbers(a, "<u8")) for a in part["a"]]
    table, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([numbers(b, "<u4") for b in part["b"]]), len(table)).astype("<u4")
    ends = np.cumsum([len(k) for k in keys])
    return part.assign(a=[planes(total[at[e - len(k) : e]], "<u4") for e, k in zip(ends, keys, strict=True)], b=b"")


def score(part: pd.DataFrame) -> pd.DataFrame:
    """A block and the counts of its n-grams -> doc_id, n_tokens, the sum of logs, and how many of them still lack - log(corpus size)."""
    twins = int((part["kind"] == 0).sum())  # blocks with the same content have one name
    home = part[part["kind"] == 0].iloc[0]
    ids, ends, h = opened(int(home["n"]), home["a"], home["b"])
    c = []
    for order, g in enumerate(grams(h, ends), 1):
        rows = part[part["kind"] == order].drop_duplicates("part").sort_values("part")
        found = np.concatenate([np.zeros(1, "<u4"), *(numbers(a, "<u4") for a in rows["a"])]).astype(float)  # the first is for 0
        own, at = np.unique(np.r_[np.uint64(0), g], return_inverse=True)
        c.append(found[at[1:]])
    c1, c2, c3 = c
    before = lambda x: np.r_[np.ones(min(1, len(x))), x[:-1]]
    has = np.arange(len(h)) - np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends]))  # words before it
    three, two = c3 >= LEAST, c2 >= LEAST
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.where(three, np.log(c3) - np.log(before(c2)), np.where(two, np.log(c2) - np.log(before(c1)) + np.where(has > 1, np.log(ALPHA), 0), np.log(c1) + np.log(ALPHA) * np.minimum(has, 2)))
    low = ~three & ~two
    sums = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[0, ends]])
    out = pd.DataFrame({"doc_id": pd.array([None if i == -(2**63) else i for i in ids.tolist()], "Int64"), "n_tokens": np.diff(np.r_[0, ends]), "logs": sums(logs), "low": sums(low.astype(float)).round().astype("int64")})
    return pd.concat([out] * twins)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_score (natural log, the sum over the document's words) for each row of ``docs``.

    Words are what stands between ASCII white space, A-Z lower-cased; the n-grams of all rows count, a document's own
    and those of copies too, and orders 2 and 3 need LEAST occurrences. A null or empty text has 0 words and score 0.
    Only doc_id and text are read, once. An empty table gives an empty result; repeated rows give repeated rows and count.
    """
    spark = docs.sparkSession
    schema = "key long, block long, kind int, part int, n long, a binary, b binary"
    home = stash(docs.select("doc_id", "text").mapInArrow(blocks, schema))
    dealt = home.mapInArrow(deal(2 * partitions(spark)), schema)
    counted = dealt.groupBy("key").applyInPandas(count, schema)
    scored = stash(counted.unionByName(home).groupBy("block").applyInPandas(score, "doc_id long, n_tokens long, logs double, low long"))
    discard(home)
    total = scored.agg(F.sum("n_tokens")).first()[0] or 1
    return scored.select("doc_id", "n_tokens", F.round(F.col("logs") - F.col("low") * F.log(F.lit(float(total))), 4).alias("log_score"))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), spot AS (
    SELECT doc_id, i, ws[i] AS w3, CASE WHEN i > 1 THEN ws[i - 1] END AS w2, CASE WHEN i > 2 THEN ws[i - 2] END AS w1 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words)
), c1 AS (SELECT w3, count(*) AS n FROM spot GROUP BY w3),
c2 AS (SELECT w2, w3, count(*) AS n FROM spot WHERE w2 IS NOT NULL GROUP BY w2, w3),
c3 AS (SELECT w1, w2, w3, count(*) AS n FROM spot WHERE w1 IS NOT NULL GROUP BY w1, w2, w3),
scored AS (
    SELECT spot.doc_id,
        CASE WHEN t.n >= {LEAST} THEN ln(t.n) - ln(tc.n)
             WHEN b.n >= {LEAST} THEN ln(b.n) - ln(bc.n) + CASE WHEN i > 2 THEN ln({ALPHA}) ELSE 0 END
             ELSE ln(u.n) - ln((SELECT count(*) FROM spot)) + ln({ALPHA}) * least(i - 1, 2) END AS s
    FROM spot
    JOIN c1 u ON u.w3 = spot.w3
    LEFT JOIN c1 bc ON bc.w3 = spot.w2
    LEFT JOIN c2 b ON b.w2 = spot.w2 AND b.w3 = spot.w3
    LEFT JOIN c2 tc ON tc.w2 = spot.w1 AND tc.w3 = spot.w2
    LEFT JOIN c3 t ON t.w1 = spot.w1 AND t.w2 = spot.w2 AND t.w3 = spot.w3
)
SELECT words.doc_id, len(ws)::BIGINT AS n_tokens, round(coalesce(s, 0), 4) AS log_score
FROM words LEFT JOIN (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id) USING (doc_id)
"""
