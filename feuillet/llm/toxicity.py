"""Toxicity by a chain of classifiers.

The chain predicts categories one after the other and the given label last. Each link is a linear model over words and
their beginnings and over the probabilities of the links before it. A link learns from probabilities that the earlier ones give to
documents they weren't fitted on (out of fold), so that it meets in training what it will meet later. The table of
labels has one label, toxic; a category's own label is weak: toxic, and the text has one of the category's words.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stash, table, texts

#: fixed values: words that mark the categories' weak labels
CATEGORIES = {"insult": ("idiot", "moron", "stupid", "clown", "loser"), "degradation": ("scum", "trash", "worthless"), "contempt": ("pathetic", "disgusting")}
EDGES = "\"'`.,;:!?()[]{}<>«»“”’…*-_|/"


PREFIXES = (4, 5, 6, 7)
MOST_WORDS = 100_000  # a worker's memory; then it starts anew


def traits(word: str) -> list[str]:
    """A word as such, marked by =, and its beginnings: endings vary in many languages."""
    word = word.strip(EDGES)
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


def words(text: str) -> set[str]:
    return {t for w in set(text.lower().split()) for t in traits(w)}


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 12, l2: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the bias, which isn't shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    shrink = np.full(x.shape[1], l2)
    shrink[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curve, x.T @ (y - p) - shrink * w)
        step *= min(1.0, 4 / max(1e-9, np.abs(step).max()))
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def chance(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    vocabulary: dict[str, int]
    names: list[str]
    weights: list[np.ndarray]
    threshold: float

    def hits(self, many: list[str]) -> list[list[int]]:
        """The indices of each text's traits; each distinct word is looked up once, and known words are kept."""
        known, get, out = _known.setdefault(tuple(self.vocabulary), {}), self.vocabulary.get, []
        for text in many:
            if len(known) > MOST_WORDS:
                known.clear()
            found = set()
            for w in set(text.lower().split()):
                if (k := known.get(w)) is None:
                    k = known[w] = tuple(i for t in traits(w) if (i := get(t)) is not None)
                if k:
                    found.update(k)
            out.append(list(found))
        return out

    def probabilities(self, hits: list[list[int]]) -> np.ndarray:
        """One row for each document, one column for each link."""
        x = dense(hits, len(self.vocabulary))
        for w in self.weights:
            x = np.hstack([x, chance(w, x)[:, None]])
        return x[:, len(self.vocabulary) :]


_known: dict[tuple[str, ...], dict[str, tuple[int, ...]]] = {}


def dense(hits: list[list[int]], width: int) -> np.ndarray:
    x = np.zeros((len(hits), width))
    for row, found in zip(x, hits, strict=True):
        row[found] = 1
    return x


def fit(docs: DataFrame, labels: DataFrame, categories: Mapping[str, tuple[str, ...]] = CATEGORIES, max_rows: int = 5_000, max_words: int = 100, folds: int = 5) -> Chain | None:
    """The chain from at most ``max_rows`` labelled documents (the least by a hash of doc_id) and their ``max_words`` most telling traits.

    Several labels of one doc_id count as the largest; rows without label or text don't count. With one class only
    there is nothing to learn: None.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))  # bounded by max_rows

    def run(batch):
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "words": [sorted(words(t)) for t in texts(batch)]}

    rows = stash(map_batches(docs.select("doc_id", "text").where("text is not null").join(picked, "doc_id"), run, "doc_id long, toxic int, words array<string>"))
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    if not 0 < t < n:
        return None
    # |log odds| of a word among toxic and other documents, by how often it is there
    seen = rows.select("toxic", F.explode("words").alias("word")).where("length(word) between 3 and 40").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a + b >= 3")
    rate = lambda c, size: (F.col(c) + 0.5) / (size + 1.0)
    telling = F.abs(F.log(rate("a", t) / rate("b", n - t))) * F.sqrt(F.col("a") / t + F.col("b") / (n - t))
    vocabulary, told = [], set()
    for r in seen.orderBy(F.desc(F.round(telling, 9)), F.desc(F.length("word")), "word").limit(6 * max_words).collect():
        if len(vocabulary) < max_words and not any((stem, r["a"], r["b"]) in told for stem in (r["word"].lstrip("=")[:n] for n in PREFIXES)):
            vocabulary.append(r["word"])  # a trait that says just what a kept one with the same beginning says is left out
            told.update((r["word"].lstrip("=")[:n], r["a"], r["b"]) for n in PREFIXES)
    index = {w: k for k, w in enumerate(sorted(vocabulary))}
    seeds = sorted({f"={s}" for c in categories.values() for s in c})
    kept = rows.select("doc_id", "toxic", F.array_intersect("words", F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")).alias("hits"), F.array_intersect("words", F.array(*map(F.lit, seeds)) if seeds else F.array().cast("array<string>")).alias("marks"))
    sample = sorted(kept.collect(), key=lambda r: r["doc_id"])  # bounded by max_rows and max_words
    toxic = np.array([r["toxic"] for r in sample], float)
    targets = [(name, np.array([r["toxic"] and not set(r["marks"]).isdisjoint(f"={m}" for m in marks) for r in sample], float)) for name, marks in categories.items()]
    x = dense([[index[w] for w in r["hits"]] for r in sample], len(index))
    fold = np.arange(len(x)) % folds
    weights = []
    for _, y in [*targets, ("toxic", toxic)]:
        unseen = np.zeros(len(y))
        for k in range(folds):
            unseen[fold == k] = chance(fit_linear(x[fold != k], y[fold != k]), x[fold == k])
        weights.append(fit_linear(x, y))
        x = np.hstack([x, unseen[:, None]])
    return Chain(index, [name for name, _ in targets] + ["toxic"], weights, best_threshold(x[:, -1], toxic))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The most F1 out of fold, half-way between the probabilities on both sides."""
    by = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[by])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[by][:-1] == p[by][1:]] = 0  # equal probabilities stay together
    k = int(np.argmax(f1))
    return float((p[by][k] + (p[by][k + 1] if k + 1 < len(y) else 0)) / 2)


def score(docs: DataFrame, chain: Chain | None, names: list[str] | None = None) -> DataFrame:
    """doc_id, one probability for each link, and toxic: the last one reaches the threshold.

    Whole texts are read; a null or empty text has no words and gets the links' base rates. Without a chain all
    probabilities are 0 and nothing is toxic. Only doc_id and text are read; repeated rows give repeated rows.
    """
    names = chain.names if chain else [*(names or CATEGORIES), "toxic"]

    def run(batch):
        if chain is None:
            p = np.zeros((batch.num_rows, len(names)))
        else:
            p = chain.probabilities(chain.hits(texts(batch)))
        return {"doc_id": batch.column("doc_id"), **{f"p_{n}": p[:, k] for k, n in enumerate(names)}, "toxic": p[:, -1] >= (chain.threshold if chain else 1)}

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id long, {', '.join(f'p_{n} double' for n in names)}, toxic boolean")


def without_toxic(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """The same columns, without the documents that ``score`` calls toxic; a filter within the scan, no shuffle."""
    if chain is None:
        return docs

    def run(batch):
        p = chain.probabilities(chain.hits(texts(batch)))
        return {c: batch.column(c).filter(_mask(p[:, -1] < chain.threshold)) for c in batch.schema.names}

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def _mask(keep: np.ndarray):
    import pyarrow as pa

    return pa.array(keep)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
