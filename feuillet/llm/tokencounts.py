"""Token counts under a unigram vocabulary, with one forward pass for each prefix that pre-tokens share.

The distinct pre-tokens of what a task reads go into a trie. A node stands for a prefix; its forward score is the best
sum of piece scores over the ways to cut that prefix into pieces, and needs the scores of its ancestors only, so it is
computed once however many pre-tokens run through it. The count of pieces on the best way is stored with it; a
pre-token's terminal node has the count that documents add up.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table, texts
from .pieces import SPACE, model

MOST_NODES = 1_000_000  # about 250 MB of a worker's memory; then it starts anew
LONG = 1000  # characters; longer pre-tokens share nothing worth a place in the trie


def zipf_scores(path: str) -> dict[str, float]:
    """Log-probabilities for the pieces of a model file whose own scores are ranks only: p ~ 1 / (rank + 1)."""
    normal = [p for p, _, kind in sorted(model(path).pieces, key=lambda p: -p[1]) if kind == 1]
    total = math.log(sum(1 / (i + 1) for i in range(len(normal))))
    return {p: -math.log(i + 1) - total for i, p in enumerate(normal)}


class Trie:
    def __init__(self, scores: Mapping[str, float]):
        self.scores = scores
        self.ends: dict[str, float | None] = {}  # what a piece ends with, and the score of what is a piece itself
        for p in scores:
            self.ends |= {p[k:]: None for k in range(1, len(p)) if p[k:] not in self.ends}
            self.ends[p] = scores[p]
        self.most = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best, self.pieces = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces on the best way; of ways with equal scores, the one with fewer pieces."""
        if (known := self.terminal.get(word)) is not None:
            return known
        if len(word) > LONG:
            return self.alone(word)
        if len(self.best) > MOST_NODES:
            self.clear()
        node, path, ends = 0, [0], self.ends
        for depth, c in enumerate(word, 1):
            child = self.children.get((node, c))
            if child is None:
                before = path[-1]
                best, pieces = self.best[before] + self.unknown, self.pieces[before] + len(c.encode("utf-8", "replace"))
                for k in range(1, min(depth, self.most) + 1):
                    score = ends.get(word[depth - k : depth], False)
                    if score is False:  # no piece ends like this, nor like anything longer
                        break
                    if score is not None:
                        at = path[-k]
                        new = self.best[at] + score
                        if new > best or new == best and self.pieces[at] + 1 < pieces:
                            best, pieces = new, self.pieces[at] + 1
                child = self.children[node, c] = len(self.best)
                self.best.append(best)
                self.pieces.append(pieces)
            node = child
            path.append(node)
        self.terminal[word] = self.pieces[node]
        return self.pieces[node]


    def alone(self, word: str) -> int:
        """The same count with the scores of the last prefixes only, as many as a piece has characters."""
        best, pieces, ends = deque([0.0], self.most), deque([0], self.most), self.ends
        for depth, c in enumerate(word, 1):
            top, n = best[-1] + self.unknown, pieces[-1] + len(c.encode("utf-8", "replace"))
            for k in range(1, min(depth, self.most) + 1):
                score = ends.get(word[depth - k : depth], False)
                if score is False:
                    break
                if score is not None:
                    new = best[-k] + score
                    if new > top or new == top and pieces[-k] + 1 < n:
                        top, n = new, pieces[-k] + 1
            best.append(top)
            pieces.append(n)
        return pieces[-1]


_tries: dict[str, Trie] = {}


def trie(path: str) -> Trie:
    if path not in _tries:
        _tries[path] = Trie(zipf_scores(path))
    return _tries[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Pre-tokens (what stands between white space) and tokens of whole texts: doc_id, n_words, n_tokens.

    A character that no piece has counts as its UTF-8 bytes. A null or empty text has 0 of both. Only doc_id and text
    are read; repeated rows give repeated rows.
    """

    def run(batch):
        t, words, tokens = trie(path), [], []
        for text in texts(batch):
            found = text.split()
            words.append(len(found))
            tokens.append(sum([t.terminal[w] if (w := SPACE + x) in t.terminal else t.count(w) for x in found]))
        return {"doc_id": batch.column("doc_id"), "n_words": words, "n_tokens": tokens}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
