"""Many words at once: an automaton (Aho-Corasick) that finds all of a list in one pass over a text.

The automaton is built once in each Python worker from the words, which travel with the expression. Two uses:

* ``word_counts``: how often each word occurs, as an array in the order of the words.
* ``replaced``: ordered literal replacements. A text is searched once; only the rules whose left side is there, or may come
  about by a rule applied before, are then applied, in their order. So the result is that of applying them all.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=64)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, w in enumerate(words):
        found.add_word(w, k)
    found.make_automaton()
    return found


def counted(text: str, words: tuple[str, ...]) -> list[int]:
    """Occurrences of each word from left to right, those of one word not overlapping each other."""
    counts, free = [0] * len(words), [0] * len(words)
    for end, k in automaton(words).iter(text):
        if end + 1 - len(words[k]) >= free[k]:
            counts[k] += 1
            free[k] = end + 1
    return counts


def word_counts(c: Column, words: tuple[str, ...]) -> Column:
    """array<int>: the occurrences of each of ``words`` (distinct, not empty) in a text; null for null."""

    @F.pandas_udf("array<int>")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: counted(t, words), na_action="ignore")

    return each(c)


def weighted_counts(c: Column, each: list[dict[str, int]], once: list[dict[str, int]]) -> Column:
    """array<int>: for every group, the weights of ``each`` times the occurrences of its words, and those of ``once`` for words that occur at all."""
    words = tuple(dict.fromkeys(w for group in [*each, *once] for w in group))
    times, there = (np.array([[group.get(w, 0) for group in groups] for w in words]) for groups in (each, once))

    @F.pandas_udf("array<int>")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found = np.array([counted(t or "", words) for t in part], int).reshape(len(part), len(words))
            yield pd.Series(list((found @ times + (found > 0) @ there).astype("int32")))

    return scores(c)


def may_make(made: str, word: str) -> bool:
    """Whether ``word`` can come about where ``made`` is put into a text: one holds the other, or an end of one begins the other."""
    if word in made or made in word:
        return True
    return any(made.endswith(word[:n]) or word.endswith(made[:n]) for n in range(1, min(len(made), len(word))))


@functools.lru_cache(maxsize=64)
def rules(pairs: tuple[tuple[str, str], ...]) -> tuple[tuple[str, ...], list[int], list[int]]:
    """The distinct left sides, which of them each rule has, and as bits the later rules that each rule may bring about."""
    words = tuple(dict.fromkeys(a for a, _ in pairs))
    later = [sum(1 << j for j in range(i + 1, len(pairs)) if may_make(b, pairs[j][0])) for i, (_, b) in enumerate(pairs)]
    return words, [words.index(a) for a, _ in pairs], later


def replacer(ordered: tuple[tuple[str, str], ...]) -> Callable[[str], str]:
    """text -> text with the replacements one after the other, each all over the text."""

    def change(text: str) -> str:
        words, which, later = rules(ordered)
        there = 0
        for _, k in automaton(words).iter(text):
            there |= 1 << k
        if not there:
            return text
        todo = sum(1 << j for j, k in enumerate(which) if there >> k & 1)
        while todo:
            j = (todo & -todo).bit_length() - 1
            todo &= todo - 1
            a, b = ordered[j]
            if a in text:
                text = text.replace(a, b)
                todo |= later[j]
        return text

    return change


Rules = tuple[tuple[str, str], ...]


def in_turn(*lists: dict[str, str]) -> Rules:
    """The rules of several lists, one list after the other."""
    return tuple(pair for pairs in lists for pair in pairs.items())


def replaced(c: Column, pairs: dict[str, str] | Rules) -> Column:
    """The text after all replacements in their order; null for null."""
    change = replacer(tuple(pairs.items()) if isinstance(pairs, dict) else pairs)

    @F.pandas_udf("string")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(change, na_action="ignore")

    return each(c)
