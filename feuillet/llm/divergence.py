"""How sources of a language differ from one another in their words, by cells of equal counts.

Words are counted once, by (language, source); after that, texts play no part. A term's value for a group depends only
on its count there and its count in the other group, so terms with the same two counts are one cell: values are computed
once for each cell, and weigh as many times as the cell has terms.

* ``pair``: for two sources, cells of their two counts. Only terms that both have are joined; those that one has alone,
  and those that neither has, follow from each source's own cells and from the number of terms.
* ``term``: for a source against its language, cells are merged where their values are equal and ranked by cumulative
  multiplicity; only the classes that begin within the first ranks are expanded, in UTF-8 order.

All is whole numbers: longs, and decimals for the product that a long might not hold.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sized, stash, table

#: A-Z become a-z; all else that can't be in a term becomes a space; bytes of other characters stay
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20  # bytes of a text that are words at a time
MOST = 400_000  # terms a task holds before it sends them


def pieces(text: bytes):
    """The words of a text, some at a time."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs; the empty term has n = 0 and tells that the group occurs."""

    def count(batches):
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0

        def rows():
            keys = [(g, term, n, own[1][term]) for g, own in held.items() for term, n in own[0].items()]
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                text = lambda values: (b := pa.array(values, pa.binary())) and pa.Array.from_buffers(pa.string(), len(b), b.buffers())
                yield pa.RecordBatch.from_arrays([text([g[0] for g, *_ in part]), text([g[1] for g, *_ in part]), text([k[1] for k in part]), pa.array([k[2] for k in part], pa.int64()), pa.array([k[3] for k in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            columns = [batch.column(k).cast(pa.binary()) for k in range(3)]
            for k in range(batch.num_rows):
                lang, source, text = (c[k].as_py() or b"" for c in columns)
                total, documents = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
                before, seen = len(total), set()
                for words in pieces(text):
                    total.update(words)
                    seen.update(words)
                documents.update(seen)
                size += len(total) - before
                if size >= MOST:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    columns = docs.select("lang", "source", "text")
    counted = columns.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str | Column, total: str, terms: str = "v") -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms))."""
    count = F.col(count) if isinstance(count, str) else count
    top = (count + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = (F.col(total) + 2 * F.col(terms)).cast("decimal(20,0)")
    return 1 + F.call_function("div", top, below)


def value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = 10, most: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: docs (text, lang, source) may have other columns; nulls count as ''.

    Each row of docs is a document, so repeated rows count again. Ties in value stand in UTF-8 order of the item. A group
    without terms has its pairs still (values of 0 where its language keeps no term); a language of one source
    has no pairs; an empty table gives an empty result.
    """
    every = stash(term_counts(docs))
    kept = stash(every.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("c_lang")).where(F.col("docs") >= least_docs).drop("docs"))
    counts = stash(every.where("term <> ''").select("lang", "source", "term", F.col("n").alias("c")).join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("c_lang").alias("n_lang"))
    own = counts.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = stash(every.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(own, ["lang", "source"], "left").fillna(0, ["v", "n", "n_lang"]))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair_part(counts, groups).select(*columns).unionByName(term_part(counts, groups, most).select(*columns))


def pair_part(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Every two sources of a language: the sum over all kept terms."""
    a, b = (groups.select("lang", "v", F.col("source").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    pairs = stash(a.join(b, ["lang", "v"]).where("a < b"))
    pa_, pb_, a0, b0 = share("ca", "n_a"), share("cb", "n_b"), share(F.lit(0), "n_a"), share(F.lit(0), "n_b")
    # terms that both have, by cell
    one, two = (counts.select("lang", "term", F.col("source").alias(k), F.col("c").alias(f"c{k}")) for k in "ab")
    cells = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "ca", "cb").agg(F.count("*").alias("m"))
    more = F.col("m") * (value(pa_, pb_) - value(pa_, b0) - value(a0, pb_) + value(a0, b0))
    parts = cells.join(sized(pairs), ["lang", "a", "b"]).select("lang", "a", "b", more.alias("x"))
    # each source's own cells, as if the other had none of the terms
    single = counts.groupBy("lang", "source", "c").agg(F.count("*").alias("m"))
    for k, own in (("a", value(pa_, b0)), ("b", value(a0, pb_))):
        alone = single.select("lang", F.col("source").alias(k), F.col("c").alias(f"c{k}"), "m").join(sized(pairs), ["lang", k])
        parts = parts.unionByName(alone.select("lang", "a", "b", (F.col("m") * (own - value(a0, b0))).alias("x")))
    nothing = F.when(F.col("v") > 0, F.col("v") * value(share(F.lit(0), "n_a", "w"), share(F.lit(0), "n_b", "w"))).otherwise(0)
    parts = parts.unionByName(pairs.withColumn("w", F.greatest("v", F.lit(1))).select("lang", "a", "b", nothing.alias("x")))
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("x").alias("value"))
    both = summed.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value").select("lang", "s.*", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.withColumns({"part": F.lit("pair"), "rank": rank})


def term_part(counts: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """The terms a source uses more than its language, the first ``most``."""
    by = ["lang", "source"]
    cells = counts.groupBy(*by, "c", "c_lang").agg(F.count("*").alias("m")).join(sized(groups), by)
    p, q = share("c", "n"), share("c_lang", "n_lang")
    cells = stash(cells.where(p > q).select(*by, "c", "c_lang", "m", value(p, q).alias("value")))
    falling = Window.partitionBy(*by).orderBy(F.desc("value"))
    classes = cells.groupBy(*by, "value").agg(F.sum("m").alias("m"))
    top = classes.withColumn("k", F.row_number().over(falling)).where(F.col("k") <= most)  # a class has a term at least
    begun = top.withColumn("before", F.sum("m").over(falling.rowsBetween(Window.unboundedPreceding, -1)))
    begun = begun.withColumn("before", F.coalesce("before", F.lit(0))).where(F.col("before") < most).select(*by, "value", "before")
    chosen = cells.join(begun, [*by, "value"]).select(*by, "c", "c_lang", "value", "before")
    terms = counts.join(sized(chosen), [*by, "c", "c_lang"])
    place = F.row_number().over(Window.partitionBy(*by, "value").orderBy("term"))
    ranked = terms.withColumn("k", place).where(F.col("k") <= most).withColumn("rank", (F.col("before") + F.col("k")).cast("int")).where(F.col("rank") <= most)
    return ranked.select(*by, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
  t AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  kept AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
  g AS (SELECT DISTINCT lang, source FROM d), own AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL),
  full_ AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(own.c, 0) AS c, k.c AS cl FROM g JOIN kept k USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
  shares AS MATERIALIZED (SELECT lang, source, term, c, 1 + 1000000000::HUGEINT * (c + 2) // (sum(c) OVER w + 2 * count(*) OVER w) AS p, 1 + 1000000000::HUGEINT * (cl + 2) // (sum(cl) OVER w + 2 * count(*) OVER w) AS q FROM full_ WINDOW w AS (PARTITION BY lang, source)),
  pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
  sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE c > 0 AND p > q)
  SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM u) WHERE part = 'pair' OR r <= 10"""
