"""What one task gets: rows dealt evenly, also those without a key."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from feuillet.operators import extract as E
from feuillet.operators import matching
from feuillet.operators.matching import looked_up
from feuillet.plans.registry import QUERIES
from feuillet.sources.fixtures import Tables


@contextmanager
def conf(spark, **values):
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_acts_without_a_person_are_not_one_task(spark, data):
    with conf(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="16"):
        by = rows_by_task(Tables(spark, data).register.select("acte_id", "text"))  # the last join is for the godmother, whom a sixth lack; few keys here, so no even shares
        assert max(by) < 0.16 * sum(by)


def test_rows_without_a_key_match_nothing(spark):
    left = spark.createDataFrame([(1, None), (2, 7), (3, 8), (None, None), (4, -2)], "row long, key long")
    right = spark.createDataFrame([(7, "a"), (7, "b"), (-2, "c"), (None, "d")], "id long, v string")
    got = looked_up(left, "key", "row", right, "id")
    assert got.columns == ["row", "key", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, None, None), (2, 7, "a"), (2, 7, "b"), (3, 8, None), (None, None, None), (4, -2, "c")], key=str)


def test_books_and_mentions_are_not_merged_to_one_task(spark, data):
    t = Tables(spark, data)
    for df in (t.books, E.extract_relations(t.lines), E.extract_dates(t.lines)):
        assert len(rows_by_task(df)) == 4


def test_counts_of_mentions_need_no_sort(spark):
    line = "3 mai 1650, Charlotte Boucher, fille de Jean Boucher et de Anne Varin; Jean Boucher, laboureur. "
    docs = spark.createDataFrame([(1, line), (1, line + "Paul Durand."), (2, None), (None, line), (None, "Marie Varin")], "doc_id long, text string")
    kinds = ("names", "dates", "professions", "relations", "segments")
    counts = E.combine_extractors(docs, kinds)
    assert "Sort" not in counts._jdf.queryExecution().executedPlan().toString()
    wanted = {(i, k): 0 for i in (1, 2, None) for k in kinds}
    for k in kinds:
        for r in getattr(E, f"extract_{k}")(docs).collect():
            wanted[r.doc_id, k] += 1
    assert {(r.doc_id, r.kind): r.n for r in counts.collect()} == wanted and all(r.success == (r.n > 0) for r in counts.collect())


@pytest.mark.parametrize("name", ["ext13_marriages_with_source", "src2_split_pages", "src3_page_range", "txt16_validate_correction", "ext15_page_features", "txt14_transcription_suggest", "txt13_normalize_text"])
def test_acts_are_not_sorted(spark, data, name):
    """A task that sorts its acts holds all of them, and those without a person were one task's."""
    with conf(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and " Sort [" not in plan


def test_a_task_of_books_does_not_grow(spark, data, monkeypatch):
    monkeypatch.setattr(matching, "AT_A_TASK", 100)
    assert len(rows_by_task(Tables(spark, data).books)) > 4  # 1,500 orders, 4 shuffle partitions


def test_a_task_of_register_lines_does_not_grow(spark, data, monkeypatch):
    """A join's tasks aren't merged by compressed size where there are many acts: the next shuffle would hold all rows of one."""
    before = Tables(spark, data).register.select("acte_id", "text")
    assert len(rows_by_task(before)) <= 4  # 1,500 orders are few
    monkeypatch.setattr(matching, "AT_A_TASK", 100)
    lines = Tables(spark, data).register.select("acte_id", "text")
    assert len(rows_by_task(lines)) > 4
    assert sorted(lines.collect()) == sorted(before.collect())


def test_books_are_not_a_file_each(spark, data):
    """Files are as many as tasks; one for each book took hours where books are a million."""
    got = QUERIES["src1_read_documents"](spark, data)
    assert len(got.inputFiles()) <= 4 < got.count()
