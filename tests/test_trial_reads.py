"""How often a challenger's trial goes through its input, and what its segments need."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskmon.operators import bootstrap, features
from riskmon.plans import catalogue

EVENTS = "/root/testdata/sf0.001"


@pytest.fixture
def counted(spark, monkeypatch):
    """Counts the rows that the plans of a query take from the transactions."""
    seen, plain = spark.sparkContext.accumulator(0), catalogue.transactions

    def passed(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    def transactions(spark, d):
        rows = plain(spark, d)
        return rows.mapInPandas(passed, rows.schema)

    monkeypatch.setattr(catalogue, "transactions", transactions)
    return seen


def test_segments_take_the_input_a_few_times_and_need_no_resamples(spark, counted, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("segments do not depend on resamples of the ranking")

    monkeypatch.setattr(bootstrap, "difference", refused)
    found = catalogue.challenger_segments(spark, EVENTS)
    assert found.columns[:3] == ["segment", "value", "rows"]
    found.collect()
    # The time range, the sums per key and time, and the rows that they are joined to.
    assert counted.value <= 3 * spark.read.parquet(f"{EVENTS}/events.parquet").count()


def test_folds_keep_the_order_of_the_columns(spark):
    df = spark.createDataFrame([(f"u{i}", "ab"[i % 2], "x", float(i), 1.0) for i in range(9)], "z string, b string, a string, n double, c double")
    one = features.fit_folds(df, {"all": F.lit(True)}, ["z", "b", "a"], ["n", "c"], cardinality_limit=3)["all"]
    assert (one.dropped, list(one.levels), list(one.frequencies)) == (["a", "c"], ["b"], ["z"])
