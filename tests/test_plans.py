"""Physical plans of the operators that must not move wide rows."""

import re

import pytest
from pyspark.sql import functions as F

from winnow.operators import cleaning, encoding, importance, metrics, sampling, splitting
from winnow.plans import matrices
from winnow.plans.matrices import orders_matrix


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def shuffles(text: str) -> int:
    """Shuffles that really run: an exchange that is read again counts once."""
    return len(re.findall(r"(?:-|:) Exchange ", text))


@pytest.fixture(scope="module")
def orders(spark, sf):
    return orders_matrix(spark, sf)


@pytest.mark.parametrize("marking", [
    splitting.stratified_split, splitting.inner_holdout_split, splitting.stratified_kfold, sampling.fs_eval_sample,
    sampling.downsample_majority, lambda df: splitting.chronological_split(df, "order_ts"),
    lambda df: sampling.head_sample(df, "row_key", 700),
])
def test_marking_rows_moves_none(orders, marking):
    text = plan(marking(orders))
    assert shuffles(text) == 0 and "Join" not in text and "Sort" not in text


def test_encoding_new_rows_moves_none(orders):
    encoder = encoding.fit_encoder(orders.select("row_key", "label", "nation", "priority", "line_status"))
    text = plan(encoder.transform(orders.select("row_key", "nation", "priority", "line_status")))
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") == 2
    # The only shuffles add up the category statistics.
    assert "hashpartitioning(row_key" not in text


def test_metrics_shuffle_counts_not_rows(orders):
    scored = orders.select("label", F.col("priority").alias("model"), F.col("total_price").alias("score"))
    text = plan(metrics.ranking_metrics(scored, ["model"]))
    assert text.count("ReusedExchange") >= 2
    assert "NestedLoop" not in text and "Cartesian" not in text
    first = text[text.index("FileScan"):]
    assert re.search(r"ReadSchema: struct<label:int,total_price:double,priority:string>", first)


def test_one_shuffle_serves_all_features_and_models(orders):
    filled = orders.select("row_key", "total_price", "acct_bal")
    text = plan(importance.column_shuffle(filled, ["total_price", "acct_bal"], models=["m0", "m1", "m2"]))
    assert shuffles(text) == 1


def test_filters_and_columns_reach_the_scan(orders):
    kept = cleaning.target_map_valid(orders.withColumnRenamed("n_lines", "code"), "code", {1.0: 1, 2.0: 0}, "y").select("y")
    text = plan(kept)
    assert "In(n_lines, [1,2])" in text
    assert "ReadSchema: struct<n_lines:bigint>" in text


def test_cents_are_added_as_longs_and_exact(spark):
    values = [0.07, 1.005, -1.005, 0.285, 2.675, 1.115, 33.335, 901.0, 12_345_678_901_234.57, 99_999_999_999_999.99, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "g int, v double")
    found = rows.groupBy("g").agg(matrices._cents("v").alias("new"), F.sum(F.col("v").cast("decimal(18,2)")).cast("double").alias("old"))
    assert all(r["new"] == r["old"] for r in found.collect())
    assert "partial_sum(cast(v" not in plan(rows.groupBy("g").agg(matrices._cents("v")))
