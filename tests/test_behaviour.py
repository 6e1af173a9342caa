"""Behaviour that must not depend on table width, class size or how a setting is spelled."""

from pyspark.sql import functions as F

from winnow.operators import profiling, sampling
from winnow.plans import experiment
from winnow.sources import readers


def test_constants_have_no_correlation_at_any_width(spark):
    df = spark.range(100_003).select(
        F.lit(0.1).alias("a"), F.lit(1_000_000.3).alias("b"), F.rand(1).alias("c"), F.rand(2).alias("d"),
        (F.col("id") % 7).cast("double").alias("e"), F.when(F.col("id") < 50, F.col("id") + 0.1).otherwise(0.1).alias("f"),
        F.when(F.col("id") >= 50, F.rand(3)).alias("g"), (F.col("id") % 2).cast("int").alias("label"))
    columns = list("abcdefg")
    narrow = {(r[0], r[1]): r[2] for r in profiling.correlations(df, columns, wide_pairs=100).collect()}
    wide = {(r[0], r[1]): r[2] for r in profiling.correlations(df, columns, wide_pairs=0).collect()}
    # f is constant on the rows that know g.
    assert set(narrow) == set(wide) == {("c", "d"), ("c", "e"), ("d", "e"), ("c", "f"), ("d", "f"), ("e", "f"), ("c", "g"), ("d", "g"), ("e", "g")}
    assert all(abs(narrow[k] - wide[k]) < 1e-9 for k in narrow)
    assert {r["feature"] for r in profiling.corr_with_target(df, columns).collect()} == set("cdefg")


def test_subsample_keeps_small_classes_and_its_size(spark):
    df = spark.range(100_000).select(F.col("id").alias("row_key"), (F.col("id") < 20).cast("int").alias("label"))
    for rows in (2, 1_000, 4_000, 200_000):
        found = {r["label"]: r["count"] for r in sampling.train_row_subsample(df, "row_key", rows, ["label"]).groupBy("label").count().collect()}
        assert sum(found.values()) == min(rows, 100_000) and found[1] >= 1


def test_row_filter_on_doubles_reaches_the_file(spark, tmp_path):
    path = f"{tmp_path}/codes.parquet"
    spark.createDataFrame([(1.0, 2.5), (float("nan"), 1.0), (9.0, float("nan"))], "code double, v double").write.parquet(path)
    df = readers.scan_any(spark, path, F.col("code").isin([1.0, 9.0]))
    assert "In(code, [1.0,9.0])" in df._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in df.fillna(-1.0).collect()) == [(1.0, 2.5), (9.0, -1.0)]


def test_modes_that_differ_in_what_is_measured_are_measured_apart(monkeypatch):
    calls = []

    class Enough(Exception):
        pass

    def measured(train, features, rule, *_):
        calls.append((rule.get("fit_rows"), rule.get("holdout_time_column")))
        if len(calls) == 3:
            raise Enough
        return None

    class Frame:
        sparkSession = None

        def where(self, _):
            return self

    class Decisions:
        def withColumn(self, *_):
            return self

    rules = {"a": {}, "b": {}, "c": {"fit_rows": 10}, "d": {"holdout_time_column": "t"}}
    monkeypatch.setattr(experiment, "mode_rules", lambda config: rules)
    monkeypatch.setattr(experiment, "compute_artifacts", measured)
    monkeypatch.setattr(experiment.selection, "candidates", lambda *_: Decisions())
    monkeypatch.setattr(experiment.selection, "select_features", lambda *_: None)
    try:
        experiment.run_profiles(Frame(), [], {"splits": {}}, "label", "row_key")
    except Enough:
        pass
    assert calls == [(None, None), (10, None), (None, "t")]
