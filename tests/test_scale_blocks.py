"""Building blocks under skew and under forced multi-round paths, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from winnow.functions import ordering, selecting
from winnow.functions.running import running_totals
from winnow.operators import encoding, metrics, profiling, sampling, splitting


@pytest.fixture(scope="module")
def skewed(spark):
    """9,000 rows; one timestamp, one category and one score hold a third of them each."""
    rng = random.Random(5)
    rows = [
        (i, int(rng.random() < 0.2), 500 if i % 3 == 0 else rng.randrange(1000), "hot" if i % 3 == 1 else f"c{rng.randrange(40)}",
         0.5 if i % 3 == 2 else rng.random())
        for i in range(9000)
    ]
    return rows, spark.createDataFrame(rows, "row_key bigint, label int, t bigint, cat string, score double").cache()


def test_kth_smallest_with_many_rounds(spark, skewed, monkeypatch):
    rows, df = skewed
    monkeypatch.setattr(selecting, "FINISH_BELOW", 3)
    for column, place in (("t", 2), ("row_key", 0), ("score", 4)):
        ordered = sorted(r[place] for r in rows)
        for k in (1, 2, 3001, 4500, 8999, 9000):
            assert selecting.kth_smallest(df, column, k) == ordered[k - 1]
    with pytest.raises(ValueError):
        selecting.kth_smallest(df, "t", 0)


def test_hash_cuts_by_longer_prefixes(spark, skewed, monkeypatch):
    rows, df = skewed
    want = splitting.stratified_split(df).select("row_key", "split").collect()
    monkeypatch.setattr(ordering, "STEP_DIGITS", 1)
    monkeypatch.setattr(ordering, "FEW_ROWS", 2)
    monkeypatch.setattr(ordering, "LITERAL_GROUPS", 1)
    assert sorted(splitting.stratified_split(df).select("row_key", "split").collect()) == sorted(want)


def test_split_sizes_disjoint_and_stratified(skewed):
    rows, df = skewed
    marked = splitting.stratified_split(df).select("row_key", "label", "split").collect()
    assert len(marked) == len(rows) == len({r["row_key"] for r in marked})
    positives = sum(r[1] for r in rows)
    for name, size in (("test", 1800), ("val", 1800), ("train", 5400)):
        part = [r for r in marked if r["split"] == name]
        assert len(part) == size
        assert abs(sum(r["label"] for r in part) - positives * size / len(rows)) <= 1


def test_results_do_not_depend_on_partitioning(skewed):
    _, df = skewed
    for marking in (splitting.stratified_split, splitting.stratified_kfold, sampling.downsample_majority,
                    lambda d: splitting.chronological_split(d, "t")):
        one = sorted(map(tuple, marking(df).drop("score").collect()))
        two = sorted(map(tuple, marking(df.repartition(3, "cat")).drop("score").collect()))
        assert one == two


def test_chronological_cut_inside_a_hot_timestamp(skewed):
    rows, df = skewed
    late = df.where("t >= 300")
    marked = splitting.chronological_split(late, "t", test_size=0.25, val_size=0.35).collect()
    kept = sorted((r["t"], r["row_key"], r["split"]) for r in marked)
    names = [s for _, _, s in kept]
    assert names == sorted(names, key=["train", "val", "test"].index)
    total = len(kept)
    end_of_train = max(t for t, _, s in kept if s == "train")
    assert all(s == "train" for t, _, s in kept if t <= end_of_train)
    rest = total - names.count("train")
    assert names.count("val") == round(rest * 0.35 / 0.6)


def test_chronological_errors(spark, skewed):
    _, df = skewed
    with pytest.raises(ValueError, match="not found"):
        splitting.chronological_split(df, "absent")
    with pytest.raises(ValueError, match="two distinct"):
        splitting.chronological_split(df.where("t = 500"), "t")
    with pytest.raises(ValueError, match="empty"):
        splitting.chronological_split(df.where("false"), "t")
    with pytest.raises(ValueError, match="not enough"):
        two = spark.createDataFrame([(1, 1, 0), (2, 2, 0)], "row_key bigint, t bigint, label int")
        splitting.chronological_split(two, "t")


def test_running_totals_and_metrics_under_skew(spark, skewed):
    rows, df = skewed
    got = metrics.ranking_metrics(df, ["cat"]).where("cat = 'hot'").first()
    mine = [(r[4], r[1]) for r in rows if r[3] == "hot"]
    positives = sum(y for _, y in mine)
    seen = hits = 0
    ap = 0.0
    for value in sorted({s for s, _ in mine}, reverse=True):
        tied = [y for s, y in mine if s == value]
        seen, hits = seen + len(tied), hits + sum(tied)
        ap += sum(tied) * hits / seen
    assert got["pr_auc"] == pytest.approx(ap / positives)
    pairs = sum((p > n) + 0.5 * (p == n) for p, y in mine if y for n, z in mine if not z)
    assert got["roc_auc"] == pytest.approx(pairs / positives / (len(mine) - positives))
    def numbers(**how):
        return {r["cat"]: (r["n_pos"], round(r["pr_auc"], 9)) for r in metrics.ranking_metrics(df, ["cat"], **how).collect()}

    assert numbers() == numbers(few_groups=False)
    per = df.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    cumulative = {r["t"]: r["cum_n"] for r in running_totals(per, [], "t", ["n"]).collect()}
    assert all(cumulative[t] == sum(1 for r in rows if r[2] <= t) for t in cumulative)


def test_single_class_metrics(spark):
    rows = spark.createDataFrame([("pos", 1, 0.1), ("pos", 1, 0.2), ("neg", 0, 0.3)], "g string, label int, score double")
    found = {r["g"]: r for r in metrics.ranking_metrics(rows, ["g"]).collect()}
    assert found["pos"]["pr_auc"] == 1.0 and found["pos"]["roc_auc"] is None
    assert found["neg"]["pr_auc"] == 0.0 and found["neg"]["roc_auc"] is None


def test_out_of_fold_value_ignores_own_fold_labels(spark, skewed):
    _, df = skewed
    folded = splitting.stratified_kfold(df)
    how, overall = encoding.TargetEncoding(smoothing=5.0, min_category_size=2), F.lit(0.2)

    def values(frame):
        mapping = encoding.out_of_fold_mapping(encoding.category_stats(frame, ["cat"], by=["fold"]), how, overall)
        return {(r["category"], r["fold"]): r["encoding"] for r in mapping.collect()}

    before = values(folded)
    after = values(folded.withColumn("label", F.when((F.col("fold") == 2) & (F.col("cat") == "hot"), 1 - F.col("label")).otherwise(F.col("label"))))
    assert before[("hot", 2)] == after[("hot", 2)]
    assert before[("hot", 1)] != after[("hot", 1)]


def test_large_mapping_takes_the_shuffle_path(skewed, monkeypatch):
    _, df = skewed
    encoder = encoding.fit_encoder(df, ["cat"])

    def encoded():
        return [sorted(map(tuple, how(df).collect())) for how in (encoder.transform_training, encoder.transform)]

    small = encoded()
    monkeypatch.setattr(encoding, "BROADCAST_ROWS", 0)
    for hot in (1, 3, 10_000):  # no hot category, one, all of them
        monkeypatch.setattr(encoding, "HOT_PART", hot)
        assert encoded() == small


def test_encoder_on_unseen_and_missing(spark):
    rows = [(i, i % 2, ["x", "y", "z"][i % 3], "p" if i % 2 else "q") for i in range(60)]
    train = spark.createDataFrame(rows, "row_key bigint, label int, many string, two string")
    encoder = encoding.fit_encoder(train, how=encoding.TargetEncoding(smoothing=0.0, min_category_size=0))
    new = spark.createDataFrame([(1, 0, "new", "other"), (2, 0, None, None), (3, 0, "x", "p")], train.schema)
    found = {r["row_key"]: r for r in encoder.transform(new).collect()}
    assert found[1]["many"] == found[2]["many"] == encoder.global_mean
    assert found[1]["two"] == found[2]["two"] == 0.5 and found[3]["two"] == 1.0
    with pytest.raises(ValueError):
        encoding.TargetEncoding(folds=1)
    with pytest.raises(ValueError):
        encoding.TargetEncoding(strategy="other")


def test_wide_correlations_agree_with_the_narrow_path(spark, skewed):
    _, df = skewed
    holes = df.withColumns({"a": F.when(F.col("row_key") % 7 != 0, F.col("t")), "b": F.col("score") * 3 + F.col("label"), "k": F.lit(4.0)})
    columns = ["a", "b", "score", "k"]
    narrow = {(r[0], r[1]): r[2] for r in profiling.correlations(holes, columns).collect()}
    wide = {(r[0], r[1]): r[2] for r in profiling.correlations(holes, columns, wide_pairs=0).collect()}
    assert narrow.keys() == wide.keys() and all(wide[p] == pytest.approx(narrow[p], abs=1e-9) for p in narrow)


def test_sample_errors(spark):
    only_negative = spark.createDataFrame([(1, 0), (2, 0)], "row_key bigint, label int")
    with pytest.raises(ValueError, match="positive"):
        sampling.balanced_sample(only_negative)
    few_negative = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "row_key bigint, label int")
    with pytest.raises(ValueError, match="negative"):
        sampling.balanced_sample(few_negative)
    assert sampling.downsample_majority(few_negative).count() == 3
