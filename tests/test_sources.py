"""Loaders, readers, writers and the registry on small files."""

import pytest

from winnow.operators import cleaning
from winnow.session import scratch_path
from winnow.sources import datasets, readers, registry, writers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="latin-1")


def test_student_grades(spark, tmp_path):
    write(tmp_path / datasets.STUDENT_FILE, " Age , Job ,Grade\n18, yes ,A\n18, yes ,A\n19,,b\n20,no,\n21,no, a\n")
    data = registry.load_dataset(spark, "student_grades", str(tmp_path))
    rows = sorted(map(tuple, data.frame.select("Age", "Job", "label").collect()), key=str)
    assert rows == [(18, "yes", 1), (19, None, 0), (21, "no", 1)]
    assert data.features == ["Age", "Job"]
    assert datasets.describe(data)["total_rows"] == "3"


def test_census_income(spark, tmp_path):
    def line(age, job, income, weight=1.5):
        values = {"age": age, "class_of_worker": job, "income": income, "instance_weight": weight, "year": 94}
        return ", ".join(str(values.get(c, 0)) for c in datasets.CENSUS_COLUMNS)

    write(tmp_path / datasets.CENSUS_TRAIN, "\n".join([line(30, "?", "- 50000."), line(30, "?", "- 50000."), line(30, "?", "- 50000.", 2.0)]))
    write(tmp_path / datasets.CENSUS_TEST, "\n".join([line(41, "Private ", "50000+.")]))
    data = registry.load_dataset(spark, "census_income", str(tmp_path))
    rows = sorted(map(tuple, data.frame.select("age", "class_of_worker", "year", "label").collect()), key=str)
    assert rows == [(30.0, None, 94, 0), (30.0, None, 94, 0), (41.0, "Private", 94, 1)]
    assert data.time_column == "year" and "instance_weight" not in data.frame.columns and len(datasets.CENSUS_COLUMNS) == 42
    assert datasets.load_census_income(spark, str(tmp_path / datasets.CENSUS_TEST)).frame.count() == 3
    with pytest.raises(FileNotFoundError):
        datasets.load_census_income(spark, str(tmp_path / "absent"))


def test_health_survey(spark, tmp_path):
    rows = [(float(i), "03012015" if i % 2 else "bad", "2", "5", "2015", float(i % 6), float(i % 3), 77.0 if i == 4 else i / 7,
             1.0, None) for i in range(1, 61)]
    raw = spark.createDataFrame(
        rows, "SEQNO double, IDATE string, IMONTH string, IDAY string, IYEAR string, DIABETE3 double, SEX double, BMI double, "
              "INSULIN double, EMPTY double")
    raw.write.parquet(str(tmp_path / "brfss_2015.parquet"))
    data = registry.load_dataset(spark, "brfss_2015", str(tmp_path))
    names = data.frame.columns
    assert "INSULIN" not in names and "EMPTY" not in names and "SEQNO" not in names and "DIABETE3" not in names
    found = {r["row_key"]: r for r in data.frame.collect()}
    positives = [r for r in found.values() if r["label"] == 1]
    assert len(positives) == 10 and len(found) == 20
    one = found[1]
    assert one["interview_timestamp"] == 16495.0  # 2015-03-01
    assert one["SEX"] == "1" and isinstance(one["BMI"], float)


def test_customer_satisfaction(spark, tmp_path):
    write(tmp_path / "train.csv", "ID,v1,TARGET\n1,2.5,0\n2,3.5,1\n2,3.5,1\n")
    data = registry.load_dataset(spark, "santander_customer_satisfaction", str(tmp_path))
    assert sorted(map(tuple, data.frame.select("row_key", "v1", "label").collect())) == [(1, 2.5, 0), (2, 3.5, 1)]
    write(tmp_path / "bad" / "train.csv", "ID,v1\n1,2\n")
    with pytest.raises(ValueError, match="TARGET"):
        registry.load_dataset(spark, "santander_customer_satisfaction", str(tmp_path / "bad"))
    with pytest.raises(FileNotFoundError):
        registry.load_dataset(spark, "santander_customer_satisfaction", str(tmp_path / "absent"))


def test_registry_errors():
    assert set(registry.list_datasets()) >= {"student_grades", "census_income", "brfss_2015", "santander_customer_satisfaction"}
    with pytest.raises(ValueError):
        registry.register_dataset(registry.get_dataset("student_grades"))
    with pytest.raises(KeyError):
        registry.get_dataset("absent")


def test_label_text(spark, tmp_path):
    write(tmp_path / "labels.sas", "  age = 'AGE OF CHILD'\nnonsense\nsex='SEX' ;\nAge = \"caf\xe9\"\n x 'no'\n")
    found = {r[0]: r[1] for r in readers.scan_label_text(spark, str(tmp_path / "labels.sas")).collect()}
    assert found == {"AGE": "caf\xe9", "SEX": "SEX"}


def test_descriptions_without_usable_columns(spark, tmp_path):
    write(tmp_path / "a.csv", "x,y\n1,2\n")
    assert readers.scan_descriptions(spark, [str(tmp_path / "none.csv"), str(tmp_path / "a.csv")]) is None


def test_run_directory_is_never_overwritten(spark):
    path, df = scratch_path(spark, "run"), spark.range(3).toDF("n")
    writers.write_run_tables(path, {"numbers": df})
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        writers.write_run_tables(path, {"numbers": df})


def test_csv_split_sizes(spark):
    one, two = scratch_path(spark, "a"), scratch_path(spark, "b")
    writers.write_csv_split(spark.range(100).toDF("k"), "k", one, two, 0.25)
    assert (spark.read.csv(one).count(), spark.read.csv(two).count()) == (25, 75)


def test_dates_without_any_source_column(spark):
    df = spark.createDataFrame([(1,)], "k int")
    assert cleaning.parse_event_date(df, "day").first()["day"] == 16436  # 2015-01-01


def test_low_cardinality_ignores_fractions_and_constants(spark):
    df = spark.createDataFrame([(1.0, 0.5, 3.0, i * 1.0) for i in range(40)] + [(2.0, 1.0, 3.0, 50.0)], "two double, half double, one double, many double")
    assert cleaning.low_cardinality_columns(df) == ["two"]
