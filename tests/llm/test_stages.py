"""The filtering stages of the pipeline: which rows stay, under which column names, and what happens to empty tables."""

import random

import pytest

from winnow.llm import decontamination, near_dedup, quality, substring_dedup

DRAW = random.Random(11)
TEXTS = [" ".join(f"w{DRAW.randrange(5_000)}" for _ in range(90)) for _ in range(4)]
#: Columns named as the operators name things inside.
SCHEMA = ("doc_id long, text string, row int, key string, _t string, _z string, _spans int, _null int, missing int, _score double, score double, "
          "_hits int, hits int, _group string, class string, n long, wins boolean")


def table(spark, rows):
    return spark.createDataFrame([(i, t, k, "k", "t", "z", 1, 2, 3, 0.25, 0.5, 4, 5, "g", "c", 6, True) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def near(text: str) -> str:
    words = text.split()
    words[40] = "other"
    return " ".join(words)


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = TEXTS
    rows = [(7, a), (7, b), (3, b), (5, near(b)), (9, c), (None, c), (None, d), (None, d), (4, ""), (4, ""), (6, None), (None, None)]
    docs = table(spark, rows)
    found = near_dedup.keep_one(docs)
    assert left(found) == sorted([(7, a), (3, b), (9, c), (None, d), (4, ""), (4, ""), (6, None), (None, None)], key=repr)
    assert found.columns == docs.columns


def test_crowded_region(spark):
    """Many texts of one template, several groups: the rounds for crowded regions run."""
    words = TEXTS[3].split() * 2
    texts = []
    for k in range(60):
        mine = words[:]
        for at in DRAW.sample(range(len(mine)), 5 + k % 4):
            mine[at] = f"x{k}y{at}"
        texts.append(" ".join(mine))
    docs = table(spark, [*enumerate(texts), *enumerate(texts)])
    kept = {r["doc_id"] for r in near_dedup.near_duplicates(docs, 80).where("kept").collect()}
    assert len(kept) > 1 and left(near_dedup.keep_one(docs)) == sorted([(i, texts[i]) for i in kept], key=repr)


def test_of_equal_rows_one_stays(spark):
    a, b, *_ = TEXTS
    docs = table(spark, [(1, a), (2, b), (8, near(a))])
    assert left(near_dedup.keep_one(docs.union(docs).union(docs))) == sorted([(1, a), (2, b)], key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_same_id_and_text_with_other_columns(spark, parts):
    a = TEXTS[0]
    docs = table(spark, [(1, a), (1, a), (1, near(a))]).repartition(parts)
    first = {tuple(r) for r in near_dedup.keep_one(docs).collect()}
    assert len(first) == 1 and first == {tuple(r) for r in near_dedup.keep_one(docs.repartition(3)).collect()}


def test_stages_give_columns_as_they_are(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, f"{TEXTS[0]} tail", None, ""])]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    items = spark.createDataFrame([("i", " ".join(TEXTS[1].split()[10:30]))], "item_id string, text string")
    given = {r["row"]: tuple(r) for r in docs.collect()}

    kept = quality.keep_good(docs, labels, threshold=0.0)
    assert kept.schema == docs.schema and {r["row"]: tuple(r) for r in kept.collect()} == given
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and {r["row"]: tuple(r) for r in clean.collect()} == {k: r for k, r in given.items() if k != 1}
    cut = substring_dedup.remove_repeats(docs)
    found = {r["row"]: tuple(r) for r in cut.collect()}
    assert cut.columns == docs.columns and found == {**given, 0: (0, "", *given[0][2:]), 4: (4, "tail", *given[4][2:])}
    only = substring_dedup.remove_repeats(docs.select("text"))
    assert only.columns == ["text"] and only.count() == len(rows)


def test_stages_on_empty_tables(spark):
    nothing = table(spark, [(1, "a")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id string, text string")
    for found in (near_dedup.keep_one(nothing), quality.keep_good(nothing, labels), decontamination.clean(nothing, items), substring_dedup.remove_repeats(nothing)):
        assert found.columns == nothing.columns and found.count() == 0
