"""Queries and SQL for splits, folds, samples and time order."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.operators import sampling as P
from winnow.operators import splitting as S
from winnow.plans.matrices import EVENTS_SQL, LABELS_SQL, ORDERS_SQL, events_matrix, labels_matrix, orders_matrix, table
from winnow.sources import readers

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return keep


def ranked_sql(source: str, salt: str, name: str = "r", by: str = "label") -> str:
    """Every row's place in the salted random order of its class, and the class size."""
    part = f"PARTITION BY {by} " if by else ""
    return f"""{name} AS (SELECT *, row_number() OVER ({part}ORDER BY md5(concat_ws('|', row_key, '{salt}')), row_key) AS rk,
      count(*) OVER ({part.strip()}) AS n_class, count(*) OVER () AS n_all FROM {source})"""


def shares_sql(sizes: str, size: str, total: str, name: str, out: str) -> str:
    """Largest-remainder stratification of ``total`` rows over the classes of ``sizes``."""
    return f"""{name} AS (
  SELECT * EXCLUDE (part, rest, total), part + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
      <= total - sum(part) OVER () THEN 1 ELSE 0 END AS {out}
  FROM (SELECT *, ({size}::HUGEINT * total::HUGEINT) // (sum({size}) OVER ())::HUGEINT AS part,
               ({size}::HUGEINT * total::HUGEINT) % (sum({size}) OVER ())::HUGEINT AS rest
        FROM (SELECT *, CAST({total} AS BIGINT) AS total FROM {sizes})))"""


def split_sql(source: str, salt: str = "split-42", name: str = "s") -> str:
    """``source`` with its stratified 60/20/20 split."""
    return f"""
sizes AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
{shares_sql("sizes", "n", "ceil(CAST(0.2 AS DOUBLE) * sum(n) OVER ())", "tested", "test")},
rests AS (SELECT *, n - test AS rest_n FROM tested),
{shares_sql("rests", "rest_n", "ceil(CAST(0.25 AS DOUBLE) * sum(rest_n) OVER ())", "valued", "val")},
{ranked_sql(source, salt, "ranked")},
{name} AS (SELECT ranked.* EXCLUDE (rk, n_class, n_all), CASE WHEN rk <= test THEN 'test' WHEN rk <= test + val THEN 'val' ELSE 'train' END AS split
      FROM ranked JOIN valued USING (label))"""


SPLIT_ORDERS_SQL = f"{ORDERS_SQL}, {split_sql('m')}"


@query("stratified_split", f"WITH {SPLIT_ORDERS_SQL} SELECT row_key, label, split FROM s")
def stratified_split(spark, sf):
    return S.stratified_split(orders_matrix(spark, sf)).select("row_key", "label", "split")


@query("inner_holdout_split", f"""
WITH {ORDERS_SQL}, sizes AS (SELECT label, count(*) AS n FROM m GROUP BY label),
{shares_sql("sizes", "n", "ceil(CAST(0.25 AS DOUBLE) * sum(n) OVER ())", "h", "held")}, {ranked_sql("m", "holdout-7")}
SELECT row_key, label, rk <= held AS is_holdout FROM r JOIN h USING (label)""")
def inner_holdout(spark, sf):
    return S.inner_holdout_split(orders_matrix(spark, sf), seed=7).select("row_key", "label", "is_holdout")


def fold_sql(source: str, seed: int = 42, folds: int = 5, name: str = "f") -> str:
    ends = " + ".join(f"CAST(rk > n_class * {i} // {folds} AS INTEGER)" for i in range(1, folds))
    return f"""{ranked_sql(source, f"fold-{seed}", "fold_ranked")},
{name} AS (SELECT * EXCLUDE (rk, n_class, n_all), {ends} AS fold FROM fold_ranked)"""


@query("stratified_kfold", f"WITH {ORDERS_SQL}, {fold_sql('m')} SELECT row_key, label, fold FROM f")
def stratified_kfold(spark, sf):
    return S.stratified_kfold(orders_matrix(spark, sf)).select("row_key", "label", "fold")


@query("fs_eval_sample", f"""
WITH {ORDERS_SQL}, {ranked_sql("m", "eval-42")}
SELECT row_key, label FROM r
WHERE label = 1 OR rk <= least(n_class, CAST(floor((n_all - n_class) * 1.5) AS BIGINT))""")
def fs_eval(spark, sf):
    return P.fs_eval_sample(orders_matrix(spark, sf), neg_pos_ratio=1.5).select("row_key", "label")


@query("downsample_majority", f"""
WITH {ORDERS_SQL}, {ranked_sql("m", "down-42")} SELECT row_key, label FROM r WHERE label = 1 OR rk <= n_all - n_class""")
def downsample(spark, sf):
    return P.downsample_majority(orders_matrix(spark, sf)).select("row_key", "label")


@query("balanced_sample", f"""
WITH {EVENTS_SQL}, {ranked_sql("e", "balance-42")},
b AS (SELECT row_key, label FROM r WHERE label = 1 OR rk <= n_all - n_class),
{ranked_sql("b", "shuffle-42", "t", "")}
SELECT row_key, label, CASE WHEN rk <= floor(n_all * (CAST(2 AS DOUBLE) / 3)) THEN 'train' ELSE 'test' END AS part FROM t""")
def balanced(spark, sf):
    return P.balanced_sample(events_matrix(spark, sf)).select("row_key", "label", "part")


@query("head_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 6000")
def head_sample(spark, sf):
    return P.head_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 6000)


@query("train_row_subsample", f"""
WITH {ORDERS_SQL}, y AS (SELECT *, CAST(year(order_ts) AS INTEGER) AS bucket FROM m), {ranked_sql("y", "rows-42", by="bucket")},
sizes AS (SELECT bucket, any_value(n_class) AS n, least(5000, any_value(n_all)) AS wanted, any_value(n_all) AS whole FROM r GROUP BY bucket),
turns AS (SELECT bucket, n * wanted // whole AS part, row_number() OVER (ORDER BY n * wanted % whole DESC, bucket) AS turn,
                 wanted - sum(n * wanted // whole) OVER () AS left_over FROM sizes)
SELECT row_key, r.bucket FROM r JOIN turns USING (bucket) WHERE rk <= part + CASE WHEN turn <= left_over THEN 1 ELSE 0 END""")
def row_subsample(spark, sf):
    df = orders_matrix(spark, sf).withColumn("bucket", F.year("order_ts"))
    return P.train_row_subsample(df, rows=5000, strata=["bucket"]).select("row_key", "bucket")


# --- time --------------------------------------------------------------------------------------


def chronological_sql(source: str, ts: str, columns: str) -> str:
    return f"""
g AS (SELECT {ts} AS t, count(*) AS n FROM {source} GROUP BY {ts}),
c AS (SELECT t, n, sum(n) OVER (ORDER BY t) AS upto, sum(n) OVER () AS whole FROM g),
want AS (SELECT min(t) AS t FROM c WHERE upto >= greatest(1, round_even(CAST(whole * 0.6 AS DOUBLE), 0))),
fin AS (SELECT max(t) AS t FROM c WHERE upto <= whole - 2 AND t <= (SELECT t FROM want)),
rest AS (SELECT *, row_number() OVER (ORDER BY {ts}, row_key) AS rk, count(*) OVER () AS n_rest
         FROM {source} WHERE {ts} > (SELECT t FROM fin)),
marked AS (SELECT row_key, CASE WHEN rk <= least(greatest(round_even(CAST(n_rest * 0.5 AS DOUBLE), 0), 1), n_rest - 1)
         THEN 'val' ELSE 'test' END AS split FROM rest)
SELECT {columns}, coalesce(split, 'train') AS split FROM {source} LEFT JOIN marked USING (row_key)"""


@query("chronological_split", f"WITH {ORDERS_SQL}, {chronological_sql('m', 'order_ts', 'row_key, label')}")
def chronological(spark, sf):
    return S.chronological_split(orders_matrix(spark, sf), "order_ts").select("row_key", "label", "split")


@query("chronological_split_unique", f"WITH {EVENTS_SQL}, {chronological_sql('e', 'ts', 'row_key')}")
def chronological_unique(spark, sf):
    return S.chronological_split(events_matrix(spark, sf), "ts").select("row_key", "split")


@query("time_inner_split", f"""
WITH {ORDERS_SQL}, c AS (SELECT order_ts, count(*) AS n FROM m GROUP BY 1),
u AS (SELECT order_ts, sum(n) OVER (ORDER BY order_ts) AS upto, sum(n) OVER () AS whole FROM c),
cut AS (SELECT min(order_ts) AS t FROM u WHERE upto >= floor(whole * 0.75))
SELECT row_key, order_ts > (SELECT t FROM cut) AS is_holdout FROM m""")
def time_inner(spark, sf):
    return S.time_inner_split(orders_matrix(spark, sf), "order_ts", 0.25).select("row_key", "is_holdout")


@query("timestamp_groups", """
WITH g AS (SELECT o_orderdate AS ts, count(*) AS n_rows FROM orders GROUP BY 1)
SELECT ts, n_rows, CAST(sum(n_rows) OVER (ORDER BY ts) - n_rows AS BIGINT) AS start_row,
  CAST(sum(n_rows) OVER (ORDER BY ts) AS BIGINT) AS end_row FROM g""")
def timestamp_groups(spark, sf):
    return S.timestamp_groups(table(spark, sf, "orders"), "o_orderdate")


@query("stable_sort_time", "SELECT event_id, ts FROM events ORDER BY ts, event_id")
def stable_sort(spark, sf):
    return S.stable_sort_time(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id")


@query("resolve_source", "SELECT r_regionkey, r_name FROM region")
def resolve_source(spark, sf):
    found = readers.resolve_source(spark, sf, ["absent.parquet", "region.parquet", "nation.parquet"])
    return readers.scan_any(spark, found).select("r_regionkey", "r_name")
