"""Queries and SQL for encoders, profiling, prefilters and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.operators import encoding as E
from winnow.operators import metrics as M
from winnow.operators import prefilters as X
from winnow.operators import profiling as R
from winnow.operators import splitting as S
from winnow.plans.checks.splitting import SPLIT_ORDERS_SQL, fold_sql
from winnow.plans.matrices import (
    CATEGORICAL, EVENTS_SQL, LABELS_SQL, NUMERIC, ORDERS_SQL, events_matrix, labels_matrix, orders_matrix, stored_once, table,
)

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return keep


def split_orders(spark, sf):
    return stored_once(spark, sf, "orders-split", lambda: S.stratified_split(orders_matrix(spark, sf)))


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


NAIVE = E.TargetEncoding(smoothing=0.0, min_category_size=0, strategy="naive")
SMOOTH = E.TargetEncoding(smoothing=10.0, min_category_size=30)

# --- encoders ----------------------------------------------------------------------------------


def long_sql(source: str, columns, kind: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS {kind}) AS value{', ' + extra if extra else ''} FROM {source}" for c in columns)


@query("category_stats", f"""
WITH {ORDERS_SQL}, u AS ({long_sql("m", CATEGORICAL, "VARCHAR", "label")})
SELECT feature, value AS category, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_pos FROM u GROUP BY 1, 2""")
def category_stats(spark, sf):
    return E.category_stats(orders_matrix(spark, sf), CATEGORICAL)


@query("binary_encode_fit", f"""
WITH {ORDERS_SQL}, a AS (SELECT line_status AS c, avg(label) AS mean FROM m WHERE line_status IS NOT NULL GROUP BY 1)
SELECT 'line_status' AS feature, (SELECT c FROM a ORDER BY mean, c DESC LIMIT 1) AS negative,
  (SELECT c FROM a ORDER BY mean DESC, c LIMIT 1) AS positive""")
def binary_fit(spark, sf):
    return E.binary_categories(E.category_stats(orders_matrix(spark, sf), ["line_status", "priority"]))


@query("binary_encode_transform", f"""
WITH {ORDERS_SQL}, a AS (SELECT line_status AS c, avg(label) AS mean FROM m WHERE line_status IS NOT NULL GROUP BY 1)
SELECT row_key, CASE WHEN line_status IS NULL THEN CAST(0.5 AS DOUBLE)
   WHEN line_status = (SELECT c FROM a ORDER BY mean DESC, c LIMIT 1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS line_status FROM m""")
def binary_transform(spark, sf):
    df = orders_matrix(spark, sf)
    return E.fit_encoder(df, ["line_status"]).transform(df.select("row_key", "line_status"))


def encoding_sql(strategy: str, pos: str, n: str, overall: str) -> str:
    mean = f"(CAST({pos} AS DOUBLE) / nullif({n}, 0))"
    if strategy == "naive":
        return f"coalesce({mean}, {overall})"
    lam = f"(CAST({n} AS DOUBLE) / nullif({n} + CAST(10 AS DOUBLE), 0))"
    return f"coalesce(CASE WHEN {n} >= 30 THEN {lam} * {mean} + (1 - {lam}) * {overall} END, {overall})"


def mapping_sql(strategy: str) -> str:
    return f"""
WITH {SPLIT_ORDERS_SQL}, g AS (SELECT avg(label) AS mean FROM s WHERE split = 'train'),
a AS (SELECT coalesce(nation, '__MISSING__') AS c, count(*) AS n, sum(label) AS p FROM s WHERE split = 'train' GROUP BY 1)
SELECT 'nation' AS feature, c AS category, round({encoding_sql(strategy, "p", "n", "(SELECT mean FROM g)")}, 9) AS encoding FROM a"""


def mapping(spark, sf, how):
    train = split_orders(spark, sf).where("split = 'train'")
    stats = E.category_stats(train, ["nation"])
    overall = train.agg(F.avg("label")).scalar()
    return rounded(E.target_mapping(stats, how, overall).select("feature", "category", "encoding"), "encoding", digits=9)


@query("target_encode_smoothed", mapping_sql("smoothed"))
def target_smoothed(spark, sf):
    return mapping(spark, sf, SMOOTH)


@query("target_encode_naive", mapping_sql("naive"))
def target_naive(spark, sf):
    return mapping(spark, sf, NAIVE)


def encoded_sql(columns=("nation",), strategy: str = "smoothed") -> str:
    """CTEs: ``enc`` = split orders, each column encoded out of fold in TRAIN and by TRAIN elsewhere."""
    parts = [f"""g AS (SELECT avg(label) AS mean FROM s WHERE split = 'train'),
tr AS (SELECT * FROM s WHERE split = 'train'), {fold_sql("tr")}"""]
    picks, joins = [], []
    for i, c in enumerate(columns):
        parts.append(f"""a{i} AS (SELECT coalesce({c}, '__MISSING__') AS c, count(*) AS n, sum(label) AS p FROM tr GROUP BY 1),
b{i} AS (SELECT coalesce({c}, '__MISSING__') AS c, fold, count(*) AS n, sum(label) AS p FROM f GROUP BY 1, 2)""")
        own_n, own_p = f"(a{i}.n - b{i}.n)", f"(a{i}.p - b{i}.p)"
        overall = "(SELECT mean FROM g)"
        picks.append(f"""CASE WHEN s.split = 'train' THEN {encoding_sql(strategy, own_p, own_n, overall)}
          ELSE {encoding_sql(strategy, f"a{i}.p", f"coalesce(a{i}.n, 0)", overall)} END AS {c}""")
        joins.append(f"""LEFT JOIN a{i} ON a{i}.c = coalesce(s.{c}, '__MISSING__')
  LEFT JOIN b{i} ON b{i}.c = coalesce(s.{c}, '__MISSING__') AND b{i}.fold = f.fold""")
    rest = ", ".join(columns)
    parts.append(f"""enc AS (SELECT s.* EXCLUDE ({rest}), f.fold, {', '.join(picks)}
  FROM s LEFT JOIN f USING (row_key) {' '.join(joins)})""")
    return ", ".join(parts)


def encoded_nation(spark, sf):
    def build():
        df = split_orders(spark, sf).select("row_key", "label", "split", "sum_qty", "nation")
        return E.encode_splits(df, ["nation"], how=SMOOTH)[0]
    return stored_once(spark, sf, "orders-encoded", build)


@query("target_encode_oof", f"""
WITH {SPLIT_ORDERS_SQL}, {encoded_sql()}
SELECT row_key, split, round(nation, 9) AS nation FROM enc""")
def target_oof(spark, sf):
    df = split_orders(spark, sf).select("row_key", "label", "split", "nation")
    encoded, _ = E.encode_splits(df, ["nation"], how=SMOOTH)
    return rounded(encoded.select("row_key", "split", "nation"), "nation", digits=9)


@query("encode_constant", f"WITH {ORDERS_SQL} SELECT row_key, CAST(0 AS DOUBLE) AS site, CAST(0.5 AS DOUBLE) AS void FROM m")
def encode_constant(spark, sf):
    df = orders_matrix(spark, sf)
    return E.fit_encoder(df, ["site", "void"]).transform(df.select("row_key", "site", "void"))


@query("feature_engineer", f"""
WITH {SPLIT_ORDERS_SQL}, {encoded_sql(("priority", "segment", "nation"), "naive")},
bin AS (SELECT line_status AS c, avg(label) AS mean FROM tr WHERE line_status IS NOT NULL GROUP BY 1)
SELECT row_key, split, label, round(priority, 9) AS priority, round(segment, 9) AS segment, round(nation, 9) AS nation,
  CASE WHEN line_status IS NULL THEN CAST(0.5 AS DOUBLE)
   WHEN line_status = (SELECT c FROM bin ORDER BY mean DESC, c LIMIT 1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS line_status,
  CAST(0 AS DOUBLE) AS site, CAST(0.5 AS DOUBLE) AS void FROM enc""")
def feature_engineer(spark, sf):
    df = split_orders(spark, sf).select("row_key", "label", "split", *CATEGORICAL)
    encoded, _ = E.encode_splits(df, how=NAIVE)
    return rounded(encoded, "priority", "segment", "nation", digits=9)


@query("lookup_encode", f"""
WITH {LABELS_SQL}, a AS (SELECT lang, avg(n_chars) AS mean FROM documents WHERE lang <> 'es' GROUP BY 1)
SELECT row_key, round(coalesce(mean, CAST(-1 AS DOUBLE)), 6) AS lang_chars FROM d LEFT JOIN a USING (lang)""")
def lookup_encode(spark, sf):
    per = table(spark, sf, "documents").where("lang <> 'es'").groupBy("lang").agg(F.avg("n_chars").alias("mean"))
    out = E.lookup_encode(labels_matrix(spark, sf), F.col("lang"), per, "mean", "lang_chars", F.lit(-1.0), key="lang")
    return rounded(out.select("row_key", "lang_chars"), "lang_chars")


# --- profiling ---------------------------------------------------------------------------------


@query("class_balance", """
SELECT toxic AS class, count(*) AS n_rows, CAST(100 * count(*) AS DOUBLE) / (SELECT count(*) FROM labels) AS percent FROM labels GROUP BY 1""")
def class_balance(spark, sf):
    return R.class_balance(table(spark, sf, "labels"), "toxic")


@query("positive_rate", f"WITH {ORDERS_SQL} SELECT count(*) AS n_rows, round(avg(label), 9) AS positive_rate FROM m")
def positive_rate(spark, sf):
    return rounded(R.positive_rate(orders_matrix(spark, sf)), "positive_rate", digits=9)


_SUMMARY = ["total_price", "n_lines", "sum_qty", "priority", "nation", "line_status", "void"]
_SUMMARY_TYPES = {"total_price": "double", "n_lines": "bigint", "sum_qty": "double"}


@query("column_summary", f"""
WITH {ORDERS_SQL}, u AS ({long_sql("m", _SUMMARY, "VARCHAR")})
SELECT feature, CASE {" ".join(f"WHEN feature = '{c}' THEN '{t}'" for c, t in _SUMMARY_TYPES.items())} ELSE 'string' END AS dtype,
  count(DISTINCT value) AS n_unique, round((1 - CAST(count(value) AS DOUBLE) / count(*)) * 100, 6) AS missing_pct FROM u GROUP BY 1""")
def column_summary(spark, sf):
    return rounded(R.column_summary(orders_matrix(spark, sf), _SUMMARY), "missing_pct")


@query("numeric_describe", f"""
WITH {ORDERS_SQL}, u AS ({long_sql("m", NUMERIC, "DOUBLE")})
SELECT feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
  round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
  max(value) AS max FROM u GROUP BY 1""")
def numeric_describe(spark, sf):
    return rounded(R.numeric_describe(orders_matrix(spark, sf), NUMERIC), "mean", "std", "p25", "p50", "p75")


def _corr_sql(a: str, b: str) -> str:
    return f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"


@query("corr_with_target", f"""
WITH {ORDERS_SQL}, c AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {_corr_sql(c, 'label')} AS corr FROM m" for c in NUMERIC)})
SELECT feature, round(corr, 6) AS corr FROM c WHERE corr IS NOT NULL AND NOT isnan(corr) ORDER BY abs(corr) DESC, feature LIMIT 5""")
def corr_with_target(spark, sf):
    return rounded(R.corr_with_target(orders_matrix(spark, sf), NUMERIC, top_n=5), "corr")


_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_corr_sql(a, b)} AS corr FROM m"
    for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:])


@query("corr_top_pairs", f"""
WITH {ORDERS_SQL}, c AS ({_PAIRS_SQL})
SELECT feature_a, feature_b, round(abs(corr), 6) AS abs_corr FROM c ORDER BY abs(corr) DESC, 1, 2 LIMIT 10""")
def corr_top_pairs(spark, sf):
    return rounded(R.corr_top_pairs(orders_matrix(spark, sf), NUMERIC), "abs_corr")


@query("corr_all_pairs_wide", f"""
WITH {ORDERS_SQL}, c AS ({_PAIRS_SQL}) SELECT feature_a, feature_b, round(corr, 6) AS corr FROM c WHERE NOT isnan(corr)""")
def corr_wide(spark, sf):
    return rounded(R.correlations(orders_matrix(spark, sf), NUMERIC, wide_pairs=0), "corr")


@query("feature_pairs_self_join", f"""
WITH {ORDERS_SQL} {" UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{a}' AS feature_a, '{b}' AS feature_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_both FROM m"
    for i, a in enumerate(NUMERIC) for j, b in enumerate(NUMERIC) if i < j)}""")
def feature_pairs(spark, sf):
    return R.feature_pairs_self_join(orders_matrix(spark, sf), NUMERIC)


# --- prefilters --------------------------------------------------------------------------------


@query("filter_constant", f"""
WITH {ORDERS_SQL}, u AS ({long_sql("m", [*NUMERIC, *CATEGORICAL], "VARCHAR")})
SELECT feature FROM u GROUP BY 1 HAVING count(DISTINCT value) < 2""")
def filter_constant(spark, sf):
    return X.constant_columns(orders_matrix(spark, sf), [*NUMERIC, *CATEGORICAL])


@query("filter_quasi_constant", f"""
WITH {ORDERS_SQL}, u AS ({long_sql("m", CATEGORICAL, "VARCHAR")}), v AS (SELECT feature, value, count(*) AS n FROM u GROUP BY 1, 2),
t AS (SELECT feature, coalesce(CAST(max(CASE WHEN value IS NOT NULL THEN n END) AS DOUBLE) / sum(n), 0) AS top_share FROM v GROUP BY 1)
SELECT feature, round(top_share, 6) AS top_share FROM t WHERE top_share > 0.8 AND feature <> 'segment'""")
def filter_quasi_constant(spark, sf):
    found = X.quasi_constant_columns(orders_matrix(spark, sf), CATEGORICAL, 0.8, whitelist=["segment"])
    return rounded(found, "top_share")


@query("filter_extreme_missing", f"""
WITH {ORDERS_SQL}, u AS ({long_sql("m", [*NUMERIC, *CATEGORICAL], "VARCHAR")})
SELECT feature, round(1 - CAST(count(value) AS DOUBLE) / count(*), 6) AS missing_share FROM u WHERE feature <> 'site'
GROUP BY 1 HAVING 1 - CAST(count(value) AS DOUBLE) / count(*) > 0.01""")
def filter_extreme_missing(spark, sf):
    found = X.extreme_missing_columns(orders_matrix(spark, sf), [*NUMERIC, *CATEGORICAL], 0.01, whitelist=["site"])
    return rounded(found, "missing_share")


_COPIES = ["p_size", "size_again", "price_one", "price_two", "price_zero", "p_brand"]


@query("filter_exact_duplicates", f"""
WITH v AS (SELECT p_size, p_size AS size_again, p_retailprice AS price_one, p_retailprice AS price_two,
  CASE WHEN p_partkey > 0 THEN p_retailprice END AS price_zero, p_brand FROM part),
c AS ({" UNION ALL ".join(
    f"SELECT '{b}' AS feature, '{a}' AS same_as FROM v HAVING bool_and(CAST({a} AS VARCHAR) IS NOT DISTINCT FROM CAST({b} AS VARCHAR))"
    for a in _COPIES for b in _COPIES if a < b)})
SELECT feature, min(same_as) AS same_as FROM c GROUP BY 1""")
def filter_exact_duplicates(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey", "p_size", F.col("p_size").alias("size_again"), F.col("p_retailprice").alias("price_one"),
        F.col("p_retailprice").alias("price_two"),
        F.when(F.col("p_partkey") > 0, F.col("p_retailprice")).alias("price_zero"), "p_brand")
    return X.exact_duplicate_columns(df, _COPIES, "p_partkey")


# --- ranking metrics ---------------------------------------------------------------------------


def metrics_sql(source: str, keys: str, score: str = "score", label: str = "label") -> str:
    """CTE ``metrics``: average precision and ROC area by ``keys``, one window per key."""
    on = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in keys.split(",")) if keys else "true"
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    del on
    return f"""
per AS (SELECT {lead}{score} AS score, sum({label}) AS p, count(*) AS n FROM {source} GROUP BY ALL),
cum AS (SELECT *, sum(p) OVER ({part}ORDER BY score DESC) AS cp, sum(n) OVER ({part}ORDER BY score DESC) AS cn FROM per),
metrics AS (SELECT {lead}CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(p) AS BIGINT) AS n_pos,
  coalesce(sum(p * (CAST(cp AS DOUBLE) / cn)) / nullif(sum(p), 0), 0) AS pr_auc,
  sum((n - p) * (cp - CAST(p AS DOUBLE) / 2)) / nullif(CAST(sum(p) AS DOUBLE) * (sum(n) - sum(p)), 0) AS roc_auc FROM cum {group})"""


@query("average_precision", f"""
WITH {SPLIT_ORDERS_SQL}, sc AS (SELECT split, label, coalesce(sum_qty, 0.0) AS score FROM s), {metrics_sql("sc", "split")}
SELECT split, round(pr_auc, 6) AS pr_auc FROM metrics""")
def average_precision(spark, sf):
    df = split_orders(spark, sf).withColumn("score", F.coalesce("sum_qty", F.lit(0.0)))
    return rounded(M.average_precision(df, ["split"]), "pr_auc")


@query("roc_auc", f"""
WITH {EVENTS_SQL}, sc AS (SELECT k, label, value AS score FROM e UNION ALL SELECT -1, 0, value FROM e), {metrics_sql("sc", "k")}
SELECT k, round(roc_auc, 6) AS roc_auc FROM metrics""")
def roc_auc(spark, sf):
    df = events_matrix(spark, sf).select("k", "label", F.col("value").alias("score"))
    single = df.select(F.lit(-1).alias("k"), F.lit(0).alias("label"), "score")
    return rounded(M.roc_auc(df.unionByName(single), ["k"]), "roc_auc")


@query("metrics_by_split", f"""
WITH {SPLIT_ORDERS_SQL}, sc AS (
  SELECT 'qty' AS model, split, label, coalesce(sum_qty, 0.0) AS score FROM s UNION ALL
  SELECT 'price', split, label, total_price FROM s), {metrics_sql("sc", "model, split")}
SELECT model, split, n_rows, n_pos, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM metrics""")
def metrics_by_split(spark, sf):
    models = F.array(
        F.struct(F.lit("qty").alias("model"), F.coalesce("sum_qty", F.lit(0.0)).alias("score")),
        F.struct(F.lit("price").alias("model"), F.col("total_price").alias("score")))
    df = split_orders(spark, sf).select("split", "label", F.explode(models).alias("_m")).select("split", "label", "_m.*")
    return rounded(M.metrics_by_split(df), "pr_auc", "roc_auc")


@query("metrics_of_encoding", f"""
WITH {SPLIT_ORDERS_SQL}, {encoded_sql()}, sc AS (SELECT split, label, round(nation, 12) AS score FROM enc), {metrics_sql("sc", "split")}
SELECT split, n_rows, n_pos, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM metrics""")
def metrics_of_encoding(spark, sf):
    df = encoded_nation(spark, sf).withColumn("score", F.round("nation", 12))
    return rounded(M.ranking_metrics(df, ["split"]), "pr_auc", "roc_auc")
