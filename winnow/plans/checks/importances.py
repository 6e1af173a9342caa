"""Queries and SQL for importances, selection rules, set lookups, search and report tables.

The scorers are two fixed weighted sums, for which Shapley values have a closed form, so that the
whole chain (sample, Shapley triage, shuffling, rules, comparison) has an SQL twin over raw tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.operators import importance as I
from winnow.operators import metrics as M
from winnow.operators import reports as T
from winnow.operators import sampling as P
from winnow.operators import search as H
from winnow.operators import selection as L
from winnow.plans.checks.encoding import metrics_sql, rounded, split_orders
from winnow.plans.checks.splitting import SPLIT_ORDERS_SQL, ranked_sql
from winnow.plans.config import DEFAULTS, mode_rules
from winnow.plans.matrices import NUMERIC, stored_once, table
from winnow.session import scratch_path
from winnow.sources import writers

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return keep


WEIGHTS = {
    "m0": {"sum_qty": 0.02, "avg_disc": -3.0, "n_lines": 0.05, "acct_bal": 0.00001},
    "m1": {"sum_qty": 0.018, "avg_disc": -2.0, "sum_price": 0.0000005, "n_late": 0.02},
}
TOP_K, BLOCK = 6, 1000

# --- evaluation sample, Shapley, gain ----------------------------------------------------------


def eval_sample(spark, sf):
    return stored_once(spark, sf, "eval-sample", lambda: P.fs_eval_sample(
        split_orders(spark, sf).where("split = 'val'").select("row_key", "label", *NUMERIC), neg_pos_ratio=3))


def _w(model: str, feature: str) -> str:
    return f"CAST('{WEIGHTS[model].get(feature, 0.0)!r}' AS DOUBLE)"


EVAL_SQL = f"""{SPLIT_ORDERS_SQL}, va AS (SELECT * FROM s WHERE split = 'val'), {ranked_sql("va", "eval-42", "ve")},
x AS (SELECT row_key, label, {", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in NUMERIC)} FROM ve
  WHERE label = 1 OR rk <= least(n_class, CAST(floor((n_all - n_class) * 3) AS BIGINT)))"""

SHAP_MODEL_SQL = f"""{EVAL_SQL}, means AS (SELECT {", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in NUMERIC)} FROM x),
per_model AS ({" UNION ALL ".join(
    f"SELECT '{m}' AS model, '{c}' AS feature, abs({_w(m, c)}) * (SELECT avg(abs({c} - m_{c})) FROM x, means) AS mean_abs_shap, "
    f"{_w(m, c)} * {_w(m, c)} * (SELECT v_{c} FROM means) AS mean_gain"
    for m in WEIGHTS for c in NUMERIC)})"""

SHAP_SQL = f"""{SHAP_MODEL_SQL}, shap AS (SELECT feature, round(avg(mean_abs_shap), 9) AS mean_abs_shap FROM per_model GROUP BY 1),
raw_gain AS (SELECT feature, round(avg(mean_gain), 9) AS mean_gain FROM per_model GROUP BY 1 HAVING avg(mean_gain) > 0),
gain AS (SELECT feature, coalesce(mean_gain, 0) AS mean_gain FROM shap LEFT JOIN raw_gain USING (feature)),
top AS (SELECT feature, mean_abs_shap FROM shap ORDER BY mean_abs_shap DESC, feature LIMIT {TOP_K})"""


def per_model(spark, sf):
    return I.linear_importance(eval_sample(spark, sf), WEIGHTS, NUMERIC)


def shap_table(spark, sf):
    return stored_once(spark, sf, "shap-linear", lambda: rounded(I.shap_aggregate(per_model(spark, sf)), "mean_abs_shap", digits=9))


def raw_gain(spark, sf):
    gains = per_model(spark, sf).groupBy("feature").agg(F.round(F.avg("mean_gain"), 9).alias("mean_gain"))
    return gains.where("mean_gain > 0")


@query("linear_shap_importance", f"WITH {SHAP_MODEL_SQL} SELECT model, feature, round(mean_abs_shap, 9) AS mean_abs_shap, round(mean_gain, 9) AS mean_gain FROM per_model")
def linear_shap(spark, sf):
    return rounded(per_model(spark, sf), "mean_abs_shap", "mean_gain", digits=9)


@query("shap_aggregate", f"WITH {SHAP_SQL} SELECT * FROM shap")
def shap_aggregate(spark, sf):
    return rounded(I.shap_aggregate(per_model(spark, sf)), "mean_abs_shap", digits=9)


@query("topk_shap", f"WITH {SHAP_SQL} SELECT * FROM top")
def topk_shap(spark, sf):
    return I.topk_shap(shap_table(spark, sf), TOP_K)


@query("gain_reindex", f"WITH {SHAP_SQL} SELECT * FROM gain")
def gain_reindex(spark, sf):
    return I.gain_reindex(raw_gain(spark, sf), shap_table(spark, sf))


# --- shuffling ---------------------------------------------------------------------------------

BLOCK_SQL = f"""blocked AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', row_key, 'block', 42)), 1, 8) AS BIGINT)
    % greatest(1, CAST(ceil((SELECT count(*) FROM x) / {BLOCK}.0) AS BIGINT)) AS block FROM x)"""

SCORES_SQL = ", ".join(
    "CAST(0 AS DOUBLE)" + "".join(f" + {_w(m, c)} * {c}" for c in sorted(WEIGHTS[m])) + f" AS s_{m}" for m in WEIGHTS)


def _moved_sql(features: str) -> str:
    copies = " UNION ALL ".join(
        f"SELECT block, row_key, label, s_{m} AS base, {_w(m, c)} AS w, '{m}' AS model, '{c}' AS feature, {c} AS value, "
        f"md5(concat_ws('|', row_key, '{c}', '{m}', '42')) AS h FROM sb" for m in WEIGHTS for c in NUMERIC)
    return f"""{BLOCK_SQL}, sb AS (SELECT *, {SCORES_SQL} FROM blocked), copies AS (SELECT * FROM ({copies}) WHERE {features}),
moved AS (SELECT *, coalesce(lead(value) OVER (PARTITION BY block, feature, model ORDER BY h, row_key),
   first_value(value) OVER (PARTITION BY block, feature, model ORDER BY h, row_key
                            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS shuffled FROM copies)"""


@query("column_shuffle", f"""
WITH {EVAL_SQL}, {_moved_sql("feature IN ('sum_qty', 'avg_tax')")}
SELECT model, feature, row_key, value, shuffled FROM moved""")
def column_shuffle(spark, sf):
    df = eval_sample(spark, sf).select(
        "row_key", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("sum_qty", "avg_tax")])
    return I.column_shuffle(df, ["sum_qty", "avg_tax"], models=list(WEIGHTS), rows_per_block=BLOCK)


PERM_SQL = f"""{SHAP_SQL}, {_moved_sql("feature IN (SELECT feature FROM top)")},
sc AS (SELECT model, feature, label, base + w * (shuffled - value) AS score FROM moved
  {"".join(f" UNION ALL SELECT '{m}', '', label, s_{m} FROM sb" for m in WEIGHTS)}), {metrics_sql("sc", "model, feature")},
deltas AS (SELECT b.model, a.feature, b.pr_auc - a.pr_auc AS delta FROM metrics a JOIN metrics b
  ON a.model = b.model AND b.feature = '' AND a.feature <> ''),
perm AS (SELECT feature, round(avg(delta), 9) AS delta_mean, round(stddev_pop(delta), 9) AS delta_std FROM deltas GROUP BY 1)"""


def permutation(spark, sf):
    names = [r["feature"] for r in I.topk_shap(shap_table(spark, sf), TOP_K).collect()]  # k names
    counts = I.linear_permutation_counts(eval_sample(spark, sf), WEIGHTS, names, rows_per_block=BLOCK)
    return rounded(I.permutation_table(counts), "delta_mean", "delta_std", digits=9)


@query("permutation_importance", f"WITH {PERM_SQL} SELECT * FROM perm")
def permutation_importance(spark, sf):
    return permutation(spark, sf)


def stored_permutation(spark, sf):
    return stored_once(spark, sf, "permutation-linear", lambda: permutation(spark, sf))


@query("sort_permutation_table", f"WITH {PERM_SQL} SELECT * FROM perm ORDER BY delta_mean DESC, feature")
def sort_permutation(spark, sf):
    return I.sort_permutation_table(stored_permutation(spark, sf))


def artifacts(spark, sf):
    return stored_once(spark, sf, "artifacts-linear", lambda: L.artifact_table(
        shap_table(spark, sf), gain_reindex(spark, sf), stored_permutation(spark, sf)))


ART_SQL = f"""{PERM_SQL}, art AS (SELECT feature, mean_abs_shap, mean_gain, delta_mean, delta_std
  FROM shap LEFT JOIN gain USING (feature) LEFT JOIN perm USING (feature))"""

# --- rules -------------------------------------------------------------------------------------

_flags = {"enabled": True, "delta_max": 0.05, "delta_std_max": 0.05}
RULES = {
    **mode_rules(DEFAULTS),
    "drop_flagged": {**DEFAULTS["fs"], "overfit_filter": {**_flags, "max_shap_rank": 4, "action": "drop"}},
    "demote_flagged": {
        **DEFAULTS["fs"], "rest_policy": "keep_above_min_shap", "rest_min_shap_rank": 5, "drop_negative_features": False,
        "overfit_filter": {**_flags, "max_shap_rank": 5, "action": "demote"},
        "gain_overfit_filter": {**_flags, "max_gain_rank": 2, "action": "odd"},
    },
    "nothing_left": {**DEFAULTS["fs"], "thresholds": {"delta_abs_min": 9.0, "k_noise_std": 0.1}, "rest_policy": "unknown"},
}
GRID = {
    "delta_abs_min_values": [0.0, 0.0005, 0.001, 0.002, 0.004, 0.008, 0.016, 0.05, 0.2],
    "k_noise_std_values": [0.0, 0.1, 0.25, 0.5, 1.0, 1.8, 2.5],
    "rest_policies": ["keep_all", "keep_above_min_shap", "drop_all"],
    "drop_negative_options": [True, False],
}
GRID_BASE = {**DEFAULTS["fs"], "rest_min_shap_rank": 7}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    return str(value) if isinstance(value, int) else f"'{value}'"


_OPTION_NAMES = [f.strip().split()[0] for f in L.CANDIDATE_FIELDS.replace("\n", " ").split(",")]


def options_sql(rules, name: str = "opt") -> str:
    """The option table as VALUES."""
    rows = [L.candidate_row(i, m, r) for i, (m, r) in enumerate(rules.items(), start=1)]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"{name} AS (SELECT * FROM (VALUES {values}) v({', '.join(_OPTION_NAMES)}))"


def decide_sql(options: str) -> str:
    """CTEs up to ``kept``: every (candidate, feature) verdict with the keep-all fallback."""
    def flag(p):
        return f"""coalesce({p}_on AND ({p}_max_rank IS NULL OR {p}_rank <= {p}_max_rank) AND coalesce(delta_mean, 0) <= {p}_delta_max
          AND ({p}_std_max IS NULL OR coalesce(delta_std, 0) <= {p}_std_max), FALSE)"""
    return f"""{ART_SQL}, {options},
noise AS (SELECT coalesce(nullif(stddev_samp(delta_mean), 0), 0.000001) AS noise_std FROM perm),
each0 AS (SELECT *, rank() OVER (PARTITION BY candidate ORDER BY mean_abs_shap DESC) AS shap_rank,
   rank() OVER (PARTITION BY candidate ORDER BY mean_gain DESC) AS gain_rank, count(*) OVER (PARTITION BY candidate) AS n_features
   FROM art, opt, noise),
each1 AS (SELECT *, greatest(delta_abs_min, k_noise_std * noise_std) AS threshold, delta_mean IS NOT NULL AS permuted,
   {flag("shap")} AS shap_flag, {flag("gain")} AS gain_flag FROM each0),
each2 AS (SELECT *, (shap_flag AND shap_action = 'drop') OR (gain_flag AND gain_action = 'drop') AS barred,
   (shap_flag AND shap_action = 'demote') OR (gain_flag AND gain_action = 'demote') AS demoted FROM each1),
each3 AS (SELECT *, coalesce(permuted AND delta_mean >= threshold AND NOT demoted, FALSE) AS passes,
   (NOT permuted OR demoted) AND NOT barred AS in_rest,
   coalesce(drop_negative_features AND permuted AND delta_mean <= 0, FALSE) AS negative FROM each2),
each4 AS (SELECT * , (passes OR (in_rest AND CASE rest_policy WHEN 'keep_all' THEN TRUE
   WHEN 'keep_above_min_shap' THEN shap_rank <= coalesce(rest_min_shap_rank, n_features) ELSE FALSE END))
   AND NOT barred AND NOT negative AS kept0 FROM each3),
verdict AS (SELECT * , kept0 OR NOT bool_or(kept0) OVER (PARTITION BY candidate) AS kept FROM each4)"""


RULES_SQL = decide_sql(options_sql(RULES))
GRID_SQL = decide_sql(options_sql({f"grid_{i}": r for i, r in enumerate(L.grid_rules(GRID_BASE, GRID), start=1)}))


def decisions(spark, sf):
    return stored_once(spark, sf, "decisions-linear", lambda: L.select_features(artifacts(spark, sf), L.candidates(spark, RULES)))


@query("rank_min_desc", f"WITH {ART_SQL} SELECT feature, CAST(rank() OVER (ORDER BY mean_abs_shap DESC) AS INTEGER) AS shap_rank FROM art")
def rank_min_desc(spark, sf):
    return L.rank_min_desc(artifacts(spark, sf), "mean_abs_shap", "shap_rank").select("feature", "shap_rank")


@query("dynamic_threshold", f"""WITH {PERM_SQL}, t AS (SELECT coalesce(nullif(stddev_samp(delta_mean), 0), 0.000001) AS sd FROM perm)
SELECT round(sd, 9) AS noise_std, round(greatest(0.001, 2 * sd), 9) AS threshold FROM t""")
def dynamic_threshold(spark, sf):
    return rounded(L.dynamic_threshold(stored_permutation(spark, sf), 0.001, 2.0), "noise_std", "threshold", digits=9)


@query("keep_by_threshold", f"WITH {PERM_SQL} SELECT *, delta_mean >= 0.0025 AS passes FROM perm")
def keep_by_threshold(spark, sf):
    return L.keep_by_threshold(stored_permutation(spark, sf), 0.0025)


@query("flag_shap_overfit", f"WITH {RULES_SQL} SELECT mode, feature, shap_flag FROM verdict WHERE mode IN ('drop_flagged', 'demote_flagged')")
def flag_shap(spark, sf):
    return decisions(spark, sf).where("mode IN ('drop_flagged', 'demote_flagged')").select("mode", "feature", "shap_flag")


@query("flag_gain_overfit", f"WITH {RULES_SQL} SELECT mode, feature, gain_flag FROM verdict WHERE mode IN ('drop_flagged', 'demote_flagged')")
def flag_gain(spark, sf):
    return decisions(spark, sf).where("mode IN ('drop_flagged', 'demote_flagged')").select("mode", "feature", "gain_flag")


@query("overfit_action", f"WITH {RULES_SQL} SELECT mode, feature, barred, demoted FROM verdict")
def overfit_action(spark, sf):
    return L.decide(artifacts(spark, sf), L.candidates(spark, RULES)).select("mode", "feature", "barred", "demoted")


@query("rest_policy", f"WITH {RULES_SQL} SELECT mode, rest_policy, feature, in_rest, in_rest AND kept0 AS rest_kept FROM verdict")
def rest_policy(spark, sf):
    found = L.decide(artifacts(spark, sf), L.candidates(spark, RULES))
    return found.select("mode", "rest_policy", "feature", "in_rest", (F.col("in_rest") & F.col("kept")).alias("rest_kept"))


@query("apply_selection_rules", f"WITH {RULES_SQL} SELECT mode, feature, permuted, passes, negative, round(threshold, 9) AS threshold, kept0 AS kept FROM verdict")
def apply_rules(spark, sf):
    found = L.decide(artifacts(spark, sf), L.candidates(spark, RULES))
    return rounded(found.select("mode", "feature", "permuted", "passes", "negative", "threshold", "kept"), "threshold", digits=9)


@query("select_from_artifacts", f"WITH {RULES_SQL} SELECT mode, feature, kept FROM verdict")
def select_from_artifacts(spark, sf):
    return L.select_features(artifacts(spark, sf), L.candidates(spark, RULES)).select("mode", "feature", "kept")


@query("profile_modes", f"""
WITH {RULES_SQL} SELECT mode, delta_abs_min, k_noise_std, rest_policy, drop_negative_features, round(max(threshold), 9) AS threshold
FROM verdict WHERE mode IN ('aggressive', 'moderate', 'mild') GROUP BY ALL""")
def profile_modes(spark, sf):
    found = L.decide(artifacts(spark, sf), L.candidates(spark, mode_rules(DEFAULTS)))
    keys = ["mode", "delta_abs_min", "k_noise_std", "rest_policy", "drop_negative_features"]
    return found.groupBy(*keys).agg(F.round(F.max("threshold"), 9).alias("threshold"))


# --- lookups and set operations ----------------------------------------------------------------


@query("importance_outer_lookup", f"WITH {ART_SQL} SELECT feature, coalesce(delta_mean, 0) AS delta_mean, coalesce(delta_std, 0) AS delta_std FROM art")
def outer_lookup(spark, sf):
    return T.importance_outer_lookup(shap_table(spark, sf).select("feature"), stored_permutation(spark, sf))


@query("rest_features", f"WITH {RULES_SQL} SELECT feature FROM verdict WHERE mode = 'demote_flagged' AND in_rest")
def rest_features(spark, sf):
    mine = decisions(spark, sf).where("mode = 'demote_flagged'")
    return T.rest_features(
        shap_table(spark, sf).select("feature"), stored_permutation(spark, sf), mine.where("demoted"), mine.where("barred"))


@query("negative_features", f"WITH {PERM_SQL} SELECT feature, delta_mean <= 0.05 AS weak FROM perm WHERE delta_mean <= 0.05")
def negative_features(spark, sf):
    shifted = artifacts(spark, sf).withColumn("delta_mean", F.col("delta_mean") - 0.05)
    found = L.decide(shifted, L.candidates(spark, {"base": {"drop_negative_features": True}}))
    return found.where("negative").select("feature", F.col("negative").alias("weak"))


@query("overfit_union", f"WITH {RULES_SQL} SELECT DISTINCT feature FROM verdict WHERE mode = 'demote_flagged' AND (shap_flag OR gain_flag)")
def overfit_union(spark, sf):
    mine = decisions(spark, sf).where("mode = 'demote_flagged'")
    return T.overfit_union(mine.where("shap_flag"), mine.where("gain_flag"))


@query("kept_dropped_complement", f"WITH {RULES_SQL} SELECT feature FROM verdict WHERE mode = 'aggressive' AND NOT kept")
def complement(spark, sf):
    mine = decisions(spark, sf).where("mode = 'aggressive'")
    return T.kept_dropped_complement(shap_table(spark, sf), mine.where("kept"))


DESCRIBED_SQL = "desc_ AS (SELECT unnest(['sum_qty', 'n_lines', 'avg_disc']) AS feature, 'about ' || unnest(['sum_qty', 'n_lines', 'avg_disc']) AS description)"
REPORT_COLUMNS = """mode, feature, coalesce(description, '') AS description, kept, permuted, delta_mean, delta_std,
  round(delta_mean - threshold, 9) AS delta_minus_threshold, mean_abs_shap, mean_gain,
  CASE WHEN shap_flag AND gain_flag THEN 'SHAP, Gain' WHEN shap_flag THEN 'SHAP' WHEN gain_flag THEN 'Gain' ELSE '-' END AS overfit_flag"""
REPORT_SQL = f"{RULES_SQL}, {DESCRIBED_SQL}, report AS (SELECT {REPORT_COLUMNS} FROM verdict LEFT JOIN desc_ USING (feature))"


def report(spark, sf):
    named = shap_table(spark, sf).where(F.col("feature").isin("sum_qty", "n_lines", "avg_disc"))
    described = named.select("feature", F.concat(F.lit("about "), "feature").alias("description"))
    return rounded(T.feature_report(decisions(spark, sf), described), "delta_minus_threshold", digits=9)


@query("feature_report_join", f"WITH {REPORT_SQL} SELECT * FROM report")
def feature_report(spark, sf):
    return report(spark, sf)


# --- grid --------------------------------------------------------------------------------------


def _grid(spark):
    return L.grid_candidates(spark, GRID_BASE, GRID)


@query("grid_cross_join", f"""
WITH {GRID_SQL} SELECT candidate, delta_abs_min, k_noise_std, rest_policy, drop_negative_features, count(*) AS n_features FROM verdict GROUP BY ALL""")
def grid_cross_join(spark, sf):
    keys = ["candidate", "delta_abs_min", "k_noise_std", "rest_policy", "drop_negative_features"]
    return L.decide(artifacts(spark, sf), _grid(spark)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_features"))


SETS_SQL = f"""{GRID_SQL}, sets AS (SELECT candidate, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE kept), '') AS kept_features,
   count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE NOT kept) AS n_dropped FROM verdict GROUP BY 1),
firsts AS (SELECT *, min(candidate) OVER (PARTITION BY kept_features) AS first_candidate FROM sets),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY first_candidate) AS set_number FROM firsts)"""


def grid_sets(spark, sf):
    return stored_once(spark, sf, "grid-sets", lambda: L.feature_sets(L.select_features(artifacts(spark, sf), _grid(spark))))


@query("frontier_sweep", f"""
WITH {SETS_SQL} SELECT candidate, kept_features, CAST(n_kept AS INTEGER) AS n_kept, CAST(n_dropped AS INTEGER) AS n_dropped FROM sets""")
def frontier_sweep(spark, sf):
    found = L.feature_sets(L.select_features(artifacts(spark, sf), _grid(spark)))
    return found.select("candidate", F.concat_ws(",", "kept_features").alias("kept_features"), "n_kept", "n_dropped")


@query("dedup_feature_sets", f"""
WITH {SETS_SQL} SELECT candidate, first_candidate, CAST(set_number AS INTEGER) AS set_number, candidate <> first_candidate AS is_duplicate FROM numbered""")
def dedup_feature_sets(spark, sf):
    return H.mark_feature_sets(grid_sets(spark, sf)).select("candidate", "first_candidate", "set_number", "is_duplicate")


CAP = 3
CAP_SQL = f"""{SETS_SQL}, capped AS (SELECT candidate, CASE WHEN set_number <= {CAP} THEN 'frontier_' || set_number END AS set_mode,
  set_number <= {CAP} AND candidate <> first_candidate AS is_duplicate, set_number > {CAP} AS skipped_due_to_limit FROM numbered)"""


@query("candidate_cap", f"WITH {CAP_SQL} SELECT * FROM capped")
def candidate_cap(spark, sf):
    return H.mark_feature_sets(grid_sets(spark, sf), CAP).select("candidate", "set_mode", "is_duplicate", "skipped_due_to_limit")


@query("frontier_counts", f"""
WITH {CAP_SQL} SELECT count(*) FILTER (WHERE NOT is_duplicate AND NOT skipped_due_to_limit) AS evaluated,
  count(*) FILTER (WHERE is_duplicate) AS duplicates, count(*) FILTER (WHERE skipped_due_to_limit) AS skipped FROM capped""")
def frontier_counts(spark, sf):
    return H.frontier_counts(H.mark_feature_sets(grid_sets(spark, sf), CAP))


@query("write_frontier_log", f"WITH {CAP_SQL} SELECT coalesce(set_mode, 'none') AS mode, count(*) AS n FROM capped GROUP BY 1")
def write_frontier_log(spark, sf):
    log = H.mark_feature_sets(grid_sets(spark, sf), CAP).drop("mode").withColumnRenamed("set_mode", "mode")
    target = writers.write_frontier_log(log, scratch_path(spark, "run"))
    return spark.read.json(target).groupBy(F.coalesce("mode", F.lit("none")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


# --- models of each mode -----------------------------------------------------------------------

MODES = list(RULES)


def _points(feature: str):
    weight = sum(w.get(feature, 0.0) for w in WEIGHTS.values())
    return F.round(F.coalesce(F.col(feature).cast("double"), F.lit(0.0)) * F.lit(weight) * 1000).cast("bigint")


POINTS_SQL = {
    c: f"CAST(round(coalesce(CAST({c} AS DOUBLE), 0) * CAST('{sum(w.get(c, 0.0) for w in WEIGHTS.values())!r}' AS DOUBLE) * 1000) AS BIGINT)"
    for c in NUMERIC}


def set_models(spark, sf):
    """Each mode's all-features and filtered scorer rated on every split: the closed-form twin of fitting both."""
    def build():
        lists = L.feature_sets(decisions(spark, sf)).select("mode", "kept_features").collect()  # one row per mode
        cells, sizes = [], []
        for row in lists:
            for model, features in (("all_features", NUMERIC), ("fs_filtered", row["kept_features"])):
                total = F.lit(0).cast("bigint")
                for f in features:
                    total = total + F.col(f"_p_{f}")
                cells.append(F.struct(F.lit(row["mode"]).alias("mode"), F.lit(model).alias("model"), total.alias("score")))
                sizes.append((row["mode"], model, len(features)))
        pointed = split_orders(spark, sf).withColumns({f"_p_{f}": _points(f) for f in NUMERIC})
        scored = pointed.select("split", "label", F.explode(F.array(*cells)).alias("_c")).select("split", "label", "_c.*")
        long = rounded(M.metrics_by_split(scored, ["mode", "model"]), "pr_auc", "roc_auc", digits=9)
        counts = spark.createDataFrame(sizes, "mode string, model string, feature_count int")
        return T.metrics_table(long).join(counts, ["mode", "model"])
    return stored_once(spark, sf, "set-models", build)


_WIDE = [f"{s}_{m}" for s in ("train", "val", "test") for m in ("pr_auc", "roc_auc")]
MODELS_SQL = f"""{RULES_SQL}, member AS (SELECT mode, 'fs_filtered' AS model, feature FROM verdict WHERE kept
   UNION ALL SELECT mode, 'all_features', feature FROM verdict),
pts AS ({" UNION ALL ".join(f"SELECT row_key, split, label, '{c}' AS feature, {e} AS points FROM s" for c, e in POINTS_SQL.items())}),
sc2 AS (SELECT mode, model, row_key, split, label, CAST(sum(points) AS BIGINT) AS score FROM pts JOIN member USING (feature) GROUP BY ALL),
{metrics_sql("sc2", "mode, model, split").replace("per AS", "per2 AS").replace("FROM per)", "FROM per2)").replace("cum AS", "cum2 AS").replace("FROM cum ", "FROM cum2 ").replace("metrics AS", "metrics2 AS")},
models AS (SELECT mode, model, {", ".join(f"round(max(CASE WHEN split = '{c.split('_')[0]}' THEN {c.split('_', 1)[1]} END), 9) AS {c}" for c in _WIDE)},
   (SELECT CAST(count(*) AS INTEGER) FROM member k WHERE k.mode = q.mode AND k.model = q.model) AS feature_count FROM metrics2 q GROUP BY mode, model)"""

WEIGHT, TOLERANCE = 0.3, 0.01
SCORE_SQL = f"val_pr_auc - {WEIGHT} * (train_pr_auc - val_pr_auc)"


@query("metrics_table", f"WITH {MODELS_SQL} SELECT mode, model, feature_count, {', '.join(f'round({c}, 6) AS {c}' for c in _WIDE)} FROM models")
def metrics_table(spark, sf):
    return rounded(set_models(spark, sf), *_WIDE).select("mode", "model", "feature_count", *_WIDE)


@query("gap_penalised_score", f"WITH {MODELS_SQL} SELECT mode, model, round({SCORE_SQL}, 6) AS score FROM models")
def gap_score(spark, sf):
    return rounded(H.with_score(set_models(spark, sf), WEIGHT), "score").select("mode", "model", "score")


def chosen_sql(order: str, source: str = "models", by: str = "PARTITION BY mode ") -> str:
    return f"""SELECT *, eligible AND row_number() OVER ({by}ORDER BY eligible DESC, {order}) = 1 AS selected FROM (
   SELECT *, {SCORE_SQL} AS score, val_pr_auc >= (1 - CAST({TOLERANCE} AS DOUBLE)) * max(val_pr_auc) OVER ({by}) AS eligible FROM {source})"""


@query("select_model_within_tolerance", f"WITH {MODELS_SQL} SELECT mode, model, selected FROM ({chosen_sql('score DESC, feature_count, val_pr_auc DESC, model')})")
def within_tolerance(spark, sf):
    return H.select_model_within_tolerance(set_models(spark, sf), TOLERANCE, WEIGHT).select("mode", "model", "selected")


@query("smallest_within_tolerance", f"WITH {MODELS_SQL} SELECT mode, model, selected FROM ({chosen_sql('feature_count, val_pr_auc DESC, model')})")
def smallest(spark, sf):
    return H.smallest_within_tolerance(set_models(spark, sf), TOLERANCE).select("mode", "model", "selected")


@query("select_frontier_primary", f"""
WITH {MODELS_SQL}, fm AS (SELECT * FROM models WHERE model = 'fs_filtered')
SELECT mode, round(score, 6) AS score, feature_count FROM ({chosen_sql('score DESC, feature_count, val_pr_auc DESC, mode', 'fm', '')}) WHERE selected""")
def frontier_primary(spark, sf):
    return rounded(H.select_frontier_primary(set_models(spark, sf), TOLERANCE, WEIGHT), "score").select("mode", "score", "feature_count")


@query("identical_modes", f"""
WITH {MODELS_SQL}, ch AS ({chosen_sql('score DESC, feature_count, val_pr_auc DESC, model')}),
pr AS (SELECT mode, string_agg(concat_ws('/', model, feature_count, selected, {", ".join(_WIDE)}), ';' ORDER BY model) AS p FROM ch GROUP BY 1),
ks AS (SELECT mode, string_agg(CASE WHEN kept THEN feature END, ',' ORDER BY feature) AS k FROM verdict GROUP BY 1)
SELECT a.mode FROM pr a JOIN ks x USING (mode), pr b JOIN ks y USING (mode)
WHERE b.mode = 'moderate' AND a.mode <> 'moderate' AND a.p = b.p AND x.k IS NOT DISTINCT FROM y.k""")
def identical(spark, sf):
    chosen = H.select_model_within_tolerance(set_models(spark, sf), TOLERANCE, WEIGHT)
    return H.identical_modes(chosen, L.feature_sets(decisions(spark, sf)), "moderate")


@query("mode_summary", f"""
WITH {MODELS_SQL}, v AS (SELECT mode, CAST(count(*) FILTER (WHERE kept) AS INTEGER) AS n_kept, CAST(count(*) FILTER (WHERE NOT kept) AS INTEGER) AS n_dropped,
   delta_abs_min, k_noise_std, rest_policy FROM verdict GROUP BY ALL)
SELECT mode, n_kept, n_dropped, delta_abs_min, k_noise_std, rest_policy, round(train_pr_auc, 6) AS train_pr_auc, round(val_pr_auc, 6) AS val_pr_auc,
  round(test_pr_auc, 6) AS test_pr_auc, round({SCORE_SQL}, 6) AS score, mode = 'moderate' AS is_primary
FROM v JOIN models USING (mode) WHERE model = 'fs_filtered'""")
def mode_summary(spark, sf):
    found = T.mode_summary(L.feature_sets(decisions(spark, sf)), set_models(spark, sf), "moderate", WEIGHT)
    return rounded(found, "train_pr_auc", "val_pr_auc", "test_pr_auc", "score")


@query("mode_ranking", f"""
WITH {MODELS_SQL}, u AS (SELECT 'all_features (baseline)' AS label, * FROM models WHERE mode = 'moderate' AND model = 'all_features'
  UNION ALL SELECT mode, * FROM models WHERE model = 'fs_filtered')
SELECT label, feature_count, round(train_pr_auc, 6) AS train_pr_auc, round(val_pr_auc, 6) AS val_pr_auc,
  round(train_pr_auc - val_pr_auc, 6) AS gap, round({SCORE_SQL}, 6) AS score FROM u ORDER BY score DESC, label""")
def mode_ranking(spark, sf):
    return rounded(T.mode_ranking(set_models(spark, sf), "moderate", WEIGHT), "train_pr_auc", "val_pr_auc", "gap", "score")


@query("frontier_curve", f"""
WITH {MODELS_SQL}, c AS (SELECT row_number() OVER (ORDER BY mode) AS candidate, mode, feature_count, train_pr_auc, val_pr_auc, {SCORE_SQL} AS score
  FROM models WHERE model = 'fs_filtered')
SELECT mode, feature_count, round(train_pr_auc, 6) AS train_pr_auc, round(val_pr_auc, 6) AS val_pr_auc, round(score, 6) AS score,
  mode = (SELECT mode FROM c ORDER BY score DESC, feature_count, candidate LIMIT 1) AS is_best FROM c""")
def frontier_curve(spark, sf):
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("mode"))
    evaluated = set_models(spark, sf).where("model = 'fs_filtered'").withColumn("candidate", order)
    found = T.frontier_curve(evaluated, WEIGHT).select("mode", "feature_count", "train_pr_auc", "val_pr_auc", "score", "is_best")
    return rounded(found, "train_pr_auc", "val_pr_auc", "score")


@query("write_run_tables", f"""
WITH {MODELS_SQL} SELECT mode, model, feature_count FROM models WHERE mode <> 'mild'""")
def write_run_tables(spark, sf):
    run = scratch_path(spark, "run")
    models, same = set_models(spark, sf), set_models(spark, sf).where("mode = 'mild'").select("mode").distinct()
    sets = L.feature_sets(decisions(spark, sf))
    writers.write_run_tables(run, {"models": models, "feature_sets": sets, "permutation": stored_permutation(spark, sf)}, same)
    kept = spark.read.json(f"{run}/feature_sets").select("mode")
    return spark.read.parquet(f"{run}/models").join(kept, "mode", "left_semi").select("mode", "model", "feature_count")


# --- report tables -----------------------------------------------------------------------------


@query("feature_summary", f"""
WITH {RULES_SQL} SELECT mode, count(*) AS n_features, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE NOT kept) AS n_dropped,
  count(*) FILTER (WHERE shap_flag) AS n_shap_flags, count(*) FILTER (WHERE gain_flag) AS n_gain_flags FROM verdict GROUP BY 1""")
def feature_summary(spark, sf):
    return T.feature_summary(decisions(spark, sf))


@query("top_permutation", f"WITH {PERM_SQL} SELECT * FROM perm ORDER BY delta_mean DESC, feature LIMIT 3")
def top_permutation(spark, sf):
    return T.top_permutation(stored_permutation(spark, sf), 3)


@query("top_shap", f"WITH {SHAP_SQL} SELECT * FROM shap ORDER BY mean_abs_shap DESC, feature LIMIT 15")
def top_shap(spark, sf):
    return I.topk_shap(shap_table(spark, sf), 15)


@query("top_overfit", f"""
WITH {REPORT_SQL} SELECT feature, description, delta_mean, delta_std, mean_abs_shap AS metric FROM report
WHERE mode = 'demote_flagged' AND overfit_flag LIKE '%SHAP%' ORDER BY abs(mean_abs_shap) DESC NULLS LAST, feature LIMIT 20""")
def top_overfit(spark, sf):
    return T.top_overfit(report(spark, sf).where("mode = 'demote_flagged'"), "shap")


@query("top_kept", f"""
WITH {REPORT_SQL} SELECT feature, description, delta_mean, delta_std, mean_abs_shap, mean_gain FROM report
WHERE mode = 'moderate' AND kept ORDER BY delta_mean DESC NULLS LAST, feature LIMIT 20""")
def top_kept(spark, sf):
    return T.top_kept(report(spark, sf).where("mode = 'moderate'"))


# --- rules of the written specification --------------------------------------------------------


@query("noise_band_reference", f"""
WITH {PERM_SQL}, low AS (SELECT delta_mean FROM perm JOIN shap USING (feature) ORDER BY mean_abs_shap, feature LIMIT 4)
SELECT round(coalesce(nullif(stddev_samp(delta_mean), 0), 0.000001), 9) AS noise_std FROM low""")
def noise_band(spark, sf):
    return rounded(L.noise_band_reference(stored_permutation(spark, sf), shap_table(spark, sf), 4), "noise_std", digits=9)


@query("keep_topn_or_whitelist", f"""
WITH {PERM_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY delta_mean DESC, feature) AS pl,
   coalesce(nullif(stddev_samp(delta_mean) OVER (), 0), 0.000001) AS sd FROM perm)
SELECT feature, CAST(pl AS INTEGER) AS place, delta_mean >= 0.2 OR delta_mean >= 2 * sd OR pl <= 2 OR feature = 'avg_disc' AS kept FROM p""")
def keep_topn(spark, sf):
    found = L.keep_topn_or_whitelist(stored_permutation(spark, sf), 0.2, 2.0, 2, ["avg_disc"])
    return found.select("feature", "place", "kept")


_PERCENT_SQL = """percent_rank() OVER (ORDER BY coalesce(mean_abs_shap, 0) DESC) AS rank_shap,
  percent_rank() OVER (ORDER BY coalesce(mean_gain, 0) DESC) AS rank_gain, percent_rank() OVER (ORDER BY coalesce(delta_mean, 0) DESC) AS rank_perm"""


@query("rank_percentiles", f"WITH {ART_SQL}, p AS (SELECT feature, {_PERCENT_SQL} FROM art) SELECT feature, round(rank_shap, 9) AS rank_shap, round(rank_gain, 9) AS rank_gain, round(rank_perm, 9) AS rank_perm FROM p")
def rank_percentiles(spark, sf):
    found = L.rank_percentiles(artifacts(spark, sf)).select("feature", "rank_shap", "rank_gain", "rank_perm")
    return rounded(found, "rank_shap", "rank_gain", "rank_perm", digits=9)


@query("overfit_score", f"WITH {ART_SQL}, p AS (SELECT feature, {_PERCENT_SQL} FROM art) SELECT feature, round(rank_perm - rank_gain, 9) AS overfit_score FROM p")
def overfit_score(spark, sf):
    return rounded(L.overfit_score(artifacts(spark, sf)), "overfit_score", digits=9).select("feature", "overfit_score")
