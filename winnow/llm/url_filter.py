"""URL filter: rules first, gradient-boosted trees on lexical features for the rest. DataFrame functions only.

A rule names a host (with all its subdomains), a path prefix and a verdict; the longest fitting rule decides. URLs that a rule decides
are the labelled examples. Spark ML's boosted trees learn from them and judge all other URLs by length, depth, digit ratio, entropy,
parameter counts and statistics of the host's suffix and the path's first step.

Statistics of the host's suffix and of the path's first step (share blocked, drawn towards the share of all by ``PRIOR`` rows, and support) are counted over all labelled URLs. A labelled
URL's own statistics leave out the fold it is in, one of ``FOLDS`` by a hash of host and path, so no label is a feature of its own row. The trees are
fitted on at most ``FIT_ROWS`` labelled URLs, the first by a hash of the URL, and judge every row. Rows under ``held_out`` are learned from nowhere and
get a score beside their rule's verdict.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; A-Z of the host are lower-cased and
nothing else; with examples of one verdict only, or of none, that verdict (``allow`` if none) is given to all others;
repeated rows are rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.session import materialise

#: (host, path, verdict), fixed by the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
FIT_ROWS = 20_000
TREES, DEPTH = 12, 4
FOLDS, PRIOR = 5, 20.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for name, prefix, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, f"{name}{prefix}").otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers read from the characters of a URL."""
    text = F.lower(F.coalesce(url, F.lit("")))
    size = F.length(text)
    whole = F.greatest(size, F.lit(1))
    count = lambda c: size - F.length(F.replace(text, F.lit(c), F.lit("")))
    part = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / whole
    entropy = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda sum_, c: F.when(part(c) > 0, sum_ - part(c) * F.log2(part(c))).otherwise(sum_))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "length": size, "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")), "labels": F.size(F.split(host, r"\.")),
        "digits": F.length(F.regexp_replace(text, "[^0-9]", "")) / whole, "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_length": F.length(query),
        "fragment": count("#"), "hyphens": count("-"), "secure": text.startswith("https").cast("int"),
        "first_step": F.length(F.regexp_extract(path, "^/([^/]*)", 1)),
    }


def _statistics(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds share blocked and support of the labelled rows with the same ``key``; for learnable rows (``_learn``) without their own fold."""
    known = rows.where("_learn").select(key, "_fold", (F.col("_given") == "block").cast("double").alias("_block"))
    counts = materialise(known.groupBy(key, "_fold").agg(F.sum("_block").alias("b"), F.count("*").cast("double").alias("n")), "url-counts")
    share = counts.agg(F.sum("b") / F.sum("n")).first()[0] or 0.0
    # At most FOLDS entries for a key.
    totals = counts.groupBy(key).agg(F.sum("b").alias("_b"), F.sum("n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_fold", F.struct("b", "n")))).alias("_folds"))
    rows = rows.join(totals, key, "left").withColumn("_own", F.try_element_at("_folds", F.col("_fold")))
    own = lambda c: F.when(F.col("_learn"), F.coalesce(F.col("_own")[c], F.lit(0.0))).otherwise(0.0)
    blocked, support = F.coalesce("_b", F.lit(0.0)) - own("b"), F.coalesce("_n", F.lit(0.0)) - own("n")
    return rows.withColumns({f"{name}_blocked": (blocked + PRIOR * share) / (support + PRIOR), f"{name}_support": F.log1p(support)}).drop("_b", "_n", "_folds", "_own")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", fit_rows: int = FIT_ROWS, held_out: Column | None = None) -> DataFrame:
    """Per page: host, path, rule, verdict, and the trees' probability of ``block`` where no rule fits or ``held_out`` (a condition on host and path) holds."""
    url = F.col("_url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_given": verdict, "_suffix": F.substring_index("host", ".", -2),
                             "_step": F.regexp_extract("path", "^/([^/]*)/", 1), "_fold": F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)).cast("int")})
    rows = rows.withColumn("_learn", F.col("_given").isNotNull() & ~F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False)))
    rows = materialise(rows.withColumns(lexical(url, F.col("host"), F.col("path"))), "url-features")
    names = [*lexical(url, F.col("host"), F.col("path")), "suffix_blocked", "suffix_support", "step_blocked", "step_support"]
    rows = _statistics(_statistics(rows, "_suffix", "suffix"), "_step", "step")
    known = rows.where("_learn")
    sample = materialise(known.orderBy(F.xxhash64("_url"), "page_id").limit(fit_rows).select(*names, (F.col("_given") == "block").cast("double").alias("_label")), "url-sample")
    seen = [r[0] for r in sample.select("_label").distinct().collect()]
    out = ["page_id", "host", "path", "rule"]
    if len(seen) < 2:
        other = "block" if seen == [1.0] else "allow"
        return rows.select(*out, F.coalesce("_given", F.lit(other)).alias("verdict"), F.when(~F.col("_learn"), F.lit(float(other == "block"))).alias("block_score"))
    pack = VectorAssembler(inputCols=names, outputCol="_features")
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_says",
                          maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False).fit(pack.transform(sample).coalesce(4))
    trees.setProbabilityCol("_odds").setRawPredictionCol("_raw")

    judged = trees.transform(pack.transform(rows)).withColumn("_block", vector_to_array("_odds")[1])
    return judged.select(*out, F.coalesce("_given", F.when(F.col("_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.when(~F.col("_learn"), F.col("_block")).alias("block_score"))
