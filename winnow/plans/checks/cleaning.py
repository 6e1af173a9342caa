"""Queries and SQL for sources, sinks, projections and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.operators import cleaning as C
from winnow.operators import profiling, reports
from winnow.operators.prefilters import filter_leakage_meta
from winnow.plans.matrices import LABELS_SQL, ORDERS_SQL, labels_matrix, orders_matrix, table
from winnow.session import scratch_path
from winnow.sources import readers, registry, writers

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return keep


# --- sources -----------------------------------------------------------------------------------


@query("scan_csv_header", "SELECT * FROM customer")
def scan_csv_header(spark, sf):
    source, path = table(spark, sf, "customer"), scratch_path(spark, "customer-csv")
    source.write.option("header", True).csv(path)
    return readers.scan_csv_header(spark, path, source.schema)


_FIXED = T.StructType([
    T.StructField("row_key", T.LongType()), T.StructField("sum_qty", T.DoubleType()),
    T.StructField("nation", T.StringType()), T.StructField("label", T.IntegerType()),
])


@query("scan_csv_fixed", f"WITH {ORDERS_SQL} SELECT row_key, sum_qty, nation, label FROM m")
def scan_csv_fixed(spark, sf):
    path = scratch_path(spark, "fixed-csv")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in _FIXED.fieldNames()]
    orders_matrix(spark, sf).select(F.concat_ws(", ", *cells)).write.text(path)
    return readers.scan_csv_fixed(spark, path, _FIXED)


@query("scan_parquet", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size > 20")
def scan_parquet(spark, sf):
    return readers.scan_any(spark, f"{sf}/part.parquet", F.col("p_size") > 20).select("p_partkey", "p_name", "p_retailprice")


@query("scan_label_text", """
SELECT upper(replace(p_brand, '#', '_')) AS column_name, arg_max(p_name, p_partkey) AS label FROM part GROUP BY 1""")
def scan_label_text(spark, sf):
    path = scratch_path(spark, "labels-text")
    part = table(spark, sf, "part").orderBy("p_partkey")
    quote = F.when(F.col("p_partkey") % 2 == 0, F.lit("'")).otherwise(F.lit('"'))
    line = F.concat(F.lit("  "), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.lit(" = "), quote, "p_name", quote)
    part.select(F.when(F.col("p_partkey") % 10 == 3, F.concat(line, F.lit(" ;"))).otherwise(line)).write.text(path)
    return readers.scan_label_text(spark, path)


@query("scan_descriptions", "SELECT trim(n_name) AS feature, 'region ' || n_regionkey AS description FROM nation WHERE n_nationkey <> 3")
def scan_descriptions(spark, sf):
    path = scratch_path(spark, "descriptions")
    nation = table(spark, sf, "nation")
    name = F.when(F.col("n_nationkey") == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), "n_name", F.lit(" ")))
    nation.select(
        name.alias("Variable Name"), F.col("n_nationkey").alias("Rank"),
        F.concat(F.lit("region "), F.col("n_regionkey").cast("string"), F.lit(" ")).alias("Details"),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.scan_descriptions(spark, [path + "-absent", path])


# --- sinks -------------------------------------------------------------------------------------


@query("write_parquet_cache", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def write_parquet_cache(spark, sf):
    path = scratch_path(spark, "cache")
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    writers.write_parquet_cache(rows, path)
    writers.write_parquet_cache(rows.limit(0), path)  # the first write stands
    return readers.scan_parquet(spark, path)


@query("write_csv_split", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', o_orderkey, 'file-42')), o_orderkey) AS rk,
                  count(*) OVER () AS n FROM orders)
SELECT CASE WHEN rk <= floor(n * CAST(2 AS DOUBLE) / 3) THEN 'first' ELSE 'second' END AS part,
       count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM r GROUP BY 1""")
def write_csv_split(spark, sf):
    one, two = scratch_path(spark, "split-a"), scratch_path(spark, "split-b")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    writers.write_csv_split(orders, "o_orderkey", one, two)
    back = [
        readers.scan_csv_fixed(spark, p, orders.schema).withColumn("part", F.lit(n))
        for p, n in ((one, "first"), (two, "second"))
    ]
    return back[0].unionByName(back[1]).groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum")
    )


@query("dataset_registry", f"WITH {LABELS_SQL} SELECT row_key, label, lang, n_chars FROM d")
def dataset_registry(spark, sf):
    name = "documents_toxic"
    if name not in registry.list_datasets():
        registry.register_dataset(registry.DatasetEntry(
            name=name, loader=lambda s, p: registry.Dataset(labels_matrix(s, p)), default_path=sf, description="labelled documents", target="toxic"))
    registry.load_dataset(spark, name, sf, view="documents_toxic")
    return spark.table("documents_toxic").select("row_key", "label", "lang", "n_chars")


# --- cleaning ----------------------------------------------------------------------------------


@query("trim_columns", "SELECT n_name AS name, n_regionkey AS region FROM nation")
def trim_columns(spark, sf):
    raw = table(spark, sf, "nation").select(F.col("n_name").alias(" name "), F.col("n_regionkey").alias("region  "))
    return C.trim_column_names(raw)


@query("trim_strings_blank_to_null", """
SELECT conv_id, turn, nullif(trim(CASE WHEN turn = 1 THEN '   ' ELSE '  ' || role || ' ' END), '') AS role,
       nullif(trim(text), '') AS text FROM conversations""")
def trim_strings(spark, sf):
    raw = table(spark, sf, "conversations").withColumn(
        "role", F.when(F.col("turn") == 1, F.lit("   ")).otherwise(F.concat(F.lit("  "), "role", F.lit(" "))))
    return C.trim_strings(raw.select("conv_id", "turn", "role", "text"))


@query("strip_char", "SELECT item_id, trim(replace(text, '.', '')) AS text FROM benchmark")
def strip_char(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", C.strip_char("text", ".").alias("text"))


@query("drop_null_target", f"WITH {ORDERS_SQL} SELECT row_key, sum_qty FROM m WHERE sum_qty IS NOT NULL")
def drop_null_target(spark, sf):
    return C.drop_null_target(orders_matrix(spark, sf), "sum_qty").select("row_key", "sum_qty")


@query("dedup_rows", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def dedup_rows(spark, sf):
    return C.dedup_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("require_columns", """
SELECT 'absent' AS missing, count(*) AS n_rows FROM supplier""")
def require_columns(spark, sf):
    df = C.require_columns(table(spark, sf, "supplier"), ["s_suppkey", "s_name"])
    try:
        C.require_columns(df, ["s_suppkey", "absent"])
        missing = ""
    except ValueError as error:
        missing = str(error).rsplit(" ", 1)[-1]
    return df.agg(F.lit(missing).alias("missing"), F.count(F.lit(1)).alias("n_rows")).select("missing", "n_rows")


@query("drop_columns", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def drop_columns(spark, sf):
    return table(spark, sf, "customer").drop("c_name", "c_nationkey")


@query("drop_leaky_columns", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def drop_leaky_columns(spark, sf):
    return C.drop_leaky_columns(table(spark, sf, "part"), ["BRAND", "TYPE", "SIZE"], keep=["p_size"])


@query("filter_leakage_meta", "SELECT p_partkey, p_brand, p_type, p_size FROM part")
def leakage_meta(spark, sf):
    return filter_leakage_meta(table(spark, sf, "part"), ["p_name", "p_retailprice", "not_there"])


@query("drop_high_missing", f"WITH {ORDERS_SQL} SELECT row_key, nation, sum_qty, rare FROM (SELECT *, CASE WHEN row_key % 20 = 0 THEN sum_price END AS rare FROM m)")
def drop_high_missing(spark, sf):
    df = orders_matrix(spark, sf).select("row_key", "nation", "sum_qty", "sum_price", "void")
    rarer = F.when(F.col("row_key") % 1000 == 0, F.col("sum_price"))
    df = df.withColumns({"rare": F.when(F.col("row_key") % 20 == 0, F.col("sum_price")), "rarer": rarer})
    return C.drop_high_missing(df.drop("sum_price"))


CODES = "7, 8, 9, 77, 88, 99, 777, 888, 999, 7777, 8888, 9999, 77777, 88888, 99999"


@query("sentinel_to_null", f"""
SELECT CASE WHEN p_partkey NOT IN ({CODES}) THEN p_partkey END AS p_partkey, p_brand,
       CASE WHEN p_size NOT IN ({CODES}) THEN p_size END AS p_size,
       CASE WHEN p_retailprice NOT IN ({CODES}) THEN p_retailprice END AS p_retailprice FROM part""")
def sentinel_to_null(spark, sf):
    from winnow.sources.datasets import SURVEY_MISSING

    return C.sentinel_to_null(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), SURVEY_MISSING)


@query("target_equals", """
SELECT conv_id, turn, coalesce(CAST(upper(nullif(role, 'system')) = 'ASSISTANT' AS INTEGER), 0) AS label FROM conversations""")
def target_equals(spark, sf):
    df = table(spark, sf, "conversations").withColumn("role", F.nullif(F.col("role"), F.lit("system")))
    return df.select("conv_id", "turn", C.target_equals("role", "ASSISTANT", upper=True).alias("label"))


@query("one_vs_rest_target", "SELECT vec_id, CAST(label = 3 AS INTEGER) AS target FROM embeddings")
def one_vs_rest(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", C.one_vs_rest_target("label", 3).alias("target"))


@query("target_map_valid", """
SELECT p_partkey, CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS label FROM part WHERE p_size IN (1, 2, 3, 4)""")
def target_map_valid(spark, sf):
    from winnow.sources.datasets import SURVEY_CODES

    df = table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return C.target_map_valid(df, "p_size", SURVEY_CODES).select("p_partkey", "label")


@query("to_numeric_coerce", """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number FROM events""")
def to_numeric_coerce(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").withColumn("text", text).select("event_id", C.to_numeric_coerce("text").alias("number"))


@query("parse_event_date", """
WITH p AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%m%d%Y')
                          WHEN o_orderkey % 3 = 1 THEN '99' || strftime(o_orderdate, '%d%Y') END AS idate,
         CASE WHEN o_orderkey % 7 <> 0 THEN month(o_orderdate) END AS mo, day(o_orderdate) AS da, year(o_orderdate) AS ye
  FROM orders),
d AS (SELECT o_orderkey, coalesce(CAST(try_strptime(idate, '%m%d%Y') AS DATE), try_cast(
        CAST(ye AS VARCHAR) || '-' || lpad(CAST(mo AS VARCHAR), 2, '0') || '-' || lpad(CAST(da AS VARCHAR), 2, '0') AS DATE)) AS made FROM p)
SELECT o_orderkey, CAST(coalesce(made, (SELECT min(made) FROM d), DATE '2015-01-01') - DATE '1970-01-01' AS BIGINT) AS event_day FROM d""")
def parse_event_date(spark, sf):
    day = F.col("o_orderdate")
    raw = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "MMddyyyy"))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("99"), F.date_format(day, "ddyyyy"))).alias("IDATE"),
        F.when(F.col("o_orderkey") % 7 != 0, F.month(day).cast("string")).alias("IMONTH"),
        F.dayofmonth(day).cast("string").alias("IDAY"),
        F.year(day).cast("string").alias("IYEAR"),
    )
    return C.parse_event_date(raw, "event_day").select("o_orderkey", "event_day")


@query("low_cardinality_to_category", """
SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_quantity, l_discount, l_tax FROM lineitem""")
def low_cardinality(spark, sf):
    return C.low_cardinality_to_category(
        table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"))


@query("select_categorical", f"""
WITH {ORDERS_SQL} SELECT unnest(['priority', 'segment', 'nation', 'line_status', 'site', 'void']) AS feature,
  unnest([count(priority), count(segment), count(nation), count(line_status), count(site), count(void)]) AS non_null FROM m""")
def select_categorical(spark, sf):
    df = orders_matrix(spark, sf)
    return profiling.nonnull_counts(df, C.select_categorical(df))


@query("project_feature_set", f"WITH {ORDERS_SQL} SELECT row_key, label, sum_qty, n_lines FROM m")
def project_feature_set(spark, sf):
    return C.project_feature_set(orders_matrix(spark, sf), ["sum_qty", "n_lines"], ["row_key", "label"])


@query("union_all_files", """
SELECT s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier
UNION ALL SELECT c_name, c_nationkey, c_acctbal FROM customer""")
def union_all_files(spark, sf):
    one = table(spark, sf, "supplier").selectExpr("s_name AS name", "s_nationkey AS nationkey", "s_acctbal AS acctbal")
    two = table(spark, sf, "customer").selectExpr("c_acctbal AS acctbal", "c_name AS name", "c_nationkey AS nationkey")
    return C.union_all_files(one, two)


@query("nonnull_counts", f"""
WITH {ORDERS_SQL} SELECT unnest(['row_key', 'sum_qty', 'nation', 'void']) AS feature,
  unnest([count(row_key), count(sum_qty), count(nation), count(void)]) AS non_null FROM m""")
def nonnull_counts(spark, sf):
    return profiling.nonnull_counts(orders_matrix(spark, sf), ["row_key", "sum_qty", "nation", "void"])


@query("label_merge", """
WITH f AS (SELECT upper(replace(p_brand, '#', '_')) AS column_name, arg_max(p_name, p_partkey) AS label FROM part GROUP BY 1),
c AS (SELECT 'BRAND_1' AS column_name, count(p_partkey) AS n, 'bigint' AS t FROM part UNION ALL
      SELECT 'P_SIZE', count(p_size), 'int' FROM part UNION ALL
      SELECT 'P_TYPE', count(p_type), 'string' FROM part)
SELECT c.column_name, coalesce(f.label, CASE WHEN c.column_name <> 'P_TYPE' THEN 'own ' || c.column_name END, '') AS description,
  t AS dtype, n AS non_null_count FROM c LEFT JOIN f USING (column_name)""")
def label_merge(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey AS BRAND_1", "p_size AS P_SIZE", "p_type AS P_TYPE")
    counts = profiling.nonnull_counts(df)
    own = counts.where("feature <> 'P_TYPE'").select(
        F.col("feature").alias("column_name"), F.concat(F.lit("own "), "feature").alias("label"))
    return reports.label_merge(counts, own, scan_label_text(spark, sf), dict(df.dtypes))
