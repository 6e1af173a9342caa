"""File sources. Schemas are explicit wherever the caller knows them: inference costs a full scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.scalars import nulls_for_nan

# --- fixed values: accepted header names of a description table, in order of preference ---
NAME_ALIASES = ("feature", "column", "variable", "variable name", "variable_name")
DESCRIPTION_ALIASES = ("description", "label", "details")
LABEL_LINE = r"^(\w+)\s*=\s*['\"](.+?)['\"]"
# --- end of fixed values ---


def path_exists(spark: SparkSession, path: str) -> bool:
    """Works for any file system Spark can read, by asking the file source for its names."""
    try:
        spark.read.format("binaryFile").load(path).select("path").schema
        return True
    except Exception as missing:  # AnalysisException subclasses differ between Spark versions
        if "PATH_NOT_FOUND" in str(missing):
            return False
        raise


def resolve_source(spark: SparkSession, path: str, candidates: Sequence[str]) -> str:
    """``path`` itself if it names a file format, else the first candidate existing below it."""
    if path.lower().endswith((".parquet", ".csv", ".data", ".test", ".txt")) and path_exists(spark, path):
        return path
    for name in candidates:
        option = f"{path.rstrip('/')}/{name}"
        if path_exists(spark, option):
            return option
    raise FileNotFoundError(f"no source found under {path}; looked for {', '.join(candidates)}")


def scan_csv_header(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, which reads the data twice."""
    reader = spark.read.option("header", True).option("nanValue", "NaN")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nulls_for_nan(reader.csv(path))


def scan_csv_fixed(spark: SparkSession, path: str | list[str], schema: T.StructType, null_text: str = "?") -> DataFrame:
    """Headerless CSV with known columns; leading blanks are skipped and ``null_text`` is NULL."""
    reader = spark.read.schema(schema).option("header", False).option("ignoreLeadingWhiteSpace", True)
    return reader.option("nullValue", null_text).csv(path)


def scan_parquet(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """``where`` is applied to the columns as stored, so it reaches the file; NaN becomes NULL after it."""
    raw = spark.read.parquet(path)
    return nulls_for_nan(raw if where is None else raw.where(where))


def scan_any(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Pick the reader by suffix; ``where`` keeps rows by the columns as stored."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".parquet"):
        return scan_parquet(spark, path, where)
    if lowered.endswith(".csv"):
        rows = scan_csv_header(spark, path)
        return rows if where is None else rows.where(where)
    raise FileNotFoundError(f"unsupported file format: {path}")


def scan_label_text(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """``NAME = 'label'`` lines of a text file as (column_name, label); of repeated names the last wins.

    File, block start and row id give every line its place, so files may be split among tasks.
    """
    # The CSV reader is used for its encoding option; the separator is one that text never holds.
    lines = (
        spark.read.schema("line string")
        .option("sep", "\u0001").option("quote", "").option("encoding", encoding)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .csv(path)
        .select(
            "line",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("place"),
        )
    )
    named = lines.select(
        F.upper(F.regexp_extract("line", LABEL_LINE, 1)).alias("column_name"),
        F.regexp_extract("line", LABEL_LINE, 2).alias("label"),
        "place",
    ).where(F.col("column_name") != "")
    return named.groupBy("column_name").agg(F.max_by("label", "place").alias("label"))


def read_descriptions(table: DataFrame) -> DataFrame | None:
    """(feature, description) from a table with any accepted header names, or None without them."""
    by_lower = {c.strip().lower(): c for c in table.columns}
    name = next((by_lower[a] for a in NAME_ALIASES if a in by_lower), None)
    text = next((by_lower[a] for a in DESCRIPTION_ALIASES if a in by_lower), None)
    if name is None or text is None:
        return None
    return table.select(
        F.trim(F.col(f"`{name}`").cast("string")).alias("feature"),
        F.trim(F.col(f"`{text}`").cast("string")).alias("description"),
    ).where(F.col("feature") != "")


def scan_descriptions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame | None:
    """The first existing description table among ``paths`` that has usable columns."""
    for path in [paths] if isinstance(paths, str) else paths:
        if path_exists(spark, path):
            found = read_descriptions(spark.read.option("header", True).csv(path))
            if found is not None:
                return found
    return None
