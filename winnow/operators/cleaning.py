"""Projections, filters and cleaning. Per-column work is one ``select`` or one aggregate, not a loop of jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.scalars import near_integer, numeric_columns, pad_left, string_columns

# Aggregates with thousands of expressions no longer compile; wide tables go in batches.
COLUMN_BATCH = 150


def trim_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def trim_strings(df: DataFrame, blank_to_null: bool = True) -> DataFrame:
    """Trim every string cell; blank cells become NULL unless asked otherwise."""
    text = set(string_columns(df))

    def cell(name: str) -> Column:
        if name not in text:
            return F.col(f"`{name}`")
        trimmed = F.trim(F.col(f"`{name}`"))
        return (F.nullif(trimmed, F.lit("")) if blank_to_null else trimmed).alias(name)

    return df.select(*[cell(c) for c in df.columns])


def strip_char(column: str, char: str) -> Column:
    return F.trim(F.replace(F.col(column), F.lit(char), F.lit("")))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def dedup_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates; map-side combining absorbs rows that repeat very often."""
    return df.dropDuplicates()


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def drop_leaky_columns(df: DataFrame, tokens: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose upper-cased name contains a token; decided on the schema alone."""
    leaky = [c for c in df.columns if c not in keep and any(t in c.upper() for t in tokens)]
    return df.drop(*leaky)


def target_equals(column: str, positive: str, upper: bool = False) -> Column:
    """1 where the label is the positive one, 0 otherwise and for NULL."""
    label = F.upper(F.col(column)) if upper else F.col(column)
    return F.coalesce((label == F.lit(positive)).cast("int"), F.lit(0))


def one_vs_rest_target(column: str, focal: str | int) -> Column:
    return F.coalesce((F.col(column) == F.lit(focal)).cast("int"), F.lit(0))


def target_map_valid(df: DataFrame, column: str, codes: Mapping[float, int], name: str = "label") -> DataFrame:
    """Keep rows with a known code and map it; the filter reaches the scan."""
    if isinstance(df.schema[column].dataType, T.IntegralType):
        # Compared as doubles, whole-number columns could not be filtered in the scan.
        codes = {int(code): value for code, value in codes.items() if code == int(code)}
    mapped = F.lit(None).cast("int")
    for code, value in codes.items():
        mapped = F.when(F.col(column) == F.lit(code), F.lit(value)).otherwise(mapped)
    return df.where(F.col(column).isin(list(codes))).withColumn(name, mapped)


def sentinel_to_null(df: DataFrame, codes: Sequence[float], skip: Sequence[str] = ()) -> DataFrame:
    """Non-response codes become NULL in every numeric column."""
    numeric = set(numeric_columns(df)) - set(skip)
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(list(codes)), F.col(f"`{c}`")).alias(c) if c in numeric else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def _aggregate_in_batches(df: DataFrame, columns: Sequence[str], measure) -> dict[str, object]:
    """One row of aggregates per batch of columns; the driver receives numbers only."""
    found: dict[str, object] = {}
    for start in range(0, len(columns), COLUMN_BATCH):
        batch = list(columns[start : start + COLUMN_BATCH])
        found.update(df.agg(*[measure(c).alias(c) for c in batch]).first().asDict())
    return found


def missing_fractions(df: DataFrame, skip: Sequence[str] = ()) -> dict[str, float]:
    columns = [c for c in df.columns if c not in skip]
    return _aggregate_in_batches(df, columns, lambda c: F.avg(F.col(f"`{c}`").isNull().cast("int")))


def drop_high_missing(df: DataFrame, threshold: float = 0.98, skip: Sequence[str] = ()) -> DataFrame:
    gone = [c for c, share in missing_fractions(df, skip).items() if share is not None and share >= threshold]
    return df.drop(*gone)


def to_numeric_coerce(column: str, kind: str = "double") -> Column:
    return F.col(column).try_cast(kind)


def parse_event_date(
    df: DataFrame,
    name: str,
    text: str = "IDATE",
    month: str = "IMONTH",
    day: str = "IDAY",
    year: str = "IYEAR",
    pattern: str = "MMddyyyy",
    default: str = "2015-01-01",
) -> DataFrame:
    """Epoch day from MMDDYYYY text, else rebuilt from its parts, else the earliest date of the table.

    The earliest date is a scalar subquery, evaluated once.
    """
    have = set(df.columns)

    def part(column: str, width: int) -> Column:
        value = F.col(column).try_cast("double").try_cast("bigint").cast("string")
        return pad_left(value, width)

    tries = []
    if text in have:
        tries.append(F.try_to_date(F.col(text), pattern))
    if {month, day, year} <= have:
        tries.append(F.try_to_date(F.concat(part(month, 2), part(day, 2), part(year, 1)), pattern))
    if not tries:
        return df.withColumn(name, F.unix_date(F.lit(default).cast("date")).cast("bigint"))
    parsed = F.coalesce(*tries)
    earliest = df.select(parsed.alias("d")).agg(F.min("d")).scalar()
    chosen = F.coalesce(parsed, earliest, F.lit(default).cast("date"))
    return df.withColumn(name, F.unix_date(chosen).cast("bigint"))


def low_cardinality_columns(df: DataFrame, skip: Sequence[str] = (), most: int = 15) -> list[str]:
    """Numeric columns with 2..``most`` distinct values, all of them whole.

    A distinct set cut off just above ``most`` decides this without counting every value: a column
    leaves the running after a sketch says it is far above the limit, and only the rest is counted.
    """
    columns = [c for c in numeric_columns(df) if c not in skip]
    rough = _aggregate_in_batches(df, columns, lambda c: F.approx_count_distinct(f"`{c}`", 0.02))
    near = [c for c in columns if rough[c] <= 2 * most]
    exact = _aggregate_in_batches(df, near, lambda c: F.size(F.collect_set(f"`{c}`")))
    few = [c for c in near if 2 <= exact[c] <= most]
    whole = _aggregate_in_batches(df, few, lambda c: F.min(near_integer(F.col(f"`{c}`").cast("double"))))
    return [c for c in few if whole[c]]


def low_cardinality_to_category(df: DataFrame, skip: Sequence[str] = (), most: int = 15) -> DataFrame:
    chosen = set(low_cardinality_columns(df, skip, most))
    return df.select(
        *[
            F.rint(F.col(f"`{c}`").cast("double")).cast("bigint").cast("string").alias(c) if c in chosen else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def select_categorical(df: DataFrame, explicit: Sequence[str] | None = None) -> list[str]:
    return list(explicit) if explicit is not None else string_columns(df)


def booleans_to_int(df: DataFrame) -> DataFrame:
    flags = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)}
    return df.select(*[F.col(c).cast("int").alias(c) if c in flags else F.col(c) for c in df.columns])


def project_feature_set(df: DataFrame, features: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    return df.select(*carry, *features)


def union_all_files(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
