"""Small column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def fractional_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def nan_to_null(name: str) -> Column:
    return F.when(~F.isnan(name), F.col(name)).alias(name)


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """Missing is NULL only: Spark would count NaN as a value and let it poison averages."""
    floats = set(fractional_columns(df))
    return df.select(*[nan_to_null(c) if c in floats else F.col(c) for c in df.columns])


def near_integer(column: Column) -> Column:
    """|x - rint(x)| within 1e-8 + 1e-5 |rint(x)|; infinite values are ignored (true)."""
    whole = F.rint(column)
    close = F.abs(column - whole) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(whole)
    return F.when(F.abs(column) == F.lit(float("inf")), F.lit(True)).otherwise(close)


def pad_left(column: Column, width: int) -> Column:
    """Zero-fill to ``width`` without cutting longer text, which ``lpad`` would."""
    return F.when(F.length(column) < width, F.lpad(column, width, "0")).otherwise(column)


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def gap_penalised(train: Column, val: Column, weight: float) -> Column:
    """val - weight * (train - val); no val score ranks last, no train score means no gap."""
    gone = val.isNull() | F.isnan(val)
    known = F.when(train.isNull() | F.isnan(train), val).otherwise(train)
    return F.when(gone, F.lit(float("-inf"))).otherwise(val - F.lit(float(weight)) * (known - val))
