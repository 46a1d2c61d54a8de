"""A function over every string of a row, however deep, and small helpers of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mapped(c: Column, kind: T.DataType, fn: Callable[[Column], Column]) -> Column:
    """The value with fn over its strings; keys of maps and names of fields stay, nulls stay null."""
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), fn(c))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: mapped(x, kind.elementType, fn))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: mapped(v, kind.valueType, fn))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(mapped(c[f.name], f.dataType, fn).alias(f.name) for f in kind.fields)))
    return c


def map_strings(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return df.select(*(mapped(F.col(f"`{f.name}`"), f.dataType, fn).alias(f.name) for f in df.schema.fields))


def run_stamp(zone: str = "Asia/Seoul") -> Column:
    """The time now in a zone, as a run's file names have it."""
    return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), F.lit(zone)), "yyyyMMdd_HHmmss")
