"""Columns of dates and times in mixed formats and zones, in one unambiguous form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo.functions.times import with_time


def normalised_times(df: DataFrame, keys: dict[str, Column], fields: dict[str, Column]) -> DataFrame:
    """One row for each value of ``fields`` that is not null: the key columns, field, raw, norm, at.

    norm is yyyy-mm-dd for a date alone and otherwise the UTC instant yyyy-mm-ddThh:mm:ss.ffffffZ; at the instant in
    microseconds since 1970 (of a date alone: its start in Madrid). Both are null where the text names no real date or time, as
    for empty text. Null values give no row. Only the columns named in keys and fields are read; repeated rows stay repeated.
    """
    values = F.array(*[F.struct(F.lit(k).alias("field"), c.cast("string").alias("raw")) for k, c in fields.items()])
    long = df.select(*[c.alias(k) for k, c in keys.items()], F.explode(F.filter(values, lambda x: x["raw"].isNotNull())).alias("__v"))
    long = long.select(*keys, "__v.field", "__v.raw")
    x = with_time(long, F.col("raw"), "t")
    return x.select(*keys, "field", "raw", F.col("t_norm").alias("norm"), F.col("t_at").alias("at"))


def not_normal(times: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct readable values of ``normalised_times`` that are written otherwise than their normal form."""
    return times.filter(F.col("norm").isNotNull() & (F.col("raw") != F.col("norm"))).select(*keys, "field", "norm").distinct()


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
