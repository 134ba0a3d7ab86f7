"""Counts, bounds and distinct values of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count(df: DataFrame, offset: int = 0) -> DataFrame:
    """One row (count), never under 0; without a filter the scan answers from file footers."""
    return df.agg(F.greatest(F.count(F.lit(1)) - offset, F.lit(0)).cast("long").alias("count"))


def bounds(df: DataFrame, x: str, y: str, crs: str = "EPSG:4326") -> DataFrame:
    return df.agg(F.min(x).cast("double").alias("minx"), F.min(y).cast("double").alias("miny"), F.max(x).cast("double").alias("maxx"), F.max(y).cast("double").alias("maxy"), F.lit(crs).alias("crs"))


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def extremes(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def nearest(df: DataFrame, column: str, probe) -> DataFrame:
    """The largest value up to the probe and the smallest from it on."""
    c = F.col(column)
    return df.agg(F.max(F.when(c <= probe, c)).alias("floor_value"), F.min(F.when(c >= probe, c)).alias("ceiling_value"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """What the generic library computes by iteration: sum, average and count."""
    return df.agg(F.sum(column).alias("sum_value"), F.avg(column).alias("avg_value"), F.count(column).alias("n"))


def by_layer(df: DataFrame, layer: str) -> DataFrame:
    return df.groupBy(layer).agg(F.count(F.lit(1)).alias("n"))
