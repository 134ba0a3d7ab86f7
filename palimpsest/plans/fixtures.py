"""Versioned tables derived from the star-schema tables, the same in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
KEY = "fid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias(KEY), *ATTRS)


def ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col(KEY) % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return base(spark, sf_dir).where(F.col(KEY) % 11 != 0).withColumn("o_totalprice", price)


def theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col(KEY) % 105 == 0, F.col("o_totalprice") + 2).otherwise(F.col("o_totalprice"))
    priority = F.when(F.col(KEY) % 5 == 0, F.lit("X")).otherwise(F.col("o_orderpriority"))
    rows = base(spark, sf_dir)
    new = rows.where(F.col(KEY).between(1, 10)).withColumn(KEY, F.col(KEY) + 1_000_000)
    return rows.where(F.col(KEY) % 13 != 0).withColumn("o_totalprice", price).withColumn("o_orderpriority", priority).unionByName(new)


#: The same three snapshots in SQL.
SNAPSHOTS = """
base AS (SELECT CAST(o_orderkey AS BIGINT) AS fid, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders),
ours AS (SELECT fid, o_custkey, o_orderstatus, CASE WHEN fid % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM base WHERE fid % 11 <> 0),
theirs AS (SELECT fid, o_custkey, o_orderstatus, CASE WHEN fid % 105 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN fid % 5 = 0 THEN 'X' ELSE o_orderpriority END AS o_orderpriority FROM base WHERE fid % 13 <> 0
  UNION ALL SELECT fid + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM base WHERE fid BETWEEN 1 AND 10)"""


def points(spark: SparkSession, sf_dir: str, moved: bool = False) -> DataFrame:
    """A point layer: x and y from the first two elements; ``moved`` is its next revision."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias(KEY), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("long").alias("label"))
    if moved:
        rows = rows.where(F.col(KEY) % 10 != 0).withColumn("x", F.when(F.col(KEY) % 7 == 0, F.col("x") + 0.25).otherwise(F.col("x")))
    return rows


POINTS = """
p0 AS (SELECT CAST(vec_id AS BIGINT) AS fid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS BIGINT) AS label FROM embeddings),
p1 AS (SELECT fid, CASE WHEN fid % 7 = 0 THEN x + 0.25 ELSE x END AS x, y, label FROM p0 WHERE fid % 10 <> 0)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit graph over the events: the parent of n is n // 2, and every tenth is a merge with n - 3."""
    n = F.col("event_id").cast("long")
    first = F.when(n > 0, F.array(F.floor(n / 2))).otherwise(F.array().cast("array<bigint>"))
    parents = F.when((n % 10 == 0) & (n > 3), F.concat(first, F.array(n - 3))).otherwise(first)
    return table(spark, sf_dir, "events").select(n.alias("commit"), parents.cast("array<bigint>").alias("parents"), F.col("user_id").cast("string").alias("author"), F.col("user_id").cast("string").alias("committer"), "ts", F.col("event_type").alias("message"))


COMMITS = """
edge AS (SELECT CAST(event_id AS BIGINT) AS c, CAST(event_id AS BIGINT) // 2 AS p FROM events WHERE event_id > 0
  UNION ALL SELECT CAST(event_id AS BIGINT), CAST(event_id AS BIGINT) - 3 FROM events WHERE event_id % 10 = 0 AND event_id > 3),
node AS (SELECT CAST(event_id AS BIGINT) AS commit, CAST(user_id AS VARCHAR) AS author, ts, event_type AS message FROM events)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of one feature per user: each event is a commit that writes the feature."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias(KEY), F.col("event_id").cast("long").alias("commit"), "ts", "event_type", F.floor(F.col("value") / 10).cast("long").alias("level"))


VERSIONS = "v AS (SELECT CAST(user_id AS BIGINT) AS fid, CAST(event_id AS BIGINT) AS commit, ts, event_type, CAST(floor(value / 10) AS BIGINT) AS level FROM events)"
