"""Scans of one table at one revision, tree listings, object lookups and retyping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHILDREN, FEATURES_ONLY, TREES_ONLY, DEPTHFIRST, DEPTHFIRST_ONLY_FEATURES, DEPTHFIRST_ONLY_TREES = "CHILDREN", "FEATURES_ONLY", "TREES_ONLY", "DEPTHFIRST", "DEPTHFIRST_ONLY_FEATURES", "DEPTHFIRST_ONLY_TREES"


def scan(df: DataFrame, where: Column | str | None = None, columns: list[str] | None = None, key: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Filter, then order by the key if offset or limit ask for an order, then project."""
    out = df.where(where) if where is not None else df
    if offset or limit is not None:
        out = out.orderBy(key) if key else out
        out = out.offset(offset) if offset else out
        out = out.limit(limit) if limit is not None else out
    return out.select(columns) if columns else out


def entries(layers: dict[str, DataFrame], key: str) -> DataFrame:
    """All layers as one listing: path, parent_path, type and depth; layers themselves are TREE entries."""
    spark = next(iter(layers.values())).sparkSession
    out = spark.createDataFrame([(n, "", "TREE", 1) for n in layers], "path string, parent_path string, type string, depth int")
    for name, df in layers.items():
        out = out.unionByName(df.select(F.concat(F.lit(f"{name}/"), F.col(key).cast("string")).alias("path"), F.lit(name).alias("parent_path"), F.lit("FEATURE").alias("type"), F.lit(2).alias("depth")))
    return out


def ls_tree(listing: DataFrame, strategy: str, under: str = "") -> DataFrame:
    """Entries below a path by strategy: direct ones, or all of them for the depth-first strategies."""
    rows = listing.where(F.col("path").startswith(under + "/")) if under else listing
    if not strategy.startswith("DEPTHFIRST"):
        rows = rows.where(F.col("parent_path") == under)
    if strategy in (FEATURES_ONLY, DEPTHFIRST_ONLY_FEATURES):
        rows = rows.where("type = 'FEATURE'")
    if strategy in (TREES_ONLY, DEPTHFIRST_ONLY_TREES):
        rows = rows.where("type = 'TREE'")
    return rows.select("path", "type")


def feature_trees(listing: DataFrame) -> DataFrame:
    return listing.where("type = 'FEATURE'").select("parent_path").distinct()


def find_child(listing: DataFrame, path: str) -> DataFrame:
    return listing.where(F.col("path") == path)


def retrieve(nodes: DataFrame, objects: DataFrame, column: str = "object_id") -> DataFrame:
    """Nodes with their objects' values."""
    return nodes.join(objects, column)


def mixed(*frames: DataFrame) -> DataFrame:
    """Rows of different schemas in one table; what a row's type lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def adapt(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Retypes rows to a destination schema by attribute name: casts what is there, nulls for the rest."""
    return df.select(*[(F.col(f"`{c}`").try_cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(c) for c, kind in schema.items()])


def rename_type(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rebuilds feature ids under another type's name."""
    return df.withColumn(key, F.concat(F.lit(prefix + "."), F.element_at(F.split(F.col(key).cast("string"), r"\."), -1)))


def describe(df: DataFrame) -> DataFrame:
    """(name, type, nullable) of each attribute."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "name string, type string, nullable boolean")


def sparse(df: DataFrame, layer: str, filters: dict[str, str]) -> DataFrame:
    """Per-layer conditions with a ``default``; layers without any pass whole."""
    condition = F.lit(False)
    named = [k for k in filters if k != "default"]
    for name in named:
        condition = condition | ((F.col(layer) == name) & F.expr(filters[name]))
    rest = ~F.col(layer).isin(*named) if named else F.lit(True)
    return df.where(condition | (rest & F.expr(filters.get("default", "true"))))
