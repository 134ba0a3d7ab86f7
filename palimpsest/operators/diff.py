"""Differences between two snapshots: entries, counts, bounds, summaries, attribute diffs and filters.

A snapshot is a DataFrame with a key column and attribute columns. Every diff is one full outer join on the key that
keeps the rows whose attributes differ, nulls being equal to nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.identity import bucket_digests, changed_buckets, hash_bucket, object_id

ADDED, MODIFIED, REMOVED = "ADDED", "MODIFIED", "REMOVED"


def attributes(left: DataFrame, right: DataFrame, key: str) -> list[str]:
    """Attributes of either side, those of the left first."""
    return [c for c in left.columns if c != key] + [c for c in right.columns if c != key and c not in left.columns]


def _side(df: DataFrame, key: str, attrs: list[str], prefix: str) -> DataFrame:
    have = set(df.columns)
    return df.select(key, F.lit(True).alias(f"{prefix}there"), *[(F.col(f"`{a}`") if a in have else F.lit(None)).alias(f"{prefix}{a}") for a in attrs])


def differs(attrs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"`old_{a}`").eqNullSafe(F.col(f"`new_{a}`")) for a in attrs], F.lit(False))


def change_type() -> Column:
    return F.when(F.col("old_there").isNull(), ADDED).when(F.col("new_there").isNull(), REMOVED).otherwise(MODIFIED)


def diff(left: DataFrame, right: DataFrame, key: str, attrs: list[str] | None = None) -> DataFrame:
    """Flattened diff rows: key, change_type, old_a, new_a for each attribute; unchanged rows are left out.

    ``attrs`` restricts the comparison and the columns, so that the scans read those alone.
    """
    attrs = attrs or attributes(left, right, key)
    joined = _side(left, key, attrs, "old_").join(_side(right, key, attrs, "new_"), key, "full")
    changed = joined.where(F.col("old_there").isNull() | F.col("new_there").isNull() | differs(attrs))
    return changed.select(key, change_type().alias("change_type"), *[f"`{side}_{a}`" for a in attrs for side in ("old", "new")])


def nested(entries: DataFrame, key: str) -> DataFrame:
    """(key, change_type, old struct, new struct); the side that isn't there is null."""
    attrs = [c[4:] for c in entries.columns if c.startswith("old_")]
    side = lambda s, gone: F.when(F.col("change_type") != gone, F.struct(*[F.col(f"`{s}_{a}`").alias(a) for a in attrs]))
    return entries.select(key, "change_type", side("old", ADDED).alias("old"), side("new", REMOVED).alias("new"))


def of_type(entries: DataFrame, *kinds: str) -> DataFrame:
    return entries.where(F.col("change_type").isin(*kinds))


def one_side(entries: DataFrame, key: str, which: str) -> DataFrame:
    """Change-source views: ALL, ADDED, REMOVED, CHANGED, CHANGED_NEW or CHANGED_OLD rows, by one side's columns."""
    if which == "ALL":
        return entries
    kinds = {"ADDED": (ADDED,), "REMOVED": (REMOVED,), "CHANGED": (MODIFIED,), "CHANGED_NEW": (MODIFIED,), "CHANGED_OLD": (MODIFIED,)}[which]
    if which == "CHANGED":
        return of_type(entries, *kinds)
    side = "old_" if which in ("REMOVED", "CHANGED_OLD") else "new_"
    return of_type(entries, *kinds).select(key, *[F.col(f"`{c}`").alias(c[4:]) for c in entries.columns if c.startswith(side)])


def under_paths(entries: DataFrame, path: str, filters: list[str]) -> DataFrame:
    """Entries at one of the paths or below it."""
    p = F.col(path)
    return entries.where(reduce(lambda a, b: a | b, [(p == f) | p.startswith(f + "/") for f in filters]))


def touching(entries: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Entries whose old or new point lies in the box."""
    inside = lambda s: F.col(f"{s}_{x}").between(box[0], box[2]) & F.col(f"{s}_{y}").between(box[1], box[3])
    return entries.where(inside("old") | inside("new"))


def diff_count(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: features added, changed and removed; layers are counted by ``Repo.diff_count``.

    Only the key and a content hash are shuffled.
    """
    attrs = attributes(left, right, key)
    side = lambda df, prefix: df.select(key, object_id(df, [a for a in attrs if a in df.columns]).alias(f"{prefix}id"))
    joined = side(left, "old_").join(side(right, "new_"), key, "full").where(~F.col("old_id").eqNullSafe(F.col("new_id")))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return joined.agg(n(F.col("old_id").isNull()).alias("features_added"), n(F.col("old_id").isNotNull() & F.col("new_id").isNotNull()).alias("features_changed"), n(F.col("new_id").isNull()).alias("features_removed"))


def counts(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = lambda kind: F.coalesce(F.sum((F.col("change_type") == kind).cast("long")), F.lit(0)).alias(kind.lower())
    return entries.groupBy(*(by or [])).agg(n(ADDED), n(MODIFIED), n(REMOVED))


def diff_bounds(left: DataFrame, right: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Left, right and merged envelopes over features whose own bounds changed."""
    entries = diff(left.select(key, x, y), right.select(key, x, y), key)
    box = lambda s: [f(F.col(f"{s}_{c}")).alias(f"{s}_{n}{c}") for f, n in ((F.min, "min_"), (F.max, "max_")) for c in (x, y)]
    out = entries.agg(*box("old"), *box("new"))
    return out.select("*", *[(F.least if n == "min" else F.greatest)(f"old_{n}_{c}", f"new_{n}_{c}").alias(f"merged_{n}_{c}") for n in ("min", "max") for c in (x, y)])


def diff_summary(left: DataFrame, right: DataFrame, layer: str, key: str) -> DataFrame:
    """Per layer: added, changed, removed and the number of rows on either side. Rows are keyed by (layer, key)."""
    attrs = [a for a in attributes(left, right, key) if a != layer]
    side = lambda df, p: df.select(layer, key, F.lit(True).alias(f"{p}there"), *[F.col(a).alias(f"{p}{a}") for a in attrs])
    joined = side(left, "old_").join(side(right, "new_"), [layer, key], "full")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    old, new = F.col("old_there").isNotNull(), F.col("new_there").isNotNull()
    return joined.groupBy(layer).agg(n(~old).alias("added"), n(old & new & differs(attrs)).alias("changed"), n(~new).alias("removed"), n(old).alias("left_rows"), n(new).alias("right_rows"))


def attribute_diff(entries: DataFrame, key: str) -> DataFrame:
    """Per changed attribute: key, attribute, kind, old_value, new_value (as text); unchanged attributes are left out."""
    attrs = [c[4:] for c in entries.columns if c.startswith("old_")]
    text = lambda c: F.col(f"`{c}`").cast("string")
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), text(f"old_{a}").alias("old_value"), text(f"new_{a}").alias("new_value"), (~F.col(f"`old_{a}`").eqNullSafe(F.col(f"`new_{a}`"))).alias("differs")) for a in attrs]))
    kind = F.when(F.col("r.old_value").isNull(), ADDED).when(F.col("r.new_value").isNull(), REMOVED).otherwise(MODIFIED)
    return entries.select(key, rows.alias("r")).where("r.differs").select(key, "r.attribute", kind.alias("kind"), "r.old_value", "r.new_value")


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attributes that were added, removed or changed in type."""
    spark = left.sparkSession
    a, b = dict(left.dtypes), dict(right.dtypes)
    rows = [(c, ADDED if c not in a else REMOVED if c not in b else MODIFIED, a.get(c), b.get(c)) for c in {**a, **b} if a.get(c) != b.get(c)]
    return spark.createDataFrame(rows, "attribute string, kind string, old_type string, new_type string")


def changed_layers(left: DataFrame, right: DataFrame, layer: str, key: str) -> DataFrame:
    """Layers whose digests differ: (layer, kind). One small row per layer is compared, not the rows."""
    attrs = [a for a in attributes(left, right, key) if a != layer]
    digest = lambda df, p: bucket_digests(df.withColumn("object_id", object_id(df, attrs)), key, 1, (layer,)).select(layer, F.col("digest").alias(f"{p}digest"))
    joined = digest(left, "old_").join(digest(right, "new_"), layer, "full").where(~F.col("old_digest").eqNullSafe(F.col("new_digest")))
    return joined.select(layer, F.when(F.col("old_digest").isNull(), ADDED).when(F.col("new_digest").isNull(), REMOVED).otherwise(MODIFIED).alias("kind"))


def pruned_diff(left: DataFrame, right: DataFrame, key: str, buckets: int, left_digests: DataFrame | None = None, right_digests: DataFrame | None = None) -> DataFrame:
    """The diff, joining only hash buckets whose digests differ.

    Stored snapshots come with their digests and are partitioned by ``hash_bucket``, so equal buckets aren't read; the
    list of changed buckets has at most ``buckets`` rows and is broadcast.
    """
    attrs = attributes(left, right, key)
    stamp = lambda df: df.withColumn("object_id", object_id(df, [c for c in df.columns if c not in (key, "hash_bucket")]))
    changed = F.broadcast(changed_buckets(left_digests if left_digests is not None else bucket_digests(stamp(left), key, buckets), right_digests if right_digests is not None else bucket_digests(stamp(right), key, buckets)))
    part = lambda df: (df if "hash_bucket" in df.columns else df.withColumn("hash_bucket", hash_bucket(key, buckets))).join(changed, "hash_bucket", "left_semi").drop("hash_bucket")
    return diff(part(left), part(right), key, [a for a in attrs if a != "hash_bucket"])
