"""Spatial indexes: covering copies of a layer, sorted by quadkey, kept up by diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.spatial import quadkey
from palimpsest.operators.diff import ADDED, REMOVED, diff


def build(df: DataFrame, key: str, x: str, y: str, bounds: tuple[float, float, float, float], extra: list[str] | None = None, levels: int = 12) -> DataFrame:
    """Quadkey, key, position and the covered attributes. Written range-partitioned, a box reads few files."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(quadkey(x, y, bounds, levels).alias("quadkey"), key, x, y, *(extra or []))


def write(index: DataFrame, path: str, files: int) -> None:
    index.repartitionByRange(files, "quadkey").sortWithinPartitions("quadkey").write.mode("overwrite").parquet(path)


def covering_prefix(box: tuple[float, float, float, float], bounds: tuple[float, float, float, float], levels: int = 12) -> str:
    """The longest quadkey prefix that every point of the box shares."""
    digits = []
    for point in ((box[0], box[1]), (box[2], box[3])):
        n = [min(max(int((c - lo) / (hi - lo) * (1 << levels)), 0), (1 << levels) - 1) for c, lo, hi in zip(point, bounds[:2], bounds[2:], strict=True)]
        digits.append("".join(str((n[1] >> k & 1) * 2 + (n[0] >> k & 1)) for k in range(levels - 1, -1, -1)))
    out = ""
    for a, b in zip(*digits, strict=True):
        if a != b:
            break
        out += a
    return out


def search(index: DataFrame, x: str, y: str, box: tuple[float, float, float, float], bounds: tuple[float, float, float, float], levels: int = 12) -> DataFrame:
    """Points of the box: a quadkey range and exact comparisons, all of which reach the scan."""
    prefix = covering_prefix(box, bounds, levels)
    rows = index.where(F.col("quadkey").startswith(prefix)) if prefix else index
    return rows.where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))


def updated(index: DataFrame, old: DataFrame, new: DataFrame, key: str, x: str, y: str, bounds: tuple[float, float, float, float], extra: list[str] | None = None, levels: int = 12) -> DataFrame:
    """The index after a commit: the entries of changed keys replaced, the others kept."""
    cols = [key, x, y, *(extra or [])]
    d = diff(old.select(cols), new.select(cols), key)
    put = d.where(F.col("change_type") != REMOVED).select(key, *[F.col(f"new_{c}").alias(c) for c in cols[1:]])
    gone = d.where(F.col("change_type") != ADDED).select(key)
    return index.join(gone, key, "left_anti").select(index.columns).unionByName(build(put, key, x, y, bounds, extra, levels))
