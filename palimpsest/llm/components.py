"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import shuffle_partitions, stored


#: Up to so many links, which are counted, one task contracts them all.
ONE_TASK = 500_000


def union_find(a: list[int], b: list[int]) -> dict[int, int]:
    """Each node's smallest reachable node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def _contracted(batches):
    a, b = [], []
    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
    pairs = [(x, r) for x, r in union_find(a, b).items() if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["child", "parent"])


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that the links (a, b) reach; roots and nodes without links are not listed.

    Up to ``ONE_TASK`` links are contracted in one task. Of more, each range of nodes is first contracted within its
    partition; then links to the smallest neighbour and pointer
    jumps alternate, in a number of rounds that grows with the logarithm of the longest path left.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct()
    edges = stored(edges, "links")
    if edges.count() <= ONE_TASK:
        return stored(edges.coalesce(1).mapInArrow(_contracted, "child long, parent long"), "roots").select(F.col("child").alias("node"), F.col("parent").alias("root"))
    edges = stored(edges.repartitionByRange(shuffle_partitions(spark), "child").mapInArrow(_contracted, "child long, parent long").distinct(), "contracted")
    while True:
        least = edges.groupBy("child").agg(F.min("parent").alias("least"))
        up = least.select(F.col("child").alias("parent"), F.col("least").alias("further"))
        open_ = edges.join(up, "parent", "left_semi").limit(1).count() or edges.join(least, "child").where("parent <> least").limit(1).count()
        if not open_:
            return edges.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        side = edges.join(least, "child").where("parent <> least").select(F.col("parent").alias("child"), F.col("least").alias("parent"))
        star = stored(least.select("child", F.col("least").alias("parent")).unionByName(side).distinct(), "star")
        jump = star.groupBy("child").agg(F.min("parent").alias("further")).select(F.col("child").alias("parent"), "further")
        edges = stored(star.join(jump, "parent", "left").select("child", F.coalesce("further", "parent").alias("parent")).distinct(), "jumped")
