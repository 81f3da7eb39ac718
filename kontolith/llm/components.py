"""Connected components of an edge table by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontolith.llm.common import cut, drop_cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` long edges to ``(node, component)``, the component being its smallest node.

    Every round sends each node the smallest label among its neighbours and then replaces a label by that label's own
    label, so long chains shorten by doubling. Labels are cut to the shared folder each round; nothing but a count of
    changed rows reaches the driver. Null ends and self-loops are ignored; an empty edge table gives an empty result.
    """
    one_way = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    both = cut(one_way.union(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "cc-labels")
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        moved = step.join(jump, "new", "left").select("node", "was", F.least("new", "far").alias("component"))
        following = cut(moved, "cc-labels")
        changed = following.where("was <> component").limit(1).count()
        drop_cut(labels)
        labels = following.select("node", "component")
        labels._kontolith_place = following._kontolith_place
        if not changed:
            drop_cut(both)
            return labels
    raise RuntimeError("components did not settle")
