"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WorkArea


def components(edges: DataFrame, area: WorkArea, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b), a written table: the label is the smallest node of the component.

    Each round takes the least label among neighbours and then the label's label, so a chain halves.
    A round is written down before the next; minimums are combined before they are exchanged.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = area.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-0")
    for k in range(1, most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = lower.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label"))
        new = area.table(jumped, f"{name}-{k}")
        changed = new.agg(F.count_if(F.col("old") != F.col("label"))).first()[0]
        area.drop(f"{name}-{k - 1}")
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
