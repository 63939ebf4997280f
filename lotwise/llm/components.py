"""Connected components of a link table, by Spark joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every end of ``edges`` (columns a, b: longs).

    Each round sends every node the smallest label among its neighbours and then jumps to that label's
    own label, so path lengths halve; rounds end when no label changes. Labels are written to the shared
    folder each round; only the count of changes reaches the driver. Sums and minima are pre-aggregated,
    and the joins on ends are plain equi-joins that adaptive execution can split at a hub.
    """
    both = shared.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = shared.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        parents = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = hooked.join(parents, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = shared.written(jumped, "labels")
        shared.discard(labels)
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            shared.discard(both)
            return labels.withColumnRenamed("label", "component")
