"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattscope.llm.common import materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for each node of ``edges`` (columns a, b); a component is named by its smallest node.

    Every round a node takes the smallest label among its own label's label and those its neighbours have for
    theirs, and passes it on to the node that its label names (the scheme of FastSV). So whole trees are hooked at once and
    paths are halved: a few rounds do, in whatever order names lie along a chain. Labels are a written table each round,
    so neither the plan nor what a lost executor costs grows with the rounds. Nothing is gathered by node: minima
    are taken before the shuffle.
    """
    both = materialize(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    for _ in range(most_rounds):
        of = labels.select(F.col("node").alias("hub"), F.col("component").alias("far"))
        far = materialize(labels.join(of, labels["component"] == of["hub"]).select("node", "component", "far"), "far-labels")
        near = both.join(far.select(F.col("node").alias("b"), "far"), "b").groupBy("a").agg(F.min("far").alias("near"))
        met = materialize(far.join(near, far["node"] == near["a"]).select("node", "component", F.least("far", "near").alias("near")), "near-labels")
        passed = met.groupBy("component").agg(F.min("near").alias("passed")).withColumnRenamed("component", "to")
        step = materialize(met.join(passed, met["node"] == passed["to"], "left")
                           .select("node", F.least("component", "near", "passed").alias("component"), F.col("component").alias("before")), "labels")
        labels = step.select("node", "component")
        if step.where("component <> before").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
