"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import discard, materialise


def components(edges: DataFrame, name: str = "components", most: int = 100) -> DataFrame:
    """edges: u, v (strings). Returns node, label (the least node of its component) for every node of an edge.

    Each round is written to the shared folder, and the one before is deleted. A star's centre is a hot key of a join only, which Spark can split;
    the labels of a node's neighbours are reduced before they are shuffled."""
    both = materialise(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), name)
    for _ in range(most):
        sent = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        merged = labels.join(sent, labels["node"] == sent["u"]).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = merged.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        out = materialise(merged.join(jump, "label").select("node", "was", F.least("label", "onward").alias("label")), name)
        discard(labels)
        if out.where("label <> was").isEmpty():
            discard(both)
            return out.select("node", "label")
        labels = out.select("node", "label")
        labels._materialised = out._materialised
    raise RuntimeError(f"components need more than {most} rounds")


def star_components(ties: DataFrame, name: str = "stars") -> DataFrame:
    """ties: u, v (strings), where v is a centre that u belongs to; each centre belongs to itself. Returns node, centre
    (its least), label (the least centre of its component) for each u.

    A node stays out of the rounds: its least centre is tied to its other ones, which says as much. What the rounds
    work on are the distinct ties between centres, few in a group of which most members share theirs."""
    least = materialise(ties.groupBy("u").agg(F.min("v").alias("centre")), f"{name}-least")
    between = ties.join(least, "u").where("v <> centre").select(F.col("centre").alias("u"), "v").distinct()
    labels = components(between, f"{name}-centres").select(F.col("node").alias("centre"), "label")
    return least.join(labels, "centre", "left").select(F.col("u").alias("node"), "centre", F.coalesce("label", "centre").alias("label"))
