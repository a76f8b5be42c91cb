"""Connected components of an edge table, kept distributed.

Least-label propagation with pointer jumping: in each round every vertex takes
the least label among itself and its neighbours, then the label of its label.
Rounds are cut by reliable checkpoints, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut


def rewired(edges: DataFrame) -> DataFrame:
    """Fewer edges of the same components: each node's lesser neighbours are tied to the least of them, not to the node."""
    oriented = edges.where("src <> dst").select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")).distinct()
    least = oriented.withColumn("least", F.min("low").over(Window.partitionBy("high")))
    ties = least.select(F.explode(F.array(F.col("high"), F.col("low"))).alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()
    loops = edges.where("src = dst").select("src", "dst").distinct()
    return ties.unionByName(loops)


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label) for every node of ``edges``; label is the least node of its component.

    Defined results: self loops and repeated edges change nothing; no edges give
    an empty table; edges with a null end are ignored.
    """
    one = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    one = rewired(one)
    both = cut(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(both.groupBy("src").agg(F.min(F.least("src", "dst")).alias("label")).withColumnRenamed("src", "node"))
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["src"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
        jumped = stepped.join(roots, stepped["mid"] == roots["root"]).select("node", "old", F.least("mid", "root_label").alias("label"))
        state = cut(jumped)
        if not state.where("label < old").limit(1).count():
            return state.select("node", "label")
        labels = state.select("node", "label")
