"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecare.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label): one node for each component, for all nodes of ``edges`` (a, b).

    Every round hangs each node on its smallest neighbour, if that is smaller, and lets it follow
    that one's own step; edges then join what hangs together, and those inside vanish. Nodes
    should be numbers without meaning, such as hashes: then a share of all that are left goes
    each round, so the rows of all rounds together are a few times the edges. What a round
    leaves is staged, and no node's neighbours are gathered anywhere.
    """
    rest = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest, labels = staged(rest, "edges"), None
    while labels is None or rest.limit(1).count():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        up = staged(up.select("node", F.least("node", "up").alias("up")), "up")
        onward = up.select(F.col("node").alias("up"), F.col("up").alias("onward"))
        up = staged(up.join(onward, "up").select("node", F.col("onward").alias("up")), "up")
        step = up.withColumnRenamed("node", "label")
        if labels is None:
            labels = up.withColumnRenamed("up", "label")
        else:
            labels = staged(
                labels.join(step, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels"
            )
        ends = [up.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in "ab"]
        moved = rest.join(ends[0], "a").join(ends[1], "b").where("up_a <> up_b")
        rest = staged(
            moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "edges"
        )
    return labels
