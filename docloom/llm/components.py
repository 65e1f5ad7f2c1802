"""Connected components of a graph given by its links, by min-label hooking and pointer jumping.

Labels and links stay distributed; each round is kept in the shared checkpoint
folder. Rounds grow with the logarithm of a component's width, not its size.
The table that is asked for a hot label (that of a component with a third of
all nodes) has a row for each label, and is read back from storage before it is
joined, so that the planner is free to split the hot side or broadcast this one.

Defined cases: links with a null end are ignored; repeated links and links of a node
to itself change nothing, but such a node is returned; only the two named columns are
read; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has a link, and the smallest node that it reaches. Links may repeat, and may join a node to itself."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).dropna().distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        of_neighbour = labels.select(F.col("node").alias("v"), F.col("label").alias("neighbour"))
        best = both.join(of_neighbour, "v").groupBy(F.col("u").alias("node")).agg(F.min("neighbour").alias("best"))
        seen = labels.join(best, "node").select("node", "label", F.least("label", "best").alias("best"))
        # the node itself learns of the smaller label, and so does the node that it is labelled with
        told = seen.select("node", F.col("best").alias("label")).unionByName(seen.groupBy(F.col("label").alias("node")).agg(F.min("best").alias("label")))
        hooked = materialise(told.groupBy("node").agg(F.min("label").alias("label")), "hooked")
        onward = materialise(hooked.select(F.col("label").alias("via")).distinct().join(hooked.select(F.col("node").alias("via"), F.col("label").alias("next")), "via"), "onward")
        jumped = materialise(hooked.join(onward, hooked["label"] == onward["via"]).select("node", F.col("next").alias("label")), "labels")
        changed = jumped.join(labels.select("node", F.col("label").alias("old")), "node").where(F.col("label") != F.col("old")).limit(1).count()
        labels = jumped
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
