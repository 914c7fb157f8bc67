"""Connected components of a graph given as a table of links, without bringing links to the driver.

Each round every node takes the least label among itself and its neighbours, then follows its label's own label
(pointer jumping), so the rounds grow with the logarithm of a component's width. A round is written to the shared
folder, which cuts the lineage; only the number of changed nodes comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import dropped, written


def components(links: DataFrame, node_type: str = "long") -> DataFrame:
    """``links``: columns a, b, in either direction and with repeats. Returns node, label (the least node of its component), a written table.

    Nodes without links don't appear. Null ends and self links are dropped. Needs distinct values per node, so a hub is
    as large as the number of different neighbours it has.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast(node_type).alias("a"), F.col("b").cast(node_type).alias("b"))
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        offered = both.join(now, both["b"] == now["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        nearer = now.join(offered, "node").select("node", F.col("label").alias("was"), F.least("label", "offer").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = written(nearer.join(jump, "label").select("node", "was", F.least("label", "root").alias("label")), "labels")
        changed = after.where("label <> was").limit(1).count()
        dropped(now)
        now = after
        if not changed:
            dropped(both)
            out = now.select("node", "label")
            out._written_path = now._written_path
            return out
