"""Connected components of a link table, as DataFrame rounds.

Every round a node takes the least label among its own and its neighbours', then its label's
label, so labels run along chains by doubling.  Nothing is collected but one count a round; each
round's labels are written to the shared folder, which keeps the lineage short and survives lost
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stored


def components(links: DataFrame, root: str, name: str) -> DataFrame:
    """``(id, label)`` for each node of ``links`` (``a``, ``b``): the least id reachable from it."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.where("a <> b").distinct(), root, f"{name}-edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), root, f"{name}-0")
    for n in range(1, 64):
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("next"))
        up = labels.select(F.col("id").alias("_p"), F.col("label").alias("_l"))
        jumped = new.join(up, new["next"] == up["_p"], "left").select("id", "old", F.least("next", F.coalesce("_l", "next")).alias("label"))
        done = stored(jumped, root, f"{name}-{n}")
        labels = done.select("id", "label")
        if done.where("label <> old").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle")
