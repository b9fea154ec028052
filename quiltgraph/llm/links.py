"""Connected components over links, by min labels, in DataFrame rounds.

Each round every node takes the least label among its neighbours, and labels
are followed once (pointer jumping).  Rounds grow with the logarithm of the
longest path at best and are few for the star-like links of near duplicates.
No link or component reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node in links(a, b); self links and repeats do no harm."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").dropDuplicates())
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    labels = stored(least.select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        # the least label of the neighbours, then the label of that label
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        step = stored(step.join(jump, F.col("next") == F.col("at"), "left").select("node", F.least("next", F.coalesce("further", "next")).alias("new"), "component"))
        changed = step.where("new <> component").limit(1).count()
        dropped(labels)
        labels = step.select("node", F.col("new").alias("component"))
        labels._stored_at = step._stored_at
        if not changed:
            dropped(both)
            return labels
