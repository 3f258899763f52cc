"""Connected components of a link table by least labels and pointer jumping; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b long): label is the smallest node that links lead to.

    In each round a node takes the least label of its neighbours, then the label of its label. Rounds are written to the
    shared folder, and end when nothing changes; ``rounds`` only guards against a fault in storage.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    # the first labels are each node's least neighbour or itself, summed up before anything is dealt out
    now = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(now.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        step = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        heads = now.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = stored(step.join(heads, "mid").select("node", "old", F.least("mid", "far").alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        now = new.select("node", "label")
        if not changed:
            return now
    raise RuntimeError("labels still change")
