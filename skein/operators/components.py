"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.storage import written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(``node``, ``component``) for the ends of ``edges`` (src, dst): the least node reachable.

    Each round a node takes the least label among its neighbours, hands it on to the node that
    its own label names, and then follows labels to their labels, so that long chains shorten by
    half. Labels are written out each round: the joins have plain exchanges on both sides, which
    adaptive execution can split at hubs, and a lost executor costs no more than a round. Null
    ends are left out; self-loops and repeated edges change nothing. Raises after ``rounds``
    rounds without an end.
    """
    ends = edges.select("src", "dst").where("src is not null and dst is not null")
    both = written(ends.union(ends.select("dst", "src")).toDF("src", "dst").distinct(), "edges")
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("m"))
        asked = labels.join(near, labels["node"] == near["src"]).select("node", "component", F.least("component", "m").alias("m"))
        hooks = asked.select("node", "m").union(asked.where("m < component").select("component", "m"))
        hooked = written(hooks.groupBy("node").agg(F.min("m").alias("component")), "hooked")
        up = hooked.select(F.col("node").alias("up"), F.col("component").alias("above"))
        jumped = hooked.join(up, hooked["component"] == up["up"]).select("node", F.col("above").alias("component"))
        new = written(jumped, "labels")
        old = labels.select(F.col("node").alias("was"), F.col("component").alias("had"))
        moved = new.join(old, new["node"] == old["was"]).where("component <> had").limit(1).count()
        labels = new
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
