"""Connected components by contraction: hook to the least neighbour, jump, relabel, repeat.

Each round writes its small tables to the shared folder, so no lineage grows and a join on a
hub reads two plain tables, whose skewed partitions adaptive execution can split. Nothing
but row counts reaches the driver. Each round at least halves the roots that still have
edges; stars end in one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordgauge.session import cut, free


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node of `edges` (a, b): comp is the least id that it reaches."""
    e = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")).select("id", F.least("id", "p").alias("comp")))
        up = hook.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        once = hook.join(up, "comp").select("id", F.col("top").alias("comp"))
        parent = cut(once.join(up, "comp").select("id", F.col("top").alias("comp")))
        free(hook)
        if label is None:
            label = parent
        else:
            up = parent.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
            before, label = label, cut(label.join(up, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")))
            free(before)
        left = parent.select(F.col("id").alias("a"), F.col("comp").alias("x"))
        right = parent.select(F.col("id").alias("b"), F.col("comp").alias("y"))
        moved = e.join(left, "a").join(right, "b").filter("x <> y")
        before, e = e, cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        free(before, *([] if label is parent else [parent]))
    if label is None:
        return e.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return label
