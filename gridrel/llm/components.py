"""Connected components of an edge table by hooking to smaller neighbours and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrel.llm.common import free, spread_join, stash


def _moved(rows: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """rows with the labels of a column led on by hooks (from, to); a label that many rows hold is no hot key."""
    held = rows.groupBy(F.col(column).alias(column)).agg(F.count("*").alias("__held"))
    led = hooks.select(F.col("from").alias(column), F.col("to").alias("__to")).join(held, column)
    out = spread_join(rows, led, column, "__held")
    return out.withColumn(column, F.coalesce("__to", column)).drop("__to", "__held")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): label is the smallest id that id is linked to, over any number of edges (a, b).

    Ids are of any orderable type; edges with a null end, and those from an id to itself, link
    nothing; repeated edges count once; without edges the result is empty.  Every round hooks
    each label to the least label next to it and then halves the chains; rounds end when no edge
    joins two labels.  Edges whose ends agree are left out of later rounds, and each round's
    tables are written to shared storage, and removed when the next are.
    """
    ends = stash(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    labels = stash(ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct().withColumn("label", F.col("id")), "cc-labels")
    while True:
        # hooks: for every label, the least label that an edge leads to
        both = ends.union(ends.select("b", "a")).where("a > b")
        hooks = stash(both.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("to")), "cc-hooks")
        if hooks.isEmpty():
            free(hooks, ends)
            return labels
        while True:  # hooks lead downwards only: follow them to their ends by doubling
            h, g = hooks.select("from", "to").alias("h"), hooks.select("from", "to").alias("g")
            two = h.join(g, F.col("h.to") == F.col("g.from"), "left").select(F.col("h.from").alias("from"), F.coalesce("g.to", "h.to").alias("to"), F.col("g.to").isNotNull().alias("moved"))
            two = stash(two, "cc-hooks")
            free(hooks)
            hooks = two
            if two.where("moved").isEmpty():
                break
        old_labels, old_ends = labels, ends
        labels = stash(_moved(labels, "label", hooks), "cc-labels")
        ends = stash(_moved(_moved(ends, "a", hooks), "b", hooks).where("a <> b").distinct(), "cc-edges")
        free(hooks, old_labels, old_ends)
