"""Connected components of a link table, as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genotiles.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every id of edges (two columns of ids) with the smallest id it is connected to.

    Each round takes every id to the smallest label among its neighbours' and then to its label's label, so
    paths shrink by more than half. Nothing but one counter reaches the driver. Links of an id to
    itself and repeated links change nothing; an empty table gives an empty table.
    """
    x, y = edges.columns
    pairs = edges.select(F.col(x).cast("long").alias("id"), F.col(y).cast("long").alias("near"))
    both = written(pairs.union(pairs.select("near", "id")).distinct(), "links")
    labels = written(both.groupBy("id").agg(F.least(F.min("near"), F.col("id")).alias("root")), "labels")
    while True:
        offered = (
            both.join(labels.toDF("near", "offer"), "near").groupBy("id").agg(F.min("offer").alias("offer"))
        )
        # A label hands on what its holders are offered, so a root may be taken over as well.
        lower = labels.join(offered, "id").select("id", "root", F.least("root", "offer").alias("offer"))
        hooks = lower.where("offer < root").groupBy(F.col("root").alias("id")).agg(F.min("offer").alias("hook"))
        hooked = lower.join(hooks, "id", "left").select("id", F.least("offer", F.coalesce("hook", "offer")).alias("parent"), "root")
        jump = hooked.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        following = written(
            hooked.join(jump, "parent", "left").select("id", F.coalesce("above", "parent").alias("root"), F.col("root").alias("before")),
            "labels",
        )
        labels = following.select("id", "root")
        if following.where("root <> before").isEmpty():
            return labels
