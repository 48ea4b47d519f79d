"""Connected components of a table of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import mark, sweep, written


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> (node, label) for each node with a link; label is the least node of its component.

    Each round hooks every node to its least smaller neighbour, follows those pointers to
    their ends, and contracts the links to what is left between different labels.
    """
    spark, since = links.sparkSession, mark()
    edges = written(links.filter("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct(), "cc-links")
    nodes = edges.select(F.col("lo").alias("node")).unionByName(edges.select(F.col("hi").alias("node"))).distinct()
    labels = written(nodes.withColumn("label", F.col("node")), "cc-labels")
    while not edges.isEmpty():
        parent = written(edges.groupBy("hi").agg(F.min("lo").alias("to")), "cc-hook")
        while True:
            up = parent.select(F.col("hi").alias("to"), F.col("to").alias("next"))
            jumped = written(parent.join(up, "to", "left").select("hi", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "cc-hook")
            parent = jumped.select("hi", "to")
            if jumped.filter("moved").isEmpty():
                break
            sweep(spark, since, edges, labels, jumped)
        up = parent.select(F.col("hi").alias("label"), F.col("to").alias("next"))
        labels = labels.join(up, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        labels = written(labels, "cc-labels")
        sweep(spark, since, edges, labels, jumped)
        a = parent.select(F.col("hi").alias("lo"), F.col("to").alias("to_lo"))
        b = parent.select("hi", F.col("to").alias("to_hi"))
        e = edges.join(b, "hi").select("lo", "to_hi").filter("lo <> to_hi").distinct()
        e = e.join(a, "lo", "left").select(F.coalesce("to_lo", "lo").alias("u"), F.col("to_hi").alias("v"))
        edges = written(e.filter("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct(), "cc-links")
    sweep(spark, since, labels)
    return labels
