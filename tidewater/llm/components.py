"""Connected components of a table of links, without gathering them anywhere.

Each round, a node takes the least label among its own and its neighbours', and then its
label's label, so that chains shorten by about half; rounds end when nothing changes. Every
round is written to the shared folder, and the one before deleted. A node of many links, and a label
of many nodes, are dealt into parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, join_salted, stored


def components(links: DataFrame) -> DataFrame:
    """links: u, v. Returns node, label for every node of a link; label is the least node of its component."""
    spark, fixed = links.sparkSession, Scratch(links.sparkSession)
    links = links.where("u <> v")
    edges = fixed.stored(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    before = Scratch(spark)
    ends = edges.select("u", F.col("v").alias("node"))
    centres = hot_keys(ends, ["node"])
    labels = before.stored(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")), "labels")
    while True:
        here = Scratch(spark)
        near = join_salted(ends, labels, ["node"], centres).groupBy("u").agg(F.min("label").alias("near"))
        took = labels.join(near, labels["node"] == near["u"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        took = here.stored(took, "took")
        up = took.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = join_salted(took, up, ["label"], hot_keys(took, ["label"])).select("node", "old", F.least("label", "up").alias("label"))
        after = Scratch(spark)
        jumped = after.stored(jumped, "labels")
        here.clear()
        before.clear()
        labels, before = jumped.select("node", "label"), after
        if jumped.where("old <> label").isEmpty():
            out = stored(labels, "components")
            before.clear()
            fixed.clear()
            return out
