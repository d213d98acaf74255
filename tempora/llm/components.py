"""Connected components of a link table by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, label: the smallest node that it reaches. Only linked nodes have a row.

    Each round takes the smallest label among a node's neighbours, combined
    before the shuffle, and then the label's own label. A cluster of near
    copies, a star or a few stars, settles in two or three rounds.
    """
    edges = links.select(F.col("a").alias("s"), F.col("b").alias("t"))
    edges = staged(edges.union(links.select(F.col("b").alias("s"), F.col("a").alias("t"))).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("s").alias("node")).agg(F.least(F.min("t"), F.first("s")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "t"), "t").groupBy(F.col("s").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = staged(moved.join(own, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.where("old <> label").take(1):
            return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The result of components() over further links, from its result so far: only labels that the new links join are worked on."""
    ends = links
    for side in ("a", "b"):
        known = labels.select(F.col("node").alias(side), F.col("label").alias("known"))
        ends = ends.join(known, side, "left").withColumn(side, F.coalesce("known", side)).drop("known")
    moved = components(ends.where("a <> b").distinct())
    renamed = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("lower")), "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    return staged(renamed.union(moved.join(labels, "node", "left_anti").select("node", "label")), "labels")
