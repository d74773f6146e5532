"""Connected components of a link table, as DataFrame rounds.

Each round every node takes the smallest label among its own and its
neighbours', then its label's label (pointer jumping), so that long chains
close in a logarithmic number of rounds.  Labels are written to the shared
folder after each round; aggregates combine map-side and joins are plain
equi-joins that adaptive execution can split where one node holds many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table

MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), any order, repeats allowed -> (node, root): every linked
    node with the smallest node of its component.  No links: no rows."""
    both = Table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = Table(both.df.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    for _ in range(MAX_ROUNDS):
        old = labels.df
        near = (both.df.join(old.select(F.col("node").alias("a"), "root"), "a")
                .groupBy(F.col("b").alias("node")).agg(F.min("root").alias("near")))
        low = old.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("low"))
        jump = old.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = Table(low.join(jump, "low").select("node", "was", F.least("low", "far").alias("root")), "labels")
        changed = new.df.where("root <> was").limit(1).count()
        labels.drop()
        labels = new
        if not changed:
            both.drop()
            return labels.df.select("node", "root")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
