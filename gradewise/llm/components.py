"""Connected components of a link table, by labels that only ever fall."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradewise.llm import common


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest
    node that can be reached. Each round takes the smallest label among the
    neighbours and then the label of that label, so paths shorten by halves;
    every round is a written table. No links give no rows."""
    both = common.written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-links")
    labels = common.written(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")),
        "cc-labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m")))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = common.written(lower.join(jump, "comp").select("node", "was", F.least("comp", "next").alias("comp")),
                             "cc-labels")
        if new.where("was <> comp").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
