"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraygraph.session import store


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the least node that links lead to.

    Every round takes the least label of the neighbours and then the label of that label, so long chains shorten
    exponentially. Rounds are stored in the shared folder; only a count of changed labels reaches the driver.
    """
    edges = links.filter("a != b").select("a", "b").distinct()
    both = store(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))))
    labels = store(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        of_other = labels.select(F.col("node").alias("other"), "label")
        near = both.join(of_other, "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("jumped"))
        moved = store(lower.join(jump, "lower").select("node", F.least("lower", "jumped").alias("new"), "label"))
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.filter("new != label").limit(1).count() == 0:
            return labels
