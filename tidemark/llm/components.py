"""Connected components by contraction, on rows of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b); a component is its smallest id.

    Each round maps every id to its smallest neighbour and the links likewise. An id with
    a smaller neighbour vanishes, so the ids left at least halve; a star takes one round.
    """
    links = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        smallest = stored(
            both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("low")),
            "smallest",
        )
        of_a = smallest.select(F.col("id").alias("a"), F.col("low").alias("to_a"))
        of_b = smallest.select(F.col("id").alias("b"), F.col("low").alias("to_b"))
        links = stored(
            links.join(of_a, "a").join(of_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
            .filter("a <> b").distinct(),
            "links",
        )
        step = smallest.select(F.col("id").alias("component"), "low")
        if labels is None:
            labels = smallest.select("id", F.col("low").alias("component"))
        else:
            labels = labels.join(step, "component", "left").select(
                "id", F.coalesce("low", "component").alias("component")
            )
        labels = stored(labels, "labels")
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
