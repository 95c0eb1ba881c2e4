"""Connected components of an edge table, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._base import dropped, stored


def _state(edges: DataFrame) -> tuple:
    """Two numbers that tell whether a round changed the edges."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Rows (id, component) for every node of ``edges`` (a long, b long): the smallest id that it reaches.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Both look
    up the smallest neighbour by a partially aggregated minimum and a join, so a hub
    with a large share of all edges is never gathered in one task. Self loops,
    repeated edges and an empty table are allowed; an edge with a null end is dropped.
    """
    spark = edges.sparkSession
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges"
    )
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a > b")
            .distinct()
        )
        after = stored(small, "edges")
        dropped(spark, now)
        before, now, state = state, after, _state(after)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
