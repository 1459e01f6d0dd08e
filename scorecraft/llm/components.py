"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.store import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; the component is its least node.

    Alternating stars: nodes link their larger neighbours, then their smaller ones, to the
    least node they know.  The graph becomes one star per component after a number of rounds
    that grows with the logarithm of its size.  Minima are combined before each shuffle and
    joined back, so a node with very many neighbours is never gathered; each round is
    written to the shared folder.  Null ends and loops are left out.
    """
    now = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )

    def mark(df: DataFrame):
        # exact: equal sets of edges have equal sums, and the stars only ever move down
        return df.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)"))).first()

    before = mark(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = stored(
            small.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .distinct()
        )
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
