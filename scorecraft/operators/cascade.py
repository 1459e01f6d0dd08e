"""Propagation of a severity level along a dependency table, by path doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.session import Scratch, ensure_checkpoint_dir


def _further(offer: Column, hops: Column) -> Column:
    """An offer seen from a node ``hops`` further on."""
    moved = F.struct(offer["level"].alias("level"), (offer["back"] - hops).alias("back"))
    return F.when(offer.isNotNull(), moved)


def _jumps(into: DataFrame, singles: int, scratch: Scratch) -> DataFrame:
    """``node, to, offer, hops, open`` of every node with one predecessor.

    A jump leads from the node back to ``to`` in ``hops`` steps and keeps the best offer on
    the way.  Each round joins a jump to that of the node it leads to, so its length doubles,
    until it leads to a node that has none.  Jumps along a cycle stay open; they are left
    once they are as long as there are open jumps, and then hold all that they pass.
    """
    one = F.lit(1).cast("long")
    jumps, _ = scratch.write(
        into.where("ways = 1").select("node", "to", "offer", one.alias("hops"), F.lit(True).alias("open"))
    )
    length, left = 1, singles
    while left:
        more = jumps.select(
            F.col("node").alias("next"),
            F.col("to").alias("beyond"),
            F.col("offer").alias("later"),
            F.col("hops").alias("length"),
            F.col("open").alias("on"),
        )
        joined = (
            jumps.where("open")
            .join(more, F.col("to") == F.col("next"), "left")
            .select(
                "node",
                F.coalesce("beyond", "to").alias("to"),
                F.greatest("offer", _further(F.col("later"), F.col("hops"))).alias("offer"),
                (F.col("hops") + F.coalesce("length", F.lit(0))).alias("hops"),
                F.coalesce("on", F.lit(False)).alias("open"),
            )
        )
        jumps, seen = scratch.write(
            jumps.where("not open").unionByName(joined), left=F.count(F.when(F.col("open"), 1))
        )
        length, before, left = 2 * length, left, seen["left"]
        if left == before and length >= left:
            break
    return jumps


def _settled(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, best`` of every node that ``edges(from, node, offer, hops)`` lead to.

    A node knows the best of its edges' offers and of what the nodes before it know, moved
    on; only those improved in a round pass on in the next.
    """
    edges, _ = scratch.write(edges)
    state, seen = scratch.write(
        edges.groupBy("node").agg(F.max("offer").alias("best")).withColumn("fresh", F.col("best").isNotNull()),
        fresh=F.count(F.when(F.col("fresh"), 1)),
    )
    while seen["fresh"]:
        passing = state.where("fresh").select(F.col("node").alias("from"), "best")
        offers = edges.join(passing, "from").select(
            "node", _further(F.col("best"), F.col("hops")).alias("offer")
        )
        state, seen = scratch.write(
            state.select("node", "best")
            .unionByName(offers, allowMissingColumns=True)
            .groupBy("node")
            .agg(F.max("best").alias("old"), F.max("offer").alias("new"))
            .select(
                "node",
                F.greatest("old", "new").alias("best"),
                F.coalesce(F.col("new") > F.col("old"), F.col("new").isNotNull()).alias("fresh"),
            ),
            fresh=F.count(F.when(F.col("fresh"), 1)),
        )
    return state.select("node", "best")


def propagate_level(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """The worst level each node inherits from its transitive predecessors.

    ``levels(node, level)`` with 0 for no concern, ``edges(predecessor, successor)``.
    Returns ``(node, level, inherited_level, hops)``, hops being the distance to the
    nearest predecessor with the inherited level; in a cycle a node also inherits its own.

    1. Nodes with one predecessor double their jumps: a chain takes as many rounds as its
       length has binary digits, of one write each.
    2. Nodes with several are joined by edges that skip the chains between them, with the
       best offer on the way; offers pass along these edges until none improves.

    Every state has one row a node, never the pairs of the closure.  Predecessors are
    combined map-side before they are shuffled, which also covers a node with very many.
    Each round's state is written to the shared folder, which costs a lost executor one
    round and keeps the plan small; all states are dropped at the end.
    """
    ensure_checkpoint_dir(levels.sparkSession)
    scratch = Scratch(levels.sparkSession)
    own, _ = scratch.write(levels.select("node", F.col("level").cast("int").alias("level")))
    links, _ = scratch.write(
        edges.select("predecessor", "successor")
        .where("predecessor is not null and successor is not null")
        .distinct()
    )
    known = own.where("level > 0").select(
        F.col("node").alias("predecessor"), F.struct("level", F.lit(-1).cast("long").alias("back")).alias("offer")
    )
    steps = links.join(known, "predecessor", "left")
    into, seen = scratch.write(
        steps.groupBy(F.col("successor").alias("node")).agg(
            F.count(F.lit(1)).alias("ways"),
            F.min("predecessor").alias("to"),
            F.max("offer").alias("offer"),
        ),
        singles=F.count(F.when(F.col("ways") == 1, 1)),
        several=F.count(F.when(F.col("ways") > 1, 1)),
    )
    jumps = _jumps(into, seen["singles"], scratch)
    found = jumps.select("node", F.col("offer").alias("best"))
    if seen["several"]:
        joins = into.where("ways > 1").select(F.col("node").alias("successor"))
        chains = jumps.select(
            F.col("node").alias("predecessor"),
            F.when(~F.col("open"), F.col("to")).alias("from"),
            F.col("offer").alias("later"),
            F.col("hops").alias("length"),
        )
        short = (
            steps.join(joins, "successor")
            .join(chains, "predecessor", "left")
            .select(
                F.when(F.col("length").isNull(), F.col("predecessor")).otherwise(F.col("from")).alias("from"),
                F.col("successor").alias("node"),
                F.greatest("offer", _further(F.col("later"), F.lit(1))).alias("offer"),
                (F.coalesce("length", F.lit(0)) + 1).alias("hops"),
            )
            .groupBy("from", "node")
            .agg(F.max("offer").alias("offer"), F.min("hops").alias("hops"))
        )
        state = _settled(short, scratch)
        ends = state.select(F.col("node").alias("to"), F.col("best").alias("later"))
        beyond = _further(F.col("later"), F.col("hops"))
        found = (
            jumps.join(ends, "to", "left")
            .select("node", F.greatest("offer", beyond).alias("best"))
            .unionByName(state)
        )
    inherited = (
        own.join(found.withColumnRenamed("node", "target"), F.col("node") == F.col("target"), "left")
        .select(
            "node",
            "level",
            F.coalesce(F.col("best.level"), F.lit(0)).alias("inherited_level"),
            (-F.col("best.back")).alias("hops"),
        )
        .checkpoint()
    )
    scratch.drop()
    return inherited
