"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

1. A fingerprint has a bit for each of 64 positions: whether over half of a text's shingle
   hashes have it.  Equal fingerprints are one node, so groups of copies cost one row.
2. Embedding: the counts of ones in segments of two bits.  One changed bit moves one count by
   one, so the Manhattan distance of two embeddings never exceeds the number of differing
   bits.  A count is written as 00, 01 or 11, which makes the distance itself a count of
   differing bits of two 64-bit codes.
3. Grid: codes at distance 3 or less are at distance 1 or less in one of their halves.  A
   node stands in the cell of each half; it looks into its own two cells and into those one
   count higher, where neighbours one count lower are found by looking up themselves.
4. First every node is held against one centre for each cell it looks into: a number of
   comparisons linear in nodes.  The links found make provisional groups.  Then only cells
   that also hold nodes of another group are opened, and nodes of two groups are compared;
   pairs within a group are not, as no link among them can change a component.
5. Every comparison checks the Manhattan bound, then the exact number of differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm import text as tx
from scorecraft.llm.components import components
from scorecraft.llm.store import stored, table

#: Shingles whose bits are counted at once.
STEP = 1 << 15
#: Differing bits up to which fingerprints link; the grid of two halves is made for it.
MOST_BITS = 3
LOW = 0x5555555555555555
HALF = 0xFFFFFFFF


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text, 0 if it has no words.

    Shingles of ``words`` words, repeats included; all words if they are fewer.  Only A-Z is
    lower-cased, and words end at U+0020 and U+0009 to U+000D.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    data = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    starts, ends = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), STEP):
        some = zip(starts[i : i + STEP], ends[i : i + STEP], strict=True)
        values = np.array([hashed(data[a:b], seed) for a, b in some], "<u8")
        bits = np.unpackbits(values.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    over = 2 * ones > len(starts)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, bits`` of every row; the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            values = np.array([fingerprint(x.as_py(), words) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "bits"]
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, bits long")


def embedded(bits: Column) -> Column:
    """The counts of ones in the segments of two bits, each written as 00, 01 or 11."""
    low = F.lit(LOW)
    one, other = bits.bitwiseAND(low), F.shiftrightunsigned(bits, 1).bitwiseAND(low)
    return one.bitwiseOR(other).bitwiseOR(F.shiftleft(one.bitwiseAND(other), 1))


def _half(code: Column, half: int) -> Column:
    return F.shiftrightunsigned(code, 32) if half else code.bitwiseAND(F.lit(HALF))


def _cell(half: int, cell: Column) -> Column:
    """The number of a cell: 32 bits of the half's code, and the half."""
    return (cell * 2 + half).alias("cell")


def cells(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``cell``, one row for each half."""
    at = F.array(*[_cell(h, _half(F.col("code"), h)) for h in (0, 1)])
    return nodes.withColumn("cell", F.explode(at))


def looks(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``cell``: of each half the own cell and those with one count raised."""

    def of(half: int) -> Column:
        own = _half(F.col("code"), half)
        # a count of 0 becomes 01, one of 1 becomes 11: its lowest bit that is not yet set
        raised = F.transform(
            F.array(*[F.lit(1 << 2 * i).cast("long") for i in range(16)]),
            lambda x: own.bitwiseOR(
                F.when(own.bitwiseAND(x) == 0, x).otherwise(F.shiftleft(x, 1))
            ),
        )
        every = F.array_distinct(F.concat(F.array(own), raised))
        return F.transform(every, lambda x: _cell(half, x))

    return nodes.withColumn("cell", F.explode(F.concat(of(0), of(1))))


def _near(a: str, b: str) -> Column:
    """The Manhattan distance of the embeddings, a lower bound, then the differing bits."""
    bound = F.bit_count(F.col(f"{a}.code").bitwiseXOR(F.col(f"{b}.code")))
    exact = F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits")))
    return (bound <= MOST_BITS) & (exact <= MOST_BITS)


def linked(nodes: DataFrame) -> DataFrame:
    """``a, b``: links between the fingerprints ``bits`` (weighted by ``rows``) that join them
    to the same components as all their links do."""
    nodes = stored(nodes.withColumn("code", embedded(F.col("bits"))))
    standing, looking = cells(nodes), looks(nodes.select("bits", "code"))

    # one centre a cell, the fingerprint of most rows: links of a number linear in nodes
    first = F.max_by(F.struct("bits", "code"), F.struct("rows", "bits")).alias("centre")
    centres = standing.groupBy("cell").agg(first).select("cell", "centre.*")
    first_links = stored(
        looking.alias("a")
        .join(centres.alias("b"), "cell")
        .where(_near("a", "b") & (F.col("a.bits") != F.col("b.bits")))
        .select(F.col("a.bits").alias("a"), F.col("b.bits").alias("b"))
        .distinct()
    )
    groups = components(first_links)
    grouped = stored(
        nodes.join(groups, F.col("bits") == F.col("node"), "left").select(
            "bits", "code", F.coalesce("component", "bits").alias("grp")
        )
    )

    # cells that hold another group than the one that looks
    own = cells(grouped)
    kinds = own.groupBy("cell").agg(F.min("grp").alias("least"), F.max("grp").alias("most"))
    other = (F.col("least") != F.col("grp")) | (F.col("most") != F.col("grp"))
    asking = looks(grouped).join(kinds, "cell").where(other).drop("least", "most")
    pairs = (
        asking.alias("a")
        .join(own.alias("b"), "cell")
        .where((F.col("a.grp") != F.col("b.grp")) & _near("a", "b"))
        .select(F.col("a.bits").alias("a"), F.col("b.bits").alias("b"))
    )
    return first_links.unionByName(pairs.distinct())


def near_duplicates(documents: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Two rows link when their fingerprints differ in three bits or fewer; the component is
    the smallest ``doc_id`` reachable by links, the row's own included.  Null and empty texts
    have fingerprint 0 and link like others.  Rows without an id link too, but give no
    component its name; one that reaches no id has a null component.  Rows that repeat an id
    are rows of their own, which link only by their fingerprints.  Columns besides ``doc_id``
    and ``text`` are not read.
    """
    found = stored(fingerprints(documents, words))
    nodes = stored(
        found.groupBy("bits").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"))
    )
    groups = components(linked(nodes.select("bits", "rows")))
    grouped = stored(
        nodes.join(groups, F.col("bits") == F.col("node"), "left").select(
            "bits", F.coalesce("component", "bits").alias("grp"), "least"
        )
    )
    named = grouped.groupBy("grp").agg(F.min("least").alias("component_id"))
    of = grouped.join(named, "grp").select(F.col("bits").alias("node"), "component_id")
    return found.join(of, found["bits"] == of["node"]).select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by three-word shingles, linked up to three differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))
