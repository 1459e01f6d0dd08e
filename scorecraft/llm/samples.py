"""Bounded samples of labelled documents to fit small models on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id) -> F.Column:
    """0, 1 or 2 by ``crc32`` of the id as text; fold 1 is held out from training."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, per_class: int
) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``per_class`` training documents of either class.

    The ids with the smallest hashes are taken, so reruns agree; rows of the held-out fold,
    unlabelled rows and null ids never enter, and an id labelled both ways is left out.
    The sample has a fixed bound, hence the broadcast; the documents are only scanned.
    """
    clean = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(fold("doc_id") != 1)
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    order = F.xxhash64(F.col("doc_id").cast("string"))
    parts = [
        clean.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        for value in (0, 1)
    ]
    chosen = parts[0].unionByName(parts[1])
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def within_lines(sample: DataFrame, most_lines: int) -> DataFrame:
    """The documents of a labelled sample, whole, whose lines add up to ``most_lines`` of
    either class at most.

    Texts of every length stand in the order of their ids' hashes, so a class of long texts
    has fewer of them.  Those that are longer than the bound by themselves come last; a class
    keeps its first document in any case.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    sized = sample.groupBy("doc_id", "label").agg(F.sum(lines).alias("lines"))
    order = Window.partitionBy("label").orderBy(
        F.col("lines") > most_lines, F.xxhash64(F.col("doc_id").cast("string")), "doc_id"
    )
    upto = F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.select(
        "doc_id", upto.alias("upto"), F.row_number().over(order).alias("nth")
    )
    chosen = placed.where((F.col("upto") <= most_lines) | (F.col("nth") == 1)).select("doc_id")
    return sample.join(F.broadcast(chosen), "doc_id", "left_semi")
