"""A training corpus from raw documents: five stages, each by one operator.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and is
written as Parquet and reread as the next one's ``docs``.  All but the last return the
columns of ``documents``.

* ``quality_classifier``: documents that the line field scores below 0.5 go.  Labels are
  those of ``labels`` outside the held-out fold; null and empty texts are scored like any.
* ``quality_rules``: documents that fail the base rules or the boosted trees go, among them
  null and empty texts.
* ``ngram_jaccard_join``: of each group of near duplicates (shingles of five words, four
  fifths of the union in common) the document with the least id stays.
* ``mixing``: documents are taken as often as their source's target needs, up to three
  times; a document taken twice is two rows.
* ``packing``: pieces of all documents in sequences of at most 2048 tokens.

A stage deletes the tables that the one before it wrote for its own use, so a stage's result
is to be written before the next one begins.

Repeated rows are documents of their own, except in the third stage, where rows with one id
are one document.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorecraft.llm import jaccard_join, mixing, packing, quality_crf, quality_rules
from scorecraft.llm.store import delete, shared_folder, step, table

#: No SQL: two stages are models fitted on labels.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with step(spark):
        field = quality_crf.train(docs, table(spark, sf_dir, "labels"))
        return quality_crf.keep_good(docs, field)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with step(spark):
        # fitted on the given documents: those that the first stage leaves are nearly all good
        forest = quality_rules.train(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
        )
        return quality_rules.keep_good(docs, forest)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with step(spark):
        return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with step(spark):
        return mixing.repeat_taken(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with step(spark):
        return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; a stage's input is deleted once its
    output is written, but for that of the last, which its result reads."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
