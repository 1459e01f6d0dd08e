from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from scorecraft.llm import jaccard_join, packing
from scorecraft.llm.store import stored, table

from .conftest import SF
from .test_graphs import brute_components
from .test_tokens import check_pieces


def test_stages_one_by_one(spark, tokenizer):
    docs = table(spark, SF, "documents")
    columns, labels = docs.columns, {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, SF))
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        gone = {r.doc_id for r in before.select("doc_id").collect()} - ids
        if name == "quality_classifier":
            assert sum(labels.get(d) == 1 for d in gone) <= 2
            assert sum(labels.get(d) == 0 for d in ids) <= 2
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            roots = {r[2] for r in brute_components(rows, jaccard_join.Rule())}
            assert {str(d) for d in ids} == roots
        if name == "mixing":
            assert docs.groupBy("doc_id").count().where("count > 3").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    once = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    covered = pieces.groupBy("doc_id").agg(F.sum("length").alias("ids"), F.max("doc_tokens").alias("all"))
    assert covered.join(once, "doc_id").where("ids <> all * times").count() == 0
    unique = docs.dropDuplicates(["doc_id"])
    rows = packing.digest(packing.pack(unique, __import__("public_tokenizers").path("byte_bpe_50k.json"))).collect()
    assert check_pieces(rows, unique, tokenizer, packing.Limits()) < 0.02


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    ]
