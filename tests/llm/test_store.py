from __future__ import annotations

from pathlib import Path

import pyarrow as pa

from scorecraft.llm.store import BATCH_BYTES, step, stored


def test_a_step_deletes_what_the_one_before_wrote(spark):
    base = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(base.glob("scorecraft-*"))
    kept = stored(spark.range(3))  # outside any step
    with step(spark):
        first = stored(spark.range(5))
    assert first.count() == 5
    with step(spark):
        stored(spark.range(2))
        assert len(set(base.glob("scorecraft-*")) - before) == 2
    with step(spark):
        pass
    assert len(set(base.glob("scorecraft-*")) - before) == 1
    assert kept.count() == 3


def test_a_step_hands_rows_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    rows = spark.range(0, 9000, 1, 1).selectExpr("repeat(cast(id as string), 500) as text")
    with step(spark):
        got = [r.bytes for r in rows.mapInArrow(sizes, "bytes long").collect()]
    assert len(got) > 2
    assert sum(got) > 3 * BATCH_BYTES
    assert max(got) < 1.1 * BATCH_BYTES
