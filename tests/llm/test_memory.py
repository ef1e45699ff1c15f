"""What a task holds at once: bounded batches, texts handed over once, no Python workers where none are needed."""

import pyarrow as pa
import pytest

from farelake.llm import decontaminate, near_dedup, sharding, toxicity
from farelake.llm.common import BATCH_BYTES
from farelake.session import durable
from tests.llm.conftest import SCHEMA, prose, rows_of

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
ROW = 4000


def _bytes_of(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])


@pytest.mark.parametrize("operator", ["toxicity", "drop_toxic", "near_groups", "leaks"])
def test_batches_are_bounded(spark, odd, operator):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, prose(3, 30))], "item_id long, text string")
    run = {"toxicity": lambda: toxicity.toxicity(odd, labels), "drop_toxic": lambda: toxicity.drop_toxic(odd, labels),
           "near_groups": lambda: near_dedup.near_groups(odd), "leaks": lambda: decontaminate.leaks(odd, items)}[operator]
    spark.conf.unset(BOUND)
    run()
    wide = spark.range(5000, numPartitions=1).selectExpr("id", f"repeat('x', {ROW}) as text")
    seen = wide.mapInArrow(_bytes_of, "rows long, bytes long").collect()
    assert sum(r.rows for r in seen) == 5000
    assert max(r.bytes for r in seen) <= BATCH_BYTES + 2 * ROW


def test_toxic_texts_are_handed_over_once(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    plan = toxicity.drop_toxic(odd, labels)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    assert plan.children().head().output().size() == len(odd.columns)


def test_sharding_needs_no_python_on_executors(spark):
    docs = spark.createDataFrame(rows_of([prose(k, 20) for k in range(50)]), SCHEMA)
    stored = durable(docs, "documents")
    plan = sharding.shard_documents(stored, shards=3, carry=None)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan


def test_frequent_signatures_do_not_depend_on_batches():
    words = prose(1, 300).split()
    texts = [" ".join([*words[:k], "changed", *words[k + 1:]]) for k in range(60)]
    whole = pa.RecordBatch.from_arrays(
        [pa.array(range(60), pa.int64()), pa.array([b"k"] * 60), pa.array(texts)], ["doc_id", "text_key", "text"])

    def frequent(batches):
        *_, last = near_dedup._key_batches(iter(batches), 5, 75)
        return dict(zip(last.column("sign").to_pylist(), last.column("met").to_pylist()))

    together = frequent([whole])
    assert max(together.values()) > 30
    assert frequent([whole.slice(k, 1) for k in range(60)]) == together
