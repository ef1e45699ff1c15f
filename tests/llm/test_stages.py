"""The corpus pipeline: each stage's decisions on planted rows, and the whole run against the stages one by one."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.conftest import SCHEMA, prose, rows_of

ITEM = ("Which of the nine harbour towns of the old northern league kept a lantern burning through every winter night? "
        "The fishermen of Aldermouth kept it burning because their fathers had once been lost on the reef.")
COPIES = range(300, 310)
NEAR, LEAK, NOTHING, EMPTY = 310, 311, 312, 313


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with toxic ones, copies, a near copy, a benchmark leak and odd rows, stored as the pipeline reads them."""
    r = random.Random(11)
    texts, marks = [], []
    for k in range(240):
        words = prose(k + 2000, 60).split()
        if k % 3 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["blorgy", "snarvish", "gritzle"]))
        texts.append(" ".join(words))
        marks.append(k % 3 == 0)
    copy = prose(7, 120).split()
    texts += [" ".join(copy)] * len(COPIES) + [" ".join(copy[:60] + ["changed"] + copy[61:])]
    texts += [prose(8, 80) + " " + ITEM + " " + prose(9, 80), None, ""]
    ids = [*range(240), *COPIES, NEAR, LEAK, NOTHING, EMPTY]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows_of(texts, ids), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(m)) for k, m in enumerate(marks)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "benchmark leaks", "mixing", "sharding"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        assert out.columns[:len(columns)] == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = docs.collect()
    clean = {k for k in range(240) if k % 3}
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    assert ids["toxicity"] == clean | {*COPIES, NEAR, LEAK, NOTHING, EMPTY}
    assert ids["near copies"] - {*COPIES, NEAR} == clean | {LEAK, NOTHING, EMPTY}
    assert len(ids["near copies"] & {*COPIES, NEAR}) == 1
    assert ids["benchmark leaks"] == ids["near copies"] - {LEAK}
    assert len(kept["benchmark leaks"]) == len(ids["benchmark leaks"])
    words = {r.doc_id: (r.text or "").split() for r in kept["benchmark leaks"]}
    mixed = Counter()
    for r in kept["mixing"]:
        text = (r.text or "").split()
        assert text == words[r.doc_id][:len(text)]
        mixed[r.doc_id] += len(text)
    assert all(mixed[k] <= 2 * len(words[k]) for k in mixed)
    total = sum(map(len, words.values()))
    assert abs(sum(mixed.values()) - 1.5 * total) <= 0.02 * total
    shards = defaultdict(list)
    for r in kept["sharding"]:
        shards[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())
    assert Counter((r.doc_id, r.text) for r in kept["sharding"]) == Counter((r.doc_id, r.text) for r in kept["mixing"])
    whole = corpus_pipeline.run(spark, tables)
    key = ["doc_id", "text", "shard_bytes", "shard", "slot"]
    assert Counter(map(tuple, whole.select(key).collect())) == Counter(map(tuple, docs.select(key).collect()))


def test_no_documents(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
