import os

import corpus_pipeline
from ordercash.llm import common
from ordercash.llm.common import lean

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_pipeline_stages_hand_small_batches_to_python(spark):
    before = spark.conf.get(KEY)
    try:
        docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
        assert corpus_pipeline.packing_stage(spark, docs, "").count() == 2
        assert int(spark.conf.get(KEY)) <= 1_000
    finally:
        spark.conf.set(KEY, before)


def _resident_mb() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20


def test_a_worker_gives_back_what_a_task_has_freed():
    pins = []

    def work(batches):
        for batch in batches:
            held = [b"x" * 100_000 for _ in range(3_000)]
            pins.append(b"x" * 100_000)  # stands behind them, so that the heap doesn't shrink by itself
            yield batch + len(held)

    before = _resident_mb()
    assert list(lean(work)(iter([1, 2]))) == [3_001, 3_002]
    assert _resident_mb() - before < 100


def test_lean_functions_give_back_at_both_ends(monkeypatch):
    began = []
    monkeypatch.setattr(common, "give_back", lambda: began.append(1))
    list(lean(iter)([1, 2]))
    assert len(began) == 2  # as the task begins and as it ends
    list(lean(iter)([]))
    assert len(began) == 4
