"""The pipeline's stages on the smallest sample, each against what it says it does."""

import corpus_pipeline
from ordercash.llm import decontamination, jaccard_join, quality_classifier, quality_rules
from ordercash.llm.common import written
from ordercash.llm.queries import ORACLES, QUERIES, table

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = table(spark, SMALL, "documents")
    labels = table(spark, SMALL, "labels")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, SMALL), name)
        assert docs.columns == before.columns
        seen[name] = (before, docs)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = seen["quality_rules"]
    assert ids(after) == ids(quality_rules.judged(before).filter("kept"))
    before, after = seen["quality_classifier"]
    score = quality_classifier.score(before["text"], quality_classifier.fit(before, labels))
    assert ids(after) == ids(before.withColumn("s", score).filter("s >= 0.3"))
    before, after = seen["jaccard_join"]
    groups = {r.doc_id: r.group_id for r in jaccard_join.linked(before).collect()}
    assert ids(after) == sorted(set(groups.values()))
    before, after = seen["decontamination"]
    found = decontamination.hits(before, table(spark, SMALL, "benchmark"))
    hit = {r.record["doc_id"] for r in found.filter("contaminated").collect()}
    old = {r.doc_id: r.text for r in before.collect()}
    new = {r.doc_id: r.text for r in after.collect()}
    assert all(new[i] == t for i, t in old.items() if i not in hit)
    assert all(new.get(i) != old[i] for i in hit)
    again = decontamination.hits(after, table(spark, SMALL, "benchmark"))
    assert again.filter("contaminated").count() == 0

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert set(ids(packed.distinct())) == set(new)


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
