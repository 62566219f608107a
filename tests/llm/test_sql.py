"""The operators' SQL by DuckDB, alone and for what the whole pipeline does, stage by stage."""

import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ordercash.llm.common import written
from ordercash.llm.queries import ORACLES, QUERIES, default_tokenizer
from tests.conftest import SMALL
from tools.check import compare, connect

LENGTH = 4096


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    outcome = compare(spark, connect(SMALL), SMALL, name, QUERIES[name], ORACLES[name])
    assert outcome.startswith("ok"), outcome


def whole_text_pieces(texts):
    """(doc_id, piece, start, length, crc32) of whole texts' ids, each text closed by id 1."""
    tokenizer = Tokenizer.from_file(default_tokenizer())
    out = []
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), LENGTH):
            part = np.array(ids[k : k + LENGTH], dtype="<u4")
            out.append((doc_id, k // LENGTH, k, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


def pieces_of(rows):
    return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


def assert_gapless(rows):
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= LENGTH


def test_pieces_are_those_of_whole_texts(spark):
    rows = QUERIES["op7_packing"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert pieces_of(rows) == whole_text_pieces([tuple(d) for d in docs])
    assert_gapless(rows)


@pytest.fixture
def folder(spark, tmp_path):
    """The smallest sample with a null text, an empty one, a long one and rows that come twice."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    some = docs.orderBy("doc_id").limit(5)
    top = 10**6
    blank = some.limit(1).selectExpr(
        *(f"cast(null AS {f.dataType.simpleString()}) AS {f.name}" if f.name != "doc_id"
          else f"cast({top} AS {f.dataType.simpleString()}) AS doc_id" for f in docs.schema)
    )
    empty = some.limit(1).selectExpr(
        *("'' AS text" if c == "text" else f"doc_id + {top} + 1 AS doc_id" if c == "doc_id" else c for c in docs.columns)
    )
    long = " ".join(f"word{i} of row {i * i}" for i in range(9000))
    far = some.limit(1).selectExpr(
        *(f"'{long}' AS text" if c == "text" else f"cast(doc_id + {top} + 2 AS bigint) AS doc_id" if c == "doc_id" else c
          for c in docs.columns)
    )
    docs.unionByName(some).unionByName(blank).unionByName(empty).unionByName(far).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_run_does_what_the_stages_sql_says(spark, folder, monkeypatch):
    stages = []

    def kept(df, name):
        out = written(df, name)
        stages.append(out)
        return out

    monkeypatch.setattr(corpus_pipeline, "written", kept)
    rows = corpus_pipeline.run(spark, folder).collect()
    start = spark.read.parquet(f"{folder}/documents.parquet")
    rules, classifier, joined, cleaned = stages[:4]

    def sql(name, docs):
        con = duckdb.connect()
        paths = docs.inputFiles()
        con.read_parquet(paths).create_view("documents")
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{folder}/benchmark.parquet/*.parquet'")
        told = con.execute(ORACLES[name])
        names = [d[0] for d in told.description]
        return [dict(zip(names, r, strict=True)) for r in told.fetchall()]

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    assert ids(rules) == sorted(r["doc_id"] for r in sql("op5_quality_rules", start) if r["kept"])
    assert set(ids(classifier)) <= set(ids(rules))
    groups = {}
    for r in sql("op2_jaccard_join", classifier):
        groups.setdefault(r["class_id"], []).append(r["doc_id"])
    assert ids(joined) == sorted(map(min, groups.values()))
    told = {r["doc_id"]: r for r in sql("op10_decontamination", joined)}
    before = {r.doc_id: r.text for r in joined.collect()}
    after = {r.doc_id: r.text for r in cleaned.collect()}
    gone = {i for i, r in told.items() if r["contaminated"] and r["n_hit"] == r["n_words"]}
    assert set(after) == set(before) - gone
    assert all((after[i] == before[i]) != told[i]["contaminated"] for i in after)
    assert not any(r["contaminated"] for r in sql("op10_decontamination", cleaned))
    assert pieces_of(rows) == whole_text_pieces(after.items())
    assert_gapless(rows)
