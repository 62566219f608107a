"""Quality rules against plain Python, and the classifier on labels it has not seen."""

import inspect
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from ordercash.llm import quality_classifier as qc
from ordercash.llm import quality_rules as qr

SPACE = re.compile("[^\x20\x09-\x0d]+")


def figures(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    failed = len(words) < 10 or 100 * len(twice) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(twice), failed,
    )


TEXTS = [
    None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x " * 700, "line\nline\nline \n\nother",
    "un été à la mer # * $ % & | < > fin", "one two three four five six seven eight nine ten eleven",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z a b c d e", "no\x0bbreak\x0c\rhere too",
]


def test_figures_are_those_of_plain_python(make):
    rows = qr.judged(make(TEXTS)).collect()
    got = {
        r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in rows
    }
    assert got == {i: figures(t) for i, t in enumerate(TEXTS)}


def test_a_failing_host_goes_and_a_small_one_is_shrunk(make):
    good = " ".join(f"w{i}" for i in range(12))
    texts = [good] * 200 + ["bad"] * 95 + [good] * 5 + ["bad", good]
    hosts = ["clean"] * 200 + ["junk"] * 100 + [None, "clean"]
    docs = make(texts, sources=hosts)
    rows = qr.judged(docs).collect()
    assert {r.host for r in rows if r.host_rejected} == {"junk", qr.NULL_HOST}
    assert sum(r.kept for r in rows) == 201
    kept = qr.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 201
    rates = {r.host: r.host_rate for r in rows}
    assert rates["clean"] < 0.05 and 0.8 < rates["junk"] < 0.96


def test_empty_tables(make, spark):
    assert qr.judged(make([])).collect() == [] and qr.accepted(make([])).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert qc.accepted(make([]), labels).collect() == []
    even = make(["some text", None]).select(qc.score(F.col("text"), qc.fit(make([]), labels)))
    assert len(even.collect()) == 2


def test_held_out_labels_are_told(make, spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    texts, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randint(20, 60))]
        bad = i % 6 == 0
        if bad:
            words = [w + rng.choice(["###", "$$$", "***"]) for w in words] if i % 12 else words[:1] * 30
        texts.append(" ".join(words))
        labels.append((i, None if i == 7 else int(not bad), 0))
    docs = make([*texts, None], [*range(300), 300])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = qc.fit(docs, known)
    scored = docs.select("doc_id", qc.score(docs["text"], model).alias("score")).collect()
    assert all(0 <= r.score <= 1 for r in scored) and len(scored) == 301
    held = [(r.score >= qc.CUT) == (r.doc_id % 6 != 0) for r in scored if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(held) / len(held) >= 0.95
    # Held-out labels play no part.
    flipped = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - (q or 0), t) for i, q, t in labels]
    again = qc.fit(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert (again[0] == model[0]).all() and again[1] == model[1]
    assert qc.accepted(docs, known).columns == docs.columns


def test_labels_of_absent_documents_use_up_no_sample(make, spark):
    assert inspect.signature(qc.fit).parameters["sample"].default == 10_000
    texts = [("plain words here " if i % 2 else "### $$$ ") * (1 + i % 5) for i in range(60)]
    docs = make(texts)
    rows = [(i, i % 2, 0) for i in range(3000)]
    few, many = (spark.createDataFrame(r, "doc_id long, quality int, toxic int") for r in (rows[:60], rows))
    a, b = qc.fit(docs, few, sample=40), qc.fit(docs, many, sample=40)
    assert a[0].any() and (a[0] == b[0]).all() and a[1] == b[1]


def test_learning_comes_to_the_least_loss_of_all_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 5)).astype(np.float32)
    y = (x @ np.array([1.5, -1, 0.5, 0, 0]) + rng.normal(size=120) > -0.5).astype(int)
    gaps = (x[y == 1][:, None, :] - x[y == 0][None, :, :]).reshape(-1, 5).astype(float)
    l2 = 0.01

    def loss(w):
        return np.log1p(np.exp(-gaps @ w)).mean() + l2 / 2 * w @ w

    least = np.zeros(5)
    for _ in range(4000):  # plain descent over every pair
        least -= 0.5 * (l2 * least - gaps.T @ (1 / (1 + np.exp(gaps @ least))) / len(gaps))
    w, cut = qc.learn(x, y, 400, 8192, l2, 5)
    assert loss(least) <= loss(w) <= loss(least) * 1.02
    assert w @ least / np.linalg.norm(w) / np.linalg.norm(least) > 0.99
    # As many rows lie below the cut as labels are bad.
    assert (x @ w < cut).sum() == (y == 0).sum()


def test_scores_of_ties_repeats_long_texts_and_clashing_columns(make, spark):
    texts = [("plain words here again " if i % 3 else "### $$$ ") * (1 + i % 5) for i in range(60)]
    long = "plain words of a very long text\n" * 60_000
    docs = make([*texts, long, "", None, texts[1]], [*range(60), 100, 101, 102, 1])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = qc.fit(docs, labels)
    rows = docs.select("doc_id", "text", qc.score(F.col("text"), model).alias("score")).collect()
    of = {}
    for r in rows:  # equal texts tie, wherever they stand
        assert of.setdefault(r.text or "", r.score) == r.score and 0 <= r.score <= 1
    assert of[long] > of[texts[0]]
    kept = qc.accepted(docs, labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.score >= qc.CUT)
    named = docs.selectExpr("doc_id AS `k`", "text AS body", "1 AS _id", "2 AS _label", "3 AS _text", "4 AS quality", "5 AS score")
    again = qc.fit(named, labels.withColumnRenamed("doc_id", "k"), "k", "body")
    assert (again[0] == model[0]).all() and again[1] == model[1]
    # Texts that are all the same have no pair that tells them apart: all stay on one side of the cut.
    same = make(["one text for all of them"] * 20)
    told = {r.score for r in same.select(qc.score(F.col("text"), qc.fit(same, labels)).alias("score")).collect()}
    assert len(told) == 1


def test_every_pair_is_learnt_from_in_every_step():
    rng = np.random.default_rng(7)
    good, bad = rng.normal(size=300) * 9, rng.normal(size=70) * 9
    chance = 1 / (1 + np.exp(good[:, None] - bad[None, :]))
    for at_once in (1, 1000, 1 << 18):
        of_good, of_bad = qc.pulls(good, bad, at_once)
        assert np.allclose(of_good, chance.sum(1), rtol=1e-12) and np.allclose(of_bad, chance.sum(0), rtol=1e-12)
    far = qc.pulls(np.array([2000.0, -2000.0]), np.array([0.0]), 9)
    assert np.allclose(far[0], [0, 1]) and np.allclose(far[1], [1])
    # One step, by hand: at zero weights all pairs pull by half, and Adam goes by the gradient's sign.
    x = rng.normal(size=(300, 4)).astype(np.float32)
    y = (np.arange(300) % 3 > 0).astype(np.int32)
    grad = -(x[y == 1].mean(0) - x[y == 0].mean(0)) / 2
    assert np.allclose(qc.learn(x, y, 1, 1 << 18, 0.0, 5)[0], -0.1 * np.sign(grad), rtol=1e-4)
    # A feature of one bad row among 20,000 is in few of the pairs; what is learnt of it depends on no draw.
    x = rng.normal(size=(20_000, 2)).astype(np.float32)
    x[:, 1] = 0
    y = np.ones(20_000, dtype=np.int32)
    y[:2000] = 0
    x[0, 1] = 1
    one, other = (qc.learn(x, y, 20, 1 << 18, 1e-3, seed) for seed in (1, 2))
    assert (one[0] == other[0]).all() and one[1] == other[1] and one[0][1] < 0
