"""Manifest of rows: roots, proofs and tampering against a plain recursion."""

import hashlib
import random

from pyspark.sql import functions as F

from ordercash.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(nodes):
    """Levels of one tree up to its single node."""
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([h("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return out


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out += [d for i, d in enumerate(level[run : run + 16], run) if i != at]
        at //= 16
    return out


def plain(rows):
    leaf = lambda r: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: fold([d for *_, d in sorted(trees[s])]) for s in order}
    tops = fold([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (there, doc, d) in enumerate(sorted(trees[s])):
            proof = h("".join(siblings(levels[s], i) + siblings(tops, k)))
            out.append((doc if there else None, d, levels[s][-1][0], tops[-1][0], proof))
    return sorted(out, key=repr)


def docs(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree int, place string, digest string"
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], schema)


def told(df):
    got = df.select("id", "leaf", "subroot", "root", merkle.digest(merkle.proof_text(F.col("proof"))).alias("p"))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_manifest_equals_plain_recursion(spark):
    rng = random.Random(1)
    rows = [(i, "hot", "en", 3, f"text {i} é") for i in range(4100)]
    rows += [(i, f"s{i % 40}", None, None, None) for i in range(5000, 5300)]
    rows += [(None, None, None, None, ""), (7, None, "x", 1, "A" * 300_000), (8, "", "de", 0, "")]
    rows += [(9, "copies", "en", 1, "same")] * 70
    rows += [(10, "zé", "en", 1, "other"), (10, "zé", "en", 2, "Other")]
    rng.shuffle(rows)
    df = docs(spark, rows).repartition(6)
    assert told(merkle.manifest(df)) == plain(rows)


def test_sizes_around_the_fan_out(spark):
    for n in (1, 16, 17, 256, 257):
        rows = [(i, "a", None, None, str(i)) for i in range(n)]
        assert told(merkle.manifest(docs(spark, rows))) == plain(rows)
    assert merkle.manifest(docs(spark, [])).collect() == []


def test_only_tampered_rows_are_told(spark):
    rows = [(i, f"s{i % 3}", "en", 5, "Text" if i % 2 else "text") for i in range(400)]
    df = docs(spark, rows)
    lower = merkle.leaf_digest([F.lower("text") if c == "text" else F.col(c) for c in merkle.FIELDS])
    got = merkle.manifest(df, claim=F.when(F.col("doc_id") % 5 == 0, lower)).select(
        "id", "root", merkle.folded(F.coalesce("claim", "leaf"), F.col("proof")).alias("folded")
    )
    assert {r.id for r in got.collect() if r.root != r.folded} == {i for i in range(400) if i % 5 == 0 and i % 2}
