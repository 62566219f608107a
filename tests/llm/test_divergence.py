"""Distances of sources and their terms against plain counting."""

import re
from collections import Counter

import pytest

from ordercash.llm import divergence


def plain(rows, min_docs, prior=5, top=50):
    rows = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == lang]
        docs = Counter(t for *_, w in here for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        counts = {s: Counter() for _, s, _ in here}
        for _, s, w in here:
            counts[s].update(t for t in w if docs[t] >= min_docs)

        def shares(c):
            total = sum(c.values()) + prior * len(kept)
            return {t: 1 + 10**9 * (c[t] + prior) // total for t in kept}

        whole = shares(sum(counts.values(), Counter()))
        p = {s: shares(c) for s, c in counts.items()}
        for s in counts:
            far = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            over = [(whole[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", sorted(far)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


ROWS = [
    (f"l{i % 2}" if i % 7 else None, f"s{i % 11}", f"The word{i % 5} été and x{i % 13} the, B{i % 3}a don't" * (1 + i % 4))
    for i in range(300)
]
ROWS += [("l0", "hot", "copy of one text")] * 200 + [("l1", None, None), (None, "", ""), ("bare", "a", "once"), ("bare", "b", "123"), ("l\x000", "z", "the")]
ROWS += [("l0", "s1", "the " * 50_000), ("l0", "é", "ÉCOLE école Ärger"), ("l0", "zz", "...")]


@pytest.mark.parametrize("cuts", [{}, {"fit_bytes": 700, "tile": 3, "block": 2}])
def test_audit_equals_plain_counting(spark, cuts, monkeypatch):
    monkeypatch.setattr(divergence, "SAMPLE", 1)
    docs = spark.createDataFrame([(*r, 1, "y") for r in ROWS], "lang string, source string, text string, id int, vector string").repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(docs, min_docs=4, top=6, **cuts).collect())
    assert got == plain(ROWS, 4, top=6)


def test_audit_without_kept_terms_or_rows(spark):
    docs = spark.createDataFrame([("en", "a", "x"), ("en", "b", None)], "lang string, source string, text string")
    got = sorted(tuple(r) for r in divergence.audit(docs).collect())
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(docs.limit(0)).collect() == []


def test_only_a_to_z_are_lower_cased(spark):
    texts = ["ABC xYz", "KELVIN İI ÉTÉ ABC", "", None, "É"]
    docs = spark.createDataFrame([(t, "l", "s") for t in texts], "text string, lang string, source string")
    got = divergence.with_terms(divergence.marked(docs, "text", "lang", "source")).collect()
    terms = [[t.split("\x00")[1] for t in r.terms] for r in got]
    assert terms == [["abc", "xyz"], ["Kelvin", "İi", "ÉtÉ", "abc"], [], [], ["É"]]


@pytest.mark.parametrize("chunk_bytes", [1, 200, 1 << 20])
def test_lists_add_up_to_the_terms_of_each_text(spark, chunk_bytes, monkeypatch):
    monkeypatch.setattr(divergence, "LIST", 3)
    texts = [*(r[2] for r in ROWS[:40]), None, "", "...", "ab", "ABC xYz", "KELVIN İI ÉTÉ ABC", "x1y`z{q", "a" * 30, "É"]
    rows = [(t, f"l{i % 3}" if i % 5 else None, f"s{i % 4}" if i % 6 else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    told = divergence.with_terms(divergence.marked(docs, "text", "lang", "source")).collect()
    seen, terms = Counter(), Counter()
    for r in told:
        seen.update(set(r.terms))
        terms.update((r.source, t) for t in r.terms)
    got_seen, got_terms, groups = Counter(), Counter(), set()
    for r in divergence.counted(docs, chunk_bytes=chunk_bytes).collect():
        if r.lang is not None:
            groups.add((r.lang, r.source))
        for t in r.seen or ():
            got_seen[t] += r.weight
        for t in r.terms or ():
            got_terms[r.source, t] += r.weight
        assert max(len(r.seen or ()), len(r.terms or ())) <= 3 and len(set(r.terms or ())) == len(r.terms or ())
    assert (got_seen, got_terms) == (seen, terms)
    assert groups == {(r.lang, r.source) for r in told}


def test_terms_are_told_once_for_each_chunk(spark):
    docs = spark.createDataFrame([("the cat and the dog " * 20, "en", "s")] * 500, "text string, lang string, source string")
    rows = divergence.counted(docs.coalesce(1)).collect()
    # 4 terms in 500 documents, and 10,000 or 20,000 times: six bits, and five.
    assert sum(len(r.seen or ()) for r in rows) == 4 * 6
    assert sum(len(r.terms or ()) for r in rows) == 4 * 5
