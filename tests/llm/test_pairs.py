"""The n-gram Jaccard join against all pairs."""

import itertools
import random

import numpy as np

from ordercash.llm import jaccard_join as jj


def grams(text):
    words = (text or "").split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(ids, texts):
    sets = [grams(t) for t in texts]
    links, others = [0] * len(ids), [set() for _ in ids]
    group = list(range(len(ids)))
    for a, b in itertools.combinations(range(len(ids)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and common >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            if sets[a] != sets[b]:
                others[a].add(sets[b])
                others[b].add(sets[a])
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    lowest = {g: min(i for i, h in zip(ids, group, strict=True) if h == g) for g in group}
    return sorted((i, lowest[g], n, len(o)) for i, g, n, o in zip(ids, group, links, others, strict=True))


def near_copies(seed=3):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(60)) for _ in range(30)]
    base = texts[0].split()
    for _ in range(40):  # one large group of texts that all differ
        words = base[:]
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(60)] = f"w{rng.randrange(999)}"
        texts.append(" ".join(words))
    return texts + [texts[0]] * 20 + [texts[5], "one two", "one two", "", " \n", "long " * 5000]


def test_groups_and_links_are_those_of_all_pairs(make):
    texts = near_copies()
    ids = list(range(100, 100 + len(texts)))
    got = jj.linked(make(texts, ids), block_rows=7).collect()
    assert sorted((r.doc_id, r.group_id, r.n_links, r.n_texts) for r in got) == brute(ids, texts)


def test_one_of_each_group_stays(make):
    texts = near_copies()
    ids = list(range(len(texts)))
    docs = make(texts, ids)
    kept = jj.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g for _, g, _, _ in brute(ids, texts)})


def test_nulls_repeats_and_no_rows(make):
    docs = make([None, None, "a b c d e f", "a b c d e f", "x y"], [1, None, 5, 5, None])
    rows = {(r.doc_id, r.group_id, r.n_links) for r in jj.linked(docs).collect()}
    assert rows == {(1, 1, 0), (None, None, 0), (5, 5, 1)}
    assert sorted((r.doc_id or 0, r.text or "") for r in jj.deduplicated(docs).collect()) == [
        (0, ""), (0, "x y"), (1, ""), (5, "a b c d e f")
    ]
    assert jj.linked(make([])).collect() == []
    assert jj.deduplicated(make([])).collect() == []


def test_both_ways_to_verify_agree():
    rng = np.random.default_rng(1)
    left = [np.unique(rng.integers(0, 60, 40)) for _ in range(12)]
    right = [np.unique(np.concatenate([x, rng.integers(0, 60, 3)])) for x in left]
    every = np.ones((12, 12), dtype=bool)
    whole = jj._similar(left, right, every, 0.8)
    for i in range(12):
        one = np.zeros_like(every)
        one[i, :] = True
        assert (jj._similar(left, right, one, 0.8)[i] == whole[i]).all()
    assert whole.any() and not whole.all()


def test_bands_reach_the_recall():
    bands, rows = jj.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
