"""Language-model scores against a plain model held in dictionaries."""

import collections
import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from ordercash.llm import partial_matching as pm


def brute(docs):
    counts, trained, ends, zs = collections.defaultdict(collections.Counter), collections.Counter(), collections.Counter(), set()
    for i, text in docs:
        z, words = pm.tokens(text)
        zs.add(z)
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2:
            continue
        trained.update(words)
        ends[z] += 1
        for w in words:
            for context, symbol in pm.positions(w):
                counts[z, context][symbol] += 1
                for k in range(len(context) + 1):
                    counts[-1, context[k:]][symbol] += 1

    def code(z, context, symbol):
        total, out = 0.0, set()
        for key in [(z, context)] + [(-1, context[k:]) for k in range(len(context) + 1)]:
            left = {s: c for s, c in counts.get(key, {}).items() if s not in out}
            out |= set(left)
            if symbol in left:
                return total + math.log10((2 * left[symbol] - 1) / (2 * sum(left.values())))
            if left:
                total += math.log10(len(left) / (2 * sum(left.values())))
        return total - math.log10(257 - len(counts.get((-1, b""), {})))

    n, v = sum(trained.values()), len(trained)
    result = []
    for i, text in docs:
        z, words = pm.tokens(text)
        score = math.log10((ends[z] + 1) / (sum(ends.values()) + len(zs) + 1))
        score += sum(code(z, c, s) for w in words for c, s in pm.positions(w))
        base = sum(math.log10((trained[w] + 1) / (n + v + 1)) for w in words)
        result.append((i, len(words), sum(trained[w] > 0 for w in words), n, base, score))
    return result


def close(a, b):
    return all(x == y if not isinstance(y, float) else math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True))


def test_scores_are_those_of_the_plain_model(make):
    texts = ["The cat sat on the mat", "the dog sat", None, "", "été à été", "zebra quux", "The cat sat on the mat"] * 5
    texts += ["word " * 3000, "unseen\tthings\x0bhere 文字 文字"]
    ids = [*range(len(texts) - 1), None]
    docs = make(texts, ids)
    got = pm.scores(docs, chunk_bytes=2000, bucket_words=5).collect()
    want = brute(list(zip(ids, texts, strict=True)))
    key = lambda r: repr(r[0])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    assert len(got) == len(texts)
    assert all(close(a, b) for a, b in zip(got, sorted(want, key=key), strict=True))
    assert {r.doc_id for r in pm.scores(docs).filter("held_out").select("doc_id").collect()} == {
        i for i in ids if i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    }


def test_probabilities_of_all_symbols_sum_to_one():
    seen = {7: {(b" ab", 98): 3, (b" ab", 99): 1}, 9: {(b" ab", 98): 2, (b"xab", 100): 4}}
    key = lambda c, s: pm.packed(c) << 8 | s
    packed = {z: pm._summed(np.array([key(*k) for k in held]), np.array(list(held.values()))) for z, held in seen.items()}
    every = pm._summed(*map(np.concatenate, zip(*packed.values(), strict=True)))
    levels = pm.all_levels(*every, *pm._summed(pm._cut(every[0], 2), every[1]), order=5)
    got = pm.log_probabilities(np.array([key(b" ab", i) for i in range(256)]), *packed[7], levels)
    # 257 symbols share the mass; the one that no byte stands for is one of the unseen.
    assert math.isclose(sum(10**p for p in got) + 10 ** min(got), 1.0, rel_tol=1e-9)


def test_scores_do_not_depend_on_how_the_work_is_cut(make, monkeypatch):
    texts = ["The cat sat on the mat", "the dog sat", None, "été à été", "same same"] * 40 + ["long " * 20_000]
    docs = make(texts, [*range(len(texts) - 41), *[3] * 41])
    told = lambda df: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())
    whole = told(pm.scores(docs))
    monkeypatch.setattr(pm, "MOST_BINS", 3)
    assert told(pm.scores(docs.repartition(5), chunk_bytes=3000, bin_bytes=9000)) == whole


def test_nothing_to_learn_from(make):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = pm.scores(make(["ab", None], held)).collect()
    assert {r.train_tokens for r in rows} == {0}
    assert all(r.score < 0 and r.n_known == 0 for r in rows)
    assert pm.scores(make([])).collect() == []


def test_contexts_reach_across_blanks(spark, make):
    words = [b"ab", b"cd", b"e"]
    whole = b" ab cd e \xff"
    z, seen = pm.tokens(" AB\tcd  e")
    assert (z, seen) == (0, [*words, pm.END])
    assert [x for w in seen for x in pm.positions(w)] == [
        (whole[max(0, i - 5) : i], whole[i : i + 1]) for i in range(1, len(whole))
    ]
    learnt = [i for i in range(90) if zlib.crc32(str(i).encode()) % 7 != 2][:30]
    held = [i for i in range(90, 300) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    texts = ["the cat sat on a mat", "my dog ran to an old inn"] * 15
    docs = make(texts + ["the cat sat on a mat", "mat a on sat cat the"], learnt + held)
    score = {r.doc_id: r.score for r in pm.scores(docs).collect()}
    assert score[held[0]] > score[held[1]] + 1


def test_keys_are_the_positions_of_each_text_for_any_step():
    texts = [None, "", "A b\tcc", "é " * 9, "abcdefghij", "x"]
    words = [pm.words_of(t)[1] for t in texts]
    for order in (0, 1, 3, 6):
        want = [
            (pm.packed(c) * 256 + s[0], i)
            for i, t in enumerate(texts) for w in pm.tokens(t)[1]
            for c, s in pm.positions(w, order)
        ]
        for step in (1, 2, 5, 1_000):
            got = [
                (int(k), int(i)) for keys, at in pm._keys(words, order, step)
                for k, i in zip(keys, at, strict=True)
            ]
            assert got == want


def test_a_chunk_is_not_held_as_objects_of_its_words(tmp_path):
    text = pa.array([" ".join(f"{chr(97 + i % 26)}{i * j % 997:x}" for j in range(400)) for i in range(2_000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_000)), text, pa.array([False, True] * 1_000)], ["doc_id", "text", "held_out"])
    write = pm._write_chunks(tmp_path.as_uri(), 2, 10_000, 1, 1 << 30)
    tracemalloc.start()
    try:
        (chunk,) = write(iter([batch]))
        assert tracemalloc.get_traced_memory()[1] < 17 * text.nbytes
    finally:
        tracemalloc.stop()
    rows = chunk.to_pandas().set_index("z").loc[pm.WORDS]
    got = dict(zip(pm._unpack_words(rows["keys"]), pm._loosen(rows["counts"], np.uint32).tolist(), strict=True))
    want = collections.Counter(w for t in text.to_pylist()[::2] for w in [*t.encode().split(), pm.END])
    assert {w: n for w, n in got.items() if n} == want
    assert got.keys() == {w for t in text.to_pylist() for w in [*t.encode().split(), pm.END]}


def test_words_are_told_for_any_step():
    texts = [pm._whole(pm.words_of(t)[1]) for t in [None, "", "A b\tcc b", "é " * 9, "a", "cc", None]]
    want = [t.split(b" ")[1:] for t in texts]
    for step in (1, 5, 20, 1_000):
        words, place, first = pm._told_words(texts, step)
        got = [[words[i] for i in part] for part in np.split(place, first[1:])]
        assert got == want and len(set(words)) == len(words)


def test_bins_are_told_in_one_pass():
    place = np.array([3, 4095, 0, 3, 0, 3])
    assert {b: at.tolist() for b, at in pm._by_bin(place).items()} == {0: [2, 4], 3: [0, 3, 5], 4095: [1]}
    assert pm._by_bin(place[:0]) == {}
    words = [b"b", b"\xff", b"a", b"c"]
    binned = pm._word_bins(words, 2)
    assert {b: [words[i] for i in at] for b, at in binned.items()} == {
        b: some for b in (0, 1) if (some := [w for w in sorted(words) if zlib.crc32(w) % 2 == b])
    }
