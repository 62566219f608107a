"""Decontamination, license scans and quotations against plain Python."""

import random
import re

from ordercash.llm import decontamination as dc
from ordercash.llm import license_scan as ls
from ordercash.llm import quote_linking as ql


def brute(text, items):
    ws = dc.words(text)
    hit, names = set(), set()
    for name, t in items:
        iw = dc.words(t)
        n = min(13, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw else set()
        for i in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add("" if name is None else str(name))
    return len(ws), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(ws)


def case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("aab") + rng.choice("éx") * rng.randint(0, 1)
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 5, 13, 14, 20, 30])))) for i in range(25)]
    items += [(25, None), (None, "Null id, of few words"), (26, items[3][1]), (27, "-- ..")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 90))) for _ in range(40)]
    texts += [f"{t}. And {items[i][1].upper()}, so" for i, t in enumerate(texts[:20])]
    return items, [*texts, None, "", "a " * 5000]


def test_hits_are_those_of_every_window(make, spark):
    for seed in range(2):
        items, texts = case(seed)
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        want = {i: brute(t, items) for i, t in enumerate(texts)}
        for block_words in (10**6, 40):
            rows = dc.hits(make(texts), benchmark, block_words=block_words).collect()
            assert {r.record["doc_id"]: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows} == want


def test_items_in_blocks_and_of_equal_words(make, spark):
    items, texts = case(7)
    items += [(1000 + i, items[7][1]) for i in range(50)] + [("one", "word")] * 2
    benchmark = spark.createDataFrame([(None if i is None else str(i), t) for i, t in items], "item_id string, text string")
    size = sum(len(dc.words(t)) for _, t in items)
    folder, count = dc.blocks(benchmark, "item_id", "text", -(-size // 5))
    assert count == 5
    assert spark.read.parquet(folder).count() == sum(1 for _, t in items if dc.words(t))
    docs, want = make(texts), {i: brute(t, items) for i, t in enumerate(texts)}
    for block_words in (size, -(-size // 5)):
        rows = dc.hits(docs, benchmark, block_words=block_words).collect()
        assert {r.record["doc_id"]: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows} == want
    one, five = (
        sorted(tuple(r) for r in dc.decontaminated(docs.fillna(""), benchmark, block_words=w).drop("lang").collect())
        for w in (size, -(-size // 5))
    )
    assert one == five


def test_many_equal_short_items_share_an_entry():
    automaton = dc.Automaton([(str(i), [b"word"]) for i in range(10_000)] + [("long", [b"a", b"word"])])
    assert max(map(len, automaton.short)) == 2
    spans, items = automaton.match([b"x", b"word", b"x", b"a", b"word"])
    assert spans == [(1, 2), (3, 5)] and len(items) == 10_001


def test_spans_are_cut_out_of_contaminated_documents_alone(make, spark):
    item = " ".join(f"q{i}" for i in range(20))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = "nothing\nof the kind " * 30
    docs = make([clean + item + "!\nend", item, clean * 20 + item, None, clean])
    out = dc.decontaminated(docs, benchmark)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and set(got) == {0, 2, 3, 4}
    assert got[0].text == clean + "!\nend" and got[0].n_chars == len(got[0].text)
    assert got[2].text == clean * 20 + item and got[4].text == clean and got[3].text is None
    assert dc.decontaminated(make([]), benchmark).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminated(docs, none).count() == 5


def test_license_templates_are_found_where_they_stand(make):
    rng = random.Random(1)
    filler = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    texts, want = [], set()
    for i in range(120):
        name, notice = ls.TEMPLATES[i % len(ls.TEMPLATES)]
        words = notice.split()
        if i >= 60 and len(words) > 25:  # one changed word breaks five shingles of many
            words[len(words) - 2] = "changed"
        texts.append(f"{filler(rng.randint(0, 80))}\n{' '.join(words).upper()}\n{filler(rng.randint(0, 40))}")
        want.add((i, name))
    texts += [None, "", filler(5000), "Permission to use, copy, modify", filler(30)]
    got = {(r.doc_id, r.license) for r in ls.scanned(make(texts)).collect()}
    assert want <= got
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    five = lambda t: {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)}
    for i, name in got:
        template = five(dict(ls.TEMPLATES)[name])
        assert len(template & five(texts[i])) >= 0.8 * len(template)
    first = {r.doc_id: r.first_word for r in ls.scanned(make(["a b c Released under the MIT License."])).collect()}
    assert first == {0: 3}
    assert ls.scanned(make([])).collect() == [] and ls.scanned(make(texts), []).collect() == []


def licenses_by_hand(texts, templates):
    """{(id, license): (containment, first word)} of all texts against all templates, without windows."""

    def five(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
        return [tuple(words[k : k + 5]) for k in range(len(words) - 4)]

    known = [(name, set(five(text))) for name, text in templates if name is not None]
    found = {}
    for doc, text in texts:
        own = five(text)
        for name, template in known:  # one name may stand for several wordings
            t = len(template)
            for start in range(-2 * t, len(own), t) if t and template & set(own) else ():
                part = own[max(start, 0) : start + 3 * t]
                share = len(template & set(part)) / t
                if share >= 0.8:
                    first = max(start, 0) + min(i for i, x in enumerate(part) if x in template)
                    before = found.get((doc, name), (0, first))
                    found[doc, name] = max(before[0], share), min(before[1], first)
    return found


def licenses(df):
    return {(r.doc_id, r.license): (r.containment, r.first_word) for r in df.collect()}


def test_scan_of_all_documents_equals_every_template_against_every_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = licenses_by_hand([(r.doc_id, r.text) for r in docs.collect()], ls.TEMPLATES)
    assert want and licenses(ls.scanned(docs)) == want


def test_scan_of_edge_cases_equals_every_template_against_every_text(spark, make):
    rng = random.Random(5)
    filler = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    whole = dict(ls.TEMPLATES)["BSD-3-Clause-text"]
    line = "Released under the MIT License. "
    cut = " ".join(whole.split()[:60])  # too little of the whole text, all of the notice
    texts = [
        whole, f"{filler(3000)} {whole} {filler(3000)} {whole}", cut, line * 500, f"{filler(20000)} {line}",
        whole.replace("source", "other"), None, "", "five words are not here", f"{filler(7)} {line}", f"{line}{whole}",
    ]
    ids = [*range(9), None, None]
    known = [*ls.TEMPLATES, ("none", None), ("none", ""), ("short", "four words of it"), (None, line), ("same", line), ("same", cut)]
    table = spark.createDataFrame(known, "license string, text string").repartition(3)
    want = licenses_by_hand(zip(ids, texts, strict=True), known)
    assert {("BSD-3-Clause-text", 0), ("MIT", 4), ("same", None)} <= {(name, doc) for doc, name in want}
    assert (2, "BSD-3-Clause-text") not in want
    docs = make(texts, ids)
    assert licenses(ls.scanned(docs, table)) == want
    # Repeated rows change nothing, nor do columns named as the operator's own.
    clashing = docs.unionAll(docs).selectExpr("doc_id AS s", "text AS hash", "1 AS doc_id", "2 AS text", "3 AS one")
    assert licenses(ls.scanned(clashing, table, "s", "hash")) == want
    assert ls.scanned(docs, table.limit(0)).collect() == []


def test_templates_of_any_number_stand_in_no_plan(make):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    known = [(f"L{i}", " ".join(rng.choices(words, k=120))) for i in range(1500)]  # 180,000 words
    picked = rng.sample(known, 30)
    got = ls.scanned(make([text for _, text in picked]), known)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert set(licenses(got)) == {(i, name) for i, (name, _) in enumerate(picked)}


MAIL = [
    ("t", 1, "a", "Hello all.\nWho has the key?\n\nSecond part here"),
    ("t", 2, "b", "I have it.\n\n> Who has  the KEY?"),
    ("t", 3, "c", "> I have it.\n>> Who has the key?\nGreat.\n> Unknown words\nBye"),
    ("t", 4, "d", "No quote"),
    ("t", 5, "e", "> > Hello all.\nDeep only"),
    ("u", 1, "f", "> Who has the key?\nother scope"),
    ("u", 2, None, None),
    (None, 1, "g", "null scope"),
    (None, 2, "h", "> null scope\nanswer"),
]


def test_replies_find_their_originals(spark):
    mail = spark.createDataFrame([(*m, 0) for m in MAIL], "conv_id string, turn long, role string, text string, hash int")
    rows = {(r.conv_id, r.turn): (r.text, r.parent, r.start, r.depth) for r in ql.conversations(mail).collect()}
    assert rows == {
        ("t", 1): (MAIL[0][3], None, 1, 0),
        ("t", 2): ("I have it.\n", 1, 1, 1),
        ("t", 3): ("Great.\nBye", 2, 1, 2),
        ("t", 4): ("No quote", None, 4, 0),
        ("t", 5): ("Deep only", 1, 1, 1),
        ("u", 1): ("other scope", None, 1, 0),
        ("u", 2): ("", None, 2, 0),
        (None, 1): ("null scope", None, 1, 0),
        (None, 2): ("answer", 1, 1, 1),
    }
    assert ql.conversations(mail.limit(0)).collect() == []
    twice = ql.conversations(mail.unionAll(mail))
    assert twice.count() == 2 * len(MAIL)


def test_turns_as_mail_come_back_as_they_were(spark):
    turns = [("c", i, "user", f"line {i}\n\nmore {'word ' * (i % 3)}\nend") for i in range(40)]
    table = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")
    rows = ql.conversations(ql.as_mail(table)).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in rows) == turns
    assert {(r.turn, r.parent, r.start, r.depth) for r in rows} == {(i, i - 1 if i else None, 0, i) for i in range(40)}


def test_lines_of_very_many_marks_are_quotes_like_others(spark):
    table = spark.createDataFrame(
        [("c", 1, "user", "hello"), ("c", 2, "user", ">" * 1_000_000 + " hello\nyes"),
         ("c", 3, "user", "> " * 500_000 + "hello\nno"), ("c", 4, "user", "> \t" * 1000)],
        "conv_id string, turn long, who string, text string",
    )
    rows = {r.turn: r for r in ql.conversations(table, role="who").collect()}
    assert [(rows[t].text, rows[t].parent) for t in (1, 2, 3, 4)] == [("hello", None), ("yes", 1), ("no", 1), ("", None)]
    mail = ql.as_mail(table.filter("turn = 1"), role="who").collect()
    assert [(m.who, m.text) for m in mail] == [("user", "hello")]
