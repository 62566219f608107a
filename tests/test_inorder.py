"""Order, spans and nulls: against plain Python, with one key that owns most rows, over many ranges."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from ordercash.model import SAP_RELATIONSHIPS, STAR_RELATIONSHIPS
from ordercash.operators import inorder
from ordercash.plans.ordered import RANGE, carried, chunked, deep_page, numbered, ranges, running, with_running
from registry import QUERIES
from registry.inorder import SAP_COLUMNS, STAR_COLUMNS
from tests.conftest import SMALL, rows

DAY = datetime.date(2020, 1, 1)


def table(n=3000, seed=1):
    """(id, key, day, amount): half of the rows have one key, some keys, days and amounts are null."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 2 else rng.choice(["a", "b", "c", None])
        day = None if rng.random() < 0.05 else DAY + datetime.timedelta(rng.randrange(40))
        out.append((i, key, day, None if rng.random() < 0.1 else rng.randrange(1000)))
    return out


SCHEMA = "id long, key string, day date, amount long"
late = lambda d: (d is None, d or DAY)  # noqa: E731  nulls last


@pytest.fixture(scope="module")
def data(spark):
    held = table()
    return held, spark.createDataFrame(held, SCHEMA).repartition(7)


@pytest.mark.parametrize("n", [1, 6])
def test_running_values_include_peers(data, n):
    held, df = data
    values = running(df, "amount", "day", ["key"], n)
    got = with_running(df, values, "day", ["key"], {
        c: F.col(c) for c in ("rows_so_far", "sum_so_far", "least_so_far", "most_so_far", "values_so_far")
    })
    want = []
    for i, key, day, amount in held:
        upto = [r for r in held if r[1] == key and late(r[2]) <= late(day)]
        known = [r[3] for r in upto if r[3] is not None]
        want.append((i, key, day, amount, len(upto), sum(known) if known else None, min(known, default=None), max(known, default=None), len(known)))
    assert rows(got) == sorted(want, key=repr)


def test_running_over_all_rows_gives_ranks(data):
    held, df = data
    values = running(df.filter("amount IS NOT NULL"), "amount", "amount", (), 5)
    got = {r.amount: (r.rows_so_far - r.peers + 1, r.distinct_so_far) for r in values.collect()}
    amounts = sorted(r[3] for r in held if r[3] is not None)
    places = {a: amounts.index(a) + 1 for a in amounts}
    dense = {a: k for k, a in enumerate(sorted(set(amounts)), 1)}
    assert got == {a: (places[a], dense[a]) for a in dense}


def test_numbers_are_gapless_in_each_key(data):
    held, df = data
    got = {r.id: r.place for r in numbered(df, [F.col("day").asc_nulls_last(), F.col("id")], ["key"], 6).collect()}
    want = {}
    for key in {r[1] for r in held}:
        order = sorted((r for r in held if r[1] == key), key=lambda r: (late(r[2]), r[0]))
        want |= {r[0]: i for i, r in enumerate(order)}
    assert got == want


@pytest.mark.parametrize("offset", [0, 17, 1490, 2980, 5000])
def test_deep_pages_are_those_of_a_sort(data, offset):
    held, df = data
    order = [F.col("amount").desc_nulls_first(), F.col("id").asc()]
    got = [r.id for r in deep_page(df, order, 25, offset, 8).collect()]
    want = sorted(held, key=lambda r: (r[3] is not None, -(r[3] or 0), r[0]))[offset : offset + 25]
    assert got == [r[0] for r in want]


def test_a_page_at_a_million_reads_only_its_ranges(spark):
    df = spark.range(1_200_000).select(((F.col("id") * 7919) % 1_200_007).alias("v"))
    page = deep_page(df, [F.col("v").asc()], 10, 1_000_000, 40)
    assert [r.v for r in page.collect()] == sorted(i * 7919 % 1_200_007 for i in range(1_200_000))[1_000_000:1_000_010]
    held = re.search(r"PartitionFilters: \[(.*?)\]", page._jdf.queryExecution().toString()).group(1)
    assert RANGE in held and len(set(re.findall(r"\b\d+\b", held.split("#")[-1])[1:])) <= 3


def test_last_values_are_carried_across_ranges(data):
    held, df = data
    got = {r.id: r.carried for r in carried(df, ["day", "id"], ["key"], F.col("amount"), 9).collect()}
    first = lambda r: (r[2] is not None, r[2] or DAY, r[0])
    want = {}
    for key in {r[1] for r in held}:
        last = None
        for r in sorted((r for r in held if r[1] == key), key=first):
            last = last if r[3] is None else r[3]
            want[r[0]] = last
    assert got == want


def test_lists_keep_repeats_and_nulls_in_order(data):
    held, df = data
    got = chunked(df, [F.col("id").asc()], ["key"], "amount", 100, 4).collect()
    assert max(len(r["items"]) for r in got) == 100
    for key in {r[1] for r in held}:
        whole = [x for r in sorted((r for r in got if r.key == key), key=lambda r: r.chunk) for x in r["items"]]
        assert whole == [r[3] for r in held if r[1] == key]


def test_a_hot_key_lies_in_many_ranges(data):
    _, df = data
    held = ranges(df, [F.col("key"), F.col("day"), F.col("id")], 8).filter("key = 'hot'")
    assert held.select(RANGE).distinct().count() >= 3


def test_pairs_within_a_span(data, spark):
    held, df = data
    left = df.filter("id % 9 = 0").select("key", F.col("id").alias("x"), F.col("day").alias("start"))
    right = df.filter("id % 7 = 0").select("key", F.col("id").alias("y"), "day")
    pairs = inorder.within_days(left, right, "key", "start", "day", 5)
    want = [
        (a[0], b[0]) for a in held if a[0] % 9 == 0 and a[1] and a[2]
        for b in held if b[0] % 7 == 0 and b[1] == a[1] and b[2] and 0 <= (b[2] - a[2]).days <= 5
    ]
    assert rows(pairs, "x", "y") == sorted(want, key=repr)
    assert rows(inorder.within_days(left, right, "key", "start", "day", 0), "x", "y") == sorted(
        [w for w in want if held[w[0]][2] == held[w[1]][2]], key=repr
    )
    text = QUERIES["adhoc_interval_join"](spark, SMALL)._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_not_in_is_null_aware(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    listed = lambda *v: spark.createDataFrame([(i,) for i in v], "y string")
    ask = lambda *v: rows(inorder.not_in(df, "x", listed(*v), "y"))
    assert ask("a") == [("b",)]
    assert ask("a", None) == [] and ask(None) == []
    assert ask() == sorted([("a",), ("b",), (None,)], key=repr)
    assert "NestedLoop" not in inorder.not_in(df, "x", listed("a"), "y")._jdf.queryExecution().toString()


def test_full_join_of_raw_rows(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, l int")
    right = spark.createDataFrame([("a", 5), ("a", 6), ("c", 7), (None, 8)], "k string, r int")
    assert rows(inorder.full_join_many(left, right, "k"), "k", "l", "r") == rows(left.join(right, "k", "full"), "k", "l", "r")


def test_inclusions_find_the_declared_links(spark):
    for name, declared, columns in (("inclusions", STAR_RELATIONSHIPS, STAR_COLUMNS), ("inclusions_documents", SAP_RELATIONSHIPS, SAP_COLUMNS)):
        check = QUERIES["relationship_check" if name == "inclusions" else "relationship_check_documents"](spark, SMALL)
        whole = {(r.child, r.parent) for r in check.collect() if r.orphans == 0 and r.child_rows}
        found = {(r.dependent, r.referenced) for r in QUERIES[name](spark, SMALL).collect()}
        names = {f"{t}.{c}" for t, c in columns}
        assert {p for p in whole if set(p) <= names} <= found
        assert len(declared) == 6


def test_inclusions_of_columns_that_share_no_values_by_chance(spark):
    t = {
        "parent": spark.createDataFrame([("p1", "x"), ("p2", "x"), ("p3", None)], "id string, word string"),
        "child": spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c3", None)], "id string, parent string"),
        "other": spark.createDataFrame([("p1", None), ("q", None)], "some string, nothing string"),
    }
    got = rows(inorder.inclusions(t))
    assert got == [("child.parent", "other.some", 1, True), ("child.parent", "parent.id", 1, True)]


def test_inclusions_of_more_columns_than_a_number_has_bits(spark):
    n = 2 * inorder.WORD + 3
    wide = spark.createDataFrame(
        [tuple(f"v{i}" for i in range(n)), tuple(f"v{i}" for i in range(n))], ", ".join(f"c{i} string" for i in range(n))
    )
    few = spark.createDataFrame([("v0", f"v{n - 1}"), ("x", f"v{n - 1}")], "a string, b string")
    got = inorder.inclusions({"wide": wide, "few": few})
    assert rows(got) == sorted([
        ("few.b", f"wide.c{n - 1}", 1, False), ("wide.c0", "few.a", 1, True), (f"wide.c{n - 1}", "few.b", 1, False),
    ], key=repr)


def test_inclusions_sort_no_values(spark):
    tables = {"one": spark.createDataFrame([("a",)], "x string"), "two": spark.createDataFrame([("a",)], "y string")}
    plan = inorder.inclusions(tables)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
