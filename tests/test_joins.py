import pytest
from pyspark.sql import functions as F

from ordercash.plans import (
    having_no,
    having_some,
    join_totals,
    left_join_many,
    page_after,
)
from tests.conftest import rows

MANY = [("a", i) for i in range(100)] + [("b", 1), ("b", 2), (None, 7), ("x", 9)]
LEFT = [("a", "l1"), ("a", "l2"), ("b", "l3"), ("c", "l4"), (None, "l5")]


def _tables(spark):
    left = spark.createDataFrame(LEFT, "k string, l string")
    many = spark.createDataFrame(MANY, "k string, m int")
    return left, many


def test_left_join_many_is_a_left_join(spark):
    left, many = _tables(spark)
    assert rows(left_join_many(left, many, "k")) == rows(left.join(many, "k", "left"))
    for none in (left.limit(0), many.limit(0)):
        pair = (none, many) if "l" in none.columns else (left, none)
        assert rows(left_join_many(*pair, "k")) == rows(pair[0].join(pair[1], "k", "left"))


def test_left_join_many_has_no_single_task_and_no_limit(spark):
    left, many = _tables(spark)
    plan = left_join_many(left, many, "k")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan


def test_page_after_walks_through_all_rows(spark):
    table = spark.createDataFrame([(i % 3, i) for i in range(20)], "g int, i int")
    seen, last = [], {"g": -1, "i": -1}
    while page := [tuple(r) for r in page_after(table, last, 6).collect()]:
        seen += page
        last = dict(zip(("g", "i"), page[-1], strict=True))
    assert seen == sorted((i % 3, i) for i in range(20))
    back = page_after(table, {"g": 1, "i": 7}, 3, descending=True)
    assert [tuple(r) for r in back.collect()] == [(1, 4), (1, 1), (0, 18)]


def test_semi_and_anti_keep_duplicates_and_treat_null_as_unmatched(spark):
    left, many = _tables(spark)
    assert rows(having_some(left, many, "k"), "l") == [("l1",), ("l2",), ("l3",)]
    assert rows(having_no(left, many, "k"), "l") == [("l4",), ("l5",)]


def small_partitions(spark):
    before = {key: spark.conf.get(key) for key in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "64",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "65536",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "65536",
}


@pytest.fixture
def small_partitions(spark):
    before = {key: spark.conf.get(key) for key in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def _skewed(spark):
    """A third of 300,000 rows on key 0, from several input partitions."""
    return spark.range(0, 300_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5_000).alias("k"), "id"
    )


def _totals(spark):
    return spark.range(0, 20_000, 1, 8).groupBy((F.col("id") % 4_000).alias("k")).agg(
        F.count("*").alias("n")
    )


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("join", [
    lambda df, totals: having_some(df, totals, "k"),
    lambda df, totals: having_no(df, totals.filter("k > 10"), "k"),
    lambda df, totals: join_totals(df, totals, "k"),
    lambda df, totals: join_totals(df, totals, "k", "inner"),
], ids=["semi", "anti", "left", "inner"])
def test_a_hot_key_is_split_in_joins_with_aggregates(spark, small_partitions, join):
    assert "skew=true" in _final_plan(join(_skewed(spark), _totals(spark)))


def test_a_plain_join_with_an_aggregate_is_not_split(spark, small_partitions):
    plain = _skewed(spark).join(_totals(spark), "k", "left")
    assert "skew=true" not in _final_plan(plain)


def test_joins_with_aggregates_keep_their_meaning(spark):
    left, many = _tables(spark)
    totals = many.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        assert rows(join_totals(left, totals, "k", how)) == rows(left.join(totals, "k", how))


def test_both_halves_of_a_left_join_read_one_shuffle_of_the_left_side(spark):
    left = spark.range(100).selectExpr("nullif(id % 50, 7) AS k", "id AS n")
    many = spark.range(200).selectExpr("nullif(id % 25, 3) AS k", "id AS m")
    expected = left.join(many, "k", "left").select("k", "n", "m")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left_join_many(left.repartition(3), many.repartition(3), "k").select("k", "n", "m")
        got = sorted(map(tuple, joined.collect()), key=repr)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == rows(expected)
    assert "ReusedExchange" in plan.split("Initial Plan")[0]
