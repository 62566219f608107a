"""What the physical plans must and must not hold, with broadcasts by size switched off."""

import re

import pytest

from registry import QUERIES
from ordercash.operators import analytics, customers, orders, products
from ordercash.session import scratch_dir
from ordercash.sources.sample import Sample
from ordercash.sources.tables import load_o2c
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def no_size_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def stored(spark):
    """The star tables as parquet with text keys, as a user would have them."""
    root = scratch_dir(spark, "stored")
    for name, df in Sample(spark, SMALL).star().items():
        df.write.parquet(f"{root}/{name}")
    return load_o2c(spark, root)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_is_distributed(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert not re.search(r"Python|PandasGroup|MapInPandas", text)
    if name != "adhoc_theta_join":  # five fixed bands
        assert "BroadcastNestedLoopJoin" not in text
    for window in re.findall(r"windowspecdefinition\(([^)]*)", text):
        assert not window.startswith("specifiedwindowframe"), "window over the whole table"
        assert re.match(r"(customer_id|product_type)#", window)


@pytest.mark.parametrize("build, key", [
    (lambda t: orders.get_order(t, "5"), "order_id,5"),
    (lambda t: customers.get_customer(t, "5"), "customer_id,5"),
    (lambda t: products.get_product(t, "5"), "product_id,5"),
    (lambda t: products.list_products(t, "SMALL"), "product_type,SMALL"),
    (lambda t: orders.order_flow(t, "5"), "order_id,5"),
    (lambda t: orders.order_items(t, "5"), "order_id,5"),
    (lambda t: customers.customer_summary(t, "5"), "customer_id,5"),
])
def test_keys_reach_the_scan(stored, build, key):
    assert f"EqualTo({key})" in plan(build(stored))


def test_scans_read_only_the_columns_needed(stored):
    text = plan(products.billed_products(stored))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert "order_id:string,product_id:string,quantity:decimal(18,2),net_amount:decimal(20,4)" \
        in schemas
    assert all("plant" not in s and "currency" not in s for s in schemas)


def test_missing_rows_are_found_by_anti_join(stored):
    for df in (orders.undelivered(stored), orders.unbilled(stored), orders.unpaid(stored),
               analytics.revenue_leakage(stored)):
        assert "LeftAnti" in plan(df)


def test_pages_are_cut_without_a_full_sort(stored):
    for df in (orders.list_orders(stored), customers.list_customers(stored),
               products.top_products(stored)):
        assert "TakeOrderedAndProject" in plan(df)


def test_page_of_orders_never_shuffles_customers_or_orders(stored):
    text = plan(orders.list_orders(stored))
    assert "hashpartitioning(customer_id" not in re.sub(
        r"HashAggregate\(keys=\[customer_id.*?\n.*hashpartitioning\(customer_id.*?\n", "", text
    )


def test_top_few_per_key_are_cut_before_the_shuffle(spark):
    text = plan(QUERIES["adhoc_row_number"](spark, SMALL))
    assert re.search(r"Exchange hashpartitioning\(customer_id.*\n.*WindowGroupLimit.*Partial", text)


def test_lines_are_summed_without_a_shuffle_of_their_own(stored):
    text = plan(products.billed_products(stored))
    # live invoices are counted by order and their counts shuffled, lines are shuffled once,
    # and all that follows is per-product partial sums
    assert text.count("hashpartitioning(order_id") == 3
    assert text.count("hashpartitioning(order_id#") == 3
    assert "hashpartitioning(product_id#" in text
    assert not re.search(r"hashpartitioning\(product_id#\w+, order_id", text)


def test_lines_of_many_orders_are_found_once(stored):
    text = plan(orders.order_items(stored, stored["orders"].filter("order_type = '1-URGENT'")))
    assert text.count("LeftSemi") == 1


def test_partitions_are_small_enough_to_sort(spark):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
