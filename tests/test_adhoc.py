from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ordercash.operators import adhoc
from tests.conftest import day, rows


def _sales(spark, *sold):
    """One live invoiced order with a line per (product, type, amount)."""
    items = [("o1", p, Decimal(1), a if a is None else Decimal(a)) for p, _, a in sold]
    return {
        "order_items": spark.createDataFrame(
            items, "order_id string, product_id string, quantity decimal(18,2), "
            "net_amount decimal(20,4)",
        ),
        "invoices": spark.createDataFrame([("o1", 0)], "order_id string, is_cancelled int"),
        "products": spark.createDataFrame(
            [(p, p, k, p) for p, k, _ in sold],
            "product_id string, product_name string, product_type string, old_sku string",
        ),
    }


@pytest.mark.parametrize("best, want", [
    (1, [("X", "a", 1), ("X", "b", 1), ("Y", "e", 1)]),
    (2, [("X", "a", 1), ("X", "b", 1), ("Y", "e", 1), ("Y", "f", 2)]),
    (3, [("X", "a", 1), ("X", "b", 1), ("X", "c", 3), ("X", "d", 3), ("Y", "e", 1),
         ("Y", "f", 2)]),
])
def test_rank_includes_ties_and_skips_places_after_them(spark, best, want):
    t = _sales(spark, ("a", "X", 9), ("b", "X", 9), ("c", "X", 5), ("d", "X", 5), ("g", "X", 1),
               ("e", "Y", None), ("f", "Y", 2))
    assert rows(adhoc.rank(t, best), "product_type", "product_id", "place") == want


def _orders(spark):
    return {"orders": spark.createDataFrame(
        [("1", "c", day("2024-01-01"), 5), ("2", "c", day("2024-01-01"), 7),
         ("3", "c", day("2024-02-01"), 1), ("4", "d", None, 2), ("5", "c", None, 4)],
        "order_id string, customer_id string, order_date date, total_amount int",
    )}


def test_ledger_counts_orders_of_one_day_together(spark):
    got = rows(adhoc.window_agg(_orders(spark)), "customer_id", "order_date", "orders_so_far",
               "amount_so_far", "least_so_far", "most_so_far", "amount_in_all")
    assert got == sorted([
        ("c", day("2024-01-01"), 2, 12, 5, 7, 17), ("c", day("2024-02-01"), 3, 13, 1, 7, 17),
        ("c", None, 4, 17, 1, 7, 17), ("d", None, 1, 2, 2, 2, 2),
    ], key=repr)


def test_latest_orders_put_undated_ones_first(spark):
    got = rows(adhoc.row_number(_orders(spark), latest=2), "customer_id", "order_id", "n")
    assert got == [("c", "3", 2), ("c", "5", 1), ("d", "4", 1)]


def test_bands_cover_every_age_once(spark):
    ages = [-5, 0, 1, 30, 31, 90, 91, 365, 366, 5000]
    invoices = spark.createDataFrame([(a,) for a in ages], "age int").select(
        F.date_sub(F.lit(day("2024-06-30")), F.col("age")).alias("invoice_date"),
        F.lit(1).cast("decimal(30,4)").alias("total_amount"), F.lit(0).alias("is_cancelled"),
    )
    got = rows(adhoc.theta_join({"invoices": invoices}, day("2024-06-30")), "band", "n_invoices")
    assert got == sorted([("current", 2), ("1-30", 2), ("31-90", 2), ("91-365", 2),
                          ("over 365", 2)])


def test_every_type_and_code_has_a_cell(spark):
    orders = spark.createDataFrame(
        [("t1", "A"), ("t1", "A"), ("t2", None)], "order_type string, delivery_status string"
    )
    got = rows(adhoc.cross_join({"orders": orders}))
    assert got == [("t1", "A", 2), ("t1", "B", 0), ("t1", "C", 0), ("t2", "A", 0), ("t2", "B", 0),
                   ("t2", "C", 0), ("t2", None, 1)]


def test_no_status_code_is_lost(spark):
    orders = spark.createDataFrame(
        [("c", "t", "A"), ("c", "t", "D"), ("c", "t", None), ("c", "t", "A"), ("x", "u", None)],
        "customer_id string, order_type string, delivery_status string",
    )
    t = {"orders": orders}
    assert rows(adhoc.array_agg(t)) == [("c", ["A", "D", None]), ("x", [None])]
    assert rows(adhoc.unnest(t)) == [("c", "A"), ("c", "D"), ("c", None), ("x", None)]
    assert rows(adhoc.json_agg(t)) == [
        ("t", '[{"status":"A","orders":2},{"status":"D","orders":1},{"status":null,"orders":1}]'),
        ("u", '[{"status":null,"orders":1}]'),
    ]
    assert ("t", "D", 1) in rows(adhoc.cross_join(t))


def test_rounding_goes_away_from_zero(spark):
    items = spark.createDataFrame(
        [("o", "1", Decimal("2.5"), Decimal("2.5000")), ("o", "2", Decimal("1"), Decimal("-2.5"))],
        "order_id string, line_no string, quantity decimal(18,2), net_amount decimal(20,4)",
    )
    got = rows(adhoc.cast({"order_items": items}), "line", "quantity_text", "net_whole")
    assert got == [(1, "2.50", 3), (2, "1.00", -3)]


def test_concat_leaves_out_null(spark):
    customers = spark.createDataFrame(
        [("1", "Ann", "BUILDING"), ("2", "Bo", None), ("3", "Cy", "AUTO")],
        "customer_id string, name string, grouping string",
    )
    got = rows(adhoc.strings({"customers": customers}), "label")
    assert got == [("Ann/",), ("Bo/",), ("Cy/AUTO",)]
