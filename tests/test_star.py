"""Small tables on which the fixed queries' finer points show."""

from decimal import Decimal

import pytest

from ordercash.model import STAR
from ordercash.operators import analytics, customers, orders, products
from tests.conftest import day, rows


def table(spark, name, *records):
    schema = STAR[name]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in records]
    return spark.createDataFrame(data, schema)


def d(x):
    return Decimal(str(x))


@pytest.fixture(scope="module")
def t(spark):
    return {
        "customers": table(
            spark, "customers",
            {"customer_id": "1", "name": "Ann", "is_blocked": 0},
            {"customer_id": "2", "name": "Bo", "is_blocked": 1},
            {"customer_id": "10", "name": "Cy", "is_blocked": 0},
        ),
        "orders": table(
            spark, "orders",
            {"order_id": "o1", "customer_id": "1", "order_date": day("2024-01-01"),
             "total_amount": d(10)},
            {"order_id": "o2", "customer_id": "1", "order_date": None, "total_amount": d(20)},
            {"order_id": "o3", "customer_id": "2", "order_date": day("2024-01-05"),
             "total_amount": d(30)},
            {"order_id": "o4", "customer_id": "9", "order_date": day("2024-01-05"),
             "total_amount": d(40)},
        ),
        "order_items": table(
            spark, "order_items",
            {"order_id": "o1", "line_no": "10", "product_id": "p1", "quantity": d(2),
             "net_amount": d(5)},
            {"order_id": "o1", "line_no": "9", "product_id": "p2", "quantity": d(1),
             "net_amount": d(7)},
            {"order_id": "o2", "line_no": "1", "product_id": "p1", "quantity": d(1),
             "net_amount": d(100)},
        ),
        "deliveries": table(
            spark, "deliveries",
            {"delivery_id": "d1", "order_id": "o1", "goods_status": "C",
             "ship_date": day("2024-01-11")},
            {"delivery_id": "d2", "order_id": "o3", "goods_status": "C",
             "ship_date": day("2024-01-04")},
            {"delivery_id": "d3", "order_id": "o4", "goods_status": "C", "ship_date": None},
            {"delivery_id": "d4", "order_id": "o2", "goods_status": "A", "ship_date": None},
        ),
        "invoices": table(
            spark, "invoices",
            {"invoice_id": "i1", "order_id": "o1", "customer_id": "1", "total_amount": d(12),
             "is_cancelled": 0, "invoice_date": day("2024-01-12")},
            {"invoice_id": "i2", "order_id": "o1", "customer_id": "1", "total_amount": d(3),
             "is_cancelled": 0, "invoice_date": day("2024-01-13")},
            {"invoice_id": "i3", "order_id": "o3", "customer_id": "2", "total_amount": d(30),
             "is_cancelled": 1, "invoice_date": day("2024-01-14")},
            {"invoice_id": "i4", "order_id": "o3", "customer_id": "2", "total_amount": d(31),
             "is_cancelled": 0, "invoice_date": day("2024-01-15")},
        ),
        "payments": table(
            spark, "payments",
            {"payment_id": "m1", "customer_id": "1", "amount": d(4), "is_incoming": 1},
            {"payment_id": "m2", "customer_id": "1", "amount": d(100), "is_incoming": 0},
            {"payment_id": "m3", "customer_id": "2", "amount": d(9), "is_incoming": 0},
        ),
        "products": table(
            spark, "products",
            {"product_id": "p1", "product_name": "Nut", "product_type": "X", "is_deleted": 1},
            {"product_id": "p2", "product_name": "Bolt", "product_type": "Y", "is_deleted": 0},
        ),
    }


def test_summary_repeats_amounts_per_joined_row(t):
    # Ann: 2 orders, 2 live invoices (15), 2 payments of which one of 4 came in.
    # Invoiced 15 x 2 orders x 2 payments; paid 4 x 2 orders x 2 invoices.
    got = {r.customer_id: r for r in customers.customer_summary_all(t).collect()}
    assert (got["1"].total_orders, got["1"].total_invoiced, got["1"].total_paid) == (2, 60, 16)
    assert got["1"].outstanding == 44
    assert (got["10"].total_orders, got["10"].outstanding) == (0, 0)
    assert rows(customers.customer_summary(t, "1"), "total_invoiced", "total_paid") == [
        (d("60.0000"), d("16.0000"))
    ]


def test_net_summary_counts_each_amount_once(t):
    got = {r.customer_id: r for r in customers.customer_summary_net(t).collect()}
    assert (got["1"].total_invoiced, got["1"].total_paid, got["1"].outstanding) == (15, 4, 11)
    assert [r.customer_id for r in customers.customer_summary_net(t).collect()] == ["2", "1", "10"]


def test_lists_follow_text_order_and_newest_first_with_nulls_ahead(t):
    assert [r.customer_id for r in customers.list_customers(t).collect()] == ["1", "10", "2"]
    assert [r.customer_id for r in customers.list_customers(t, blocked=False).collect()] == [
        "1", "10",
    ]
    assert [r.customer_id for r in customers.list_customers(t, limit=1, offset=1).collect()] == [
        "10"
    ]
    got = [(r.order_id, r.customer_name) for r in orders.list_orders(t).collect()]
    assert got == [("o2", "Ann"), ("o3", "Bo"), ("o4", None), ("o1", "Ann")]


def test_lookups_give_no_row_for_an_unknown_key(t):
    assert customers.get_customer(t, "404").count() == 0
    assert orders.get_order(t, "404").count() == 0
    assert orders.order_flow(t, "404").count() == 0
    assert products.get_product(t, "p1").count() == 1  # withdrawn, still found
    assert [r.product_id for r in products.list_products(t).collect()] == ["p2"]


def test_lookups_take_many_keys(spark, t):
    keys = spark.createDataFrame([("1",), ("10",), ("1",), ("404",)], "customer_id string")
    assert rows(customers.get_customer(t, keys), "customer_id") == [("1",), ("10",)]
    got = rows(customers.customer_summary(t, keys), "customer_id", "total_orders", "total_paid")
    assert got == [("1", 2, d("16.0000")), ("10", 0, d("0.0000"))]
    assert rows(customers.customer_orders(t, keys)) == rows(customers.customer_orders(t, "1"))
    orders_ = spark.createDataFrame([("o1",), ("o2",)], "order_id string")
    got = [(r.order_id, r.line_no) for r in orders.order_items(t, orders_).collect()]
    assert got == [("o1", "9"), ("o1", "10"), ("o2", "1")]
    assert rows(orders.get_order(t, orders_), "order_id") == [("o1",), ("o2",)]


def test_lines_sort_by_number_not_text(t):
    got = [(r.line_no, r.product_name) for r in orders.order_items(t, "o1").collect()]
    assert got == [("9", "Bolt"), ("10", "Nut")]


def test_top_products_count_a_line_per_live_invoice(t):
    got = rows(products.top_products(t), "product_id", "total_orders", "total_revenue")
    assert got == [("p1", 1, d("10.0000")), ("p2", 1, d("14.0000"))]
    assert products.top_products(t, limit=51).count() == 2


def test_stuck_orders(t):
    assert rows(orders.incomplete_orders(t, "delivery"), "order_id") == []
    assert rows(orders.incomplete_orders(t, "billing"), "order_id") == [("o4",)]
    assert rows(orders.incomplete_orders(t, "payment"), "invoice_id") == [("i4",)]
    with pytest.raises(ValueError):
        orders.incomplete_orders(t, "shipping")


def test_leakage_needs_a_known_customer(t):
    assert rows(analytics.revenue_leakage(t)) == []
    assert rows(analytics.overdue_ar(t), "invoice_id", "is_blocked") == [("i4", 1)]


def test_delivery_performance_allows_negative_days(t):
    got = analytics.delivery_performance(t).collect()[0]
    assert (got.shipped_orders, float(got.avg_days), got.min_days, got.max_days) == (2, 4.5, -1, 10)


def test_flow_of_one_order_is_its_part_of_the_bulk_flow(t):
    for order in ("o1", "o2", "o3", "o4"):
        every = orders.order_flow_all(t).filter(f"order_id = '{order}'")
        assert rows(orders.order_flow(t, order)) == rows(every)


def test_bulk_flow_has_one_row_per_document(t):
    got = rows(orders.order_flow_all(t), "order_id", "delivery_id", "invoice_id", "n_payments")
    assert got == sorted([
        ("o1", "d1", None, 1), ("o1", None, "i1", 1), ("o1", None, "i2", 1),
        ("o2", "d4", None, 1), ("o3", "d2", None, 0), ("o3", None, "i3", 0),
        ("o3", None, "i4", 0), ("o4", "d3", None, 0),
    ], key=repr)


def test_customer_orders_has_one_row_per_document(t):
    got = [(r.order_id, r.delivery_id, r.invoice_id)
           for r in customers.customer_orders(t, "1").collect()]
    assert got == [("o2", "d4", None), ("o1", "d1", None), ("o1", None, "i1"), ("o1", None, "i2")]


def test_stage_counts(t):
    got = analytics.stage_counts(t).collect()[0].asDict()
    assert got == {
        "total_customers": 3, "blocked_customers": 1, "total_orders": 4, "orders_delivered": 3,
        "orders_billed": 2, "total_invoices": 4, "cancelled_invoices": 1,
        "total_payments_received": 1, "total_products": 1,
    }


def test_relationship_check_counts_orphans(t):
    got = {(r.child, r.parent): (r.child_rows, r.null_keys, r.orphans)
           for r in analytics.relationship_check(t).collect()}
    assert got[("orders.customer_id", "customers.customer_id")] == (4, 0, 1)
    assert got[("order_items.product_id", "products.product_id")] == (3, 0, 0)
