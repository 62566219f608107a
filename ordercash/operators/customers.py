"""Customer lists, lookups and balances.

A lookup takes one key, or a DataFrame of keys for many at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercash.model import Tables
from ordercash.plans import having_some, left_join_many, left_join_one, newest_first, page, pick


def list_customers(
    t: Tables, blocked: bool | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    customers = t["customers"]
    if blocked is not None:
        customers = customers.filter(F.col("is_blocked") == int(blocked))
    return page(customers, [F.col("customer_id").asc_nulls_last()], limit, offset)


def get_customer(t: Tables, customer_id: str | DataFrame) -> DataFrame:
    """The customer with this key; no row when there is none."""
    return pick(t["customers"], "customer_id", customer_id)


def customer_orders(t: Tables, customer_id: str | DataFrame) -> DataFrame:
    """Orders of a customer, newest first, with one row per delivery and one per invoice; an order
    with neither keeps one row."""
    orders = pick(t["orders"], "customer_id", customer_id)
    deliveries = t["deliveries"].select("order_id", "delivery_id", "goods_status", "ship_date")
    invoices = t["invoices"].select(
        "order_id", "invoice_id", F.col("total_amount").alias("invoice_amount"), "is_cancelled"
    )
    documents = deliveries.unionByName(invoices, allowMissingColumns=True)
    documents = having_some(documents, orders, "order_id")
    return left_join_many(orders, documents, "order_id").orderBy(
        "customer_id", *newest_first("order_date", "order_id", "delivery_id", "invoice_id")
    )


def _totals(t: Tables, wanted: str | DataFrame | None) -> DataFrame:
    """Per customer, in one grouping: orders, live invoices and payments, counts and sums."""
    facts = (
        t["orders"].select("customer_id", F.lit(1).alias("n_orders")),
        t["invoices"].filter(F.col("is_cancelled") == 0).select(
            "customer_id",
            F.lit(1).alias("n_invoices"),
            F.col("total_amount").cast("decimal(28,4)").alias("invoiced"),
        ),
        t["payments"].select(
            "customer_id",
            F.lit(1).alias("n_payments"),
            F.when(F.col("is_incoming") == 1, F.col("amount"))
            .cast("decimal(28,4)")
            .alias("paid"),
        ),
    )
    if wanted is not None:
        facts = tuple(pick(f, "customer_id", wanted) for f in facts)
    orders, invoices, payments = facts
    both = orders.unionByName(invoices, allowMissingColumns=True)
    every = both.unionByName(payments, allowMissingColumns=True)
    return every.groupBy("customer_id").agg(
        *[
            F.sum(c).alias(c)
            for c in ("n_orders", "n_invoices", "n_payments", "invoiced", "paid")
        ]
    )


def _with_totals(t: Tables, wanted: str | DataFrame | None) -> DataFrame:
    """Customers with their totals; keys cut every table ahead of the grouping."""
    customers = t["customers"].select("customer_id", "name", "is_blocked")
    if wanted is not None:
        customers = pick(customers, "customer_id", wanted)
    totals = _totals(t, wanted)
    joined = left_join_one(customers, totals, "customer_id")
    zero = F.lit(0)
    return joined.select(
        "customer_id",
        "name",
        "is_blocked",
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("n_orders", "n_invoices", "n_payments", "invoiced", "paid")
        ],
    )


def _times(amount: str, *counts: str):
    """An amount repeated once per matching row of the other tables (once when none match)."""
    value = F.col(amount)
    for c in counts:
        value = value * F.greatest(F.col(c), F.lit(1)).cast("decimal(18,0)")
    return value.cast("decimal(38,4)")


def _summary(t: Tables, wanted: str | DataFrame | None = None) -> DataFrame:
    """Totals as a join of orders, invoices and payments on the customer alone gives them.

    Such a join pairs every invoice with every order and payment of its customer, so each
    sum is multiplied by the row counts of the other two tables. The product is computed
    from per-customer totals; the pairs are never formed.
    """
    return _with_totals(t, wanted).select(
        "customer_id",
        "name",
        "is_blocked",
        F.col("n_orders").alias("total_orders"),
        _times("invoiced", "n_orders", "n_payments").alias("total_invoiced"),
        _times("paid", "n_orders", "n_invoices").alias("total_paid"),
    )


def customer_summary(t: Tables, customer_id: str | DataFrame) -> DataFrame:
    return _summary(t, customer_id)


def _by_outstanding(df: DataFrame) -> DataFrame:
    owed = (F.col("total_invoiced") - F.col("total_paid")).cast("decimal(38,4)")
    return df.withColumn("outstanding", owed).orderBy(*newest_first("outstanding", "customer_id"))


def customer_summary_all(t: Tables) -> DataFrame:
    """Every customer's totals, repeated sums included, by outstanding amount."""
    return _by_outstanding(_summary(t))


def customer_summary_net(t: Tables) -> DataFrame:
    """As ``customer_summary_all`` with every invoice and payment counted once."""
    return _by_outstanding(
        _with_totals(t, None).select(
            "customer_id",
            "name",
            "is_blocked",
            F.col("n_orders").alias("total_orders"),
            F.col("invoiced").cast("decimal(38,4)").alias("total_invoiced"),
            F.col("paid").cast("decimal(38,4)").alias("total_paid"),
        )
    )
