"""Order lists, lookups, stuck orders and the trace of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercash.model import Tables
from ordercash.plans import (
    having_no,
    having_some,
    join_totals,
    left_join_many,
    left_join_one,
    newest_first,
    page,
    pick,
)

STAGES = ("delivery", "billing", "payment")
#: Rows of a page whose keys and names are surely small: some 10 MB.
SMALL_PAGE = 100_000


def _names(t: Tables, *extra: str) -> DataFrame:
    return t["customers"].select("customer_id", F.col("name").alias("customer_name"), *extra)


def list_orders(t: Tables, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of orders, newest first, with the customer's name.

    The page is cut first; customers are then probed with the page's keys, at most ``limit`` of them.
    Keys and names of a page up to ``SMALL_PAGE`` orders are broadcast, so that neither table is shuffled
    for the join; Spark chooses for larger ones.
    """
    newest = newest_first("order_date", "order_id")
    rows = page(t["orders"], newest, limit, offset)
    small = F.broadcast if limit <= SMALL_PAGE else (lambda df: df)
    keys = small(rows.select("customer_id").distinct())
    names = _names(t).join(keys, "customer_id", "left_semi")
    return (
        left_join_one(rows, small(names), "customer_id")
        .select(
            "order_id", "customer_id", "customer_name", "order_date", "total_amount",
            "currency", "delivery_status", "process_status",
        )
        .orderBy(*newest)
    )


def get_order(t: Tables, order_id: str | DataFrame) -> DataFrame:
    """The order with this key, or those with the keys of a DataFrame."""
    return pick(t["orders"], "order_id", order_id)


def shipped(t: Tables) -> DataFrame:
    """Deliveries whose goods have left."""
    return t["deliveries"].filter(F.col("goods_status") == "C")


def live_invoices(t: Tables) -> DataFrame:
    return t["invoices"].filter(F.col("is_cancelled") == 0)


def incoming_payments(t: Tables) -> DataFrame:
    return t["payments"].filter(F.col("is_incoming") == 1)


def undelivered(t: Tables) -> DataFrame:
    """Orders without any delivery, oldest first."""
    return (
        left_join_one(having_no(t["orders"], t["deliveries"], "order_id"), _names(t), "customer_id")
        .select("order_id", "customer_name", "order_date", "total_amount", "delivery_status")
        .orderBy(F.col("order_date").asc_nulls_last(), "order_id")
    )


def unbilled(t: Tables) -> DataFrame:
    """Shipped deliveries of orders without any invoice, void ones included."""
    deliveries = shipped(t).select("order_id", "delivery_id", "ship_date")
    return (
        t["orders"].select("order_id", "total_amount")
        .join(having_no(deliveries, t["invoices"], "order_id"), "order_id")
        .select("order_id", "total_amount", "delivery_id", "ship_date")
    )


def never_paid(t: Tables) -> DataFrame:
    """Live invoices of customers from whom no payment has ever come in, with the customer."""
    invoices = live_invoices(t).select("invoice_id", "customer_id", "invoice_date", "total_amount")
    return having_no(invoices, incoming_payments(t), "customer_id").join(
        _names(t, "is_blocked"), "customer_id"
    )


def unpaid(t: Tables) -> DataFrame:
    return (
        never_paid(t)
        .select("invoice_id", "customer_name", "invoice_date", "total_amount")
        .orderBy(F.col("invoice_date").asc_nulls_last(), "invoice_id")
    )


def incomplete_orders(t: Tables, stage: str = "delivery") -> DataFrame:
    """What is stuck at a stage: ``delivery``, ``billing`` or ``payment``."""
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {', '.join(STAGES)}")
    return {"delivery": undelivered, "billing": unbilled, "payment": unpaid}[stage](t)


_FLOW = (
    "order_id", "customer_id", "customer_name", "order_amount", "delivery_status",
    "requested_delivery_date", "delivery_id", "ship_date", "goods_status", "picking_status",
    "invoice_id", "invoice_date", "invoice_amount", "is_cancelled",
)


def _flow_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id", "customer_id", F.col("total_amount").alias("order_amount"),
        "delivery_status", "requested_delivery_date",
    )


def _flow_deliveries(t: Tables) -> DataFrame:
    return t["deliveries"].select(
        "order_id", "delivery_id", "ship_date", "goods_status", "picking_status"
    )


def _flow_invoices(t: Tables) -> DataFrame:
    return t["invoices"].select(
        "order_id", "invoice_id", "invoice_date",
        F.col("total_amount").alias("invoice_amount"), "is_cancelled",
    )


def order_flow(t: Tables, order_id: str) -> DataFrame:
    """The trace of one order; as ``order_flow_all``."""
    order = get_order(t, order_id)
    # The key admits one order, so its customer is a scalar that filters both scans.
    customer_id = order.select("customer_id").scalar()
    return _flow(
        order,
        _names(t).filter(F.col("customer_id") == customer_id),
        _flow_documents(t).filter(F.col("order_id") == order_id),
        incoming_payments(t).filter(F.col("customer_id") == customer_id),
    )


def order_flow_all(t: Tables) -> DataFrame:
    """The trace of every order in linear size: one row per delivery and one per invoice.

    An order with neither keeps one row. Payments belong to the customer, not the order, so
    they come as the customer's count, sum and latest clearing date; pairing them with each
    document would give rows that grow with the square of a customer's activity.
    """
    return _flow(t["orders"], _names(t), _flow_documents(t), incoming_payments(t))


def _flow_documents(t: Tables) -> DataFrame:
    return _flow_deliveries(t).unionByName(_flow_invoices(t), allowMissingColumns=True)


def _flow(
    orders: DataFrame, names: DataFrame, documents: DataFrame, payments: DataFrame
) -> DataFrame:
    received = payments.groupBy("customer_id").agg(
        F.count("*").alias("n_payments"),
        F.sum("amount").alias("payment_amount"),
        F.max("clearing_date").alias("last_clearing_date"),
    )
    named = left_join_one(_flow_orders(orders), names, "customer_id")
    flow = left_join_many(join_totals(named, received, "customer_id"), documents, "order_id")
    return flow.select(
        *_FLOW,
        F.coalesce("n_payments", F.lit(0)).alias("n_payments"),
        "payment_amount",
        "last_clearing_date",
    )


def order_items(t: Tables, order_id: str | DataFrame) -> DataFrame:
    """Lines of an order, or of the orders in a DataFrame, with product attributes, in order.

    For one order the products are cut to its own; for many, that would find their lines twice, which
    takes more than the products do.
    """
    items = pick(t["order_items"], "order_id", order_id)
    products = t["products"].select("product_id", "product_name", "product_type", "old_sku")
    if isinstance(order_id, str):
        products = having_some(products, items, "product_id")
    return left_join_one(items, products, "product_id").select(
        *items.columns, "product_name", "product_type", "old_sku"
    ).orderBy(
        "order_id", F.col("line_no").cast("int").asc_nulls_last(), "product_id", "plant", "net_amount"
    )
