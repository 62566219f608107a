"""Ready-made reports over the document model: newest orders, unpaid invoices, link traces."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercash.model import Tables
from ordercash.plans import (
    having_some,
    join_totals,
    left_join_many,
    left_join_one,
    newest_first,
    page,
)
from ordercash.plans.kept import kept

TOP = 20  # Fixed value: rows shown by each report.


def recent_orders(s: Tables, limit: int = TOP) -> DataFrame:
    rows = s["sales_order_headers"].select(
        "sales_order", "sold_to_party", "creation_date", "total_net_amount",
        "overall_delivery_status",
    )
    return page(rows, newest_first("creation_date", "sales_order"), limit)


def customer_details(s: Tables, limit: int = TOP) -> DataFrame:
    rows = s["business_partners"].select(
        "customer", "business_partner_name", "business_partner_full_name",
        "business_partner_is_blocked", "business_partner_grouping", "last_change_date",
    )
    return page(rows, [F.col("customer").asc_nulls_last()], limit)


def top_materials(s: Tables, limit: int = TOP) -> DataFrame:
    """Materials by ordered value, whether billed or not."""
    totals = s["sales_order_items"].groupBy("material").agg(
        F.count("*").alias("order_count"),
        F.sum("net_amount").alias("total_net_amount"),
    )
    return page(totals, newest_first("total_net_amount", "material"), limit)


# Header column and payment column of each way to link an invoice to payments.
LINKS = {
    "document": ("accounting_document", "accounting_document"),
    "invoice_reference": ("accounting_document", "invoice_reference"),
    "customer": ("sold_to_party", "customer"),
}


def unpaid_by_link(s: Tables, link: str = "invoice_reference") -> DataFrame:
    """Live invoices that are unpaid under a link, each with its number of open links.

    An invoice without any linked payment has one open link; otherwise each linked payment
    without a clearing date is one. Payments are counted per key before the join, so an
    invoice is one row however many payments its key has.
    """
    ours, theirs = LINKS[link]
    settled = s["payments_accounts_receivable"].groupBy(F.col(theirs).alias(ours)).agg(
        F.count("*").alias("n_links"),
        F.count_if(F.col("clearing_date").isNull()).alias("n_open"),
    )
    live = s["billing_document_headers"].filter(~F.col("billing_document_is_cancelled")).select(
        "billing_document", "sold_to_party", "billing_document_date", "total_net_amount",
        *({ours} - {"sold_to_party"}),
    )
    open_links = F.when(F.col("n_links").isNull(), F.lit(1)).otherwise(F.col("n_open"))
    return (
        join_totals(live, settled, ours)
        .withColumn("open_links", open_links.cast("bigint"))
        .filter(F.col("open_links") > 0)
        .select(
            "billing_document", "sold_to_party", "billing_document_date", "total_net_amount",
            "open_links",
        )
    )


def _repeat(df: DataFrame, times: str, limit: int) -> DataFrame:
    """Each row as often as ``times`` says, but no more often than a page of ``limit`` can show."""
    bounded = F.least(F.col(times), F.lit(limit)).cast("int")
    return df.withColumn(times, F.explode(F.sequence(F.lit(1), bounded))).drop(times)


def unpaid_invoices(s: Tables, limit: int = TOP) -> DataFrame:
    """The newest live invoices without a cleared payment of the same accounting document."""
    order = newest_first("billing_document_date", "billing_document")
    newest = page(unpaid_by_link(s, "document"), order, limit)
    return page(_repeat(newest, "open_links", limit), order, limit)


_PATH = ("sales_order", "sold_to_party", "delivery_document", "billing_document", "payment_id")


class _Links(NamedTuple):
    """The four tables a trace follows, as pairs of the documents they link."""

    delivery_items: DataFrame
    billing_items: DataFrame
    headers: DataFrame
    payments: DataFrame


def _links(s: Tables) -> _Links:
    return _Links(
        s["outbound_delivery_items"].select(
            F.col("reference_sd_document").alias("sales_order"), "delivery_document"
        ),
        s["billing_document_items"].select(
            F.col("reference_sd_document").alias("delivery_document"), "billing_document"
        ),
        s["billing_document_headers"].select("billing_document", "accounting_document"),
        s["payments_accounts_receivable"].select("accounting_document"),
    )


def _links_near(links: _Links, orders: DataFrame) -> _Links:
    """All four tables cut down to what a page of orders leads to, before they are shuffled."""
    delivery_items = links.delivery_items.join(
        orders.select("sales_order"), "sales_order", "left_semi"
    )
    billing_items = having_some(links.billing_items, delivery_items, "delivery_document")
    headers = having_some(links.headers, billing_items, "billing_document")
    payments = having_some(links.payments, headers, "accounting_document")
    return _Links(delivery_items, billing_items, headers, payments)


def _paths(orders: DataFrame, links: _Links, keep: bool = False) -> DataFrame:
    """Every distinct link path of ``orders`` and how many item-level paths it stands for.

    Items link documents, so a document pair occurs once per item that names it. The pairs
    are counted before they are joined; the number of item paths is the product of counts.
    ``keep`` is that of ``trace_orders_full``.
    """
    deliveries = links.delivery_items.groupBy("sales_order", "delivery_document").agg(
        F.count("*").alias("n_delivery")
    )
    billings = links.billing_items.groupBy("delivery_document", "billing_document").agg(
        F.count("*").alias("n_billing")
    )
    payments = links.payments.groupBy("accounting_document").agg(F.count("*").alias("n_payment"))
    paths = left_join_many(orders, deliveries, "sales_order")
    paths = left_join_many(paths, billings, "delivery_document")
    if keep:
        paths = kept("paths", paths)
    paths = left_join_one(paths, links.headers, "billing_document")
    paths = join_totals(paths, payments, "accounting_document")
    n_paths = F.lit(1).cast("bigint")
    for n in ("n_delivery", "n_billing", "n_payment"):
        n_paths = n_paths * F.coalesce(n, F.lit(1))
    return paths.withColumn(
        "payment_id", F.when(F.col("n_payment").isNotNull(), F.col("accounting_document"))
    ).withColumn("n_paths", n_paths)


def trace_orders(s: Tables, limit: int = TOP) -> DataFrame:
    """Order to delivery to invoice to payment for the newest orders, ``limit`` link paths.

    Every order has at least one path, so the newest ``limit`` orders hold all rows of the
    page, and all other tables are probed with their keys before they are shuffled.
    """
    newest = newest_first("creation_date", "sales_order")
    orders = page(
        s["sales_order_headers"].select("sales_order", "sold_to_party", "creation_date"),
        newest, limit,
    )
    paths = _paths(orders, _links_near(_links(s), orders))
    order = newest + [
        F.col(c).asc_nulls_last() for c in ("delivery_document", "billing_document", "payment_id")
    ]
    rows = page(paths.select(*_PATH, "creation_date", "n_paths"), order, limit)
    return page(_repeat(rows, "n_paths", limit), order, limit).select(*_PATH)


def trace_orders_full(s: Tables, keep: bool = False) -> DataFrame:
    """Every distinct link path of every order, with the number of item-level paths.

    With ``keep`` the paths from orders to invoices are written once when this is called, so that the
    shuffles that lead to them are not on disk with those that follow.
    """
    orders = s["sales_order_headers"].select("sales_order", "sold_to_party")
    paths = _paths(orders, _links(s), keep)
    return paths.select(*_PATH, "n_paths")


# Each report by the name ``question_intent`` gives it.
REPORTS = {
    f.__name__: f
    for f in (recent_orders, customer_details, top_materials, unpaid_invoices, trace_orders)
}
