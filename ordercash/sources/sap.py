"""The star model derived from the document model.

A column without a counterpart, and a source column a table does not carry, come out as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordercash.model import STAR, Tables
from ordercash.plans import left_join_one


def _project(df: DataFrame, table: str, **columns: str | Column) -> DataFrame:
    """``df`` in the shape of a star table, its columns taken by name or expression."""

    def source(name: str) -> Column:
        given = columns.get(name)
        if isinstance(given, str):
            return F.col(given) if given in df.columns else F.lit(None)
        return F.lit(None) if given is None else given

    return df.select(
        *[source(f.name).cast(f.dataType).alias(f.name) for f in STAR[table].fields]
    )


def _flag(df: DataFrame, column: str) -> Column:
    return F.col(column).cast("int") if column in df.columns else F.lit(0)


def customers(s: Tables) -> DataFrame:
    df = s["business_partners"]
    return _project(
        df, "customers", customer_id="customer", name="business_partner_name",
        grouping="business_partner_grouping", created_date="creation_date",
        is_blocked=_flag(df, "business_partner_is_blocked"),
        is_archived=_flag(df, "is_marked_for_archiving"),
    )


def orders(s: Tables) -> DataFrame:
    return _project(
        s["sales_order_headers"], "orders", order_id="sales_order", customer_id="sold_to_party",
        order_type="sales_order_type", sales_org="sales_organization",
        order_date="creation_date", requested_delivery_date="requested_delivery_date",
        total_amount="total_net_amount", currency="transaction_currency",
        delivery_status="overall_delivery_status",
    )


def order_items(s: Tables) -> DataFrame:
    return _project(
        s["sales_order_items"], "order_items", order_id="sales_order",
        line_no="sales_order_item", product_id="material", quantity="requested_quantity",
        unit="requested_quantity_unit", net_amount="net_amount", plant="production_plant",
        item_category="sales_order_item_category",
    )


def _delivered_orders(s: Tables) -> DataFrame:
    return s["outbound_delivery_items"].select(
        "delivery_document", F.col("reference_sd_document").alias("order_id")
    ).distinct()


def deliveries(s: Tables) -> DataFrame:
    """One row per delivery and order it serves."""
    joined = _delivered_orders(s).join(
        s["outbound_delivery_headers"], "delivery_document", "left"
    )
    return _project(
        joined, "deliveries", delivery_id="delivery_document", order_id="order_id",
        created_date="creation_date", ship_date="actual_goods_movement_date",
        picking_status="overall_picking_status", goods_status="overall_goods_movement_status",
        shipping_point="shipping_point", delivery_block="delivery_block_reason",
    )


def invoices(s: Tables) -> DataFrame:
    """One row per invoice and order it bills, found through the delivery its items name.

    An invoice whose items name no known delivery keeps one row without an order.
    """
    billed = s["billing_document_items"].select(
        "billing_document", F.col("reference_sd_document").alias("delivery_document")
    ).distinct()
    billed_orders = (
        billed.join(_delivered_orders(s), "delivery_document")
        .select("billing_document", "order_id")
        .distinct()
    )
    headers = s["billing_document_headers"]
    # Headers are unique by document, so the links lead the join and AQE can split them.
    with_order = billed_orders.join(headers, "billing_document")
    without = headers.join(
        billed_orders.select("billing_document").distinct(), "billing_document", "left_anti"
    )
    joined = with_order.unionByName(without, allowMissingColumns=True)
    return _project(
        joined, "invoices", invoice_id="billing_document", order_id="order_id",
        customer_id="sold_to_party", invoice_type="billing_document_type",
        invoice_date="billing_document_date", total_amount="total_net_amount",
        currency="transaction_currency", accounting_doc="accounting_document",
        is_cancelled=F.col("billing_document_is_cancelled").cast("int"),
    )


def payments(s: Tables) -> DataFrame:
    """Receivable postings; a cleared one counts as money received."""
    return _project(
        s["payments_accounts_receivable"], "payments", payment_id="accounting_document",
        payment_item="accounting_document_item", customer_id="customer",
        clearing_date="clearing_date", posting_date="posting_date",
        amount="amount_in_transaction_currency", currency="transaction_currency",
        clearing_doc="clearing_accounting_document", gl_account="gl_account",
        is_incoming=F.col("clearing_date").isNotNull().cast("int"),
    )


def products(s: Tables) -> DataFrame:
    names = s["product_descriptions"].filter(F.col("language") == "EN").select(
        "product", F.col("product_description").alias("product_name")
    )
    df = left_join_one(s["products"], names, "product")
    return _project(
        df, "products", product_id="product", product_name="product_name",
        product_type="product_type", old_sku="product_old_id",
        is_deleted=_flag(df, "is_marked_for_deletion"),
    )


def o2c_from_sap(s: Tables) -> dict[str, DataFrame]:
    return {
        f.__name__: f(s)
        for f in (customers, orders, order_items, deliveries, invoices, payments, products)
    }
