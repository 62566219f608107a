"""Product lists, lookups and the best sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercash.model import Tables
from ordercash.plans import mix, newest_first, page, pick



def list_products(
    t: Tables, product_type: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    products = t["products"].filter(F.col("is_deleted") == 0)
    if product_type:
        products = products.filter(F.col("product_type") == product_type)
    return page(products, [F.col("product_id").asc_nulls_last()], limit, offset)


def get_product(t: Tables, product_id: str | DataFrame) -> DataFrame:
    """The product with this key, or those with the keys of a DataFrame, withdrawn or not."""
    return pick(t["products"], "product_id", product_id)


def billed_products(t: Tables) -> DataFrame:
    """Per product over lines whose order has a live invoice: orders, revenue and units.

    A line counts once per live invoice of its order. The number of live invoices per order
    stands in for the invoices themselves, and lines are summed per order and product before
    products are joined, so no invoice is paired with a line.
    """
    live = (
        t["invoices"].filter(F.col("is_cancelled") == 0)
        .groupBy("order_id")
        .agg(F.count("*").cast("decimal(18,0)").alias("n_live"))
    )
    per_order = (
        mix(t["order_items"].select("order_id", "product_id", "net_amount", "quantity"), "order_id")
        .join(mix(live, "order_id"), ["order_id", "_mix"])
        .groupBy("product_id", "order_id", "_mix")
        .agg(
            F.sum(F.col("net_amount") * F.col("n_live")).alias("revenue"),
            F.sum(F.col("quantity") * F.col("n_live")).alias("units"),
        )
    )
    per_product = per_order.groupBy("product_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("revenue").cast("decimal(38,4)").alias("total_revenue"),
        F.sum("units").cast("decimal(38,2)").alias("total_units_sold"),
    )
    products = t["products"].select("product_id", "product_name", "product_type", "old_sku")
    return products.join(per_product, "product_id")


def top_products(t: Tables, limit: int = 10) -> DataFrame:
    """The products with the highest billed revenue."""
    return page(billed_products(t), newest_first("total_revenue", "product_id"), limit)
