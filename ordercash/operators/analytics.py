"""Business-wide measures: lead times, leakage, receivables and stage counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordercash.model import STAR_RELATIONSHIPS, Relationship, Tables
from ordercash.operators.orders import never_paid, shipped
from ordercash.plans import having_no


def delivery_performance(t: Tables) -> DataFrame:
    """Count, mean, least and most days from order to goods issue."""
    dated = shipped(t).filter(F.col("ship_date").isNotNull()).select("order_id", "ship_date")
    days = F.datediff("ship_date", "order_date")
    return (
        t["orders"].filter(F.col("order_date").isNotNull()).select("order_id", "order_date")
        .join(dated, "order_id")
        .agg(
            F.count("*").alias("shipped_orders"),
            F.round(F.avg(days.cast("decimal(18,6)")), 1).alias("avg_days"),
            F.min(days).alias("min_days"),
            F.max(days).alias("max_days"),
        )
    )


def revenue_leakage(t: Tables) -> DataFrame:
    """Shipped orders of known customers that were never invoiced."""
    deliveries = having_no(shipped(t).select("order_id", "ship_date"), t["invoices"], "order_id")
    return (
        t["orders"].select("order_id", "customer_id", F.col("total_amount").alias("order_amount"))
        .join(deliveries, "order_id")
        .join(
            t["customers"].select("customer_id", F.col("name").alias("customer_name")),
            "customer_id",
        )
        .select("order_id", "customer_name", "ship_date", "order_amount")
    )


def overdue_ar(t: Tables) -> DataFrame:
    """Live invoices of customers that never paid, oldest first."""
    return (
        never_paid(t)
        .select("invoice_id", "customer_name", "is_blocked", "invoice_date", "total_amount")
        .orderBy(F.col("invoice_date").asc_nulls_last(), "invoice_id")
    )


def _distinct_when(condition: Column, column: str) -> Column:
    return F.count_distinct(F.when(condition, F.col(column)))


def stage_counts(t: Tables) -> DataFrame:
    """One row of nine counts over all stages; each table is scanned once."""
    rows = F.count("*")
    measures = {
        "total_customers": ("customers", rows),
        "blocked_customers": ("customers", F.count_if(F.col("is_blocked") == 1)),
        "total_orders": ("orders", rows),
        "orders_delivered": (
            "deliveries", _distinct_when(F.col("goods_status") == "C", "order_id")
        ),
        "orders_billed": ("invoices", _distinct_when(F.col("is_cancelled") == 0, "order_id")),
        "total_invoices": ("invoices", rows),
        "cancelled_invoices": ("invoices", F.count_if(F.col("is_cancelled") == 1)),
        "total_payments_received": ("payments", F.count_if(F.col("is_incoming") == 1)),
        "total_products": ("products", F.count_if(F.col("is_deleted") == 0)),
    }
    tables = dict.fromkeys(table for table, _ in measures.values())
    counts = [
        t[table].agg(*[m.alias(name) for name, (of, m) in measures.items() if of == table])
        for table in tables
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts)
    return stacked.agg(*[F.max(name).alias(name) for name in measures])


def relationship_check(
    t: Tables, relationships: tuple[Relationship, ...] = STAR_RELATIONSHIPS
) -> DataFrame:
    """Per declared relationship: child rows, rows without a key and rows without a parent.

    Child rows are counted per key value before the join, so a hot key is one row in it.
    """

    def check(r: Relationship) -> DataFrame:
        children = t[r.child].groupBy(F.col(r.child_key).alias("key")).agg(
            F.count("*").alias("n")
        )
        parents = t[r.parent].select(F.col(r.parent_key).alias("key")).distinct()
        found = children.join(parents.withColumn("found", F.lit(True)), "key", "left")
        return found.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
            F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias(
                "null_keys"
            ),
            F.coalesce(
                F.sum(F.when(F.col("key").isNotNull() & F.col("found").isNull(), F.col("n"))),
                F.lit(0),
            ).alias("orphans"),
        ).select(
            F.lit(f"{r.child}.{r.child_key}").alias("child"),
            F.lit(f"{r.parent}.{r.parent_key}").alias("parent"),
            "child_rows",
            "null_keys",
            "orphans",
        )

    return reduce(DataFrame.unionByName, [check(r) for r in relationships])
