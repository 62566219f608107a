"""Free-form analyst queries, one per SQL construct an analyst may use.

Each is a plain DataFrame query over the star tables. Where a construct has a form that
collects a whole group in one task (numbering, running sums, arrays), the query first reduces
the group to something bounded: a top few, one row per day, one row per code.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordercash.model import Tables
from ordercash.operators.orders import live_invoices, shipped
from ordercash.operators.products import billed_products
from ordercash.plans import having_no, having_some, join_totals, left_join_many, newest_first, page

# The codes a delivery status can take.
STATUS_CODES = ("A", "B", "C")

# Age bands of receivables in days, both ends included.
AGE_BANDS = (
    ("current", None, 0),
    ("1-30", 1, 30),
    ("31-90", 31, 90),
    ("91-365", 91, 365),
    ("over 365", 366, None),
)


def inner_join(t: Tables) -> DataFrame:
    """Order lines with the date and customer of their order."""
    return t["order_items"].select("order_id", "line_no", "product_id", "net_amount").join(
        t["orders"].select("order_id", "customer_id", "order_date"), "order_id"
    )


def left_join(t: Tables) -> DataFrame:
    """Every order with each of its live invoices, if any."""
    invoices = live_invoices(t).select(
        "order_id", "invoice_id", F.col("total_amount").alias("invoice_amount")
    )
    return left_join_many(
        t["orders"].select("order_id", "customer_id", "total_amount"),
        invoices, "order_id",
    )


def right_join(t: Tables) -> DataFrame:
    """Payment count and sum of every customer, also of those without payments."""
    paid = t["payments"].groupBy("customer_id").agg(
        F.count("*").alias("n_payments"), F.sum("amount").alias("paid")
    )
    return paid.join(t["customers"].select("customer_id", "name"), "customer_id", "right")


def full_join(t: Tables) -> DataFrame:
    """Shipments against invoices per order; either side may be missing."""
    delivered = shipped(t).groupBy("order_id").agg(F.count("*").alias("n_shipped"))
    invoiced = t["invoices"].groupBy("order_id").agg(F.count("*").alias("n_invoices"))
    return delivered.join(invoiced, "order_id", "full")


def cross_join(t: Tables) -> DataFrame:
    """Orders per type and status code, with a row for every known combination, empty ones too,
    and one for each other code that orders of the type have, null included.

    The second factor is a fixed code list, so the product is an explode of one row per type.
    """
    orders = t["orders"].groupBy("order_type", "delivery_status").agg(F.count("*").alias("n_orders"))
    types = orders.select("order_type").distinct()
    empty = types.select(
        "order_type", F.explode(F.array(*map(F.lit, STATUS_CODES))).alias("delivery_status"),
        F.lit(0).cast("bigint").alias("n_orders"),
    )
    return orders.unionByName(empty).groupBy("order_type", "delivery_status").agg(
        F.sum("n_orders").alias("n_orders")
    )


def theta_join(t: Tables, as_of: date) -> DataFrame:
    """Live invoices by age band: joined on a range, counted and summed.

    The bands are a fixed list of five rows and are broadcast.
    """
    rows = [
        F.struct(
            F.lit(band).alias("band"),
            F.lit(first).cast("int").alias("first_day"),
            F.lit(last).cast("int").alias("last_day"),
        )
        for band, first, last in AGE_BANDS
    ]
    bands = t["invoices"].sparkSession.range(1).select(F.inline(F.array(*rows)))
    aged = live_invoices(t).filter(F.col("invoice_date").isNotNull()).select(
        F.datediff(F.lit(as_of), "invoice_date").alias("age"), "total_amount"
    )
    in_band = (F.col("first_day").isNull() | (F.col("age") >= F.col("first_day"))) & (
        F.col("last_day").isNull() | (F.col("age") <= F.col("last_day"))
    )
    return (
        aged.join(F.broadcast(bands), in_band)
        .groupBy("band")
        .agg(F.count("*").alias("n_invoices"), F.sum("total_amount").alias("amount"))
    )


def semi_join(t: Tables, over: int = 100_000) -> DataFrame:
    """Customers with at least one order above an amount."""
    large = t["orders"].filter(F.col("total_amount") > over)
    return having_some(t["customers"].select("customer_id", "name"), large, "customer_id")


def anti_join(t: Tables) -> DataFrame:
    """Products that occur on no order."""
    return having_no(
        t["products"].select("product_id", "product_name"), t["order_items"], "product_id"
    )


def filters(t: Tables, since: date, until: date) -> DataFrame:
    """Open orders of a period, urgent ones or those above an amount."""
    return t["orders"].filter(
        F.col("delivery_status").isin("A", "B")
        & F.col("order_date").between(since, until)
        & F.col("requested_delivery_date").isNotNull()
        & ((F.col("order_type") == "1-URGENT") | ~(F.col("total_amount") <= 200_000))
    ).select("order_id", "customer_id", "order_date", "order_type", "total_amount")


def like(t: Tables, sku: str, product_type: str) -> DataFrame:
    """Products by SKU pattern, or by type pattern in either case."""
    return t["products"].filter(
        F.col("old_sku").like(sku) | F.col("product_type").ilike(product_type)
    ).select("product_id", "old_sku", "product_type")


def group_having(t: Tables, at_least: int = 5) -> DataFrame:
    """Order statistics of customers with some number of orders."""
    amount = F.col("total_amount")
    return (
        t["orders"].groupBy("customer_id")
        .agg(
            F.count("*").alias("n_orders"),
            F.sum(amount).alias("total"),
            F.round(F.avg(amount.cast("decimal(28,12)")), 2).alias("mean"),
            F.min(amount).alias("least"),
            F.max(amount).alias("most"),
        )
        .filter(F.col("n_orders") >= at_least)
    )


def distinct(t: Tables) -> DataFrame:
    return t["orders"].select("customer_id", "delivery_status").distinct()


def count_distinct(t: Tables) -> DataFrame:
    """Orders and different customers per order type."""
    return t["orders"].groupBy("order_type").agg(
        F.count("*").alias("n_orders"), F.count_distinct("customer_id").alias("n_customers")
    )


def case(t: Tables) -> DataFrame:
    """Orders per size class, with a flag for classes above the smallest."""
    amount = F.col("total_amount")
    size = (
        F.when(amount < 50_000, "small").when(amount < 200_000, "medium").otherwise("large")
    )
    return (
        t["orders"].groupBy(size.alias("size"))
        .agg(F.count("*").alias("n_orders"), F.sum(amount).alias("total"))
        .withColumn("is_notable", F.when(F.col("size") == "small", False).otherwise(True))
    )


def union_all(t: Tables) -> DataFrame:
    """Every document of every order, as (order_id, kind, document_id)."""
    return (
        t["deliveries"]
        .select("order_id", F.lit("delivery").alias("kind"), F.col("delivery_id").alias("id"))
        .unionByName(
            t["invoices"].select(
                "order_id", F.lit("invoice").alias("kind"), F.col("invoice_id").alias("id")
            )
        )
    )


def union(t: Tables) -> DataFrame:
    """Customers that were invoiced or that paid, each once."""
    return (
        t["invoices"].select("customer_id").unionByName(t["payments"].select("customer_id"))
    ).distinct()


def order_page(t: Tables, limit: int = 50, offset: int = 100) -> DataFrame:
    """A page of orders by amount."""
    rows = t["orders"].select("order_id", "customer_id", "total_amount")
    return page(rows, newest_first("total_amount", "order_id"), limit, offset)


def row_number(t: Tables, latest: int = 3) -> DataFrame:
    """The latest few orders of each customer, numbered.

    The bound on the number lets each map task keep that many rows per customer, so a
    customer with most of the orders sends few of them to the numbering task.
    """
    w = Window.partitionBy("customer_id").orderBy(*newest_first("order_date", "order_id"))
    return (
        t["orders"].select("customer_id", "order_id", "order_date")
        .withColumn("n", F.row_number().over(w))
        .filter(F.col("n") <= latest)
    )


def rank(t: Tables, best: int = 3) -> DataFrame:
    """The best-selling few products of each type by billed revenue, ties included.

    Ranks are found over distinct revenues, of which only the few highest per type reach the
    window, and are then joined to the products; any number of products may tie.
    """
    sold = billed_products(t).select("product_type", "product_id", "total_revenue")
    revenues = sold.groupBy("product_type", "total_revenue").agg(F.count("*").alias("tied"))
    w = Window.partitionBy("product_type").orderBy(F.col("total_revenue").desc_nulls_first())
    ahead = F.sum("tied").over(w.rowsBetween(Window.unboundedPreceding, -1))
    places = (
        revenues.withColumn("n", F.row_number().over(w))
        .filter(F.col("n") <= best)
        .withColumn("place", F.coalesce(ahead, F.lit(0)) + 1)
        .filter(F.col("place") <= best)
        .select(F.col("product_type").alias("type"), F.col("total_revenue").alias("at"), "place")
    )
    same = F.col("type").eqNullSafe(F.col("product_type")) & F.col("at").eqNullSafe(
        F.col("total_revenue")
    )
    return sold.join(places, same).select("product_type", "product_id", "total_revenue", "place")


def window_agg(t: Tables) -> DataFrame:
    """Each customer's ledger by day: orders and amount of the day, so far, and in all.

    Orders of one day are peers under the default frame, so summing per day first gives the
    same running values, and a window then holds one row per day of the calendar at most.
    """
    daily = t["orders"].groupBy("customer_id", "order_date").agg(
        F.count("*").alias("n_orders"), F.sum("total_amount").alias("amount"),
        F.min("total_amount").alias("least"), F.max("total_amount").alias("most"),
    )
    whole = Window.partitionBy("customer_id")
    so_far = whole.orderBy(F.col("order_date").asc_nulls_last())
    return daily.select(
        "customer_id",
        "order_date",
        F.sum("n_orders").over(so_far).alias("orders_so_far"),
        F.sum("amount").over(so_far).alias("amount_so_far"),
        F.min("least").over(so_far).alias("least_so_far"),
        F.max("most").over(so_far).alias("most_so_far"),
        F.sum("amount").over(whole).alias("amount_in_all"),
    )


def scalar_subquery(t: Tables) -> DataFrame:
    """Orders above the mean order amount."""
    amount = F.col("total_amount")
    mean = t["orders"].select(F.avg(amount.cast("decimal(28,12)"))).scalar()
    return t["orders"].filter(amount > mean).select("order_id", "total_amount")


def correlated_subquery(t: Tables) -> DataFrame:
    """Orders above the mean amount of their own customer."""
    own = t["orders"].groupBy("customer_id").agg(
        F.sum("total_amount").alias("own_total"), F.count("total_amount").alias("own_orders")
    )
    orders = t["orders"].select("order_id", "customer_id", "total_amount")
    return (
        join_totals(orders, own, "customer_id", "inner")
        .filter(F.col("total_amount") * F.col("own_orders") > F.col("own_total"))
        .select("order_id", "customer_id", "total_amount")
    )


def null_functions(t: Tables, as_of: date) -> DataFrame:
    """Deliveries with a date filled in, and dates clipped to a day."""
    day = F.lit(as_of)
    return t["deliveries"].select(
        "delivery_id",
        F.coalesce("ship_date", day).alias("filled"),
        F.nullif(F.col("goods_status"), F.lit("A")).alias("status"),
        F.greatest("ship_date", day).alias("later"),
        F.least("ship_date", day).alias("earlier"),
    )


def cast(t: Tables) -> DataFrame:
    """Order lines with values cast between text, numbers, dates and truth values.

    A number is rounded when cast to an integer in the source database and cut off here, so
    the rounding is written out.
    """
    return t["order_items"].select(
        "order_id",
        F.col("line_no").cast("int").alias("line"),
        F.col("quantity").cast("string").alias("quantity_text"),
        F.round("net_amount", 0).cast("bigint").alias("net_whole"),
        F.col("line_no").cast("int").cast("boolean").alias("has_line"),
        F.col("net_amount").cast("decimal(18,2)").alias("net_cents"),
    )


def date_now(t: Tables, as_of: date | None = None, days: int = 30) -> DataFrame:
    """Open orders overdue by more than some days, as of today unless a day is given."""
    today: Column = F.current_date() if as_of is None else F.lit(as_of)
    due = F.col("requested_delivery_date")
    return t["orders"].filter(
        (F.col("delivery_status") != "C") & (due < F.date_sub(today, days))
    ).select("order_id", "requested_delivery_date", F.datediff(today, due).alias("days_late"))


def date_trunc(t: Tables) -> DataFrame:
    """Order count and amount per month."""
    month = F.date_trunc("month", "order_date").cast("date")
    return t["orders"].groupBy(month.alias("month")).agg(
        F.count("*").alias("n_orders"), F.sum("total_amount").alias("amount")
    )


def to_char(t: Tables) -> DataFrame:
    """Orders with their date as text in two layouts."""
    return t["orders"].select(
        "order_id",
        F.date_format("order_date", "yyyy-MM").alias("month_text"),
        F.date_format("order_date", "dd/MM/yyyy").alias("day_text"),
    )


def to_date(t: Tables) -> DataFrame:
    """Invoices with the day read back from text, and the days to it from the month's start."""
    text = F.date_format("invoice_date", "yyyyMMdd")
    day = F.to_date(text, "yyyyMMdd")
    first = F.to_date(F.concat(F.date_format("invoice_date", "yyyyMM"), F.lit("01")), "yyyyMMdd")
    return t["invoices"].select(
        "invoice_id", day.alias("day"), F.datediff(day, first).alias("days_in")
    )


def rounding(t: Tables) -> DataFrame:
    """Net amounts to cents and to whole units, halves away from zero."""
    return t["order_items"].select(
        "order_id",
        "line_no",
        F.round("net_amount", 2).alias("to_cents"),
        F.round("net_amount", 0).alias("to_units"),
    )


def strings(t: Tables) -> DataFrame:
    """Customers with name parts and a label; concat leaves out what is null."""
    return t["customers"].select(
        "customer_id",
        F.substring("name", 1, 8).alias("short_name"),
        F.upper("name").alias("upper_name"),
        F.lower("grouping").alias("lower_group"),
        F.concat_ws(
            "", F.col("name"), F.lit("/"), F.nullif(F.col("grouping"), F.lit("BUILDING"))
        ).alias("label"),
    )


def array_agg(t: Tables) -> DataFrame:
    """The distinct delivery status codes of each customer's orders as a sorted array; a null
    among them comes last."""
    status = F.col("delivery_status")
    return t["orders"].groupBy("customer_id").agg(
        F.array_sort(F.collect_set(status)).alias("known"), F.bool_or(status.isNull()).alias("blank")
    ).select(
        "customer_id",
        F.when(F.col("blank"), F.array_append("known", F.lit(None).cast("string")))
        .otherwise(F.col("known")).alias("statuses"),
    )


def json_agg(t: Tables) -> DataFrame:
    """Per order type, a JSON list of its order counts by status code, a null code as null."""
    cell = F.struct(
        F.col("delivery_status").alias("status"), F.col("n_orders").alias("orders")
    )
    cells = F.array_sort(
        F.collect_list(cell),
        lambda a, b: F.when(a["status"] == b["status"], 0)
        .when(a["status"].isNull(), 1).when(b["status"].isNull(), -1)
        .when(a["status"] < b["status"], -1).otherwise(1),
    )
    return (
        t["orders"].groupBy("order_type", "delivery_status").agg(F.count("*").alias("n_orders"))
        .groupBy("order_type")
        .agg(F.to_json(cells, {"ignoreNullFields": "false"}).alias("by_status"))
    )


def json_build_object(t: Tables) -> DataFrame:
    """Each product as a JSON object."""
    return t["products"].select(
        "product_id",
        F.to_json(
            F.struct(
                F.col("product_id").alias("id"),
                F.col("product_type").alias("type"),
                F.col("is_deleted").alias("deleted"),
            )
        ).alias("object"),
    )


def unnest(t: Tables) -> DataFrame:
    """One row per customer and distinct status code of its orders, null included."""
    return t["orders"].select("customer_id", F.col("delivery_status").alias("status")).distinct()


def extract(t: Tables) -> DataFrame:
    """Invoice count and amount by year and month number."""
    return (
        t["invoices"]
        .groupBy(
            F.extract(F.lit("YEAR"), "invoice_date").alias("year"),
            F.extract(F.lit("MONTH"), "invoice_date").alias("month"),
        )
        .agg(F.count("*").alias("n_invoices"), F.sum("total_amount").alias("amount"))
    )
