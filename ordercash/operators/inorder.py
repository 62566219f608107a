"""Analyst queries that depend on an order or on nulls, on raw rows whatever share of them one key has.

Spans of days, values as of a day, running values by row, deep pages, ranks over all rows, long lists, and
the two joins that treat missing keys in a way of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordercash.model import Tables
from ordercash.operators.orders import live_invoices, shipped
from ordercash.operators.products import billed_products
from ordercash.plans import having_no, join_totals, mix, newest_first
from ordercash.plans.ordered import carried, chunked, deep_page, running, with_running

DAY_ONE = "1970-01-01"
WORD = 62  # columns whose bits one long number holds


def incoming(t: Tables) -> DataFrame:
    return t["payments"].filter(F.col("is_incoming") == 1)


def within_days(
    left: DataFrame, right: DataFrame, on: str, start: str, day: str, days: int
) -> DataFrame:
    """Pairs with the same ``on`` whose ``day`` (right) lies from ``start`` (left) to ``days`` later.

    The calendar is cut into bins as long as the span. A left row can only meet the bin of its start and
    the next one, so it stands in both, and the join is one on equal (key, bin), of which AQE splits a hot
    one on both sides; the days are compared after it. Each pair has one bin, that of the right row. Rows
    without a key or a day meet none.
    """
    bin_of = lambda c: F.floor(F.datediff(F.col(c), F.lit(DAY_ONE).cast("date")) / (days + 1))
    spans = left.filter(F.col(start).isNotNull()).withColumn(
        "_bin", F.explode(F.array(bin_of(start), bin_of(start) + 1))
    )
    points = right.filter(F.col(day).isNotNull()).withColumn("_bin", bin_of(day))
    return (
        spans.join(points, [on, "_bin"])
        .filter(F.col(day).between(F.col(start), F.date_add(start, days)))
        .drop("_bin")
    )


def interval_join(t: Tables, days: int = 30) -> DataFrame:
    """Live invoices with the customer's incoming payments of their day and the ``days`` after it."""
    invoices = live_invoices(t).select("customer_id", "invoice_id", "invoice_date")
    payments = incoming(t).select("customer_id", "payment_id", "clearing_date", "amount")
    pairs = within_days(invoices, payments, "customer_id", "invoice_date", "clearing_date", days)
    return pairs.select(
        "customer_id", "invoice_id", "payment_id", F.datediff("clearing_date", "invoice_date").alias("days"), "amount"
    )


def as_of_payment(t: Tables, n: int | None = None) -> DataFrame:
    """Each live invoice with its customer's latest incoming payment up to its day, the last by id of a day.

    Invoices and payments are put into one order by customer and day, payments of a day ahead of its
    invoices, and the last payment is carried on; no invoice is paired with payments it doesn't get.
    """
    invoices = live_invoices(t).select(
        "customer_id", F.col("invoice_date").alias("day"), F.lit(1).alias("later"), F.col("invoice_id").alias("id"),
        F.lit(None).cast("string").alias("payment_id"),
    )
    payments = incoming(t).filter(F.col("clearing_date").isNotNull()).select(
        "customer_id", F.col("clearing_date").alias("day"), F.lit(0).alias("later"), F.col("payment_id").alias("id"),
        "payment_id",
    )
    paid = F.when(F.col("later") == 0, F.struct("payment_id", F.col("day").alias("clearing_date")))
    rows = carried(invoices.unionByName(payments), ["day", "later", "id"], ["customer_id"], paid, n)
    # An invoice without a customer or a day has no payment up to it.
    known = F.col("customer_id").isNotNull() & F.col("day").isNotNull()
    return rows.filter("later = 1").withColumn("carried", F.when(known, F.col("carried"))).select(
        F.col("id").alias("invoice_id"), "customer_id", F.col("day").alias("invoice_date"), "carried.payment_id",
        "carried.clearing_date",
    )


def running_totals(t: Tables, n: int | None = None) -> DataFrame:
    """Each order with its customer's orders, sum, least, most and mean amount up to its day, peers included."""
    orders = t["orders"].select("order_id", "customer_id", "order_date", "total_amount")
    values = running(orders, "total_amount", "order_date", ["customer_id"], n)
    mean = F.col("sum_so_far").cast("double") / F.col("values_so_far")
    return with_running(orders, values, "order_date", ["customer_id"], {
        "orders_so_far": F.col("rows_so_far"), "amount_so_far": F.col("sum_so_far"),
        "least_so_far": F.col("least_so_far"), "most_so_far": F.col("most_so_far"),
        "mean_so_far": F.when(F.col("values_so_far") > 0, mean),
    })


def deep_order_page(t: Tables, limit: int = 50, offset: int = 1000, n: int | None = None) -> DataFrame:
    """A page of orders by amount from any depth."""
    rows = t["orders"].select("order_id", "customer_id", "total_amount")
    return deep_page(rows, newest_first("total_amount", "order_id"), limit, offset, n)


def full_rank(t: Tables, n: int | None = None) -> DataFrame:
    """Every sold product with its place by billed revenue among all, as rank and as dense rank."""
    sold = billed_products(t).select("product_id", "total_revenue").withColumn("_less", -F.col("total_revenue"))
    values = running(sold, "_less", "_less", (), n)
    told = with_running(sold, values, "_less", (), {
        "place": F.col("rows_so_far") - F.col("peers") + 1, "dense_place": F.col("distinct_so_far"),
    })
    return told.drop("_less")


def order_lists(t: Tables, size: int = 100, n: int | None = None) -> DataFrame:
    """The status codes of each customer's orders by day, repeats and nulls kept, in lists of ``size``."""
    rows = t["orders"].select("customer_id", "order_date", "order_id", "delivery_status")
    by_day = [F.col("order_date").asc_nulls_last(), F.col("order_id").asc_nulls_last()]
    return chunked(rows, by_day, ["customer_id"], "delivery_status", size, n).withColumnRenamed("items", "statuses")


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows of ``df`` of which ``column NOT IN (SELECT other_column FROM other)`` is true.

    Nothing is, once the list has a null, nor for a null itself, but for an empty list, of which everything
    is. Whether it has rows and nulls are two counts, and the rest is an anti join, which AQE can split.
    """
    counts = other.agg(F.count("*").alias("n"), F.count(F.col(other_column)).alias("known"))
    empty = counts.select(F.col("n") == 0).scalar()
    whole = counts.select(F.col("n") == F.col("known")).scalar()
    keys = other.select(F.col(other_column).alias(column)).filter(F.col(column).isNotNull())
    rest = having_no(df, keys, column)
    return rest.filter(empty | (whole & F.col(column).isNotNull()))


def not_in_payments(t: Tables) -> DataFrame:
    """Invoices whose accounting document is not in the payments' references, asked of three lists: all
    references, some of which are null; those that are known; and none."""
    invoices = t["billing_document_headers"].select("billing_document", "accounting_document")
    refs = t["payments_accounts_receivable"].select("invoice_reference")
    lists = {"all": refs, "known": refs.filter(F.col("invoice_reference").isNotNull()), "none": refs.limit(0)}
    out = None
    for name, listed in lists.items():
        rows = not_in(invoices, "accounting_document", listed, "invoice_reference").select(
            F.lit(name).alias("asked"), "billing_document", "accounting_document"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def full_join_many(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """``left FULL JOIN right USING (on)`` where a key may have any number of rows on either side.

    AQE splits neither side of a full join. This is the inner join, of which it splits both, and the rows
    of each side whose key the other doesn't have; keys of null match nothing.
    """
    matched = mix(left, on).join(mix(right, on), [on, "_mix"]).drop("_mix")
    return (
        matched.unionByName(having_no(left, right, on), allowMissingColumns=True)
        .unionByName(having_no(right, left, on), allowMissingColumns=True)
    )


def full_join_rows(t: Tables) -> DataFrame:
    """Every shipment against every invoice of its order; either side may be missing."""
    return full_join_many(
        shipped(t).select("order_id", "delivery_id", "ship_date"),
        t["invoices"].select("order_id", "invoice_id", "invoice_date"), "order_id",
    )


def _bits_set(word: Column, first: int) -> Column:
    """Numbers, from ``first`` on, of the bits of ``word`` that are set."""
    at = F.sequence(F.lit(0), F.lit(WORD - 1))
    return F.transform(F.filter(at, lambda i: F.getbit(word, i) == 1), lambda i: i + first)


def inclusions(tables: Tables, columns: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """All pairs of columns of different tables of which one's values are all found in the other.

    ``columns`` are (table, column) pairs, by default every text column; values are compared as text, nulls
    left out, columns without values too. Each distinct value is brought together with the columns that have
    it; what a column's values have in common is found from the distinct sets of columns, of which there are few,
    and no column is ever joined to another. ``referenced_is_key``: no value stands twice there.
    """
    if columns is None:
        columns = [
            (name, f.name) for name, df in tables.items() for f in df.schema.fields if f.dataType.typeName() == "string"
        ]
    names = [f"{table}.{column}" for table, column in columns]
    spark = next(iter(tables.values())).sparkSession
    # Sets of columns are bits of as many long numbers as it takes: those are aggregated by hashing, where
    # lists would have the values sorted and written to disk.
    words = range(-(-len(columns) // WORD))

    def bits(told: dict[int, Column], word: int) -> Column:
        """The columns of one word of which ``told`` is true."""
        own = [F.when(c, F.lit(1 << (i % WORD))).otherwise(F.lit(0)).cast("long") for i, c in told.items() if i // WORD == word]
        return reduce(Column.bitwiseOR, own, F.lit(0).cast("long"))

    def members(kind: str) -> Column:
        """Numbers of the columns whose bits are set."""
        return F.flatten(F.array(*(_bits_set(F.col(f"{kind}{w}"), w * WORD) for w in words)))

    held = None
    for name in dict.fromkeys(table for table, _ in columns):
        own = [(i, c) for i, (table, c) in enumerate(columns) if table == name]
        cells = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.col(c).cast("string").alias("value")) for i, c in own)))
        counts = (
            tables[name].select(cells.alias("cell")).select("cell.*").filter(F.col("value").isNotNull())
            .groupBy("value").agg(*(F.count_if(F.col("at") == i).alias(f"n{i}") for i, _ in own))
        )
        part = counts.select(
            "value", *(bits({i: F.col(f"n{i}") > 0 for i, _ in own}, w).alias(f"found{w}") for w in words),
            *(bits({i: F.col(f"n{i}") > 1 for i, _ in own}, w).alias(f"twice{w}") for w in words),
        )
        held = part if held is None else held.unionByName(part)
    # One row for each distinct set of columns.
    marks = [f"{kind}{w}" for kind in ("found", "twice") for w in words]
    sets = (
        held.groupBy("value").agg(*(F.bit_or(c).alias(c) for c in marks))
        .groupBy(*marks).agg(F.count("*").alias("n"))
        .select(members("found").alias("found"), members("twice").alias("twice"), "n")
    )
    pairs = (
        sets.select("found", "n", F.explode("found").alias("a"))
        .select("a", "n", F.explode("found").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("common"))
    )
    sizes = pairs.filter("a = b").select("a", F.col("common").alias("n_values"))
    keys = sets.select(F.explode("twice").alias("b")).distinct().withColumn("repeated", F.lit(True))
    told = spark.range(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("at", "name"))
    table = lambda c: F.substring_index(c, ".", 1)
    return (
        pairs.join(sizes, "a").filter("common = n_values").join(keys, "b", "left")
        .join(told.select(F.col("at").alias("a"), F.col("name").alias("dependent")), "a")
        .join(told.select(F.col("at").alias("b"), F.col("name").alias("referenced")), "b")
        .filter(table(F.col("dependent")) != table(F.col("referenced")))
        .select("dependent", "referenced", "n_values", F.col("repeated").isNull().alias("referenced_is_key"))
    )
