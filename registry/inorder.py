"""Analyst queries over order, spans and nulls; the SQL uses the construct itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordercash.operators import inorder
from registry.base import query

DAYS = 30
# Payments of the sample all fall into one month after all invoices: spread over the years.
_SPREAD = "clearing_date - CAST(CAST(substr(payment_id, 2) AS INT) * 37 % 10500 AS INT)"
_SPREAD_CTE = {
    "spread_payments": f"SELECT * REPLACE (CAST({_SPREAD} AS DATE) AS clearing_date) FROM o2c_payments"
}


def _spread(s):
    t = s.star()
    days = F.substring("payment_id", 2, 20).cast("int") * 37 % 10500
    return {**t, "payments": t["payments"].withColumn("clearing_date", F.date_sub("clearing_date", days))}


@query(
    "adhoc_interval_join",
    f"""SELECT i.customer_id, i.invoice_id, p.payment_id, CAST(p.clearing_date - i.invoice_date AS INT) AS days,
        p.amount
    FROM o2c_invoices i JOIN spread_payments p ON p.customer_id = i.customer_id
        AND p.clearing_date BETWEEN i.invoice_date AND i.invoice_date + {DAYS}
    WHERE i.is_cancelled = 0 AND p.is_incoming = 1""",
    number=["amount"], ctes=_SPREAD_CTE,
)
def _(s):
    return inorder.interval_join(_spread(s), DAYS)


@query(
    "adhoc_as_of_payment",
    """SELECT invoice_id, customer_id, invoice_date, paid[2] AS payment_id, paid[1] AS clearing_date
    FROM (SELECT invoice_id, customer_id, invoice_date, (
            SELECT max((CAST(p.clearing_date AS VARCHAR), p.payment_id)) FROM spread_payments p
            WHERE p.customer_id = i.customer_id AND p.clearing_date <= i.invoice_date AND p.is_incoming = 1) AS paid
        FROM o2c_invoices i WHERE is_cancelled = 0)""",
    text=["invoice_date"], ctes=_SPREAD_CTE,
)
def _(s):
    return inorder.as_of_payment(_spread(s))


@query(
    "adhoc_running_totals",
    """SELECT order_id, customer_id, order_date, total_amount, COUNT(*) OVER w AS orders_so_far,
        SUM(total_amount) OVER w AS amount_so_far, MIN(total_amount) OVER w AS least_so_far,
        MAX(total_amount) OVER w AS most_so_far,
        CAST(SUM(total_amount) OVER w AS DOUBLE) / COUNT(total_amount) OVER w AS mean_so_far
    FROM o2c_orders WINDOW w AS (PARTITION BY customer_id ORDER BY order_date NULLS LAST)""",
    text=["order_date"], number=["total_amount", "amount_so_far", "least_so_far", "most_so_far"],
)
def _(s):
    return inorder.running_totals(s.star())


@query(
    "adhoc_deep_page",
    """SELECT order_id, customer_id, total_amount FROM o2c_orders
    ORDER BY total_amount DESC NULLS FIRST, order_id LIMIT 50 OFFSET 1000""",
    number=["total_amount"],
)
def _(s):
    return inorder.deep_order_page(s.star())


@query(
    "adhoc_full_rank",
    """SELECT product_id, total_revenue, RANK() OVER w AS place, DENSE_RANK() OVER w AS dense_place
    FROM (SELECT oi.product_id, SUM(oi.net_amount) AS total_revenue FROM o2c_order_items oi
        JOIN o2c_invoices i ON i.order_id = oi.order_id AND i.is_cancelled = 0
        JOIN o2c_products p ON p.product_id = oi.product_id GROUP BY oi.product_id)
    WINDOW w AS (ORDER BY total_revenue DESC NULLS LAST)""",
    number=["total_revenue"],
)
def _(s):
    return inorder.full_rank(s.star())


@query(
    "adhoc_order_lists",
    """SELECT customer_id, n // 100 AS chunk,
        array_to_string(list(coalesce(delivery_status, '-') ORDER BY n), ',') AS statuses
    FROM (SELECT customer_id, delivery_status, row_number() OVER (PARTITION BY customer_id
            ORDER BY order_date NULLS LAST, order_id NULLS LAST) - 1 AS n FROM o2c_orders)
    GROUP BY customer_id, n // 100""",
)
def _(s):
    lists = inorder.order_lists(s.star())
    return lists.withColumn("statuses", F.array_join("statuses", ",", "-"))


_NOT_IN = """SELECT '{0}' AS asked, billing_document, accounting_document FROM billing_document_headers
    WHERE accounting_document NOT IN (SELECT invoice_reference FROM payments_accounts_receivable {1})"""


@query(
    "adhoc_not_in",
    " UNION ALL ".join([
        _NOT_IN.format("all", ""), _NOT_IN.format("known", "WHERE invoice_reference IS NOT NULL"),
        _NOT_IN.format("none", "WHERE FALSE"),
    ]),
)
def _(s):
    return inorder.not_in_payments(s.sap())


@query(
    "adhoc_full_join_rows",
    """SELECT COALESCE(d.order_id, i.order_id) AS order_id, delivery_id, ship_date, invoice_id, invoice_date
    FROM (SELECT * FROM o2c_deliveries WHERE goods_status = 'C') d
    FULL OUTER JOIN o2c_invoices i ON i.order_id = d.order_id""",
    text=["ship_date", "invoice_date"],
)
def _(s):
    return inorder.full_join_rows(s.star())


def _inclusions_sql(columns: list[tuple[str, str]], prefix: str) -> str:
    """Every column against every other."""
    cells = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{t}.{c}' AS c, CAST(\"{c}\" AS VARCHAR) AS v FROM {prefix}{t} WHERE \"{c}\" IS NOT NULL"
        for t, c in columns
    )
    return f"""SELECT a.c AS dependent, b.c AS referenced, count(*) AS n_values, r.keyed AS referenced_is_key
    FROM (SELECT DISTINCT t, c, v FROM cells) a JOIN (SELECT DISTINCT t, c, v FROM cells) b ON a.v = b.v AND a.t <> b.t
    JOIN (SELECT c, count(DISTINCT v) AS size FROM cells GROUP BY c) s ON s.c = a.c
    JOIN (SELECT c, count(DISTINCT v) = count(*) AS keyed FROM cells GROUP BY c) r ON r.c = b.c
    GROUP BY a.c, b.c, s.size, r.keyed HAVING count(*) = s.size""".replace("cells", f"({cells})")


# Text columns of the sample's tables, as the SQL of them has.
STAR_COLUMNS = [
    ("customers", "customer_id"), ("customers", "name"), ("orders", "order_id"), ("orders", "customer_id"),
    ("order_items", "order_id"), ("order_items", "product_id"), ("order_items", "line_no"),
    ("deliveries", "delivery_id"), ("deliveries", "order_id"), ("invoices", "invoice_id"),
    ("invoices", "order_id"), ("invoices", "customer_id"), ("payments", "payment_id"),
    ("payments", "customer_id"), ("products", "product_id"), ("products", "product_name"),
]
SAP_COLUMNS = [
    ("sales_order_headers", "sales_order"), ("sales_order_headers", "sold_to_party"),
    ("sales_order_items", "sales_order"), ("sales_order_items", "material"),
    ("outbound_delivery_items", "delivery_document"), ("outbound_delivery_items", "reference_sd_document"),
    ("billing_document_headers", "billing_document"), ("billing_document_headers", "accounting_document"),
    ("billing_document_headers", "sold_to_party"), ("billing_document_items", "billing_document"),
    ("billing_document_items", "reference_sd_document"), ("payments_accounts_receivable", "accounting_document"),
    ("payments_accounts_receivable", "invoice_reference"), ("payments_accounts_receivable", "customer"),
    ("business_partners", "business_partner"), ("business_partners", "customer"),
]


@query("inclusions", _inclusions_sql(STAR_COLUMNS, "o2c_"))
def _(s):
    return inorder.inclusions(s.star(), STAR_COLUMNS)


@query("inclusions_documents", _inclusions_sql(SAP_COLUMNS, ""))
def _(s):
    return inorder.inclusions(s.sap(), SAP_COLUMNS)
