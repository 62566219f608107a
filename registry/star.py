"""Fixed queries over the star model; the SQL says what each rule says of the sample's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordercash.model import STAR_RELATIONSHIPS
from ordercash.operators import analytics, customers, orders, products
from ordercash.sources import tables
from ordercash.sources.sample import NET
from registry.base import query

ORDER = "7"
BLOCKED = "SELECT customer_id FROM o2c_customers WHERE is_blocked = 1"
ORDER_TEXT = ("order_date", "requested_delivery_date")


def blocked(t):
    return t["customers"].filter(F.col("is_blocked") == 1)


@query(
    "list_customers",
    "SELECT * FROM o2c_customers WHERE is_blocked = 1 ORDER BY customer_id LIMIT 50 OFFSET 10",
    text=["created_date"],
)
def _(s):
    return customers.list_customers(s.star(), blocked=True, offset=10)


@query(
    "get_customer",
    """SELECT * FROM o2c_customers WHERE customer_id IN (
        SELECT customer_id FROM o2c_payments WHERE is_incoming = 1)""",
    text=["created_date"],
)
def _(s):
    t = s.star()
    return customers.get_customer(t, orders.incoming_payments(t))


@query(
    "customer_orders",
    f"""WITH wanted AS (SELECT * FROM o2c_orders WHERE customer_id IN ({BLOCKED}))
    SELECT w.*, delivery_id, goods_status, ship_date, NULL AS invoice_id, NULL AS invoice_amount,
        NULL AS is_cancelled FROM wanted w, o2c_deliveries d WHERE d.order_id = w.order_id
    UNION ALL
    SELECT w.*, NULL, NULL, NULL, invoice_id, i.total_amount, is_cancelled
        FROM wanted w, o2c_invoices i WHERE i.order_id = w.order_id
    UNION ALL
    SELECT w.*, NULL, NULL, NULL, NULL, NULL, NULL FROM wanted w
        WHERE order_id NOT IN (SELECT order_id FROM o2c_deliveries)
            AND order_id NOT IN (SELECT order_id FROM o2c_invoices)""",
    text=[*ORDER_TEXT, "ship_date"], number=["total_amount", "invoice_amount"],
)
def _(s):
    t = s.star()
    return customers.customer_orders(t, blocked(t))


# Each amount counts once for every pair of rows of the two other tables; a table without rows of
# the customer counts as one. Straight over the sample: live invoices are the returned-as-A lines
# of an order, payments are the purchase and error events.
_SUMMARY = f"""SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name,
        CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_blocked,
        COALESCE(n_orders, 0) AS total_orders,
        COALESCE(invoiced, 0) * COALESCE(n_orders, 1) * COALESCE(n_events, 1) AS total_invoiced,
        COALESCE(received, 0) * COALESCE(n_orders, 1) * COALESCE(n_live, 1) AS total_paid
    FROM customer
    LEFT JOIN (SELECT o_custkey AS c_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey)
        USING (c_custkey)
    LEFT JOIN (SELECT o_custkey AS c_custkey, COUNT(DISTINCT o_orderkey) AS n_live,
            SUM({NET}) AS invoiced
        FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_returnflag = 'A'
        GROUP BY o_custkey) USING (c_custkey)
    LEFT JOIN (SELECT user_id AS c_custkey, COUNT(*) AS n_events,
            SUM(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase') AS received
        FROM events WHERE event_type = 'purchase' OR event_type = 'error'
        GROUP BY user_id) USING (c_custkey)
    {{where}}"""


@query(
    "customer_summary",
    _SUMMARY.format(where="WHERE c_acctbal < 0"),
    number=["total_invoiced", "total_paid"],
)
def _(s):
    t = s.star()
    return customers.customer_summary(t, blocked(t))


@query(
    "customer_summary_all",
    f"""SELECT *, total_invoiced - total_paid AS outstanding FROM ({_SUMMARY.format(where='')})
    ORDER BY outstanding DESC NULLS FIRST, customer_id""",
    number=["total_invoiced", "total_paid", "outstanding"],
)
def _(s):
    return customers.customer_summary_all(s.star())


@query(
    "customer_summary_net",
    """SELECT *, total_invoiced - total_paid AS outstanding FROM (
        SELECT c.customer_id, c.name, c.is_blocked,
            (SELECT COUNT(*) FROM o2c_orders o WHERE o.customer_id = c.customer_id)
                AS total_orders,
            (SELECT COALESCE(SUM(i.total_amount), 0) FROM o2c_invoices i
                WHERE i.customer_id = c.customer_id AND i.is_cancelled = 0) AS total_invoiced,
            (SELECT COALESCE(SUM(p.amount), 0) FROM o2c_payments p
                WHERE p.customer_id = c.customer_id AND p.is_incoming = 1) AS total_paid
        FROM o2c_customers c)""",
    number=["total_invoiced", "total_paid", "outstanding"],
)
def _(s):
    return customers.customer_summary_net(s.star())


@query(
    "list_products",
    """SELECT * FROM o2c_products WHERE product_type = 'SMALL' AND is_deleted = 0
    ORDER BY product_id LIMIT 50""",
)
def _(s):
    return products.list_products(s.star(), product_type="SMALL")


@query(
    "get_product",
    """SELECT * FROM o2c_products WHERE product_id IN (
        SELECT product_id FROM o2c_order_items WHERE quantity >= 50)""",
)
def _(s):
    t = s.star()
    return products.get_product(t, t["order_items"].filter(F.col("quantity") >= 50))


@query(
    "list_orders",
    """SELECT order_id, customer_id, (SELECT name FROM o2c_customers c
            WHERE c.customer_id = o.customer_id) AS customer_name, order_date, total_amount,
        currency, delivery_status, process_status FROM o2c_orders o
    ORDER BY order_date DESC NULLS FIRST, order_id LIMIT 50 OFFSET 5""",
    text=["order_date"], number=["total_amount"],
)
def _(s):
    return orders.list_orders(s.star(), offset=5)


@query(
    "get_order",
    """SELECT * FROM o2c_orders WHERE order_id IN (
        SELECT order_id FROM o2c_invoices WHERE is_cancelled = 1)""",
    text=ORDER_TEXT, number=["total_amount"],
)
def _(s):
    t = s.star()
    return orders.get_order(t, t["invoices"].filter(F.col("is_cancelled") == 1))


@query(
    "incomplete_delivery",
    """SELECT order_id, (SELECT name FROM o2c_customers c
            WHERE c.customer_id = o.customer_id) AS customer_name, order_date, total_amount,
        delivery_status
    FROM o2c_orders o WHERE order_id NOT IN (SELECT order_id FROM o2c_deliveries)""",
    text=["order_date"], number=["total_amount"],
)
def _(s):
    return orders.incomplete_orders(s.star(), "delivery")


# An order is shipped with its lines of status F that are delivered, and billed with any line that is not
# free; both are told from all of its lines at once.
_SHIPPED_LINE = "l_linestatus = 'F' AND l_suppkey % 3 <> 0"
_LAST_SHIP = f"CAST(MAX(CASE WHEN {_SHIPPED_LINE} THEN l_shipdate END) AS DATE)"
_UNBILLED = f"bool_and(l_returnflag = 'N') AND bool_or({_SHIPPED_LINE})"


@query(
    "incomplete_billing",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
        CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
        'D' || l_orderkey || 'F' AS delivery_id, {_LAST_SHIP} AS ship_date
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    GROUP BY l_orderkey, o_totalprice HAVING {_UNBILLED}""",
    text=["ship_date"], number=["total_amount"],
)
def _(s):
    return orders.incomplete_orders(s.star(), "billing")


# Neither free nor taken back is live; an invoice is what the lines of one mark of an order come to.
_NEVER_PAID = f"""FROM (
        SELECT 'I' || l_orderkey || l_returnflag AS invoice_id, c_name AS customer_name,
            CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_blocked,
            CAST(MIN(l_shipdate) AS DATE) AS invoice_date, SUM({NET}) AS total_amount
        FROM lineitem, orders, customer
        WHERE l_returnflag NOT IN ('N', 'R') AND o_orderkey = l_orderkey AND c_custkey = o_custkey
            AND (SELECT COUNT(*) FROM events WHERE user_id = c_custkey AND event_type = 'purchase') = 0
        GROUP BY l_orderkey, l_returnflag, c_custkey, c_name, c_acctbal)"""


@query(
    "incomplete_payment",
    f"SELECT invoice_id, customer_name, invoice_date, total_amount {_NEVER_PAID}",
    text=["invoice_date"], number=["total_amount"],
)
def _(s):
    return orders.incomplete_orders(s.star(), "payment")


ORDER_FLOW_ALL = """SELECT o.order_id, o.customer_id, c.name AS customer_name,
        o.total_amount AS order_amount, o.delivery_status, o.requested_delivery_date,
        x.delivery_id, x.ship_date, x.goods_status, x.picking_status,
        x.invoice_id, x.invoice_date, x.invoice_amount, x.is_cancelled,
        (SELECT COUNT(*) FROM o2c_payments p
            WHERE p.customer_id = o.customer_id AND p.is_incoming = 1) AS n_payments,
        (SELECT SUM(amount) FROM o2c_payments p
            WHERE p.customer_id = o.customer_id AND p.is_incoming = 1) AS payment_amount,
        (SELECT MAX(clearing_date) FROM o2c_payments p
            WHERE p.customer_id = o.customer_id AND p.is_incoming = 1) AS last_clearing_date
    FROM o2c_orders o LEFT JOIN o2c_customers c ON c.customer_id = o.customer_id
    LEFT JOIN (
        SELECT order_id, delivery_id, ship_date, goods_status, picking_status,
            NULL AS invoice_id, NULL AS invoice_date, NULL AS invoice_amount,
            NULL AS is_cancelled FROM o2c_deliveries
        UNION ALL
        SELECT order_id, NULL, NULL, NULL, NULL,
            invoice_id, invoice_date, total_amount, is_cancelled FROM o2c_invoices
    ) x ON x.order_id = o.order_id"""


@query(
    "order_flow",
    f"SELECT * FROM ({ORDER_FLOW_ALL}) WHERE order_id = '{ORDER}'",
    text=["requested_delivery_date", "ship_date", "invoice_date", "last_clearing_date"],
    number=["order_amount", "invoice_amount", "payment_amount"],
)
def _(s):
    return orders.order_flow(s.star(), ORDER)


@query(
    "order_flow_all",
    ORDER_FLOW_ALL,
    text=["requested_delivery_date", "ship_date", "invoice_date", "last_clearing_date"],
    number=["order_amount", "invoice_amount", "payment_amount"],
)
def _(s):
    return orders.order_flow_all(s.star())


@query(
    "order_items",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS VARCHAR) AS line_no,
        CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
        'EA' AS unit, {NET} AS net_amount, CAST(l_suppkey AS VARCHAR) AS plant,
        l_returnflag AS item_category, l_linestatus AS delivery_status,
        p_name AS product_name, p_type AS product_type, p_brand AS old_sku
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
    WHERE '1-URGENT' = ANY (SELECT o_orderpriority FROM orders WHERE o_orderkey = l_orderkey)""",
    number=["quantity", "net_amount"],
)
def _(s):
    t = s.star()
    return orders.order_items(t, t["orders"].filter(F.col("order_type") == "1-URGENT"))


@query(
    "top_products",
    # A line counts once for each live invoice of its order, of which the sample has at most one.
    f"""SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name,
        p_type AS product_type, p_brand AS old_sku, total_orders, total_revenue, total_units_sold
    FROM part, (
        SELECT l_partkey, COUNT(DISTINCT l_orderkey) AS total_orders, SUM({NET}) AS total_revenue,
            SUM(CAST(l_quantity AS DECIMAL(18,2))) AS total_units_sold
        FROM lineitem
        WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
        GROUP BY l_partkey)
    WHERE l_partkey = p_partkey
    ORDER BY total_revenue DESC NULLS FIRST, product_id LIMIT 10""",
    number=["total_revenue", "total_units_sold"],
)
def _(s):
    return products.top_products(s.star())


@query(
    "delivery_performance",
    f"""SELECT COUNT(days) AS shipped_orders, ROUND(AVG(days), 1) AS avg_days,
        MIN(days) AS min_days, MAX(days) AS max_days
    FROM (SELECT CAST({_LAST_SHIP} - CAST(o_orderdate AS DATE) AS INT) AS days
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_orderdate)""",
)
def _(s):
    return analytics.delivery_performance(s.star())


@query(
    "revenue_leakage",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS order_id, c_name AS customer_name,
        {_LAST_SHIP} AS ship_date, CAST(o_totalprice AS DECIMAL(18,2)) AS order_amount
    FROM lineitem, orders, customer WHERE o_orderkey = l_orderkey AND c_custkey = o_custkey
    GROUP BY l_orderkey, c_custkey, c_name, o_totalprice HAVING {_UNBILLED}""",
    text=["ship_date"], number=["order_amount"],
)
def _(s):
    return analytics.revenue_leakage(s.star())


@query(
    "overdue_ar",
    f"""SELECT invoice_id, customer_name, is_blocked, invoice_date, total_amount
    {_NEVER_PAID}""",
    text=["invoice_date"], number=["total_amount"],
)
def _(s):
    return analytics.overdue_ar(s.star())


@query(
    "stage_counts",
    """SELECT * FROM
    (SELECT COUNT(*) AS total_customers, COUNT(*) FILTER (WHERE is_blocked = 1)
        AS blocked_customers FROM o2c_customers),
    (SELECT COUNT(*) AS total_orders FROM o2c_orders),
    (SELECT COUNT(DISTINCT order_id) AS orders_delivered FROM o2c_deliveries
        WHERE goods_status = 'C'),
    (SELECT COUNT(DISTINCT order_id) FILTER (WHERE is_cancelled = 0) AS orders_billed,
        COUNT(*) AS total_invoices, COUNT(*) FILTER (WHERE is_cancelled = 1)
        AS cancelled_invoices FROM o2c_invoices),
    (SELECT COUNT(*) AS total_payments_received FROM o2c_payments WHERE is_incoming = 1),
    (SELECT COUNT(*) AS total_products FROM o2c_products WHERE is_deleted = 0)""",
)
def _(s):
    return analytics.stage_counts(s.star())


def orphans_sql(r, prefix: str = "o2c_") -> str:
    return f"""SELECT '{r.child}.{r.child_key}' AS child, '{r.parent}.{r.parent_key}' AS parent,
        COUNT(*) AS child_rows,
        COUNT(CASE WHEN c.{r.child_key} IS NULL THEN 1 END) AS null_keys,
        COUNT(CASE WHEN c.{r.child_key} IS NOT NULL AND p.{r.parent_key} IS NULL THEN 1 END)
            AS orphans
    FROM {prefix}{r.child} c LEFT JOIN (SELECT DISTINCT {r.parent_key} FROM {prefix}{r.parent}) p
        ON p.{r.parent_key} = c.{r.child_key}"""


@query("relationship_check", " UNION ALL ".join(orphans_sql(r) for r in STAR_RELATIONSHIPS))
def _(s):
    return analytics.relationship_check(s.star())


def _keys(table: str, key: str) -> str:
    return f"""SELECT '{table}' AS table_name, CAST(SUM(n) AS BIGINT) AS n_rows,
        CAST(SUM(CASE WHEN k IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_keys,
        COUNT(CASE WHEN k IS NOT NULL AND n > 1 THEN 1 END) AS repeated_keys
    FROM (SELECT {key} AS k, COUNT(*) AS n FROM o2c_{table} GROUP BY {key})"""


@query("check_keys", " UNION ALL ".join(_keys(t, k) for t, k in tables.KEYS.items()))
def _(s):
    return tables.check_keys(s.star())
