"""Analyst queries, one per SQL construct; the SQL uses the construct itself."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ordercash.operators import adhoc
from registry.base import query

AS_OF = date(2001, 12, 31)
_DAY = f"DATE '{AS_OF}'"


@query(
    "adhoc_inner_join",
    """SELECT oi.order_id, oi.line_no, oi.product_id, oi.net_amount, o.customer_id, o.order_date
    FROM o2c_order_items oi INNER JOIN o2c_orders o ON o.order_id = oi.order_id""",
    text=["order_date"], number=["net_amount"],
)
def _(s):
    return adhoc.inner_join(s.star())


@query(
    "adhoc_left_join",
    """SELECT o.order_id, o.customer_id, o.total_amount, i.invoice_id,
        i.total_amount AS invoice_amount
    FROM o2c_orders o LEFT JOIN o2c_invoices i
        ON i.order_id = o.order_id AND i.is_cancelled = 0""",
    number=["total_amount", "invoice_amount"],
)
def _(s):
    return adhoc.left_join(s.star())


@query(
    "adhoc_right_join",
    """SELECT c.customer_id, c.name, p.n_payments, p.paid FROM (
        SELECT customer_id, COUNT(*) AS n_payments, SUM(amount) AS paid
        FROM o2c_payments GROUP BY customer_id) AS p
    RIGHT JOIN o2c_customers c ON c.customer_id = p.customer_id""",
    number=["paid"],
)
def _(s):
    return adhoc.right_join(s.star())


@query(
    "adhoc_full_join",
    """SELECT COALESCE(d.order_id, i.order_id) AS order_id, n_shipped, n_invoices FROM (
        SELECT order_id, COUNT(*) AS n_shipped FROM o2c_deliveries WHERE goods_status = 'C'
        GROUP BY order_id) d
    FULL OUTER JOIN (SELECT order_id, COUNT(*) AS n_invoices FROM o2c_invoices
        GROUP BY order_id) i ON i.order_id = d.order_id""",
)
def _(s):
    return adhoc.full_join(s.star())


@query(
    "adhoc_cross_join",
    """SELECT order_type, delivery_status, COUNT(order_id) AS n_orders
    FROM (SELECT order_type, delivery_status, order_id FROM o2c_orders
        UNION ALL SELECT DISTINCT order_type, code, CAST(NULL AS VARCHAR)
        FROM o2c_orders CROSS JOIN (VALUES ('A'), ('B'), ('C')) AS c(code))
    GROUP BY order_type, delivery_status""",
)
def _(s):
    return adhoc.cross_join(s.star())


@query(
    "adhoc_theta_join",
    f"""SELECT band, COUNT(*) AS n_invoices, SUM(total_amount) AS amount
    FROM (SELECT {_DAY} - invoice_date AS age, total_amount FROM o2c_invoices
        WHERE is_cancelled = 0) i
    JOIN (VALUES ('current', -100000, 0), ('1-30', 1, 30), ('31-90', 31, 90),
        ('91-365', 91, 365), ('over 365', 366, 100000)) AS b(band, lo, hi)
    ON i.age >= b.lo AND i.age <= b.hi GROUP BY band""",
    number=["amount"],
)
def _(s):
    return adhoc.theta_join(s.star(), AS_OF)


@query(
    "adhoc_semi_join",
    """SELECT customer_id, name FROM o2c_customers c WHERE EXISTS (
        SELECT 1 FROM o2c_orders o WHERE o.customer_id = c.customer_id
        AND o.total_amount > 400000)""",
)
def _(s):
    return adhoc.semi_join(s.star(), over=400_000)


@query(
    "adhoc_anti_join",
    """SELECT product_id, product_name FROM o2c_products p WHERE NOT EXISTS (
        SELECT 1 FROM o2c_order_items i WHERE i.product_id = p.product_id
        AND i.quantity >= 45)""",
)
def _(s):
    t = s.star()
    bulk = t["order_items"].filter(F.col("quantity") >= 45)
    return adhoc.anti_join({**t, "order_items": bulk})


@query(
    "adhoc_filter",
    """SELECT order_id, customer_id, order_date, order_type, total_amount FROM o2c_orders
    WHERE delivery_status IN ('A', 'B')
        AND order_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'
        AND requested_delivery_date IS NOT NULL
        AND (order_type = '1-URGENT' OR NOT total_amount <= 200000)""",
    text=["order_date"], number=["total_amount"],
)
def _(s):
    return adhoc.filters(s.star(), date(1996, 1, 1), date(1998, 6, 30))


@query(
    "adhoc_like",
    """SELECT product_id, old_sku, product_type FROM o2c_products
    WHERE old_sku LIKE 'Brand#1_' OR product_type ILIKE 'econ%'""",
)
def _(s):
    return adhoc.like(s.star(), "Brand#1_", "econ%")


@query(
    "adhoc_group_having",
    """SELECT customer_id, COUNT(*) AS n_orders, SUM(total_amount) AS total,
        ROUND(CAST(AVG(total_amount) AS DECIMAL(28,8)), 2) AS mean,
        MIN(total_amount) AS least, MAX(total_amount) AS most
    FROM o2c_orders GROUP BY customer_id HAVING COUNT(*) >= 5""",
    number=["total", "mean", "least", "most"],
)
def _(s):
    return adhoc.group_having(s.star())


@query("adhoc_distinct", "SELECT DISTINCT customer_id, delivery_status FROM o2c_orders")
def _(s):
    return adhoc.distinct(s.star())


@query(
    "adhoc_count_distinct",
    """SELECT order_type, COUNT(*) AS n_orders, COUNT(DISTINCT customer_id) AS n_customers
    FROM o2c_orders GROUP BY order_type""",
)
def _(s):
    return adhoc.count_distinct(s.star())


@query(
    "adhoc_case",
    """SELECT size, COUNT(*) AS n_orders, SUM(total_amount) AS total,
        CASE WHEN size = 'small' THEN FALSE ELSE TRUE END AS is_notable
    FROM (SELECT total_amount, CASE WHEN total_amount < 50000 THEN 'small'
        WHEN total_amount < 200000 THEN 'medium' ELSE 'large' END AS size FROM o2c_orders)
    GROUP BY size""",
    number=["total"],
)
def _(s):
    return adhoc.case(s.star())


@query(
    "adhoc_union_all",
    """SELECT order_id, 'delivery' AS kind, delivery_id AS id FROM o2c_deliveries
    UNION ALL SELECT order_id, 'invoice', invoice_id FROM o2c_invoices""",
)
def _(s):
    return adhoc.union_all(s.star())


@query(
    "adhoc_union",
    "SELECT customer_id FROM o2c_invoices UNION SELECT customer_id FROM o2c_payments",
)
def _(s):
    return adhoc.union(s.star())


@query(
    "adhoc_order_page",
    """SELECT order_id, customer_id, total_amount FROM o2c_orders
    ORDER BY total_amount DESC NULLS FIRST, order_id LIMIT 50 OFFSET 100""",
    number=["total_amount"],
)
def _(s):
    return adhoc.order_page(s.star())


@query(
    "adhoc_row_number",
    """SELECT * FROM (SELECT customer_id, order_id, order_date, CAST(ROW_NUMBER() OVER (
        PARTITION BY customer_id ORDER BY order_date DESC NULLS FIRST, order_id) AS INT) AS n
        FROM o2c_orders) WHERE n <= 3""",
    text=["order_date"],
)
def _(s):
    return adhoc.row_number(s.star())


@query(
    "adhoc_rank",
    """SELECT * FROM (SELECT product_type, product_id, total_revenue, RANK() OVER (
            PARTITION BY product_type ORDER BY total_revenue DESC NULLS FIRST) AS place
        FROM (SELECT product_type, product_id, SUM(net_amount) AS total_revenue
            FROM o2c_products JOIN o2c_order_items USING (product_id)
            JOIN (SELECT order_id FROM o2c_invoices WHERE is_cancelled = 0) USING (order_id)
            GROUP BY product_type, product_id))
    WHERE place <= 3""",
    number=["total_revenue"],
)
def _(s):
    return adhoc.rank(s.star())


@query(
    "adhoc_window_agg",
    """SELECT DISTINCT customer_id, order_date,
        COUNT(*) OVER w AS orders_so_far, SUM(total_amount) OVER w AS amount_so_far,
        MIN(total_amount) OVER w AS least_so_far, MAX(total_amount) OVER w AS most_so_far,
        SUM(total_amount) OVER (PARTITION BY customer_id) AS amount_in_all
    FROM o2c_orders WINDOW w AS (PARTITION BY customer_id ORDER BY order_date)""",
    text=["order_date"],
    number=["amount_so_far", "least_so_far", "most_so_far", "amount_in_all"],
)
def _(s):
    return adhoc.window_agg(s.star())


@query(
    "adhoc_scalar_subquery",
    """SELECT order_id, total_amount FROM o2c_orders
    WHERE total_amount > (SELECT AVG(total_amount) FROM o2c_orders)""",
    number=["total_amount"],
)
def _(s):
    return adhoc.scalar_subquery(s.star())


@query(
    "adhoc_correlated_subquery",
    """SELECT order_id, customer_id, total_amount FROM o2c_orders o
    WHERE total_amount > (SELECT AVG(total_amount) FROM o2c_orders x
        WHERE x.customer_id = o.customer_id)""",
    number=["total_amount"],
)
def _(s):
    return adhoc.correlated_subquery(s.star())


@query(
    "adhoc_nullfn",
    """SELECT delivery_id, COALESCE(ship_date, DATE '1998-01-01') AS filled,
        NULLIF(goods_status, 'A') AS status, GREATEST(ship_date, DATE '1998-01-01') AS later,
        LEAST(ship_date, DATE '1998-01-01') AS earlier FROM o2c_deliveries""",
    text=["filled", "later", "earlier"],
)
def _(s):
    return adhoc.null_functions(s.star(), date(1998, 1, 1))


@query(
    "adhoc_cast",
    """SELECT order_id, CAST(line_no AS INTEGER) AS line,
        CAST(quantity AS VARCHAR) AS quantity_text, CAST(ROUND(net_amount, 0) AS BIGINT)
        AS net_whole, CAST(CAST(line_no AS INTEGER) AS BOOLEAN) AS has_line,
        CAST(net_amount AS DECIMAL(18,2)) AS net_cents FROM o2c_order_items""",
    number=["net_cents"],
)
def _(s):
    return adhoc.cast(s.star())


@query(
    "adhoc_date_now",
    f"""SELECT order_id, requested_delivery_date,
        CAST({_DAY} - requested_delivery_date AS INT) AS days_late
    FROM o2c_orders WHERE delivery_status <> 'C'
        AND requested_delivery_date < {_DAY} - INTERVAL 30 DAY""",
    text=["requested_delivery_date"],
)
def _(s):
    return adhoc.date_now(s.star(), AS_OF)


@query(
    "adhoc_date_trunc",
    """SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, COUNT(*) AS n_orders,
        SUM(total_amount) AS amount FROM o2c_orders GROUP BY ALL""",
    text=["month"], number=["amount"],
)
def _(s):
    return adhoc.date_trunc(s.star())


@query(
    "adhoc_to_char",
    """SELECT order_id, strftime(order_date, '%Y-%m') AS month_text,
        strftime(order_date, '%d/%m/%Y') AS day_text FROM o2c_orders""",
)
def _(s):
    return adhoc.to_char(s.star())


@query(
    "adhoc_to_date",
    """SELECT invoice_id, CAST(strptime(strftime(invoice_date, '%Y%m%d'), '%Y%m%d') AS DATE)
        AS day, CAST(invoice_date - CAST(date_trunc('month', invoice_date) AS DATE) AS INT)
        AS days_in
    FROM o2c_invoices""",
    text=["day"],
)
def _(s):
    return adhoc.to_date(s.star())


@query(
    "adhoc_round",
    """SELECT order_id, line_no, ROUND(net_amount, 2) AS to_cents,
        ROUND(net_amount, 0) AS to_units FROM o2c_order_items""",
    number=["to_cents", "to_units"],
)
def _(s):
    return adhoc.rounding(s.star())


@query(
    "adhoc_string",
    """SELECT customer_id, SUBSTRING(name, 1, 8) AS short_name, UPPER(name) AS upper_name,
        LOWER("grouping") AS lower_group,
        CONCAT(name, '/', NULLIF("grouping", 'BUILDING')) AS label FROM o2c_customers""",
)
def _(s):
    return adhoc.strings(s.star())


@query(
    "adhoc_array_agg",
    """SELECT customer_id, string_agg(DISTINCT coalesce(delivery_status, '~'), ','
        ORDER BY coalesce(delivery_status, '~')) AS statuses FROM o2c_orders GROUP BY customer_id""",
)
def _(s):
    arrays = adhoc.array_agg(s.star())
    return arrays.withColumn("statuses", F.array_join("statuses", ",", "~"))


@query(
    "adhoc_json_agg",
    """SELECT order_type, '[' || string_agg('{"status":' || coalesce('"' || delivery_status || '"', 'null')
            || ',"orders":' || n || '}', ',' ORDER BY delivery_status NULLS LAST) || ']' AS by_status
    FROM (SELECT order_type, delivery_status, COUNT(*) AS n FROM o2c_orders GROUP BY ALL)
    GROUP BY order_type""",
)
def _(s):
    return adhoc.json_agg(s.star())


@query(
    "adhoc_json_object",
    """SELECT product_id, CAST(json_object('id', product_id, 'type', product_type, 'deleted',
        is_deleted) AS VARCHAR) AS object FROM o2c_products""",
)
def _(s):
    return adhoc.json_build_object(s.star())


@query(
    "adhoc_unnest",
    "SELECT DISTINCT customer_id, delivery_status AS status FROM o2c_orders",
)
def _(s):
    return adhoc.unnest(s.star())


@query(
    "adhoc_extract",
    """SELECT CAST(EXTRACT(YEAR FROM invoice_date) AS INT) AS year,
        CAST(EXTRACT(MONTH FROM invoice_date) AS INT) AS month,
        COUNT(*) AS n_invoices, SUM(total_amount) AS amount FROM o2c_invoices GROUP BY ALL""",
    number=["amount"],
)
def _(s):
    return adhoc.extract(s.star())
