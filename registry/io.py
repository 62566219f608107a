"""Sources, sinks and derived models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercash.operators import adhoc, orders
from ordercash.session import scratch_dir
from ordercash.sources import sap, sinks, tables
from registry.base import query


#: Rows of a compressed file of JSON lines: some 200 MB of text.
FILE_ROWS = 1_000_000
# Columns of the given tables by how they are written as text: as they are, with four digits, or with micros.
_GIVEN = {
    "customer": "c_custkey c_name c_nationkey c_acctbal:number c_mktsegment",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:number o_orderdate:time o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:number l_extendedprice:number "
    "l_discount:number l_tax:number l_returnflag l_linestatus l_shipdate:time",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice:number",
    "events": "event_id ts:time user_id event_type value:number props",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal:number",
    "nation": "n_nationkey n_name n_regionkey",
}
# Columns of the document tables that the sample has.
_DOCUMENTS = {
    "business_partners": "business_partner customer business_partner_name business_partner_full_name "
    "business_partner_is_blocked business_partner_grouping last_change_date",
    "products": "product product_type product_old_id is_marked_for_deletion",
    "product_descriptions": "product language product_description",
    "sales_order_headers": "sales_order sold_to_party creation_date total_net_amount:number overall_delivery_status",
    "sales_order_items": "sales_order sales_order_item material requested_quantity:number net_amount:number",
    "outbound_delivery_headers": "delivery_document actual_goods_movement_date overall_goods_movement_status "
    "overall_picking_status",
    "outbound_delivery_items": "delivery_document delivery_document_item reference_sd_document "
    "reference_sd_document_item",
    "billing_document_headers": "billing_document accounting_document sold_to_party billing_document_date "
    "total_net_amount:number billing_document_is_cancelled",
    "billing_document_items": "billing_document material net_amount:number reference_sd_document "
    "reference_sd_document_item",
    "payments_accounts_receivable": "accounting_document invoice_reference customer clearing_date",
}
_DOCUMENT_CTES = {
    "products_rows": """SELECT CAST(p_partkey AS VARCHAR) AS product, p_type AS product_type,
        p_brand AS product_old_id, p_size > 45 AS is_marked_for_deletion FROM part""",
    "product_descriptions_rows": """SELECT CAST(p_partkey AS VARCHAR) AS product, 'EN' AS language,
        p_name AS product_description FROM part""",
    "outbound_delivery_headers_rows": """SELECT delivery_id AS delivery_document,
        ship_date AS actual_goods_movement_date, goods_status AS overall_goods_movement_status,
        picking_status AS overall_picking_status FROM o2c_deliveries""",
}


def _columns(told: str) -> list[tuple[str, str]]:
    return [(c, kind or "text") for c, _, kind in (x.partition(":") for x in told.split())]


def _lines_sql(tables: dict[str, str], rows: str = "{}") -> str:
    """A digest of each row with all its columns."""
    form = {
        "text": "CAST({} AS VARCHAR)", "number": "CAST(CAST({} AS DECIMAL(18,4)) AS VARCHAR)",
        "time": "strftime({}, '%Y-%m-%d %H:%M:%S.%f')",
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, md5(concat_ws('|', "
        + ", ".join(f"coalesce({form[kind].format(c)}, '~')" for c, kind in _columns(told))
        + f")) AS row_digest FROM {rows.format(name) if rows.format(name) in _DOCUMENT_CTES else name}"
        for name, told in tables.items()
    )


def _lines(loaded, tables: dict[str, str]) -> DataFrame:
    form = {
        "text": lambda c: F.col(c).cast("string"),
        "number": lambda c: F.col(c).cast("decimal(18,4)").cast("string"),
        "time": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    }
    parts = [
        loaded[name].select(
            F.lit(name).alias("name"),
            F.md5(F.concat_ws("|", *(F.coalesce(form[kind](c), F.lit("~")) for c, kind in _columns(told)))).alias("row_digest"),
        )
        for name, told in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("load_o2c", _lines_sql(_GIVEN))
def _(s):
    """The given parquet files loaded by name: a digest of every row with all its columns."""
    return _lines(tables.load_o2c(s.spark, s.root, _GIVEN), _GIVEN)


@query("load_jsonl", _lines_sql(_DOCUMENTS, "{}_rows"), ctes=_DOCUMENT_CTES)
def _(s):
    """All ten tables written as JSON lines and loaded with their declared schemas: a digest of every row.

    Lines repeat every name in every row, so they are written compressed; such a file is read by one task,
    and so holds ``FILE_ROWS`` rows at most.
    """
    root = scratch_dir(s.spark, "jsonl")
    given = s.sap()
    for name in _DOCUMENTS:
        given[name].write.option("maxRecordsPerFile", FILE_ROWS).json(f"{root}/{name}", compression="gzip")
    return _lines(tables.load_jsonl(s.spark, root), _DOCUMENTS)


@query(
    "export_rows",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, CAST(ts AS DATE) AS day,
        CAST(value AS DECIMAL(18,2)) AS amount FROM events WHERE date_part('us', ts) % 1000000 > 0
    UNION ALL SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S'), CAST(ts AS DATE),
        CAST(value AS DECIMAL(18,2)) FROM events WHERE date_part('us', ts) % 1000000 = 0""",
    text=["day"], number=["amount"],
)
def _(s):
    return sinks.export_rows(
        s.raw("events").selectExpr(
            "event_id", "ts", "CAST(ts AS DATE) AS day", "CAST(value AS DECIMAL(18,2)) AS amount"
        )
    )


@query(
    "write_json",
    "SELECT order_id, order_date, total_amount FROM o2c_orders",
    text=["order_date"], number=["total_amount"],
)
def _(s):
    """Orders exported as JSON lines and read back as the text and doubles they became."""
    path = scratch_dir(s.spark, "export")
    sinks.write_json(s.star()["orders"].select("order_id", "order_date", "total_amount"), path)
    return s.spark.read.schema("order_id string, order_date string, total_amount double").json(
        path
    )


@query(
    "preview",
    """SELECT order_id, total_amount FROM o2c_orders
    WHERE total_amount > (SELECT AVG(total_amount) FROM o2c_orders)
    ORDER BY order_id LIMIT 50""",
    number=["total_amount"],
)
def _(s):
    return sinks.preview(adhoc.scalar_subquery(s.star()).orderBy("order_id"))


_NULL = "CAST(NULL AS VARCHAR) AS"
_FROM_SAP = {
    "customers": (
        f"""SELECT customer_id, name, "grouping", is_blocked, 0 AS is_archived,
            CAST(NULL AS DATE) AS created_date FROM o2c_customers""",
        ["created_date"], [],
    ),
    "orders": (
        f"""SELECT order_id, customer_id, {_NULL} order_type, {_NULL} sales_org, order_date,
            CAST(NULL AS DATE) AS requested_delivery_date, total_amount, {_NULL} currency,
            delivery_status, {_NULL} process_status FROM o2c_orders""",
        ["order_date", "requested_delivery_date"], ["total_amount"],
    ),
    "order_items": (
        f"""SELECT order_id, line_no, product_id, quantity, {_NULL} unit, net_amount,
            {_NULL} plant, {_NULL} item_category, {_NULL} delivery_status FROM o2c_order_items""",
        [], ["quantity", "net_amount"],
    ),
    "deliveries": (
        f"""SELECT delivery_id, order_id, CAST(NULL AS DATE) AS created_date, ship_date,
            picking_status, goods_status, {_NULL} shipping_point, {_NULL} delivery_block
            FROM o2c_deliveries""",
        ["created_date", "ship_date"], [],
    ),
    # An invoice is tied to its order through a delivery, so one without delivery has no order.
    "invoices": (
        f"""SELECT invoice_id, CASE WHEN EXISTS (SELECT 1 FROM billing_document_items b
                JOIN outbound_delivery_items d ON d.delivery_document = b.reference_sd_document
                WHERE b.billing_document = invoice_id) THEN order_id END AS order_id,
            customer_id, {_NULL} invoice_type, invoice_date, total_amount, {_NULL} currency,
            REPLACE(invoice_id, 'I', 'A') AS accounting_doc, is_cancelled FROM o2c_invoices""",
        ["invoice_date"], ["total_amount"],
    ),
    "payments": (
        f"""SELECT accounting_document AS payment_id, {_NULL} payment_item,
            customer AS customer_id, clearing_date, CAST(NULL AS DATE) AS posting_date,
            CAST(NULL AS DOUBLE) AS amount, {_NULL} currency, {_NULL} clearing_doc,
            {_NULL} gl_account, CASE WHEN clearing_date IS NULL THEN 0 ELSE 1 END AS is_incoming
            FROM payments_accounts_receivable""",
        ["clearing_date", "posting_date"], [],
    ),
    "products": (
        """SELECT product_id, product_name, product_type, old_sku, is_deleted
            FROM o2c_products""",
        [], [],
    ),
}


def _register_table(name: str, sql: str, text: list[str], number: list[str]) -> None:
    @query(f"o2c_from_sap_{name}", sql, text=text, number=number)
    def _(s):
        return sap.o2c_from_sap(s.sap())[name]


for _name, (_sql, _text, _number) in _FROM_SAP.items():
    _register_table(_name, _sql, _text, _number)


@query(
    "o2c_from_sap",
    """SELECT order_id, (SELECT name FROM o2c_customers c
            WHERE c.customer_id = o.customer_id) AS customer_name, order_date, total_amount,
        delivery_status
    FROM o2c_orders o WHERE order_id NOT IN (SELECT order_id FROM o2c_deliveries)""",
    text=["order_date"], number=["total_amount"],
)
def _(s):
    """A star query answered from the document model."""
    return orders.undelivered(sap.o2c_from_sap(s.sap()))
