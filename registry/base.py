"""The list of registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from ordercash.session import configure
from ordercash.sources.sample import (
    DELIVERY_STATUS,
    JOINED_SQL_TEXT,
    NET,
    QUESTION,
    SHIPPED,
    SQL_TEXT,
    Sample,
)
from ordercash.sources.sinks import export_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K = "CAST(l_orderkey AS VARCHAR)"
_BILLED = (
    "FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N' "
    "GROUP BY l_orderkey, l_returnflag, o_custkey"
)

CTES = {
    "o2c_customers": """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name,
        c_mktsegment AS "grouping", CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_blocked,
        CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS is_archived,
        DATE '1994-01-01' + CAST(c_custkey % 365 AS INT) AS created_date FROM customer""",
    "o2c_orders": f"""SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
        CAST(o_custkey AS VARCHAR) AS customer_id, o_orderpriority AS order_type,
        CAST(o_orderdate AS DATE) AS order_date,
        CAST(o_orderdate AS DATE) + 14 AS requested_delivery_date,
        CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount, 'USD' AS currency,
        {DELIVERY_STATUS} AS delivery_status, o_orderstatus AS process_status FROM orders""",
    "o2c_order_items": f"""SELECT {K} AS order_id, CAST(l_linenumber AS VARCHAR) AS line_no,
        CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
        'EA' AS unit, {NET} AS net_amount, CAST(l_suppkey AS VARCHAR) AS plant,
        l_returnflag AS item_category, l_linestatus AS delivery_status FROM lineitem""",
    "o2c_deliveries": f"""SELECT CONCAT('D', {K}, l_linestatus) AS delivery_id, {K} AS order_id,
        CAST(MAX(CASE WHEN l_linestatus = 'F' THEN l_shipdate END) AS DATE) AS ship_date,
        {SHIPPED} AS picking_status, {SHIPPED} AS goods_status
        FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY l_orderkey, l_linestatus""",
    "o2c_invoices": f"""SELECT CONCAT('I', {K}, l_returnflag) AS invoice_id, {K} AS order_id,
        CAST(o_custkey AS VARCHAR) AS customer_id, CAST(MIN(l_shipdate) AS DATE) AS invoice_date,
        SUM({NET}) AS total_amount, 'USD' AS currency,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_cancelled {_BILLED}""",
    "o2c_payments": """SELECT CONCAT('P', CAST(event_id AS VARCHAR)) AS payment_id,
        CAST(user_id AS VARCHAR) AS customer_id, CAST(ts AS DATE) AS clearing_date,
        CAST(value AS DECIMAL(18,2)) AS amount, 'USD' AS currency,
        CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_incoming
        FROM events WHERE event_type IN ('purchase', 'error')""",
    "o2c_products": """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name,
        p_type AS product_type, p_brand AS old_sku,
        CASE WHEN p_size > 45 THEN 1 ELSE 0 END AS is_deleted FROM part""",
    "sales_order_headers": f"""SELECT CAST(o_orderkey AS VARCHAR) AS sales_order,
        CAST(o_custkey AS VARCHAR) AS sold_to_party, CAST(o_orderdate AS DATE) AS creation_date,
        CAST(o_totalprice AS DECIMAL(18,2)) AS total_net_amount,
        {DELIVERY_STATUS} AS overall_delivery_status FROM orders""",
    "sales_order_items": f"""SELECT {K} AS sales_order,
        CAST(l_linenumber AS VARCHAR) AS sales_order_item, CAST(l_partkey AS VARCHAR) AS material,
        CAST(l_quantity AS DECIMAL(18,2)) AS requested_quantity, {NET} AS net_amount
        FROM lineitem""",
    "outbound_delivery_items": f"""SELECT CONCAT('D', {K}, l_linestatus) AS delivery_document,
        CAST(l_linenumber AS VARCHAR) AS delivery_document_item, {K} AS reference_sd_document,
        CAST(l_linenumber AS VARCHAR) AS reference_sd_document_item
        FROM lineitem WHERE l_suppkey % 3 <> 0""",
    "billing_document_items": f"""SELECT CONCAT('I', {K}, l_returnflag) AS billing_document,
        CAST(l_partkey AS VARCHAR) AS material, {NET} AS net_amount,
        CONCAT('D', {K}, l_linestatus) AS reference_sd_document,
        CAST(l_linenumber AS VARCHAR) AS reference_sd_document_item
        FROM lineitem WHERE l_returnflag <> 'N'""",
    "billing_document_headers": f"""SELECT CONCAT('I', {K}, l_returnflag) AS billing_document,
        CONCAT('A', {K}, l_returnflag) AS accounting_document,
        CAST(o_custkey AS VARCHAR) AS sold_to_party,
        CAST(MIN(l_shipdate) AS DATE) AS billing_document_date, SUM({NET}) AS total_net_amount,
        l_returnflag = 'R' AS billing_document_is_cancelled {_BILLED}""",
    "payments_accounts_receivable": f"""SELECT CONCAT('A', {K}, l_returnflag)
        AS accounting_document, CASE WHEN l_orderkey % 3 = 0 THEN NULL
        ELSE CONCAT('A', {K}, l_returnflag) END AS invoice_reference,
        CAST(o_custkey AS VARCHAR) AS customer, CASE WHEN l_orderkey % 10 = 0 THEN NULL
        ELSE CAST(MAX(l_shipdate) AS DATE) END AS clearing_date
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE l_returnflag = 'A' AND l_orderkey % 2 = 0
        GROUP BY l_orderkey, l_returnflag, o_custkey""",
    "business_partners": """SELECT CONCAT('BP', CAST(c_custkey AS VARCHAR)) AS business_partner,
        CAST(c_custkey AS VARCHAR) AS customer, c_name AS business_partner_name,
        CONCAT(c_name, ' ', c_mktsegment) AS business_partner_full_name,
        c_acctbal < 0 AS business_partner_is_blocked,
        c_mktsegment AS business_partner_grouping,
        DATE '1994-01-01' + CAST(c_custkey % 365 AS INT) AS last_change_date FROM customer""",
    "questions": f"SELECT o_orderkey AS question_id, {QUESTION} AS question FROM orders",
    "sql_log": f"SELECT o_orderkey AS log_id, {SQL_TEXT} AS sql_text FROM orders",
    "joined_log": f"SELECT o_orderkey AS log_id, {JOINED_SQL_TEXT} AS sql_text FROM orders",
}


def with_tables(sql: str, ctes: dict[str, str] | None = None) -> str:
    """``sql`` preceded by those model tables, and tables of ``ctes``, that it names."""
    known = {**CTES, **(ctes or {})}
    text = sql + " ".join((ctes or {}).values())
    used = [f"{name} AS ({body})" for name, body in known.items() if name in text]
    return f"WITH {', '.join(used)} {sql}" if used else sql


def query(
    name: str,
    sql: str | None = None,
    text: Iterable[str] = (),
    number: Iterable[str] = (),
    ctes: dict[str, str] | None = None,
):
    """Register ``f(sample) -> DataFrame`` under ``name``.

    Results leave as plain types; ``text`` and ``number`` name the columns of ``sql`` that
    must be cast to text and to double for that.
    """

    def register(build: Callable[[Sample], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return export_rows(build(Sample(configure(spark), sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            casts = [f"CAST({c} AS VARCHAR) AS {c}" for c in text]
            casts += [f"CAST({c} AS DOUBLE) AS {c}" for c in number]
            body = dedent(sql).strip()
            if casts:
                body = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({body})"
            ORACLES[name] = with_tables(body, ctes)
        return build

    return register
