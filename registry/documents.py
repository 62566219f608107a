"""Reports over the document model; the SQL is written from their rules."""

from __future__ import annotations

from ordercash.model import SAP_RELATIONSHIPS
from ordercash.operators import analytics, documents
from registry.base import query
from registry.star import orphans_sql


@query(
    "recent_orders",
    """SELECT sales_order, sold_to_party, creation_date, total_net_amount,
        overall_delivery_status FROM sales_order_headers
    ORDER BY creation_date DESC NULLS FIRST, sales_order LIMIT 20""",
    text=["creation_date"], number=["total_net_amount"],
)
def _(s):
    return documents.recent_orders(s.sap())


@query(
    "customer_details",
    """SELECT customer, business_partner_name, business_partner_full_name,
        business_partner_is_blocked, business_partner_grouping, last_change_date
    FROM business_partners ORDER BY customer LIMIT 20""",
    text=["last_change_date"],
)
def _(s):
    return documents.customer_details(s.sap())


@query(
    "top_materials",
    """SELECT material, COUNT(*) AS order_count, SUM(net_amount) AS total_net_amount
    FROM sales_order_items GROUP BY material
    ORDER BY total_net_amount DESC NULLS FIRST, material LIMIT 20""",
    number=["total_net_amount"],
)
def _(s):
    return documents.top_materials(s.sap())


# An invoice is open once for each of its payment rows that has not cleared, or once if it has none.
_OPEN = """(SELECT CASE WHEN COUNT(*) = 0 THEN 1 ELSE COUNT(*) - COUNT(clearing_date) END
        FROM payments_accounts_receivable WHERE {theirs} = {ours})"""


@query(
    "unpaid_invoices",
    f"""SELECT billing_document, sold_to_party, billing_document_date, total_net_amount
    FROM (SELECT *, UNNEST(RANGE({_OPEN.format(theirs='accounting_document', ours='h.accounting_document')}))
        FROM billing_document_headers h WHERE NOT billing_document_is_cancelled)
    ORDER BY billing_document_date DESC NULLS FIRST, billing_document LIMIT 20""",
    text=["billing_document_date"], number=["total_net_amount"],
)
def _(s):
    return documents.unpaid_invoices(s.sap())


def _register_link(key: str, link: str) -> None:
    ours, theirs = documents.LINKS[link]

    @query(
        key,
        f"""SELECT * FROM (
            SELECT billing_document, sold_to_party, billing_document_date, total_net_amount,
                {_OPEN.format(theirs=theirs, ours=f'h.{ours}')} AS open_links
            FROM billing_document_headers h WHERE NOT billing_document_is_cancelled)
        WHERE open_links > 0""",
        text=["billing_document_date"], number=["total_net_amount"],
    )
    def _(s):
        return documents.unpaid_by_link(s.sap(), link)


_register_link("unpaid_by_link", "invoice_reference")
_register_link("unpaid_by_document", "document")
_register_link("unpaid_by_customer", "customer")

# Straight over the sample: an order's shipped lines by status make its deliveries, its billed lines
# by status and flag the invoices of a delivery, and even orders' A invoices are in accounts.
_KEY = "CAST(o_orderkey AS VARCHAR)"
TRACE_FULL = f"""SELECT {_KEY} AS sales_order, CAST(o_custkey AS VARCHAR) AS sold_to_party,
        'D' || {_KEY} || s.l_linestatus AS delivery_document,
        'I' || {_KEY} || b.l_returnflag AS billing_document,
        CASE WHEN b.l_returnflag = 'A' AND o_orderkey % 2 = 0 THEN 'A' || {_KEY} || 'A' END
            AS payment_id,
        COALESCE(s.n, 1) * COALESCE(b.n, 1) AS n_paths
    FROM orders
    LEFT JOIN (SELECT l_orderkey, l_linestatus, COUNT(*) AS n FROM lineitem
        WHERE l_suppkey % 3 <> 0 GROUP BY ALL) s ON s.l_orderkey = o_orderkey
    LEFT JOIN (SELECT l_orderkey, l_linestatus, l_returnflag, COUNT(*) AS n FROM lineitem
        WHERE l_returnflag <> 'N' GROUP BY ALL) b
        ON b.l_orderkey = s.l_orderkey AND b.l_linestatus = s.l_linestatus"""
_PATH = "sales_order, sold_to_party, delivery_document, billing_document, payment_id"


@query(
    "trace_orders",
    f"""SELECT {_PATH} FROM (SELECT *, UNNEST(RANGE(n_paths)) FROM ({TRACE_FULL}))
    JOIN (SELECT {_KEY} AS sales_order, o_orderdate FROM orders) USING (sales_order)
    ORDER BY CAST(o_orderdate AS DATE) DESC NULLS FIRST, sales_order,
        delivery_document NULLS LAST, billing_document NULLS LAST, payment_id NULLS LAST LIMIT 20""",
)
def _(s):
    return documents.trace_orders(s.sap())


@query("trace_orders_full", TRACE_FULL)
def _(s):
    return documents.trace_orders_full(s.sap())


# In the sample, products and their descriptions are rows of one table.
_PARTS = {
    "products": "SELECT CAST(p_partkey AS VARCHAR) AS product FROM part",
    "product_descriptions": "SELECT CAST(p_partkey AS VARCHAR) AS product FROM part",
}


@query(
    "relationship_check_documents",
    " UNION ALL ".join(orphans_sql(r, prefix="") for r in SAP_RELATIONSHIPS),
    ctes=_PARTS,
)
def _(s):
    return analytics.relationship_check(s.sap(), SAP_RELATIONSHIPS)
