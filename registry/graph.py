"""Entity graphs over query results; the SQL lists entities and pairs by UNION ALL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordercash.operators import documents, graph, orders, products
from registry.base import query
from registry.documents import TRACE_FULL
from registry.star import ORDER_FLOW_ALL

# Lines that name the same entities in several columns, some blank, so that the choice of
# column and the first-value rule have work to do.
_ORDER = "CAST(l_orderkey AS {text})"
MIXED = {
    "line_key": f"CONCAT({_ORDER}, '-', CAST(l_linenumber AS {{text}}), '-', "
    "CAST(l_partkey AS {text}), '-', CAST(l_suppkey AS {text}), '-', "
    "CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS {text}))",
    "order_id": "CASE WHEN l_linenumber = 1 THEN '  ' WHEN l_linenumber = 2 THEN NULL "
    f"ELSE CONCAT(' ', {_ORDER}) END",
    "sales_order": _ORDER,
    "billing_document": f"CASE WHEN l_returnflag = 'N' THEN '' "
    f"ELSE CONCAT('I', {_ORDER}, l_returnflag) END",
    "delivery_document": f"CASE WHEN l_suppkey % 3 = 0 THEN NULL "
    f"ELSE CONCAT('D', {_ORDER}, l_linestatus) END",
    "product": "CASE WHEN l_partkey % 4 = 0 THEN '' ELSE CAST(l_partkey AS {text}) END",
    "material": "CAST(l_partkey AS {text})",
    "line_status": "CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_linestatus END",
}


def _mixed_columns(text: str) -> list[str]:
    return [f"{e.format(text=text)} AS {name}" for name, e in MIXED.items()]


def mixed(s):
    # Equal lines meet in ranges of the lines, so the lines of an order lie together and its nodes and
    # edges combine before they are shuffled; all columns make the range, so an order may fill many.
    lines = s.raw("lineitem").selectExpr(*_mixed_columns("STRING"))
    return lines.repartitionByRange(*MIXED).distinct()


# The columns that every line fills.
MIXED_TOGETHER = [("line_key", "sales_order", "material")]


_MIXED_CTE = {
    "mixed": f"SELECT DISTINCT {', '.join(_mixed_columns('VARCHAR'))} FROM lineitem"
}


def _first(*columns: str) -> str:
    return "COALESCE(" + ", ".join(f"NULLIF(TRIM({c}), '')" for c in columns) + ")"


_MIXED_IDS = {
    "order": _first("order_id", "sales_order"),
    "invoice": _first("billing_document"),
    "delivery": _first("delivery_document"),
    "product": _first("product", "material"),
}


@query(
    "entity_ids",
    f"""SELECT line_key, CAST(NULL AS VARCHAR) AS customer_entity,
        {', '.join(f'{e} AS {k}_entity' for k, e in _MIXED_IDS.items())} FROM mixed""",
    ctes=_MIXED_CTE,
)
def _(s):
    return graph.entity_ids(mixed(s)).select(
        "line_key", *[f"{k}_entity" for k in graph.ENTITY_COLUMNS]
    )


# Nodes of many rows are made a quarter at a time, so that their shuffles are not on disk together.
PASSES = 4


def flat(nodes):
    """Nodes with the context fields as columns of their own."""
    fields = nodes.schema["context"].dataType.names
    return nodes.select(
        "id", "type", "entity_id", "label",
        *[F.col(f"context.`{f}`").alias(f"ctx_{f}") for f in fields],
    )


def _nodes_sql(source: str, ids: dict[str, str], columns: dict[str, str], order: str) -> str:
    """``columns`` maps each context column to its test for being filled."""
    entities = " UNION ALL ".join(
        f"SELECT '{kind}' AS type, {expr} AS eid, * FROM {source}" for kind, expr in ids.items()
    )
    context = ", ".join(
        f"arg_min({c}, {order}) FILTER (WHERE {test}) AS ctx_{c}" for c, test in columns.items()
    )
    return f"""SELECT type || '_' || eid AS id, type, eid AS entity_id,
        upper(type[1]) || type[2:] || ' ' || eid AS label, {context}
    FROM ({entities}) WHERE eid IS NOT NULL GROUP BY type, eid"""


def _texts(*columns: str) -> dict[str, str]:
    return {c: f"{c} IS NOT NULL AND {c} <> ''" for c in columns}


@query(
    "graph_nodes",
    _nodes_sql(
        "mixed", _MIXED_IDS,
        _texts(*MIXED),
        "line_key",
    ),
    ctes=_MIXED_CTE,
)
def _(s):
    return flat(graph.graph_nodes(mixed(s), ["line_key"], together=MIXED_TOGETHER, passes=PASSES))


def _edges_sql(source: str, links: list[tuple[str, str, str]]) -> str:
    """``links`` holds source node, target node and label expressions."""
    pairs = " UNION ".join(
        f"SELECT {a} AS source, {b} AS target, {label} AS label FROM {source}"
        for a, b, label in links
    )
    return f"""SELECT 'e_' || source || '_' || target AS id, source, target, label
    FROM ({pairs}) WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target"""


def _node(kind: str) -> str:
    return f"'{kind}_' || {_MIXED_IDS[kind]}"


@query(
    "graph_edges_lines",
    _edges_sql("mixed", [
        (_node("order"), _node("invoice"), "'related'"),
        (_node("order"), _node("delivery"), "'related'"),
        (_node("order"), _node("product"), "'related'"),
    ]),
    ctes=_MIXED_CTE,
)
def _(s):
    _nodes, edges = graph.build_graph(mixed(s), ["line_key"])
    return edges


@query(
    "o2c_typed_edges_lines",
    _edges_sql("mixed", [
        (_node("order"), _node("delivery"), "'fulfilled by'"),
        (_node("delivery"), _node("invoice"), "'billed via'"),
        (f"CASE WHEN {_MIXED_IDS['delivery']} IS NULL THEN {_node('order')} END", _node("invoice"), "'billed via'"),
        (_node("order"), _node("product"), "'contains'"),
    ]),
    ctes=_MIXED_CTE,
)
def _(s):
    _nodes, edges = graph.o2c_typed_graph(mixed(s), ["line_key"])
    return edges


def _flow(s):
    return orders.order_flow_all(s.star()).withColumn(
        "document", F.coalesce("delivery_id", "invoice_id", F.lit(""))
    )


# The columns of each table of the flow.
FLOW_TOGETHER = [
    ("order_id", "customer_id", "customer_name", "order_amount", "delivery_status", "requested_delivery_date",
     "n_payments"),
    ("delivery_id", "goods_status", "picking_status"),
    ("invoice_id", "invoice_date", "invoice_amount", "is_cancelled"),
    ("payment_amount", "last_clearing_date"),
]
_FLOW_CTE = {
    "flow": f"""SELECT *, COALESCE(delivery_id, invoice_id, '') AS document
        FROM ({ORDER_FLOW_ALL})"""
}
_FLOW_IDS = {k: f"{k}_id" for k in ("customer", "order", "invoice", "delivery")}


@query(
    "graph_edges",
    _edges_sql("flow", [
        ("'customer_' || customer_id", "'order_' || order_id", "'related'"),
        ("'order_' || order_id", "'invoice_' || invoice_id", "'related'"),
        ("'order_' || order_id", "'delivery_' || delivery_id", "'related'"),
    ]),
    ctes=_FLOW_CTE,
)
def _(s):
    return graph.graph_edges(_flow(s))


_FLOW_CONTEXT = {
    **_texts("order_id", "customer_id", "customer_name"),
    "order_amount": "order_amount IS NOT NULL",
    **_texts("delivery_status"),
    "requested_delivery_date": "requested_delivery_date IS NOT NULL",
    **_texts("delivery_id"),
    "ship_date": "ship_date IS NOT NULL",
    **_texts("goods_status", "picking_status", "invoice_id"),
    "invoice_date": "invoice_date IS NOT NULL",
    "invoice_amount": "invoice_amount IS NOT NULL",
    "is_cancelled": "is_cancelled IS NOT NULL",
    "n_payments": "n_payments IS NOT NULL",
    "payment_amount": "payment_amount IS NOT NULL",
    "last_clearing_date": "last_clearing_date IS NOT NULL",
    **_texts("document"),
}


@query(
    "build_graph",
    _nodes_sql("flow", _FLOW_IDS, _FLOW_CONTEXT, "(order_id, document)"),
    text=["ctx_requested_delivery_date", "ctx_ship_date", "ctx_invoice_date",
          "ctx_last_clearing_date"],
    number=["ctx_order_amount", "ctx_invoice_amount", "ctx_payment_amount"],
    ctes=_FLOW_CTE,
)
def _(s):
    nodes, _edges = graph.build_graph(
        _flow(s), ["order_id", "document"], together=FLOW_TOGETHER, passes=PASSES
    )
    return flat(nodes)


@query(
    "record_fallback",
    """SELECT 'record_0' AS id, 'record' AS type, 'record_0' AS entity_id,
        'Result Row' AS label, order_type AS ctx_order_type, n AS ctx_n FROM (
        SELECT order_type, COUNT(*) AS n FROM o2c_orders GROUP BY order_type
        ORDER BY order_type LIMIT 1)""",
)
def _(s):
    per_type = s.star()["orders"].groupBy("order_type").agg(F.count("*").alias("n"))
    nodes, _edges = graph.build_graph(per_type, ["order_type"])
    return flat(nodes)


def _trace(s, keep=False):
    return documents.trace_orders_full(s.sap(), keep).withColumn(
        "path",
        F.concat_ws(
            "/", "sales_order", *[F.coalesce(c, F.lit("")) for c in (
                "delivery_document", "billing_document", "payment_id")]
        ),
    )


TRACE_TOGETHER = [("sales_order", "sold_to_party", "n_paths", "path")]
_TRACE_CTE = {
    "trace": f"""SELECT *, sales_order || '/' || COALESCE(delivery_document, '') || '/' ||
        COALESCE(billing_document, '') || '/' || COALESCE(payment_id, '') AS path
        FROM ({TRACE_FULL})"""
}


@query(
    "o2c_typed_graph",
    _edges_sql("trace", [
        ("'customer_' || sold_to_party", "'order_' || sales_order", "'placed'"),
        ("'order_' || sales_order", "'delivery_' || delivery_document", "'fulfilled by'"),
        ("'delivery_' || delivery_document", "'invoice_' || billing_document", "'billed via'"),
        ("CASE WHEN delivery_document IS NULL THEN 'order_' || sales_order END",
         "'invoice_' || billing_document", "'billed via'"),
        ("'invoice_' || billing_document", "'payment_' || payment_id", "'paid by'"),
    ]),
    ctes=_TRACE_CTE,
)
def _(s):
    _nodes, edges = graph.o2c_typed_graph(_trace(s), ["path"])
    return edges


@query(
    "o2c_typed_nodes",
    _nodes_sql(
        "trace",
        {"customer": "sold_to_party", "order": "sales_order", "invoice": "billing_document",
         "delivery": "delivery_document", "payment": "payment_id"},
        {**_texts("sales_order", "sold_to_party", "delivery_document", "billing_document",
                  "payment_id"), "n_paths": "n_paths IS NOT NULL", **_texts("path")},
        "path",
    ),
    ctes=_TRACE_CTE,
)
def _(s):
    nodes, _edges = graph.o2c_typed_graph(
        _trace(s, keep=True), ["path"], together=TRACE_TOGETHER, passes=PASSES
    )
    return flat(nodes)


@query(
    "node_details",
    f"""SELECT id AS node_id, unnest(['product_id', 'product_type', 'old_sku', 'total_orders',
            'entity_id', 'entity_type']) AS attribute,
        unnest([product_id, product_type, old_sku, CAST(total_orders AS VARCHAR), product_id,
            'product']) AS value
    FROM (SELECT 'product_' || product_id AS id, * FROM (
        SELECT product_id, product_type, old_sku, COUNT(DISTINCT order_id) AS total_orders
        FROM o2c_products JOIN (SELECT product_id, order_id FROM o2c_order_items)
            USING (product_id)
        WHERE order_id IN (SELECT order_id FROM o2c_invoices WHERE is_cancelled = 0)
        GROUP BY product_id, product_type, old_sku))""",
)
def _(s):
    sold = products.billed_products(s.star()).select(
        "product_id", "product_type", "old_sku", "total_orders"
    )
    nodes, _edges = graph.build_graph(sold, ["product_id"])
    return graph.node_details(nodes)
