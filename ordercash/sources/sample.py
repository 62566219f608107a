"""Both models derived from the sample tables (customer, orders, lineitem, part, events)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NET = (
    "CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * "
    "(CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2))) AS DECIMAL(20,4))"
)
DELIVERY_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'C' WHEN 'P' THEN 'B' ELSE 'A' END"
SHIPPED = "CASE WHEN l_linestatus = 'F' THEN 'C' ELSE 'A' END"


class LazyTables(Mapping):
    """Tables by name, each read only when asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]) -> None:
        self._builders = builders

    def __getitem__(self, name: str) -> DataFrame:
        return self._builders[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


class Sample:
    """Lazy readers of one folder of sample tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root
        self._read: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._read[name]

    def star(self) -> LazyTables:
        return LazyTables({
            "customers": lambda: self.raw("customer").selectExpr(
                "CAST(c_custkey AS STRING) AS customer_id",
                "c_name AS name",
                "c_mktsegment AS `grouping`",
                "CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_blocked",
                "CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS is_archived",
                "DATE '1994-01-01' + CAST(c_custkey % 365 AS INT) AS created_date",
            ),
            "orders": lambda: self.raw("orders").selectExpr(
                "CAST(o_orderkey AS STRING) AS order_id",
                "CAST(o_custkey AS STRING) AS customer_id",
                "o_orderpriority AS order_type",
                "CAST(o_orderdate AS DATE) AS order_date",
                "CAST(o_orderdate AS DATE) + 14 AS requested_delivery_date",
                "CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount",
                "'USD' AS currency",
                f"{DELIVERY_STATUS} AS delivery_status",
                "o_orderstatus AS process_status",
            ),
            "order_items": lambda: self.raw("lineitem").selectExpr(
                "CAST(l_orderkey AS STRING) AS order_id",
                "CAST(l_linenumber AS STRING) AS line_no",
                "CAST(l_partkey AS STRING) AS product_id",
                "CAST(l_quantity AS DECIMAL(18,2)) AS quantity",
                "'EA' AS unit",
                f"{NET} AS net_amount",
                "CAST(l_suppkey AS STRING) AS plant",
                "l_returnflag AS item_category",
                "l_linestatus AS delivery_status",
            ),
            "deliveries": lambda: self._deliveries().selectExpr(
                "CONCAT('D', l_orderkey, l_linestatus) AS delivery_id",
                "CAST(l_orderkey AS STRING) AS order_id",
                "CASE WHEN l_linestatus = 'F' THEN CAST(last_ship AS DATE) END AS ship_date",
                f"{SHIPPED} AS picking_status",
                f"{SHIPPED} AS goods_status",
            ),
            "invoices": lambda: self._invoices().selectExpr(
                "CONCAT('I', l_orderkey, l_returnflag) AS invoice_id",
                "CAST(l_orderkey AS STRING) AS order_id",
                "CAST(o_custkey AS STRING) AS customer_id",
                "CAST(first_ship AS DATE) AS invoice_date",
                "total AS total_amount",
                "'USD' AS currency",
                "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_cancelled",
            ),
            "payments": lambda: self.raw("events")
            .filter("event_type IN ('purchase', 'error')")
            .selectExpr(
                "CONCAT('P', event_id) AS payment_id",
                "CAST(user_id AS STRING) AS customer_id",
                "CAST(ts AS DATE) AS clearing_date",
                "CAST(value AS DECIMAL(18,2)) AS amount",
                "'USD' AS currency",
                "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_incoming",
            ),
            "products": lambda: self.raw("part").selectExpr(
                "CAST(p_partkey AS STRING) AS product_id",
                "p_name AS product_name",
                "p_type AS product_type",
                "p_brand AS old_sku",
                "CASE WHEN p_size > 45 THEN 1 ELSE 0 END AS is_deleted",
            ),
        })

    def _deliveries(self) -> DataFrame:
        return (
            self.raw("lineitem").filter("l_suppkey % 3 <> 0")
            .groupBy("l_orderkey", "l_linestatus")
            .agg(F.max("l_shipdate").alias("last_ship"))
        )

    def _invoices(self) -> DataFrame:
        """Lines are summed per order and flag before orders give the customer."""
        billed = (
            self.raw("lineitem").filter("l_returnflag <> 'N'")
            .groupBy("l_orderkey", "l_returnflag")
            .agg(
                F.min("l_shipdate").alias("first_ship"),
                F.max("l_shipdate").alias("last_ship"),
                F.sum(F.expr(NET)).alias("total"),
            )
        )
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        return billed.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def sap(self) -> LazyTables:
        return LazyTables({
            "business_partners": lambda: self.raw("customer").selectExpr(
                "CONCAT('BP', c_custkey) AS business_partner",
                "CAST(c_custkey AS STRING) AS customer",
                "c_name AS business_partner_name",
                "CONCAT(c_name, ' ', c_mktsegment) AS business_partner_full_name",
                "c_acctbal < 0 AS business_partner_is_blocked",
                "c_mktsegment AS business_partner_grouping",
                "DATE '1994-01-01' + CAST(c_custkey % 365 AS INT) AS last_change_date",
            ),
            "sales_order_headers": lambda: self.raw("orders").selectExpr(
                "CAST(o_orderkey AS STRING) AS sales_order",
                "CAST(o_custkey AS STRING) AS sold_to_party",
                "CAST(o_orderdate AS DATE) AS creation_date",
                "CAST(o_totalprice AS DECIMAL(18,2)) AS total_net_amount",
                f"{DELIVERY_STATUS} AS overall_delivery_status",
            ),
            "sales_order_items": lambda: self.raw("lineitem").selectExpr(
                "CAST(l_orderkey AS STRING) AS sales_order",
                "CAST(l_linenumber AS STRING) AS sales_order_item",
                "CAST(l_partkey AS STRING) AS material",
                "CAST(l_quantity AS DECIMAL(18,2)) AS requested_quantity",
                f"{NET} AS net_amount",
            ),
            "outbound_delivery_headers": lambda: self._deliveries().selectExpr(
                "CONCAT('D', l_orderkey, l_linestatus) AS delivery_document",
                "CASE WHEN l_linestatus = 'F' THEN CAST(last_ship AS DATE) END "
                "AS actual_goods_movement_date",
                f"{SHIPPED} AS overall_goods_movement_status",
                f"{SHIPPED} AS overall_picking_status",
            ),
            "outbound_delivery_items": lambda: self.raw("lineitem")
            .filter("l_suppkey % 3 <> 0")
            .selectExpr(
                "CONCAT('D', l_orderkey, l_linestatus) AS delivery_document",
                "CAST(l_linenumber AS STRING) AS delivery_document_item",
                "CAST(l_orderkey AS STRING) AS reference_sd_document",
                "CAST(l_linenumber AS STRING) AS reference_sd_document_item",
            ),
            "billing_document_items": lambda: self.raw("lineitem")
            .filter("l_returnflag <> 'N'")
            .selectExpr(
                "CONCAT('I', l_orderkey, l_returnflag) AS billing_document",
                "CAST(l_partkey AS STRING) AS material",
                f"{NET} AS net_amount",
                "CONCAT('D', l_orderkey, l_linestatus) AS reference_sd_document",
                "CAST(l_linenumber AS STRING) AS reference_sd_document_item",
            ),
            "billing_document_headers": lambda: self._invoices().selectExpr(
                "CONCAT('I', l_orderkey, l_returnflag) AS billing_document",
                "CONCAT('A', l_orderkey, l_returnflag) AS accounting_document",
                "CAST(o_custkey AS STRING) AS sold_to_party",
                "CAST(first_ship AS DATE) AS billing_document_date",
                "total AS total_net_amount",
                "l_returnflag = 'R' AS billing_document_is_cancelled",
            ),
            "payments_accounts_receivable": lambda: self._invoices()
            .filter("l_returnflag = 'A' AND l_orderkey % 2 = 0")
            .selectExpr(
                "CONCAT('A', l_orderkey, l_returnflag) AS accounting_document",
                "CASE WHEN l_orderkey % 3 <> 0 THEN CONCAT('A', l_orderkey, l_returnflag) END "
                "AS invoice_reference",
                "CAST(o_custkey AS STRING) AS customer",
                "CASE WHEN l_orderkey % 10 <> 0 THEN CAST(last_ship AS DATE) END "
                "AS clearing_date",
            ),
            "products": lambda: self.raw("part").selectExpr(
                "CAST(p_partkey AS STRING) AS product",
                "p_type AS product_type",
                "p_brand AS product_old_id",
                "p_size > 45 AS is_marked_for_deletion",
            ),
            "product_descriptions": lambda: self.raw("part").selectExpr(
                "CAST(p_partkey AS STRING) AS product",
                "'EN' AS language",
                "p_name AS product_description",
            ),
        })

    def questions(self) -> DataFrame:
        return self.raw("orders").selectExpr("o_orderkey AS question_id", f"{QUESTION} AS question")

    def sql_log(self) -> DataFrame:
        return self.raw("orders").selectExpr("o_orderkey AS log_id", f"{SQL_TEXT} AS sql_text")

    def joined_sql_log(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS log_id", f"{JOINED_SQL_TEXT} AS sql_text"
        )

    def messages(self) -> DataFrame:
        return self.raw("conversations")


QUESTION = """CASE o_orderkey % 8
  WHEN 0 THEN CONCAT('Show customer ', CAST(o_custkey AS STRING), ' orders')
  WHEN 1 THEN CONCAT('  Trace   order ', CAST(o_orderkey AS STRING))
  WHEN 2 THEN 'Top products by amount'
  WHEN 3 THEN 'Unpaid invoices'
  WHEN 4 THEN CONCAT('recent customer ', CAST(o_custkey AS STRING))
  WHEN 5 THEN 'What is the weather?'
  WHEN 6 THEN 'customer details'
  ELSE 'stop the small payment clearing' END"""

# Statements an analyst might log, one per remainder of the order key; KEY stands for the key.
STATEMENTS = (
    "SELECT sales_order FROM sales_order_headers WHERE sales_order = 'KEY';",
    "DROP TABLE products",
    "SELECT product FROM products WHERE product = 'update' LIMIT 5",
    "WITH t AS (SELECT product FROM products) SELECT product FROM t",
    "SELECT soh.customer_id FROM sales_order_headers soh",
    "   ",
    "SELECT a.sales_order FROM sales_order_headers a, sales_order_items b "
    "WHERE a.sales_order = b.sales_order",
    "SELECT EXTRACT(year FROM creation_date) AS y FROM sales_order_headers",
    "SELECT plant_name, incoterms FROM plants WHERE plant = 'KEY'",
)
JOINED_STATEMENTS = (
    "SELECT soh.sales_order, bp.business_partner_name FROM sales_order_headers AS soh "
    "JOIN business_partners bp ON soh.sold_to_party = bp.customer",
    "SELECT products.product FROM sales_order_items JOIN products ON material = product",
    "SELECT a.material FROM sales_order_items a JOIN products a ON 1 = 1",
    "SELECT COUNT(*) AS n, SUM(net_amount) total FROM sales_order_items GROUP BY material",
    "SELECT x.sales_order FROM (SELECT sales_order FROM sales_order_items) AS x "
    "WHERE x.sales_order = 'it''s' OR x.sales_order = 'KEY'",
    'select "some name" from products where product_type in (\'a\', \'b\')',
    "SELECT p.product AS product_id, d.product_description AS label FROM products p "
    "LEFT JOIN product_descriptions d ON p.product = d.product LIMIT 5",
    "SELECT dense_rank() OVER (ORDER BY product) AS r FROM products",
    "SELECT o.order_id AS order_id, c.name AS order_id FROM orders o "
    "JOIN customers c ON o.customer_id = c.customer_id",
    "SELECT product AS sku_id FROM products;;",
    "  select a, b, c, d, e, f, g from nowhere n  ",
    "SELECT billing_document FROM billing_document_headers bdh WHERE 1.5 < 20 AND "
    "bdh.billing_document = 'KEY' ORDER BY bdh.billing_document_date DESC",
    "SELECT j.cost_center, s.incoterms_classification, s.plant_name "
    "FROM journal_entry_items_accounts_receivable j "
    "JOIN customer_sales_area_assignments s ON j.customer = s.customer",
)


def _sql_text(statements: tuple[str, ...]) -> str:
    """A CASE over the order key; quotes are CHR(39), which every engine reads alike."""

    def literal(text: str) -> str:
        parts = [f"'{p}'" for p in text.split("'")]
        joined = ", CHR(39), ".join(parts).replace("'KEY'", "CAST(o_orderkey AS STRING)")
        return f"CONCAT({joined})"

    cases = " ".join(f"WHEN {i} THEN {literal(s)}" for i, s in enumerate(statements))
    return f"CASE o_orderkey % {len(statements)} {cases} END"


SQL_TEXT = _sql_text(STATEMENTS)
JOINED_SQL_TEXT = _sql_text(JOINED_STATEMENTS)
