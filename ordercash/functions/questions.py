"""Jobs over a column of analyst questions: domain test, id hints, report and table choice.

Each is a column expression over one row, so a job is a single map stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordercash.functions.strings import collapse, contains_any
from ordercash.model import SAP_TABLES

# A question belongs to the domain when it contains one of these as a
# substring. Plurals are left out where the singular already matches.
DOMAIN_WORDS = (
    "order", "customer", "delivery", "deliveries", "invoice", "payment", "product",
    "revenue", "data", "sales", "billing", "trace", "flow", "highest", "top", "show", "all",
)

# Pattern of an id after a word.
ID_PATTERN = r"[A-Za-z0-9_-]+"

# A report is chosen when every group has a word in the question; first wins.
INTENTS = (
    ("recent_orders", (("recent",), ("order",))),
    ("customer_details", (("customer",), ("detail", "show"))),
    ("top_materials", (("top",), ("product", "material"))),
    ("unpaid_invoices", (("unpaid",), ("invoice",))),
    ("trace_orders", (("trace",), ("order",))),
)

# Tables a question concerns, by the words in it.
TABLE_GROUPS = (
    (("customer", "partner", "client"), ("business_partners", "sales_order_headers")),
    (
        ("delivery", "ship", "picking"),
        ("outbound_delivery_headers", "outbound_delivery_items", "sales_order_headers"),
    ),
    (
        ("payment", "pay", "clear"),
        ("payments_accounts_receivable", "billing_document_headers", "business_partners"),
    ),
    (
        ("invoice", "bill"),
        (
            "billing_document_headers", "billing_document_items", "sales_order_headers",
            "business_partners",
        ),
    ),
    (("order",), ("sales_order_headers", "sales_order_items", "business_partners")),
    (
        ("product", "item", "material"),
        ("products", "product_descriptions", "sales_order_items"),
    ),
)
ALWAYS = "sales_order_headers"


def is_dataset_question(text: Column) -> Column:
    return contains_any(F.lower(text), DOMAIN_WORDS)


def dataset_questions(df: DataFrame, text: str = "question") -> DataFrame:
    """The rows with a flag for questions about the order-to-cash domain."""
    return df.withColumn("is_dataset", is_dataset_question(F.col(text)))


def _hint(text: Column, word: str) -> Column:
    """The id after the first whole ``word``, or null."""
    found = F.regexp_extract(text, rf"(?iU)\b{word}\s+({ID_PATTERN})\b", 1)
    return F.nullif(found, F.lit(""))


def question_hints(df: DataFrame, text: str = "question") -> DataFrame:
    """The rows with the question normalised, and the customer and order id it names."""
    return (
        df.withColumn("normalized", collapse(F.col(text)))
        .withColumn("customer_hint", _hint(F.col("normalized"), "customer"))
        .withColumn("order_hint", _hint(F.col("normalized"), "order"))
    )


def _words_seen(df: DataFrame) -> Column:
    """Text the report choice looks at: the question plus the constraint each hint adds.

    A customer constraint names customer and order columns, an order constraint names order
    columns, so a hint makes those words count as present.
    """
    return F.concat_ws(
        " ",
        F.lower("normalized"),
        F.when(F.col("customer_hint").isNotNull(), F.concat(
            F.lit("sales_order_headers sold_to_party business_partners customer_id "),
            F.lower("customer_hint"),
        )),
        F.when(F.col("order_hint").isNotNull(), F.concat(
            F.lit("sales_order_headers sales_order order_id "), F.lower("order_hint")
        )),
    )


def question_intent(df: DataFrame, text: str = "question") -> DataFrame:
    """The rows with the name of the report each question asks for, or null."""
    hinted = question_hints(df, text)
    seen = _words_seen(hinted)
    intent = F.lit(None).cast("string")
    for name, groups in reversed(INTENTS):
        every = reduce(and_, [contains_any(seen, words) for words in groups])
        intent = F.when(every, F.lit(name)).otherwise(intent)
    return hinted.withColumn("intent", intent).drop("normalized", "customer_hint", "order_hint")


def question_tables(
    df: DataFrame,
    key: str = "question_id",
    text: str = "question",
    tables: Sequence[str] = SAP_TABLES,
) -> DataFrame:
    """One row per question and table it concerns; every table when no word points at one."""
    lower = F.lower(F.col(text))
    hits = [contains_any(lower, words) for words, _ in TABLE_GROUPS]

    def names(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values if v in tables]).cast("array<string>")

    chosen = [F.when(hit, names(group)).otherwise(names(()))
              for hit, (_, group) in zip(hits, TABLE_GROUPS)]
    relevant = F.when(reduce(or_, hits), F.flatten(F.array(*chosen))).otherwise(
        names(tuple(tables))
    )
    distinct = F.array_distinct(F.concat(relevant, names((ALWAYS,))))
    return df.select(key, F.explode(distinct).alias("table_name"))
