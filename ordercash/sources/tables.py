"""Readers for the model's tables: parquet folders, JSON-lines folders, a JDBC database."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordercash.model import KEYS, SAP, STAR

# The tables that arrive as folders of JSON lines, each in a folder of its name.
JSONL_TABLES = (
    "business_partners",
    "products",
    "product_descriptions",
    "sales_order_headers",
    "sales_order_items",
    "outbound_delivery_headers",
    "outbound_delivery_items",
    "billing_document_headers",
    "billing_document_items",
    "payments_accounts_receivable",
)

UNDECLARED, CORRUPT = "_undeclared", "_corrupt_record"


def load_o2c(
    spark: SparkSession, root: str, tables: Iterable[str] = tuple(STAR)
) -> dict[str, DataFrame]:
    """Tables stored as ``<root>/<table>`` or ``<root>/<table>.parquet``."""
    return {name: spark.read.parquet(f"{root}/{name}{{,.parquet}}") for name in tables}


def load_jsonl(
    spark: SparkSession,
    root: str,
    schemas: Mapping[str, T.StructType] = SAP,
    tables: Iterable[str] = JSONL_TABLES,
) -> dict[str, DataFrame]:
    """Tables stored as folders of JSON lines; schemas are given, so no pass infers them.

    Nothing of a line is dropped: columns the schema does not declare come as text in the map
    ``_undeclared``, and a line that is no JSON, or holds a value its column cannot, comes whole in
    ``_corrupt_record``. Both are null elsewhere.
    """
    return {name: _json_lines(spark, f"{root}/{name}", schemas[name]) for name in tables}


def _json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    line = F.col("value")
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    row = F.from_json(line, whole, {"columnNameOfCorruptRecord": CORRUPT})
    entries = F.from_json(line, "map<string,string>")
    more = F.map_filter(entries, lambda name, _: ~name.isin(schema.names))
    return (
        spark.read.text(path)
        .filter(F.trim(line) != "")
        .select(row.alias("row"), F.when(F.size(more) > 0, more).alias(UNDECLARED))
        .select("row.*", UNDECLARED)
    )


def hash_predicates(column: str, n: int) -> list[str]:
    """Predicates that deal the rows of a PostgreSQL table to ``n`` tasks by a text key."""
    key = f"coalesce(hashtext({column}), 0)"
    return [f"mod(mod({key}, {n}) + {n}, {n}) = {i}" for i in range(n)]


def load_jdbc(
    spark: SparkSession,
    url: str,
    schemas: Mapping[str, T.StructType] = STAR,
    tasks: int = 64,
    properties: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Tables of a PostgreSQL database, each read by ``tasks`` tasks.

    Rows are dealt out by a hash of the table's first column, its key or its document. Filters
    and columns are pushed into each task's query.
    """
    return {
        name: spark.read.jdbc(
            url,
            name,
            predicates=hash_predicates(schema.names[0], tasks),
            properties=dict(properties or {}),
        )
        for name, schema in schemas.items()
    }


def create_views(tables: Mapping[str, DataFrame]) -> None:
    """Each table as a temporary view of its name, for ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def check_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per keyed table: rows, null keys and repeated keys.

    Lookups, lists and missing-match tests take keys to be unique and never null.
    """
    checks = []
    for name, key in KEYS.items():
        if name not in tables:
            continue
        sizes = tables[name].groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
        checks.append(
            sizes.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias(
                    "null_keys"
                ),
                F.count_if(F.col("key").isNotNull() & (F.col("n") > 1)).alias("repeated_keys"),
            ).select(F.lit(name).alias("table_name"), "n_rows", "null_keys", "repeated_keys")
        )
    stacked = checks[0]
    for check in checks[1:]:
        stacked = stacked.unionByName(check)
    return stacked
