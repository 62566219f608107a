"""Jobs over a column of logged SQL text: safety audit and identifier checks.

The checks are word lists and patterns applied to a text; nothing is parsed or planned. The audit and
the older check are column expressions over one row. The check against the catalog takes the catalog
as a table of any size: statements are reduced to their distinct shapes (quoted text emptied), their
names are rows, and joins tell which of them the catalog has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordercash.functions.strings import strip
from ordercash.plans import having_no, having_some, join_totals

# Words that get a statement rejected, and the limit added when none is given.
FORBIDDEN = (
    "drop", "delete", "update", "insert", "alter", "truncate", "grant", "revoke", "create",
)
DEFAULT_LIMIT = " LIMIT 20"

# Words that are not identifiers, for ``sql_log_identifiers``.
RESERVED = (
    "select from join left right inner outer full cross on where and or not as with limit "
    "offset group by order desc asc having union all distinct case when then else end null "
    "is in like ilike between exists true false count sum avg min max coalesce cast to over "
    "partition row_number rank date now extract interval varchar text integer numeric boolean "
    "current_date current_timestamp date_trunc to_char to_date round greatest least substring "
    "upper lower concat nullif jsonb_build_object json_agg array_agg unnest"
).split()

# The shorter list and the allowed id aliases of the older check.
OLD_RESERVED = (
    "select from join left right inner outer on where and or as with limit offset group by "
    "order desc asc count sum avg min max distinct case when then else end not null is having "
    "true false in like ilike coalesce"
).split()
ID_ALIASES = (
    "customer_id", "order_id", "delivery_id", "invoice_id", "payment_id", "product_id",
)
MIN_UNKNOWN = 5
UNKNOWN_SHARE = 0.45

# Patterns of names and of their uses.
NAME = r"[a-z_][a-z0-9_]*"
REF_PATTERN = rf"(?U)\b(from|join)\s+({NAME})(?:\s+(?:as\s+)?({NAME}))?"
AS_PATTERN = rf"(?U)\bas\s+({NAME})\b"
QUALIFIED_PATTERN = rf"(?U)\b({NAME})\.({NAME})\b"
NUMBER_PATTERN = r"(?U)\b[0-9]+(?:\.[0-9]+)?\b"


def sql_log_audit(df: DataFrame, text: str = "sql_text") -> DataFrame:
    """The rows with ``verdict`` and, where it is ``ok``, the statement as it would run.

    Verdicts: ``empty``, ``not_select``, ``forbidden``, ``ok``. A forbidden word counts
    wherever it stands, inside a literal too.
    """
    checked = df.withColumn("_raw", F.rtrim(strip(F.col(text)), F.lit(";"))).withColumn(
        "_lower", F.lower("_raw")
    )
    raw, lower = F.col("_raw"), F.col("_lower")
    starts = lower.startswith("select") | lower.startswith("with")
    verdict = (
        F.when(F.col(text).isNull() | (strip(F.col(text)) == ""), "empty")
        .when(~starts, "not_select")
        .when(lower.rlike(rf"(?U)\b(?:{'|'.join(FORBIDDEN)})\b"), "forbidden")
        .otherwise("ok")
    )
    final = F.when(lower.contains("limit"), raw).otherwise(F.concat(raw, F.lit(DEFAULT_LIMIT)))
    return (
        checked.withColumn("verdict", verdict)
        .withColumn("final_sql", F.when(F.col("verdict") == "ok", final))
        .drop("_raw", "_lower")
    )


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _blank_quotes(text: Column) -> Column:
    """Quoted text emptied; a doubled quote inside it simply ends one run and starts another."""
    return F.regexp_replace(F.regexp_replace(text, r"'[^']*'", "''"), r'"[^"]*"', '""')


def _words(text: Column) -> Column:
    """The distinct words that are names: what is between characters that no word has."""
    return F.array_distinct(F.filter(F.split(text, r"(?U)\W+"), lambda w: w.rlike(rf"^{NAME}\z")))


def catalog_table(spark: SparkSession, catalog: Mapping[str, Sequence[str]]) -> DataFrame:
    """(table_name, column_name) of a catalog given as a mapping."""
    pairs = [(t, c) for t, cols in catalog.items() for c in cols]
    return spark.createDataFrame(pairs, "table_name string, column_name string")


def _names_used(shapes: DataFrame) -> dict[str, DataFrame]:
    """Names of each shape, by ``_id``: table references with their nick, words after AS, qualified
    names and words. A match is taken once and split."""
    part = lambda m, i: F.get(F.split(m, r"(?U)\s+"), F.lit(i))
    last = lambda m: F.element_at(F.split(m, r"(?U)\s+"), -1)
    sql = F.col("_shape")
    refs = shapes.select("_id", F.posexplode(_all(sql, REF_PATTERN, 0)).alias("pos", "m")).select(
        "_id", "pos", part(F.col("m"), 1).alias("name"),
        F.when(F.size(F.split("m", r"(?U)\s+")) > 2, last(F.col("m"))).otherwise("").alias("nick"),
    )
    renamed = shapes.select("_id", F.explode(_all(sql, AS_PATTERN, 0)).alias("m")).select(
        "_id", last(F.col("m")).alias("word")
    )
    qualified = shapes.select("_id", F.explode(F.array_distinct(_all(sql, QUALIFIED_PATTERN, 0))).alias("m")).select(
        "_id", F.substring_index("m", ".", 1).alias("owner"), F.substring_index("m", ".", -1).alias("name"), "m"
    )
    loose = F.regexp_replace(F.regexp_replace(sql, QUALIFIED_PATTERN, " "), NUMBER_PATTERN, " ")
    words = shapes.select("_id", F.explode(_words(loose)).alias("word"))
    return {"refs": refs, "as": renamed, "qualified": qualified, "words": words}


def unknown_names(shapes: DataFrame, names: DataFrame) -> DataFrame:
    """(``_id``, ``unknown``) of the shapes with a name that the catalog table ``names`` doesn't have."""
    names = names.select(F.lower("table_name").alias("table"), F.lower("column_name").alias("column"))
    tables = names.select(F.col("table").alias("name"))
    used = _names_used(shapes)
    known = having_some(used["refs"], tables, "name")
    # Names a qualifier may use, each with its table; of two with one name the later holds.
    owners = known.select("_id", F.inline(F.array(
        F.struct(F.col("name").alias("owner"), F.col("name").alias("table"), (2 * F.col("pos")).alias("at")),
        F.struct(F.col("nick").alias("owner"), F.col("name").alias("table"), (2 * F.col("pos") + 1).alias("at")),
    ))).filter(
        (F.col("owner") == F.col("table")) | ((F.col("owner") != "") & ~F.col("owner").isin(RESERVED))
    ).groupBy("_id", "owner").agg(F.max_by("table", "at").alias("table"))
    resolved = used["qualified"].join(owners, ["_id", "owner"], "left").withColumn(
        "full", F.concat("table", F.lit("."), "name")
    )
    columns = names.select(F.concat("table", F.lit("."), "column").alias("full"))
    either = tables.select(F.col("name").alias("word")).unionAll(names.select("column"))
    aliases = owners.select("_id", F.col("owner").alias("word")).unionByName(used["as"]).distinct()
    words = having_no(used["words"].filter(~F.col("word").isin(RESERVED)), either, "word")
    bad = (
        having_no(used["refs"], tables, "name").select("_id", F.col("name").alias("bad"))
        .unionAll(having_no(resolved, columns, "full").select("_id", "m"))
        .unionAll(words.join(aliases, ["_id", "word"], "left_anti").select("_id", "word"))
    )
    return bad.groupBy("_id").agg(F.array_sort(F.collect_set("bad")).alias("unknown"))


def sql_log_identifiers(
    df: DataFrame, catalog: Mapping[str, Sequence[str]] | DataFrame, text: str = "sql_text"
) -> DataFrame:
    """The rows with ``unknown``: the sorted names in the SQL that the catalog does not have.

    ``catalog`` is a table (table_name, column_name), or maps table names to column names, as
    ``ordercash.model.catalog`` gives it. A null text has null. Statements that differ in quoted text
    alone are looked at once.
    """
    names = catalog if isinstance(catalog, DataFrame) else catalog_table(df.sparkSession, catalog)
    shape = _blank_quotes(F.lower(F.col(text)))
    shapes = df.select(shape.alias("_shape")).filter(F.col("_shape").isNotNull()).distinct()
    bad = unknown_names(shapes.withColumn("_id", F.unhex(F.sha2("_shape", 256))), names)
    found = join_totals(df.withColumn("_id", F.unhex(F.sha2(shape, 256))), bad, "_id")
    none = F.when(F.col(text).isNotNull(), F.array().cast("array<string>"))
    return found.withColumn("unknown", F.coalesce("unknown", none)).drop("_id")


def sql_log_aliases(
    df: DataFrame, catalog: Mapping[str, Sequence[str]], text: str = "sql_text"
) -> DataFrame:
    """The rows with the outcome of the older, laxer check.

    ``n_words`` and ``n_unknown`` count distinct words; ``verdict`` is ``too_many_unknown``,
    ``duplicate_id_alias``, ``bad_id_alias`` or ``ok``.
    """
    names = sorted({*catalog, *(c for cols in catalog.values() for c in cols)})
    found = df.withColumn("_sql", F.lower(F.col(text))).withColumns({
        "_words": F.filter(_words(F.col("_sql")), lambda w: ~w.isin(OLD_RESERVED)),
        "_ids": F.filter(_all(F.col("_sql"), AS_PATTERN), lambda a: a.endswith("_id")),
    })
    n_words = F.size("_words")
    n_unknown = F.size(F.filter("_words", lambda w: ~w.isin(names)))
    allowed = F.greatest(
        F.lit(MIN_UNKNOWN).cast("bigint"), F.floor(n_words * F.lit(UNKNOWN_SHARE))
    )
    verdict = (
        F.when(n_unknown > allowed, "too_many_unknown")
        .when(F.size("_ids") != F.size(F.array_distinct("_ids")), "duplicate_id_alias")
        .when(F.exists("_ids", lambda a: ~a.isin(list(ID_ALIASES))), "bad_id_alias")
        .otherwise("ok")
    )
    return found.withColumns(
        {"n_words": n_words, "n_unknown": n_unknown, "verdict": verdict}
    ).drop("_sql", "_words", "_ids")
