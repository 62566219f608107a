from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ordercash.functions import messages, questions, sqllog
from ordercash.functions.strings import strip
from ordercash.model import SAP, SAP_TABLES, catalog
from tests.conftest import day, rows

CATALOG = catalog(SAP)


def _ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")


def _log(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "log_id int, sql_text string")


def test_strip_removes_every_kind_of_white_space(spark):
    df = spark.createDataFrame([("\t a b  \n",), ("\x1f x",), ("  ",)], "v string")
    assert [r[0] for r in df.select(strip(F.col("v"))).collect()] == ["a b", "x", ""]


def test_domain_words_are_substrings(spark):
    df = _ask(spark, "STOP", "a small thing", "weather?", "Invoices", "hello")
    got = [r.is_dataset for r in questions.dataset_questions(df).collect()]
    assert got == [True, True, False, True, False]


def test_hints_take_the_word_after_the_first_whole_word(spark):
    df = _ask(
        spark, " show\n customer   C-1_x orders", "customer details", "Customers 5",
        "ORDER 7, order 8", "reorder 9",
    )
    got = rows(questions.question_hints(df), "normalized", "customer_hint", "order_hint")
    assert sorted(got) == sorted([
        ("show customer C-1_x orders", "C-1_x", None), ("customer details", "details", None),
        ("Customers 5", None, None), ("ORDER 7, order 8", None, "7"), ("reorder 9", None, None),
    ])


@pytest.mark.parametrize("text, intent", [
    ("recent orders", "recent_orders"),
    ("recent customer 12", "recent_orders"),  # the customer hint speaks of orders
    ("recent news", None),
    ("show customer 12 orders", "customer_details"),
    ("customer details", "customer_details"),
    ("top materials", "top_materials"),
    ("stop the product", "top_materials"),
    ("unpaid invoices", "unpaid_invoices"),
    ("trace order 5", "trace_orders"),
    ("Trace customer 5", "trace_orders"),
    ("trace it", None),
])
def test_intent(spark, text, intent):
    assert questions.question_intent(_ask(spark, text)).collect()[0].intent == intent


def test_tables_of_a_question(spark):
    def tables(text):
        return {r.table_name for r in questions.question_tables(_ask(spark, text)).collect()}

    assert tables("which material") == {
        "products", "product_descriptions", "sales_order_items", "sales_order_headers",
    }
    assert tables("hello") == set(SAP_TABLES)
    assert tables("pay") == {"payments_accounts_receivable", "billing_document_headers",
                             "business_partners", "sales_order_headers"}
    few = questions.question_tables(_ask(spark, "order"), tables=["sales_order_items"])
    assert [r.table_name for r in few.collect()] == ["sales_order_items"]


@pytest.mark.parametrize("sql, verdict, final", [
    (None, "empty", None),
    (" \t\n", "empty", None),
    (";", "not_select", None),
    ("DROP TABLE x", "not_select", None),
    ("select 1;;", "ok", "select 1 LIMIT 20"),
    ("  SELECT 1 ; ", "ok", "SELECT 1  LIMIT 20"),
    ("with x as (select 1) select 2", "ok", "with x as (select 1) select 2 LIMIT 20"),
    ("select 'update' from t", "forbidden", None),
    ("select updated from t", "ok", "select updated from t LIMIT 20"),
    ("select limits from t", "ok", "select limits from t"),
    ("select 1; delete from t", "forbidden", None),
])
def test_audit(spark, sql, verdict, final):
    got = sqllog.sql_log_audit(_log(spark, sql)).collect()[0]
    assert (got.verdict, got.final_sql) == (verdict, final)


@pytest.mark.parametrize("sql, unknown", [
    ("SELECT sales_order FROM sales_order_headers WHERE sales_order = 'it''s x'", []),
    ('SELECT soh.sales_order AS "My Name" FROM sales_order_headers soh', []),
    ("SELECT soh.customer_id FROM sales_order_headers AS soh", ["soh.customer_id"]),
    ("SELECT product FROM nowhere n", ["n", "nowhere"]),
    ("WITH t AS (SELECT product FROM products) SELECT product FROM t", ["t"]),
    ("SELECT a.sales_order FROM sales_order_headers a, sales_order_items b "
     "WHERE a.sales_order = b.sales_order", ["b", "b.sales_order"]),
    ("SELECT EXTRACT(year FROM creation_date) AS y FROM sales_order_headers",
     ["creation_date", "year"]),
    ("SELECT COUNT(*) AS n, ROUND(AVG(net_amount), 2) FROM sales_order_items", []),
    ("SELECT x.sales_order FROM (SELECT sales_order FROM sales_order_items) AS x",
     ["x.sales_order"]),
    # an alias used twice stands for the later table
    ("SELECT a.material FROM sales_order_items a JOIN products a ON 1 = 1", ["a.material"]),
    # a join word right after a table is taken for its alias, which hides the joined table
    ("SELECT products.product FROM sales_order_items JOIN products ON 1 = 1",
     ["products.product"]),
    ("SELECT dense_rank() OVER (ORDER BY product) FROM products", ["dense_rank"]),
    ("SELECT 5 AS five FROM products WHERE 1.5 < 2", []),
])
def test_identifiers(spark, sql, unknown):
    got = sqllog.sql_log_identifiers(_log(spark, sql), CATALOG).collect()[0]
    assert got.unknown == unknown
    assert set(got.asDict()) == {"log_id", "sql_text", "unknown"}


def test_identifiers_of_a_very_long_literal(spark):
    text = "SELECT product FROM products WHERE product = '" + "it''s nowhere " * 50_000 + "'"
    got = sqllog.sql_log_identifiers(_log(spark, text), CATALOG).collect()[0]
    assert got.unknown == []


@pytest.mark.parametrize("sql, verdict", [
    ("select product as product_id from products", "ok"),
    ("select a b c d e from products", "ok"),
    ("select a, b, c, d, e, f from products", "too_many_unknown"),
    ("select product as order_id, product as order_id from products", "duplicate_id_alias"),
    ("select product as sku_id from products", "bad_id_alias"),
])
def test_older_check(spark, sql, verdict):
    assert sqllog.sql_log_aliases(_log(spark, sql), CATALOG).collect()[0].verdict == verdict


@pytest.mark.parametrize("text, want", [
    ("plain", "plain"),
    ("head\n| a | b |\n|---|---|\n| 1 | 2 |\ntail", "head\ntail"),
    ("head\n --- \n\nmid\n  \n\n", "head\n\nmid"),
    ("keep - this\n-- \nend  ", "keep - this\nend  "),
    ("| only |", ""),
    (" \n ", ""),
    ("", ""),
])
def test_markdown_tables(spark, text, want):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(messages.strip_markdown_tables(F.col("v"))).collect()[0][0] == want


def test_digest(spark):
    data = [(i, f"n{i}", None, Decimal("12.50"), True, day("2024-01-02"), "hidden")
            for i in range(7)]
    df = spark.createDataFrame(
        data, "id int, name string, gone string, amount decimal(10,2), live boolean, at date, "
        "extra string",
    )
    got = messages.result_digest(df, ["id"]).collect()[0]
    assert got.n_results == 7
    lines = got.digest.split("\n")
    assert lines[0] == "Found 7 result(s)."
    assert lines[1] == "- id: 0, name: n0, gone: None, amount: 12.5, live: True, at: 2024-01-02"
    assert len(lines) == 6
    old = messages.result_digest(df, ["id"], rows=10, columns=None, mark=":").collect()[0].digest
    assert old.startswith("Found 7 result(s):\n") and "extra: hidden" in old
    assert len(old.split("\n")) == 8
    assert messages.result_digest(df.limit(0), ["id"]).collect()[0].digest == (
        "No matching data found."
    )


def test_digest_times_are_iso_text(spark):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS at")
    assert "at: 2024-01-02T03:04:05" in messages.result_digest(df, ["id"]).collect()[0].digest


def test_digest_numbers(spark):
    df = spark.createDataFrame(
        [(1, Decimal("10.000"), 1.5, 2.0e7), (2, Decimal("0.120"), 100.0, 0.25)],
        "id int, a decimal(10,3), b double, c double",
    )
    lines = messages.result_digest(df, ["id"]).collect()[0].digest.split("\n")[1:]
    assert lines == ["- id: 1, a: 10.0, b: 1.5, c: 20000000.0",
                     "- id: 2, a: 0.12, b: 100.0, c: 0.25"]


def test_numbers_in_exponent_form_keep_all_digits(spark):
    from ordercash.functions.plain import as_text

    values = [1e30, 1.5e-12, -0.0, float("nan"), float("inf"), float("-inf"), 1e7, -2.5e7, 1.25e10,
              123456789.125, -1e-5, 0.1, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    kind = df.schema["v"].dataType
    got = df.select("i", as_text(F.col("v"), kind, False).alias("a"), as_text(F.col("v"), kind, True).alias("b"))
    want = ["1" + "0" * 30, "0.0000000000015", "-0", "NaN", "Infinity", "-Infinity", "10000000", "-25000000",
            "12500000000", "123456789.125", "-0.00001", "0.1", "3"]
    assert [r.a for r in got.orderBy("i").collect()] == want
    pointed = [w if not w.lstrip("-").isdigit() else w + ".0" for w in want]
    assert [r.b for r in got.orderBy("i").collect()] == pointed


@pytest.mark.parametrize("sql, unknown", [
    ("SELECT plant_name, incoterms FROM plants WHERE plant = '7'", ["incoterms"]),
    ("SELECT j.cost_center, s.incoterms_classification, s.plant_name "
     "FROM journal_entry_items_accounts_receivable j "
     "JOIN customer_sales_area_assignments s ON j.customer = s.customer", ["s.plant_name"]),
    ("SELECT mrp_type FROM product_plants", []),
    ("SELECT schedule_line, city_name FROM sales_order_schedule_lines, business_partner_addresses", []),
])
def test_identifiers_of_the_whole_catalog(spark, sql, unknown):
    assert sqllog.sql_log_identifiers(_log(spark, sql), CATALOG).collect()[0].unknown == unknown


def test_older_check_knows_the_whole_catalog(spark):
    sql = "select plant_name, factory_calendar, valuation_area, plant_category, address_id, mrp_type from plants"
    got = sqllog.sql_log_aliases(_log(spark, sql), CATALOG).collect()[0]
    assert (got.n_unknown, got.verdict) == (0, "ok")


def test_identifiers_against_a_catalog_in_a_table(spark):
    names = spark.range(100_000).select(
        F.concat(F.lit("t"), (F.col("id") % 500).cast("string")).alias("table_name"),
        F.concat(F.lit("C"), F.col("id").cast("string")).alias("column_name"),
    )
    log = spark.createDataFrame(
        [(1, "select a.c7, c507, a.c8 from t7 a join t8 on t8.c8 = 'x'"), (2, "select c99999 from T499"),
         (3, "select c100000 from t500"), (4, None), (5, ""), (1, "select c100000 from t500")],
        "log_id long, sql_text string",
    )
    got = sqllog.sql_log_identifiers(log, names)
    assert sorted((r.log_id, r.unknown) for r in got.collect() if r.unknown is not None) == [
        (1, ["a.c8"]), (1, ["c100000", "t500"]), (2, []), (3, ["c100000", "t500"]), (5, [])
    ]
    assert [r.log_id for r in got.filter("unknown IS NULL").collect()] == [4]
    assert "c99998" not in got._jdf.queryExecution().toString()
    hot = log.filter("log_id = 2").crossJoin(spark.range(2000).select(F.col("id").alias("n")))
    assert sqllog.sql_log_identifiers(hot, names).filter(F.size("unknown") == 0).count() == 2000
