import datetime
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ordercash import model
from ordercash.operators import adhoc, analytics
from ordercash.session import scratch_dir
from ordercash.sources import sap, sinks, tables
from ordercash.sources.sample import Sample
from tests.conftest import SMALL, day, rows


def test_schemas_carry_types_and_comments():
    orders = model.STAR["orders"]
    assert orders["order_date"].dataType.simpleString() == "date"
    assert orders["total_amount"].dataType.simpleString() == "decimal(18,2)"
    assert orders["delivery_status"].metadata["comment"]
    assert set(model.SAP) <= set(model.SAP_TABLES) and len(model.SAP_TABLES) == 19


def test_catalog_reads_frames_and_schemas(spark):
    assert model.catalog({"t": spark.range(1)}) == {"t": ["id"]}
    assert model.catalog(model.STAR)["products"][0] == "product_id"


def test_relationships_name_declared_columns():
    for declared, relationships in (
        (model.STAR, model.STAR_RELATIONSHIPS), (model.SAP, model.SAP_RELATIONSHIPS),
    ):
        for r in relationships:
            assert r.child_key in declared[r.child].names
            assert r.parent_key in declared[r.parent].names


def test_document_relationships_hold_on_the_sample(spark):
    s = Sample(spark, SMALL).sap()
    got = {(r.child, r.parent): r.orphans for r in
           analytics.relationship_check(s, model.SAP_RELATIONSHIPS).collect()}
    assert got[("sales_order_items.sales_order", "sales_order_headers.sales_order")] == 0
    assert len(got) == 6


def test_load_o2c_reads_folders_and_files(spark):
    root = scratch_dir(spark, "load")
    spark.range(3).write.parquet(f"{root}/orders")
    spark.range(2).write.parquet(f"{root}/customers.parquet")
    loaded = tables.load_o2c(spark, root, ["orders", "customers"])
    assert (loaded["orders"].count(), loaded["customers"].count()) == (3, 2)
    tables.create_views(loaded)
    assert spark.sql("SELECT COUNT(*) FROM orders").collect()[0][0] == 3


def test_load_jsonl_uses_the_declared_types(spark):
    root = scratch_dir(spark, "jsonl")
    folder = f"{root}/billing_document_headers"
    os.makedirs(folder)
    lines = [
        {"billing_document": "1", "billing_document_date": "2024-05-06",
         "billing_document_is_cancelled": True, "total_net_amount": 12.345, "unused": 1},
        {"billing_document": "2"},
    ]
    with open(f"{folder}/part.jsonl", "w") as f:
        f.write("\n".join(json.dumps(x) for x in lines))
    df = tables.load_jsonl(spark, root, tables=["billing_document_headers"])[
        "billing_document_headers"
    ]
    assert df.schema["billing_document_date"].dataType.simpleString() == "date"
    got = rows(df, "billing_document", "billing_document_date", "total_net_amount",
               "billing_document_is_cancelled")
    assert got == [("1", day("2024-05-06"), Decimal("12.3450"), True), ("2", None, None, None)]


def test_hash_predicates_cover_each_part_once():
    got = tables.hash_predicates("id", 3)
    assert len(got) == 3 and all("hashtext(id)" in p for p in got)
    assert [p.rsplit(" = ", 1)[1] for p in got] == ["0", "1", "2"]


def test_load_jdbc_reads_each_table_in_parts():
    class Reader:
        def jdbc(self, url, table, predicates, properties):
            return (url, table, len(predicates), predicates[0], properties)

    class Session:
        read = Reader()

    got = tables.load_jdbc(Session(), "jdbc:postgresql://h/d", tasks=8, properties={"user": "u"})
    assert set(got) == set(model.STAR)
    url, table, n, first, properties = got["order_items"]
    assert (url, table, n, properties) == ("jdbc:postgresql://h/d", "order_items", 8, {"user": "u"})
    assert "hashtext(order_id)" in first


def test_check_keys_finds_nulls_and_repeats(spark):
    t = {"orders": spark.createDataFrame([("1",), ("1",), (None,)], "order_id string")}
    assert rows(tables.check_keys(t)) == [("orders", 3, 1, 1)]


def test_scratch_dir_follows_the_session(spark):
    class Conf:
        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return "hdfs://shared/x/"

    class Session:
        conf = Conf()

    assert scratch_dir(Session(), "a").startswith("hdfs://shared/x/a-")
    assert scratch_dir(spark, "a") != scratch_dir(spark, "a")


def test_scratch_dir_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError):
        scratch_dir(Session(), "a")


def test_export_reaches_nested_values(spark):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    df = spark.createDataFrame(
        [(1, day("2024-01-02"), Decimal("1.50"), [Decimal("2.50")], {"k": day("2024-01-03")},
          (at, Decimal("3.50")), at.replace(microsecond=60))],
        "id int, d date, m decimal(9,2), a array<decimal(9,2)>, h map<string,date>, "
        "s struct<t:timestamp,m:decimal(9,2)>, t timestamp",
    )
    got = sinks.export_rows(df).collect()[0].asDict(recursive=True)
    assert got == {
        "id": 1, "d": "2024-01-02", "m": 1.5, "a": [2.5], "h": {"k": "2024-01-03"},
        "s": {"t": "2024-01-02T03:04:05", "m": 3.5}, "t": "2024-01-02T03:04:05.000060",
    }


def test_export_leaves_plain_columns_alone(spark):
    df = spark.range(2).withColumn("s", F.lit("x"))
    assert sinks.export_rows(df).schema == df.schema
    assert sinks.preview(spark.range(200)).count() == 50


def test_star_from_documents_answers_as_the_star_does(spark):
    sample = Sample(spark, SMALL)
    derived = sap.o2c_from_sap(sample.sap())
    for name, df in derived.items():
        assert df.schema == model.STAR[name] or df.columns == model.STAR[name].names
    want = analytics.delivery_performance(sample.star())
    assert rows(analytics.delivery_performance(derived)) == rows(want)


def test_invoice_without_known_delivery_keeps_a_row(spark):
    s = {
        "outbound_delivery_items": spark.createDataFrame(
            [("d1", "s1"), ("d1", "s2")], "delivery_document string, reference_sd_document string"
        ),
        "billing_document_items": spark.createDataFrame(
            [("b1", "d1"), ("b1", "d1"), ("b2", "d9")],
            "billing_document string, reference_sd_document string",
        ),
        "billing_document_headers": spark.createDataFrame(
            [("b1", "c1", False), ("b2", "c1", True), ("b3", "c1", False)],
            "billing_document string, sold_to_party string, billing_document_is_cancelled boolean",
        ),
    }
    got = rows(sap.invoices(s), "invoice_id", "order_id", "is_cancelled")
    assert got == [("b1", "s1", 0), ("b1", "s2", 0), ("b2", None, 1), ("b3", None, 0)]


def test_today_is_the_default_day(spark):
    orders = spark.createDataFrame(
        [("1", "A", day("2000-01-01")), ("2", "A", day("2999-01-01")),
         ("3", "C", day("2000-01-01"))],
        "order_id string, delivery_status string, requested_delivery_date date",
    )
    assert rows(adhoc.date_now({"orders": orders}), "order_id") == [("1",)]


def test_every_table_of_the_document_model_is_declared():
    assert tuple(model.SAP) == model.SAP_TABLES
    assert sum(len(schema.names) for schema in model.SAP.values()) == 274


def test_load_jsonl_drops_nothing(spark, tmp_path):
    (tmp_path / "products").mkdir()
    (tmp_path / "products" / "part.jsonl").write_text(
        '{"product": "1", "gross_weight": "1.50", "unheard": {"of": [1]}}\n'
        '\n{"product": "2", "is_marked_for_deletion": "maybe"}\n{"product": \n'
    )
    df = tables.load_jsonl(spark, str(tmp_path), tables=["products"])["products"]
    assert df.columns == [*model.SAP["products"].names, "_corrupt_record", "_undeclared"]
    got = rows(df, "product", "gross_weight", "_corrupt_record", "_undeclared")
    assert len(got) == 3 and ("1", "1.50", None, {"unheard": '{"of":[1]}'}) in got
    assert ("2", None, '{"product": "2", "is_marked_for_deletion": "maybe"}', None) in got
    assert (None, None, '{"product": ', None) in got


def test_json_lines_of_the_documents_are_written_compressed(spark, tmp_path, monkeypatch):
    from registry import QUERIES, io

    monkeypatch.setattr(io, "scratch_dir", lambda _spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(io, "FILE_ROWS", 1000)
    digests = QUERIES["load_jsonl"](spark, "/root/testdata/sf0.001")
    parts = [p for p in tmp_path.rglob("part-*")]
    assert parts and all(p.name.endswith(".json.gz") for p in parts)
    # Several files of a table, as one is read by one task; no row is lost between them.
    items = spark.read.text(f"{tmp_path}/jsonl/sales_order_items")
    assert len([p for p in parts if p.parent.name == "sales_order_items"]) >= items.count() / 1000
    assert digests.filter("name = 'sales_order_items'").count() == items.count()
