import pytest
from pyspark.sql import functions as F

from ordercash.operators import documents
from ordercash.sources.sample import Sample
from tests.conftest import SMALL, day, rows


def _frames(spark):
    return {
        "sales_order_headers": spark.createDataFrame(
            [("s1", "c1", day("2024-01-01")), ("s2", "c2", day("2024-01-02")),
             ("s3", "c1", None)],
            "sales_order string, sold_to_party string, creation_date date",
        ),
        "outbound_delivery_items": spark.createDataFrame(
            [("d1", "s1"), ("d1", "s1"), ("d2", "s1")],
            "delivery_document string, reference_sd_document string",
        ),
        "billing_document_items": spark.createDataFrame(
            [("b1", "d1"), ("b1", "d1"), ("b1", "d1")],
            "billing_document string, reference_sd_document string",
        ),
        "billing_document_headers": spark.createDataFrame(
            [("b1", "a1", "c1", day("2024-02-01"), False),
             ("b2", "a2", "c1", day("2024-02-02"), False),
             ("b3", "a3", "c2", None, False),
             ("b4", "a4", "c2", day("2024-02-04"), True)],
            "billing_document string, accounting_document string, sold_to_party string, "
            "billing_document_date date, billing_document_is_cancelled boolean",
        ).withColumn("total_net_amount", F.lit(1).cast("decimal(30,4)")),
        "payments_accounts_receivable": spark.createDataFrame(
            [("a1", "a1", "c1", day("2024-03-01")), ("a2", None, "c1", None),
             ("a2", None, "c1", None)],
            "accounting_document string, invoice_reference string, customer string, "
            "clearing_date date",
        ),
    }


def test_trace_counts_item_paths_instead_of_forming_them(spark):
    s = _frames(spark)
    want = sorted([
        ("s1", "c1", "d1", "b1", "a1", 6), ("s1", "c1", "d2", None, None, 1),
        ("s2", "c2", None, None, None, 1), ("s3", "c1", None, None, None, 1),
    ], key=repr)
    assert rows(documents.trace_orders_full(s)) == want


def test_trace_page_shows_each_item_path(spark):
    got = [r.sales_order + "/" + str(r.billing_document)
           for r in documents.trace_orders(_frames(spark), limit=5).collect()]
    assert got == ["s3/None", "s2/None", "s1/b1", "s1/b1", "s1/b1"]
    assert documents.trace_orders(_frames(spark)).count() == 9


def test_unpaid_depends_on_the_link(spark):
    s = _frames(spark)

    def links(link):
        return rows(documents.unpaid_by_link(s, link), "billing_document", "open_links")

    assert links("document") == [("b2", 2), ("b3", 1)]
    assert links("invoice_reference") == [("b2", 1), ("b3", 1)]
    assert links("customer") == [("b1", 2), ("b2", 2), ("b3", 1)]
    with pytest.raises(KeyError):
        links("order")


def test_unpaid_page_repeats_an_invoice_per_open_link(spark):
    got = [r.billing_document for r in documents.unpaid_invoices(_frames(spark)).collect()]
    assert got == ["b3", "b2", "b2"]
    assert documents.unpaid_invoices(_frames(spark), limit=2).count() == 2


def test_every_intent_has_a_report(spark):
    from ordercash.functions.questions import INTENTS

    s = Sample(spark, SMALL).sap()
    for name, _ in INTENTS:
        assert 0 < documents.REPORTS[name](s).count() <= documents.TOP
