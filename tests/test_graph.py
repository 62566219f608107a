import datetime
import time
from decimal import Decimal

from pyspark.sql import functions as F

from ordercash.operators import documents, graph
from ordercash.plans.kept import SETTINGS, kept
from ordercash.sources.sample import Sample
from registry.graph import MIXED_TOGETHER, _mixed_columns, mixed
from tests.conftest import SMALL, rows

SCHEMA = "n int, customer_id string, customer string, order_id string, sales_order string, " \
    "invoice_id string, delivery_id string, product string, material string, note string, " \
    "flag boolean, qty int"

ROWS = [
    (1, " c1 ", None, "o1", None, None, "", "  ", "m1", None, None, None),
    (2, "c1", "x", "  ", "o1", "i1", None, None, None, "", False, 0),
    (3, "", "c1", "o1", None, "i1", "d1", "m1", None, "late", True, 5),
    (4, None, None, None, None, "i2", None, None, None, "alone", None, 1),
]


def _df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_entity_id_is_the_first_filled_candidate(spark):
    got = rows(graph.entity_ids(_df(spark)), "n", "customer_entity", "order_entity",
               "product_entity")
    assert got == [(1, "c1", "o1", "m1"), (2, "c1", "o1", None), (3, "c1", "o1", "m1"),
                   (4, None, None, None)]


def test_nodes_are_unique_and_keep_the_first_filled_value(spark):
    nodes = {r.id: r for r in graph.graph_nodes(_df(spark), ["n"]).collect()}
    assert set(nodes) == {"customer_c1", "order_o1", "invoice_i1", "invoice_i2", "delivery_d1",
                          "product_m1"}
    order = nodes["order_o1"]
    assert (order.type, order.entity_id, order.label) == ("order", "o1", "Order o1")
    # null then "" then a text: the text; null then False: False; null then 0: zero is a value
    assert (order.context.note, order.context.flag, order.context.qty) == ("late", False, 0)
    assert order.context.customer_id == " c1 "
    assert order.first_ord.n == 1
    assert nodes["invoice_i2"].context.customer_id is None


def test_edges_join_entities_of_one_row_once(spark):
    got = rows(graph.graph_edges(_df(spark)), "id", "source", "target", "label")
    assert got == sorted([
        ("e_customer_c1_order_o1", "customer_c1", "order_o1", "related"),
        ("e_order_o1_invoice_i1", "order_o1", "invoice_i1", "related"),
        ("e_order_o1_delivery_d1", "order_o1", "delivery_d1", "related"),
        ("e_order_o1_product_m1", "order_o1", "product_m1", "related"),
    ])


def test_graph_does_not_depend_on_partitioning(spark):
    nodes, edges = graph.build_graph(_df(spark), ["n"])
    for n in (1, 3, 7):
        again = graph.build_graph(_df(spark).repartition(n, F.rand(n)), ["n"])
        assert rows(again[0]) == rows(nodes)
        assert rows(again[1]) == rows(edges)


def test_every_edge_ends_at_a_node(spark):
    nodes, edges = graph.build_graph(_df(spark), ["n"])
    ids = nodes.select("id")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    assert ends.join(ids, "id", "left_anti").count() == 0
    assert nodes.count() == ids.distinct().count()


def test_rows_without_entities_give_one_record(spark):
    bare = spark.createDataFrame([(2, "", "b"), (1, "", None)], "n int, order_id string, v string")
    nodes, edges = graph.build_graph(bare, ["n"])
    got = nodes.collect()
    assert [(r.id, r.type, r.label, r.context.v) for r in got] == [
        ("record_0", "record", "Result Row", None)
    ]
    assert edges.count() == 0
    plain, _ = graph.build_graph(bare.drop("order_id"), ["n"])
    assert [r.id for r in plain.collect()] == ["record_0"]


def test_fallback_can_be_left_out(spark):
    bare = spark.createDataFrame([(1, "")], "n int, order_id string")
    assert graph.build_graph(bare, ["n"], fallback=False)[0].count() == 0
    df = _df(spark)
    assert rows(graph.build_graph(df, ["n"], fallback=False)[0]) == rows(
        graph.build_graph(df, ["n"])[0]
    )


def test_no_rows_give_an_empty_graph(spark):
    for df in (_df(spark).limit(0), spark.createDataFrame([], "n int, v string")):
        nodes, edges = graph.build_graph(df, ["n"])
        assert nodes.count() == 0 and edges.count() == 0


def test_order_parties_are_not_customers_in_the_plain_graph(spark):
    df = spark.createDataFrame([(1, "s1", "c1")], "n int, sales_order string, sold_to_party string")
    assert [r.id for r in graph.graph_nodes(df, ["n"]).collect()] == ["order_s1"]
    assert graph.graph_edges(df).count() == 0


def test_typed_graph_labels_and_payments(spark):
    df = spark.createDataFrame(
        [(1, "s1", "c1", "d1", "b1", "p1"), (2, "s1", "c1", None, "b2", None)],
        "n int, sales_order string, sold_to_party string, delivery_document string, "
        "billing_document string, payment_id string",
    )
    nodes, edges = graph.o2c_typed_graph(df, ["n"])
    assert rows(edges, "source", "target", "label") == [
        ("customer_c1", "order_s1", "placed"),
        ("delivery_d1", "invoice_b1", "billed via"),
        ("invoice_b1", "payment_p1", "paid by"),
        ("order_s1", "delivery_d1", "fulfilled by"),
        ("order_s1", "invoice_b2", "billed via"),
    ]
    assert "payment_p1" in {r.id for r in nodes.collect()}


def test_empty_arrays_count_as_empty(spark):
    df = spark.createDataFrame(
        [(1, "o1", []), (2, "o1", ["x"])],
        "n int, order_id string, tags array<string>",
    )
    assert graph.graph_nodes(df, ["n"]).collect()[0].context.tags == ["x"]


def test_node_details_print_numbers_and_dates(spark):
    df = spark.createDataFrame(
        [("o1", Decimal("12.50"), Decimal("10.00"), 2.0e7, 0.25, True, datetime.date(2024, 1, 2))],
        "order_id string, a decimal(9,2), b decimal(9,2), c double, d double, e boolean, f date",
    )
    nodes, _ = graph.build_graph(df, ["order_id"])
    got = {r.attribute: r.value for r in graph.node_details(nodes).collect()}
    assert got == {
        "order_id": "o1", "a": "12.5", "b": "10", "c": "20000000", "d": "0.25", "e": "true",
        "f": "2024-01-02", "entity_id": "o1", "entity_type": "order",
    }


def test_ties_and_maps(spark):
    df = spark.createDataFrame(
        [(1, "o1", "b", None), (1, "o1", "a", {"k": 1}), (2, "o1", "0", {"k": 2})],
        "n int, order_id string, v string, m map<string,int>",
    )
    node = graph.graph_nodes(df, ["n"]).collect()[0]
    assert (node.context.v, node.context.m) == ("a", {"k": 1})


def test_node_details_list_filled_fields(spark):
    nodes, _ = graph.build_graph(_df(spark), ["n"])
    got = rows(graph.node_details(nodes).filter("node_id = 'invoice_i2'"), "attribute", "value")
    assert got == [("entity_id", "i2"), ("entity_type", "invoice"), ("invoice_id", "i2"),
                   ("n", "4"), ("note", "alone"), ("qty", "1")]


def test_columns_told_to_come_together_give_the_same_nodes(spark):
    df = _df(spark)
    plain = rows(graph.graph_nodes(df, ["n"]))
    for together in (
        [("order_id", "sales_order")], [("n", "customer_id", "note"), ("flag", "qty"), ("invoice_id", "absent")],
        [tuple(df.columns)],
    ):
        assert rows(graph.graph_nodes(df, ["n"], together=together)) == plain


def test_flow_nodes_keep_the_order_once_for_the_columns_of_a_table(spark):
    from registry.graph import FLOW_TOGETHER, _flow
    from ordercash.sources.sample import Sample
    from tests.conftest import SMALL

    flow = _flow(Sample(spark, SMALL))
    plan = graph.graph_nodes(flow, ["order_id", "document"], together=FLOW_TOGETHER)
    assert all(set(g) <= set(flow.columns) for g in FLOW_TOGETHER)
    assert "_group0" in plan._jdf.queryExecution().executedPlan().toString()


def test_lines_of_an_order_lie_together_and_equal_ones_once(spark, tmp_path):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    bare = lines.limit(50).withColumn("l_extendedprice", F.lit(None).cast("double"))
    lines.unionByName(lines.limit(500)).unionByName(bare).write.parquet(f"{tmp_path}/lineitem.parquet")
    sample = Sample(spark, str(tmp_path))
    plain = sample.raw("lineitem").selectExpr(*_mixed_columns("STRING")).distinct()
    assert rows(mixed(sample)) == rows(plain)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = mixed(sample).select("sales_order", "line_key", F.spark_partition_id().alias("part"))
        placed = placed.filter("line_key IS NOT NULL").distinct().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = {r.part for r in placed}
    assert len(parts) > 1
    # Each order is in one part, but for those where a part ends.
    orders = {r.sales_order for r in placed}
    assert len({(r.sales_order, r.part) for r in placed}) < len(orders) + len(parts)


def test_graph_nodes_keeps_the_order_once_for_columns_of_every_line(spark):
    named = graph.graph_nodes(mixed(Sample(spark, SMALL)), ["line_key"], together=MIXED_TOGETHER)
    plain = graph.graph_nodes(mixed(Sample(spark, SMALL)), ["line_key"])
    assert rows(named) == rows(plain)


def test_nodes_made_in_passes_are_the_same(spark):
    df = _df(spark)
    for order, together in ((["n"], ()), (["n", "note"], [("order_id", "note"), ("flag", "qty")])):
        plain = graph.graph_nodes(df, order, together=together)
        for passes in (2, 3, 9):
            again = graph.graph_nodes(df, order, together=together, passes=passes)
            assert again.dtypes == plain.dtypes and rows(again) == rows(plain)
    for some in (df, df.limit(0), df.select("n", "note")):
        for make in (graph.build_graph, graph.o2c_typed_graph):
            for a, b in zip(make(some, ["n"], passes=3), make(some, ["n"])):
                assert rows(a) == rows(b)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_what_is_kept_leaves_no_shuffle_on_disk(spark):
    before = _shuffle_files(spark)
    settings = {key: spark.conf.get(key, None) for key in SETTINGS}
    df = spark.range(1000).repartition(3).groupBy((F.col("id") % 10).alias("k")).count()
    assert rows(kept("counts", df, df.limit(0))) == [(k, 100) for k in range(10)]
    for _ in range(100):  # files are removed beside the statement that follows
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert {key: spark.conf.get(key, None) for key in SETTINGS} == settings


def test_paths_kept_halfway_are_the_same(spark):
    tables = Sample(spark, SMALL).sap()
    assert rows(documents.trace_orders_full(tables, keep=True)) == rows(documents.trace_orders_full(tables))


def test_graph_nodes_leaves_no_shuffle_to_its_reader(spark):
    from registry import QUERIES

    nodes = QUERIES["graph_nodes"](spark, SMALL)
    assert "Exchange" not in nodes._jdf.queryExecution().executedPlan().toString()
    plain = graph.graph_nodes(mixed(Sample(spark, SMALL)), ["line_key"], together=MIXED_TOGETHER)
    assert rows(nodes, "id", "ctx_line_key", "ctx_order_id") == rows(
        plain.select("id", F.col("context.line_key"), F.col("context.order_id"))
    )


def test_build_graph_leaves_its_reader_the_record_alone_to_shuffle(spark):
    from registry import QUERIES

    text = QUERIES["build_graph"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in text and text.count("Exchange SinglePartition") == 1
