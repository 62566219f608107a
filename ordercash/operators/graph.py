"""Result rows to an entity graph: one DataFrame of nodes, one of edges.

The graph follows the rows: an entity becomes a node when a row names it, and two entities
are linked when the same row names both. A node's context keeps, for each column, the first
non-empty value in row order. Row order is given by ordering columns, and the first value is
a minimum over (order, value), so no row is numbered and partial results combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordercash.functions.plain import as_text
from ordercash.functions.strings import strip
from ordercash.plans.kept import kept

# The columns that may hold the id of each entity type, in order of preference.
ENTITY_COLUMNS = {
    "customer": ("customer_id", "business_partner", "customer"),
    "order": ("order_id", "sales_order"),
    "invoice": ("invoice_id", "billing_document"),
    "delivery": ("delivery_id", "delivery_document"),
    "product": ("product_id", "product", "material"),
}


class Link(NamedTuple):
    source: str
    target: str
    label: str
    unless: str | None = None  # entity type whose presence in the row suppresses the link


# Which entities of a row are linked.
LINKS = (
    Link("customer", "order", "related"),
    Link("order", "invoice", "related"),
    Link("order", "delivery", "related"),
    Link("order", "product", "related"),
)

# The documented graph model, with payments and a label per kind of link.
TYPED_COLUMNS = {
    **ENTITY_COLUMNS,
    "customer": (*ENTITY_COLUMNS["customer"], "sold_to_party"),
    "payment": ("payment_id",),
}
TYPED_LINKS = (
    Link("customer", "order", "placed"),
    Link("order", "delivery", "fulfilled by"),
    Link("delivery", "invoice", "billed via"),
    Link("order", "invoice", "billed via", unless="delivery"),
    Link("invoice", "payment", "paid by"),
    Link("order", "product", "contains"),
)


def _entity_id(df: DataFrame, candidates: Sequence[str]) -> Column:
    filled = [
        F.nullif(strip(F.col(f"`{c}`").cast("string")), F.lit(""))
        for c in candidates
        if c in df.columns
    ]
    return F.coalesce(*filled) if filled else F.lit(None).cast("string")


def _present(df: DataFrame, columns: dict[str, Sequence[str]]) -> dict[str, Column]:
    """Id expression of each entity type that ``df`` has a column for."""
    return {
        kind: _entity_id(df, candidates)
        for kind, candidates in columns.items()
        if any(c in df.columns for c in candidates)
    }


def entity_ids(
    df: DataFrame, columns: dict[str, Sequence[str]] = ENTITY_COLUMNS
) -> DataFrame:
    """The rows with one more column per entity type: the first non-blank candidate."""
    return df.select(
        "*", *[_entity_id(df, c).alias(f"{kind}_entity") for kind, c in columns.items()]
    )


def _node_id(kind: str, entity_id: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), entity_id)


def _filled(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    value = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return value.isNotNull() & (value != "")
    if isinstance(kind, T.ArrayType):
        return value.isNotNull() & (F.size(value) > 0)
    return value.isNotNull()


def _first(df: DataFrame, column: str, order_by: Sequence[str]) -> Column:
    """Aggregate: the filled value of the first row; of rows that tie, the least value."""
    value, filled = F.col(f"`{column}`"), _filled(df, column)
    if list(order_by) == [column]:  # the order is the value
        return F.min(F.when(filled, F.col("_ord")))[column]
    if "map<" in df.schema[column].dataType.simpleString():  # maps have no order
        return F.min_by(F.when(filled, value), F.when(filled, F.col("_ord")))
    ordered = F.struct(F.col("_ord").alias("ord"), value.alias("value"))
    return F.min(F.when(filled, ordered))["value"]


def _firsts(
    df: DataFrame, order_by: Sequence[str], together: Sequence[Sequence[str]]
) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates, and from them the first filled value of each column.

    A row that fills a whole group of ``together`` goes into one minimum with its order and the
    group's values, others into one for each column they fill; the earlier of both is the first.
    """
    aggregates, values = [], {}
    for at, group in enumerate(together):
        group = [
            c for c in group
            if c in df.columns and list(order_by) != [c] and "map<" not in df.schema[c].dataType.simpleString()
        ]
        if len(group) < 2:
            continue
        whole = reduce(Column.__and__, [_filled(df, c) for c in group])
        own = [F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(group)]
        aggregates.append(F.min(F.when(whole, F.struct(F.col("_ord").alias("ord"), *own))).alias(f"_group{at}"))
        for i, c in enumerate(group):
            single = F.struct(F.col("_ord").alias("ord"), F.col(f"`{c}`").alias("value"))
            aggregates.append(F.min(F.when(_filled(df, c) & ~whole, single)).alias(f"_single{at}_{i}"))
            first = F.col(f"_group{at}")
            first = F.when(first.isNotNull(), F.struct(first["ord"].alias("ord"), first[f"v{i}"].alias("value")))
            values[c] = F.least(first, F.col(f"_single{at}_{i}"))["value"]
    alone = [c for c in df.columns if c not in values]
    aggregates += [_first(df, c, order_by).alias(f"_alone{i}") for i, c in enumerate(alone)]
    return aggregates, values | {c: F.col(f"_alone{i}") for i, c in enumerate(alone)}


def _label(kind: Column, entity_id: Column) -> Column:
    return F.concat_ws(" ", F.initcap(kind), entity_id)


def graph_nodes(
    df: DataFrame,
    order_by: Sequence[str],
    columns: dict[str, Sequence[str]] = ENTITY_COLUMNS,
    together: Sequence[Sequence[str]] = (),
    passes: int = 1,
) -> DataFrame:
    """One node per entity: id, type, entity_id, label, context, first_ord.

    ``order_by`` must identify a row; ``first_ord`` is its value for the first row that
    names the entity. ``together`` may name groups of columns, no column twice, that most rows fill
    all or none of, such as those of one table: the order is then kept once for a group and not for
    each of its columns. The values are the same for any groups, or none.

    With ``passes`` above 1 the rows are written once when this is called, and then the nodes, a share of
    their ids at a time, so that no more than the shuffle of a share is on disk at once. The nodes are the same.
    """
    return _nodes(kept("rows", df) if passes > 1 else df, order_by, columns, together, passes)


def _nodes(
    df: DataFrame,
    order_by: Sequence[str],
    columns: dict[str, Sequence[str]],
    together: Sequence[Sequence[str]],
    passes: int,
) -> DataFrame:
    ids = _present(df, columns)
    if not ids:
        none = df.filter(F.lit(False))
        return _record(
            none.select(F.struct("*").alias("context"), F.struct(*order_by).alias("first_ord"))
        )
    entities = F.array(
        *[F.struct(i.alias("_id"), F.lit(k).alias("_type")) for k, i in ids.items()]
    )
    named = df.select(
        F.inline(entities),
        F.struct(*order_by).alias("_ord"),
        *[F.col(f"`{c}`") for c in df.columns],
    ).filter(F.col("_id").isNotNull())
    first, values = _firsts(df, order_by, together)
    context = F.struct(*[values[c].alias(c) for c in df.columns])

    def merged(rows: DataFrame) -> DataFrame:
        # Ids come first: the rows are sorted to be grouped, and ids differ sooner than types do.
        nodes = rows.groupBy("_id", "_type").agg(F.min("_ord").alias("_first_ord"), *first)
        return nodes.select("_id", "_type", context.alias("_context"), "_first_ord")

    if passes > 1:
        share = F.pmod(F.xxhash64("_id", "_type"), F.lit(passes))
        nodes = kept("nodes", *[merged(named.filter(share == k)) for k in range(passes)])
    else:
        nodes = merged(named)
    return nodes.select(
        F.concat_ws("_", "_type", "_id").alias("id"),
        F.col("_type").alias("type"),
        F.col("_id").alias("entity_id"),
        _label(F.col("_type"), F.col("_id")).alias("label"),
        F.col("_context").alias("context"),
        F.col("_first_ord").alias("first_ord"),
    )


def record_fallback(
    df: DataFrame,
    order_by: Sequence[str],
    columns: dict[str, Sequence[str]] = ENTITY_COLUMNS,
) -> DataFrame:
    """One ``record_0`` node holding the first row, when no row of ``df`` names an entity."""
    ids = _present(df, columns)
    named = F.coalesce(*ids.values()).isNotNull() if ids else F.lit(False)
    order = F.struct(*order_by)
    first = df.agg(
        F.max(named).alias("named"),
        F.min_by(F.struct("*"), order).alias("context"),
        F.min(order).alias("first_ord"),
    ).filter(~F.col("named"))
    return _record(first.select("context", "first_ord"))


def _record(first: DataFrame) -> DataFrame:
    return first.select(
        F.lit("record_0").alias("id"),
        F.lit("record").alias("type"),
        F.lit("record_0").alias("entity_id"),
        F.lit("Result Row").alias("label"),
        "context",
        "first_ord",
    )


def graph_edges(
    df: DataFrame,
    columns: dict[str, Sequence[str]] = ENTITY_COLUMNS,
    links: Sequence[Link] = LINKS,
) -> DataFrame:
    """One edge per linked pair: id, source, target, label."""
    ids = _present(df, columns)
    pairs = []
    for link in links:
        if link.source not in ids or link.target not in ids:
            continue
        source = _node_id(link.source, ids[link.source])
        target = _node_id(link.target, ids[link.target])
        if link.unless in ids:
            target = F.when(ids[link.unless].isNull(), target)
        pairs.append(
            F.struct(
                source.alias("source"), target.alias("target"), F.lit(link.label).alias("label")
            )
        )
    if not pairs:
        empty = F.lit("")
        return df.filter(F.lit(False)).select(
            *[empty.alias(c) for c in ("id", "source", "target", "label")]
        )
    return (
        df.select(F.inline(F.array(*pairs)))
        .filter(F.col("source") != F.col("target"))
        .distinct()
        .select(F.concat_ws("_", F.lit("e"), "source", "target").alias("id"), "*")
    )


def _graph(
    df: DataFrame,
    order_by: Sequence[str],
    columns: dict[str, Sequence[str]],
    links: Sequence[Link],
    fallback: bool,
    together: Sequence[Sequence[str]],
    passes: int,
) -> tuple[DataFrame, DataFrame]:
    if passes > 1:
        df = kept("rows", df)
    nodes = _nodes(df, order_by, columns, together, passes)
    if fallback:
        nodes = nodes.unionByName(record_fallback(df, order_by, columns))
    return nodes, graph_edges(df, columns, links)


def build_graph(
    df: DataFrame, order_by: Sequence[str], fallback: bool = True, together: Sequence[Sequence[str]] = (),
    passes: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a result; no rows in, none out.

    ``fallback=False`` leaves out the record node, and with it one evaluation of ``df``, for
    a result known to name some entity. For ``together`` and ``passes`` see ``graph_nodes``.
    """
    return _graph(df, order_by, ENTITY_COLUMNS, LINKS, fallback, together, passes)


def o2c_typed_graph(
    df: DataFrame, order_by: Sequence[str], fallback: bool = True, together: Sequence[Sequence[str]] = (),
    passes: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """The documented model: payment nodes too, and a label for each kind of link."""
    return _graph(df, order_by, TYPED_COLUMNS, TYPED_LINKS, fallback, together, passes)


def node_details(nodes: DataFrame) -> DataFrame:
    """Long form of the nodes: (node_id, attribute, value) for each filled context field."""
    own = {"entity_id", "entity_type"}
    attributes = [
        (f.name, as_text(F.col(f"context.`{f.name}`"), f.dataType, point=False))
        for f in nodes.schema["context"].dataType.fields
        if f.name not in own
    ]
    attributes += [("entity_id", F.col("entity_id")), ("entity_type", F.col("type"))]
    entries = F.array(
        *[F.struct(F.lit(a).alias("attribute"), v.alias("value")) for a, v in attributes]
    )
    return nodes.select(F.col("id").alias("node_id"), F.inline(entries)).filter(
        F.col("value") != ""
    )
