"""Merkle manifest of a dataset: digests of all rows, folded by tree (a column's value) and then to one root.

Time-forward processing. A node is labelled (level, tree, place); children have lower labels than their
parent. Digests travel as messages to the label of the parent: the shuffle by that label is the external
priority queue, it sorts on disk what doesn't fit and hands each node the at most 16 messages sent to it,
in order. One sweep upwards, level by level, gives every node its digest. A sweep back from the root
delivers to each node the rest of its proof: its siblings on the left and on the right, then those of
its parent, and so on. Rows of the lowest level get theirs in the task that hashes it, so proofs, of
some kilobytes each, are neither shuffled nor written.

A leaf is the digest of its fields, each ``-`` if null, else byte count, ``:`` and value. Leaves of a tree
ascend by id, subroots by tree; while more than one node remains, every 16 consecutive ones (the last
run may be shorter, even one) become the digest of their digests' hex, joined. Subroots likewise give the root.

Places are counted without a task that sees a whole tree: rows are sorted by ranges of (tree, id), counted
range by range, and the counts of the ranges before are added.

Nulls: a null tree is a tree of its own, ahead of all others; a null id comes first in its tree and has the
field ``-``. Rows of one id are ordered by their digests, so equal rows stand side by side. Empty texts
count as ``0:``. An empty table has no rows and no root. Other columns, whatever their names, are left
aside.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ordercash.llm.common import ship, written

ship(__name__)

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """H: lowercase hex sha256."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    told = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(told, F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each sorted row among those of its tree in this range, as a column ``at``."""
    last, behind = None, 0
    for rows in batches:
        if not rows.num_rows:
            continue
        tree = rows.column(rows.schema.get_field_index("tree"))
        new = np.empty(len(tree), dtype=bool)
        new[0] = tree[0].as_py() != last
        new[1:] = pc.not_equal(tree[1:], tree[:-1]).to_numpy(zero_copy_only=False)
        i = np.arange(len(tree))
        start = np.maximum.accumulate(np.where(new, i, -1))
        at = np.where(start >= 0, i - start, i + behind)
        last, behind = tree[-1].as_py(), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at)], names=[*rows.schema.names, "at"])


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with a column ``tree``) with ``place`` in the tree by ``order``, from 0, and ``size`` of the tree."""
    # Any number of equal rows may fall into several ranges.
    keys = ["tree", *order, "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    ranged = ranged.withColumn("range", F.spark_partition_id())
    schema = StructType([*ranged.schema.fields, StructField("at", LongType())])
    ranged = written(ranged.mapInArrow(_numbers, schema), "ranges")
    counts = ranged.groupBy("tree", "range").agg(F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        counts.select(
            "tree", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
            F.sum("n").over(tree).alias("size"),
        ),
        "starts",
    )
    return ranged.join(starts, ["tree", "range"]).withColumn("place", F.col("start") + F.col("at")).drop(
        "range", "at", "start"
    )


def _hex(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["digest"]), "")


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The sweep upwards from nodes (tree, place, size, digest and others), by level.

    Each level has a row for each run: ``tree``, ``place`` of the parent, ``size`` (nodes of the tree at this
    level), ``run`` (its nodes in order) and the parent's ``digest``. A tree of one node passes it on as it is.
    """
    out: list[DataFrame] = []
    more = True
    while more:
        content = F.struct("place", "digest", *(c for c in nodes.columns if c not in ("tree", "place", "size", "digest")))
        runs = written(
            nodes.groupBy("tree", F.floor(F.col("place") / FANOUT).alias("parent"), "size")
            .agg(F.array_sort(F.collect_list(content)).alias("run"))
            .select(
                "tree", F.col("parent").alias("place"), "size", "run",
                F.when(F.col("size") == 1, F.col("run")[0]["digest"]).otherwise(digest(_hex(F.col("run")))).alias("digest"),
            ),
            "level",
        )
        out.append(runs)
        more = (runs.agg(F.max("size")).first()[0] or 0) > FANOUT
        nodes = runs.select("tree", "place", F.ceil(F.col("size") / FANOUT).alias("size"), "digest")
    return out


def _siblings(run: Column, at: Column) -> Column:
    """What stands on the left and on the right of one of a run."""
    return F.struct(
        _hex(F.slice(run, F.lit(1), at)).alias("left"), _hex(F.slice(run, at + 2, F.lit(FANOUT))).alias("right")
    )


def delivered(level: DataFrame, rest: DataFrame) -> DataFrame:
    """The nodes of a level with their proofs, from those of their parents.

    ``rest`` has ``proof`` by ``tree`` and ``place`` of the parent; its other columns are handed on.
    """
    proof = F.when(F.col("size") == 1, F.col("rest")).otherwise(
        F.concat(F.array(_siblings(F.col("run"), F.col("at"))), F.col("rest"))
    )
    handed = [c for c in rest.columns if c not in ("tree", "place", "proof")]
    return (
        level.select("tree", "place", "size", "run")
        .join(rest.withColumnRenamed("proof", "rest"), ["tree", "place"])
        .select("tree", "size", "run", "rest", *handed, F.posexplode("run").alias("at", "node"))
        .select("tree", "node.*", *handed, proof.alias("proof"))
    )


def swept_back(up: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The sweep downwards: nodes of the lowest level with their proofs, from the proofs of the trees' tops."""
    rest = tops
    for level in reversed(up[1:]):
        rest = written(delivered(level, rest).drop("digest"), "proofs")
    return delivered(up[0], rest)


def folded(claim: Column, proof: Column) -> Column:
    """The root that a leaf's digest gives with these siblings."""
    return F.aggregate(proof, claim, lambda d, s: digest(F.concat(s["left"], d, s["right"])))


def proof_text(proof: Column) -> Column:
    """The siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_column: str = "doc_id",
    tree_column: str = "source",
    claim: Column | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``leaf``, ``subroot``, ``root``, ``proof`` (the siblings by level, as
    text on the left and on the right) and ``claim``: the digest given for the row, null for that of its fields.
    """
    tree = F.col(f"`{tree_column}`").cast("string")
    leaves = docs.select(
        # The null tree first, and the others in the order of their bytes.
        F.coalesce(F.concat(F.lit("="), tree), F.lit("")).alias("tree"),
        F.col(f"`{id_column}`").alias("id"),
        leaf_digest([F.col(f"`{c}`") for c in fields]).alias("digest"),
        (F.lit(None).cast("string") if claim is None else claim).alias("claim"),
    )
    up = levels(placed(leaves, "id", "digest", "claim"))
    subroots = up[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    above = levels(placed(subroots, "of"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    crown = above[-1].select("tree", "place", F.col("digest").alias("root"), none.alias("proof"))
    tops = swept_back(above, crown).select(
        F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("subroot"),
        "root", "proof",
    )
    rows = swept_back(up, written(tops, "proofs"))
    return rows.select("id", F.col("digest").alias("leaf"), "subroot", "root", "proof", "claim")
