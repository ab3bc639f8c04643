"""Shredding of nested extraction records into an adjacency table and flat tables.

``adjacency`` turns every object and scalar below the wanted fields into one node row:
``rec_id, node, parent, label, ordinal, scalar``. Nodes are named by their path, so a node
row is independent of the order in which partitions are read and of retries.
``entity_tables`` joins object nodes with their scalar children (one hash exchange on
``rec_id, parent``, pre-aggregated before it) and pivots the labels into columns.

Defined results
    null arrays, null elements and structs whose fields are all null give no node; blank
    strings, empty inner arrays and repeated values count; a row that occurs twice under the
    same ``rec_id`` gives its nodes once; a null ``rec_id`` is a key of its own; an empty
    table gives empty tables; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTION_FIELDS = ("section_title", "content")
PENALTY_FIELDS = ("violation", "penalty", "amount", "conditions")
ENTITY_KINDS = ("people", "organizations", "locations", "amounts", "dates", "references")
OBJECTS = ("detailed_sections", "penalties_and_consequences")
ROOT = "$"

_NODE = "array<struct<node:string,parent:string,label:string,ordinal:int,scalar:string,object:boolean>>"


def _node(node: Column, parent: Column, label: str, ordinal: Column, scalar: Column, is_object: Column) -> Column:
    return F.struct(
        node.alias("node"),
        parent.alias("parent"),
        F.lit(label).alias("label"),
        ordinal.cast("int").alias("ordinal"),
        scalar.cast("string").alias("scalar"),
        is_object.alias("object"),
    )


def _list(x: Column) -> Column:
    return F.coalesce(x, F.from_json(F.lit("[]"), _NODE))


def _path(parent: Column | str, label: str, i: Column) -> Column:
    head = F.lit(f"{label}[") if isinstance(parent, str) else F.concat(parent, F.lit(f".{label}["))
    return F.concat(head, i.cast("string"), F.lit("]"))


def _objects(array: Column, label: str, fields: tuple[str, ...]) -> Column:
    """One node for each struct that has a field which is not null."""

    def one(x: Column, i: Column) -> Column:
        some = F.lit(False)
        for f in fields:
            some = some | x[f].isNotNull()
        return _node(_path(ROOT, label, i), F.lit(ROOT), label, i, F.lit(None), x.isNotNull() & some)

    return _list(F.transform(array, one))


def _scalars_of(array: Column, label: str, fields: tuple[str, ...]) -> Column:
    """The scalar children of each struct."""

    def one(x: Column, i: Column) -> Column:
        parent = _path(ROOT, label, i)
        return F.array(*[_node(F.concat(parent, F.lit(f".{f}")), parent, f, F.lit(0), x[f], F.lit(False)) for f in fields])

    return _list(F.flatten(F.transform(array, one)))


def _values(array: Column, label: str, parent: Column | str) -> Column:
    """The elements of an array of strings."""
    up = F.lit(parent) if isinstance(parent, str) else parent
    return _list(F.transform(array, lambda v, j: _node(_path(parent, label, j), up, label, j, v, F.lit(False))))


def adjacency(records: DataFrame) -> DataFrame:
    """Node rows of ``detailed_sections``, ``penalties_and_consequences`` and ``important_entities``.

    One pass, no shuffle: the nodes of a record are built as one array and exploded.
    """
    c = F.col
    sections, penalties = c("detailed_sections"), c("penalties_and_consequences")
    details = F.flatten(
        F.transform(
            sections,
            lambda s, i: _values(s["key_details"], "key_details", _path(ROOT, "detailed_sections", i)),
        )
    )
    parts = [
        _objects(sections, "detailed_sections", (*SECTION_FIELDS, "key_details")),
        _scalars_of(sections, "detailed_sections", SECTION_FIELDS),
        _list(details),
        _objects(penalties, "penalties_and_consequences", PENALTY_FIELDS),
        _scalars_of(penalties, "penalties_and_consequences", PENALTY_FIELDS),
        *[_values(c(f"important_entities.{k}"), k, ROOT) for k in ENTITY_KINDS],
    ]
    nodes = F.filter(F.concat(*parts), lambda n: n["object"] | n["scalar"].isNotNull())
    return records.select(c("rec_id"), F.explode(nodes).alias("n")).select(
        "rec_id", "n.node", "n.parent", "n.label", "n.ordinal", "n.scalar"
    )


def _pos(path: Column) -> Column:
    """The last index of a path."""
    return F.regexp_extract(path, r"\[(\d+)\]$", 1).cast("int")


def pivoted(nodes: DataFrame) -> DataFrame:
    """Every row of every flat table: ``rec_id, kind, node, parent, pos, value`` and the fields of objects.

    Object nodes are joined with their scalar children and pivoted; as an object and its children
    meet under the object's path, the join and the pivot are one aggregation over ``rec_id, key``,
    with partial aggregates before its exchange. All kinds go through that one exchange.
    """
    label, parent = F.col("label"), F.col("parent")
    is_object = label.isin(*OBJECTS)
    is_leaf = label.isin("key_details", *ENTITY_KINDS)
    above = F.regexp_extract(parent, r"^([a-z_]+)\[\d+\]$", 1)  # the kind of the object that a field belongs to
    kind = F.when(is_object | is_leaf, label).otherwise(above)
    key = F.when(is_object | is_leaf, F.col("node")).otherwise(parent)
    own = F.when(is_object | is_leaf, F.col("ordinal"))
    fields = dict.fromkeys((*SECTION_FIELDS, *PENALTY_FIELDS))
    return (
        nodes.groupBy("rec_id", kind.alias("kind"), key.alias("node"))
        .agg(
            F.max(own).alias("pos"),
            F.max(F.when(is_leaf, parent)).alias("parent"),
            F.max(F.when(is_leaf, F.col("scalar"))).alias("value"),
            *[F.max(F.when(~is_object & ~is_leaf & (label == f), F.col("scalar"))).alias(f) for f in fields],
        )
        .filter(F.col("pos").isNotNull())
    )


def entity_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """``sections``, ``key_details``, ``penalties`` and ``entities``.

    Every row has ``rec_id`` and its own ``node``; ``parent`` is the ``node`` of the parent
    row where there is one.
    """
    # columns of their own for each table, so that tables can be joined; equal exchanges are reused
    of = lambda *kinds: pivoted(nodes).filter(F.col("kind").isin(*kinds))
    return {
        "sections": of("detailed_sections").select("rec_id", "node", "pos", *SECTION_FIELDS),
        "key_details": of("key_details").select("rec_id", "node", "parent", "pos", "value", _pos(F.col("parent")).alias("parent_pos")),
        "penalties": of("penalties_and_consequences").select("rec_id", "node", "pos", *PENALTY_FIELDS),
        "entities": of(*ENTITY_KINDS).select("rec_id", "node", "kind", "pos", "value"),
    }


def elements(nodes: DataFrame) -> DataFrame:
    """One row for each element of any flat table: ``rec_id, child, parent_pos, pos``; one scan, one exchange."""
    inner = F.when(F.col("kind") == "key_details", _pos(F.col("parent"))).otherwise(F.lit(-1))
    return pivoted(nodes).select("rec_id", F.col("kind").alias("child"), inner.alias("parent_pos"), "pos")
