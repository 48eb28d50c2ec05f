"""Schema records of the JSON-LD blocks of pages, unfolded level by level.

A block is a node; lists, graphs, item lists and list items hold further nodes. Each round
looks at the nodes of one depth only, keeps those that are records, and unfolds the others'
members into the next round. The rounds end with the deepest block of the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh.functions import pages
from talentmesh.session import durable_cut

# --- fixed values: schema types that only hold other records, and keys of a record without type ---
CONTAINER_TYPES = ("itemlist", "breadcrumblist", "listitem")
RECORD_KEYS = ("url", "name", "title", "datePosted")

#: The last step of a record's place: after all that it holds.
ITSELF = 9


def _at(node: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(node, path, kind)


def _members(node: Column) -> Column:
    """Elements of a list, else null."""
    return _at(node, "$", "array<variant>")


def _fields(node: Column) -> Column:
    """Fields of an object, else null."""
    return _at(node, "$", "map<string,variant>")


def _types(fields: Column) -> Column:
    kind = F.try_element_at(fields, F.lit("@type"))
    text = lambda v: F.lower(F.coalesce(_at(v, "$", "string"), F.lit("")))
    return F.when(kind.isNull(), F.array().cast("array<string>")).otherwise(
        F.coalesce(F.transform(_members(kind), text), F.array(text(kind))))


def _typed(fields: Column) -> Column:
    kind = F.try_element_at(fields, F.lit("@type"))
    return F.coalesce(F.size(_members(kind)) > 0, ~_at(kind, "$", "string").isin("", "0", "false"), F.lit(False))


def _places(values: Column, step: int) -> Column:
    """Nodes of a list with their steps; none for null."""
    none = F.array().cast("array<struct<step: int, nth: int, node: variant>>")
    return F.coalesce(F.transform(values, lambda v, i: F.struct(
        F.lit(step).alias("step"), i.cast("int").alias("nth"), v.alias("node"))), none)


def _held(node: Column, fields: Column, types: Column) -> Column:
    """What a node holds, in order: list members, graph, list elements, the item of a list item."""
    get = lambda key: F.try_element_at(fields, F.lit(key))
    graph = get("@graph")
    item_of = lambda v: F.try_element_at(_fields(v), F.lit("item"))
    elements = F.transform(_members(get("itemListElement")), lambda e: F.when(
        _fields(item_of(e)).isNotNull(), item_of(e)).otherwise(e))
    item = F.when(F.array_contains(types, "listitem"), get("item"))
    return F.concat(
        _places(_members(node), 0),
        _places(F.coalesce(_members(graph), F.when(_fields(graph).isNotNull(), F.array(graph))), 1),
        _places(elements, 2),
        _places(F.when(_fields(item).isNotNull(), F.array(item)), 3),
    )


def structured_records(pages_df: DataFrame) -> DataFrame:
    """``page_id, base, ordinal, node, record, types`` of every record, what it holds before it.

    ``ordinal`` orders the records of a page, ``record`` is JSON text and ``types`` are in lower
    case. Blocks that are no JSON are skipped.
    """
    blocks = pages_df.where(F.col("html").rlike(r"(?i)application/ld\+json")).select(
        "page_id", F.col("url").alias("base"), F.posexplode_outer(pages.json_ld_blocks(F.col("html"))).alias("nth", "block"))
    level = blocks.select("page_id", "base", F.array(F.col("nth").cast("int")).alias("place"), F.try_parse_json("block").alias("node"))
    found: list[DataFrame] = []
    while True:
        fields = F.col("fields")
        level = durable_cut(
            level.where(F.col("node").isNotNull()).withColumn("fields", _fields(F.col("node")))
            .withColumn("types", _types(fields)))
        if found and level.isEmpty():
            break
        contained = F.arrays_overlap("types", F.array(*[F.lit(t) for t in CONTAINER_TYPES]))
        keyed = F.arrays_overlap(F.map_keys(fields), F.array(*[F.lit(k) for k in RECORD_KEYS]))
        is_record = fields.isNotNull() & F.when(_typed(fields), ~contained).otherwise(keyed)
        found.append(level.where(is_record).select(
            "page_id", "base", F.concat("place", F.array(F.lit(ITSELF))).alias("ordinal"), "node",
            F.to_json("node").alias("record"), "types"))
        held = level.select("page_id", "base", "place", F.explode(_held(F.col("node"), fields, F.col("types"))).alias("h"))
        level = held.select(
            "page_id", "base", F.concat("place", F.array("h.step", "h.nth")).alias("place"), F.col("h.node").alias("node")
        ).where(F.coalesce(F.schema_of_variant("node").rlike("^(?:OBJECT|ARRAY)"), F.lit(False)))
    return reduce(DataFrame.unionByName, found)
