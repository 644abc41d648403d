"""Deeply nested records to related flat tables with parent-child links (problem 6).

Records arrive as JSON text, as VARIANT or as a nested Spark column. Every level is held as a
table of nodes ``(record keys, node_id, parent_id, ordinal, item_key, node VARIANT)``. The merged
schema of a level is inferred by one aggregation over all its nodes (field name x kind of value),
then each field that is a list in any record is exploded into a child table, recursively.

``node_id`` is built from the record's own surrogate and the path of ordinals, so it is the same
whenever a lost task is run again. Each level's nodes are written once and read by everything below, so a record is parsed once and no level
is made again from those above. Everything is a JVM expression; no Python runs on the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quire.session import Scratch

_ARRAY, _KEYED, _OBJECT, _NULL = "array", "keyed", "object", "null"
_NUMERIC = {"bigint", "decimal", "double"}


def _kind(v: Column) -> Column:
    """array | keyed (an object whose keys are all integers, hence a list by id) | object | null | scalar type."""
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    keyed = (F.size(keys) > 0) & F.forall(keys, lambda k: k.rlike("^[0-9]+$"))
    return (
        F.when(v.isNull() | F.is_variant_null(v), _NULL)
        .when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), _ARRAY)
        .when(keys.isNotNull(), F.when(keyed, _KEYED).otherwise(_OBJECT))
        .otherwise(F.lower(F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)))
    )


def _items(v: Column) -> Column:
    """The members of a child list as array<struct<item_key, node>>: a list, a list keyed by id, one bare object or
    scalar standing for a list of one, or nothing."""
    array = F.try_variant_get(v, "$", "array<variant>")
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    kind = _kind(v)
    none = F.lit(None).cast("string")

    def item(key: Column, node: Column) -> Column:
        return F.struct(key.alias("item_key"), node.alias("node"))

    return (
        F.when(kind == _ARRAY, F.transform(array, lambda x: item(none, x)))
        .when(kind == _KEYED, F.transform(entries, lambda e: item(e["key"], e["value"])))
        .when((kind == _NULL) | ((kind == _OBJECT) & (F.size(entries) == 0)), F.filter(F.array(item(none, v)), lambda x: F.lit(False)))
        .otherwise(F.array(item(none, v)))
    )


@dataclass
class Level:
    """One flat table: its merged scalar fields and the lists below it."""

    name: str
    table: DataFrame
    schema: dict[str, str] = field(default_factory=dict)
    children: dict[str, "Level"] = field(default_factory=dict)

    def walk(self):
        yield self
        for child in self.children.values():
            yield from child.walk()


def _merged(kinds: set[str]) -> str:
    """The one type that holds every kind seen in a field."""
    kinds = kinds - {_NULL}
    if kinds == {"boolean"}:
        return "boolean"
    if kinds == {"bigint"}:
        return "bigint"
    if kinds and kinds <= _NUMERIC:
        return "double"
    return "string"


def _path(*names: str) -> str:
    return "$" + "".join('["' + n.replace("\\", "\\\\").replace('"', '\\"') + '"]' for n in names)


def infer_level(nodes: DataFrame, max_fields: int = 10_000) -> dict[tuple[str, ...], set[str]]:
    """Merged schema of the objects of one level: path of field names to the kinds of value found, over all rows.

    Objects inside an object are followed (their fields belong to the same level); lists are not.
    Only one small row per field and kind reaches the driver; more than ``max_fields`` raises, as then
    the keys are data, not fields.
    """
    found: dict[tuple[str, ...], set[str]] = {}
    open_paths: list[tuple[str, ...]] = [()]
    while open_paths:
        views = []
        for path in open_paths:
            node = F.col("node") if not path else F.try_variant_get("node", _path(*path), "variant")
            views.append(F.when(_kind(node) == _OBJECT, F.struct(F.array(*map(F.lit, path)).cast("array<string>").alias("path"), F.map_entries(F.try_variant_get(node, "$", "map<string,variant>")).alias("entries"))))
        seen = (
            nodes.select(F.explode(F.array_compact(F.array(*views))).alias("o"))
            .select(F.col("o.path").alias("path"), F.explode("o.entries").alias("e"))
            .select("path", F.col("e.key").alias("name"), _kind(F.col("e.value")).alias("kind"))
            .groupBy("path", "name", "kind").agg(F.lit(1).alias("one"))
            .limit(max_fields + 1).collect()
        )
        if len(seen) > max_fields:
            raise ValueError(f"more than {max_fields} field names in one level: pass the keys as a list")
        for r in seen:
            found.setdefault((*r["path"], r["name"]), set()).add(r["kind"])
        open_paths = [(*r["path"], r["name"]) for r in seen if r["kind"] == _OBJECT]
    return found


def flatten_records(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    *,
    root: str = "items",
    lists: Mapping[str, Sequence[str]] | None = None,
    scalars: Sequence[str] | None = None,
    max_depth: int = 16,
) -> Level:
    """Flatten ``column`` of ``df`` into one table per list level.

    ``keys`` identify the record and are carried to every table. ``lists`` maps the name of a child
    table to the field names that may hold it (aliases), e.g. ``{"label_sets": ("schema", "schema_")}``;
    such a field counts as a list even where every record has a bare object. Other fields become
    lists if any record has a list there. ``root`` names the list a record consists of when its top
    level is itself a list. ``scalars``, if given, restricts the columns taken.

    Tables have: the keys, ``node_id``, ``parent_id``, ``ordinal`` (place in the list, from 0),
    ``item_key`` (the key of a list keyed by id), ``bare_value`` (a member that is not an object) and
    the merged scalar fields, named by their path joined with ``_``; names that clash get ``_2`` ...

    Nulls: a null or invalid record gives a root row without children; a null, missing or empty list
    gives no child rows; null members are dropped (ordinals keep their place). JSON text that holds JSON text
    is opened. Records with equal keys and content are kept as they come and told apart by nothing but
    their keys: make the keys unique, or the content equal, before joining tables by ``node_id``.
    """
    lists = {k: tuple(v) for k, v in (lists or {}).items()}
    alias_of = {a: name for name, names in lists.items() for a in (*names, name)}
    source = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        once = F.try_parse_json(source)
        node = F.when(F.schema_of_variant(once) == "STRING", F.try_parse_json(F.try_variant_get(once, "$", "string"))).otherwise(once)
    elif isinstance(kind, T.VariantType):
        node = source
    else:
        node = F.to_variant_object(source)
    own = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"})
    base = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], own.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("item_key"), node.alias("node"))
    scratch = Scratch(df.sparkSession, "nested")
    base = scratch.write(base, "record")
    top = Level("record", base)

    def expand(level: Level, nodes: DataFrame, sources: dict[str, list[Column]], depth: int) -> None:
        for name, places in sources.items():
            parts = [F.transform(_items(p), lambda x, j=j: F.struct(F.lit(j).alias("place"), x["item_key"].alias("item_key"), x["node"].alias("node"))) for j, p in enumerate(places)]
            joined = F.concat(*[F.coalesce(p, F.slice(F.array(F.struct(F.lit(0).alias("place"), F.lit(None).cast("string").alias("item_key"), F.col("node").alias("node"))), 1, 0)) for p in parts])
            child = (
                nodes.select(*[f"k{i}" for i in range(len(keys))], "node_id", F.posexplode(joined).alias("pos", "item"))
                .select(
                    *[f"k{i}" for i in range(len(keys))],
                    F.concat("node_id", F.lit(f"/{name}["), F.col("pos").cast("string"), F.lit("]")).alias("child_id"),
                    F.col("node_id").alias("parent_id"), F.col("pos").alias("ordinal"), F.col("item.item_key").alias("item_key"), F.col("item.node").alias("node"),
                )
                .withColumnRenamed("child_id", "node_id")
                .filter(F.col("node").isNotNull() & ~F.is_variant_null("node"))
            )
            child = scratch.write(child, "level")
            below = Level(name, child)
            describe(below, child, depth + 1)
            level.children[name] = below

    def describe(level: Level, nodes: DataFrame, depth: int) -> None:
        if depth > max_depth:
            raise ValueError(f"nesting is deeper than {max_depth} lists")
        merged = infer_level(nodes)
        places: dict[str, list[Column]] = {}
        columns: dict[str, Column] = {}
        for path in sorted(merged):
            kinds = merged[path]
            inside_list = any(merged.get(path[:i], set()) & {_ARRAY, _KEYED} or path[i - 1] in alias_of for i in range(1, len(path)))
            if inside_list:
                continue
            value = F.try_variant_get("node", _path(*path), "variant")
            if path[-1] in alias_of and kinds <= {_ARRAY, _KEYED, _OBJECT, _NULL} or kinds & {_ARRAY, _KEYED}:
                places.setdefault(alias_of.get(path[-1], "_".join(path)), []).append(value)
            elif not (kinds - {_NULL}) <= {_OBJECT} or kinds == {_NULL}:
                name = "_".join(path)
                if scalars is None or name in scalars:
                    level.schema[name] = _merged(kinds - {_OBJECT})
                    columns[name] = F.try_variant_get("node", _path(*path), level.schema[name])
        if level is top:
            places[root] = [F.when(_kind(F.col("node")) == _ARRAY, F.col("node")), *places.get(root, [])]
        expand(level, nodes, places, depth)
        taken = {*keys, "node_id", "parent_id", "ordinal", "item_key", "bare_value"}
        out = []
        for name, value in columns.items():
            fresh, n = name, 2
            while fresh in taken:
                fresh, n = f"{name}_{n}", n + 1
            taken.add(fresh)
            out.append(value.alias(fresh))
        bare = F.when(_kind(F.col("node")).isin(_ARRAY, _KEYED, _OBJECT, _NULL), None).otherwise(F.try_variant_get("node", "$", "string"))
        level.table = nodes.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "node_id", "parent_id", "ordinal", "item_key", bare.alias("bare_value"), *out)

    describe(top, base, 0)
    return top
