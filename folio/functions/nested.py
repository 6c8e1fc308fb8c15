"""Nested documents, walked by their schema: paths, values at a path, nodes, and rebuilding.

All of it is built from the schema before anything runs: the results are Columns of one narrow stage, whatever the depth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Path = tuple[str, ...]


def element(kind: T.DataType) -> T.DataType:
    """What arrays of arrays hold in the end, or the type itself."""
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind


def paths(kind: T.StructType, skip: tuple[str, ...] = ("@context",), above: Path = ()) -> Iterator[Path]:
    """The paths of all values, arrays passed through, in the order of the schema."""
    for f in kind.fields:
        if f.name in skip:
            continue
        inner = element(f.dataType)
        if isinstance(inner, T.StructType):
            yield from paths(inner, skip, (*above, f.name))
        else:
            yield (*above, f.name)


def each(x: Column, kind: T.DataType, of: Callable[[Column, T.DataType], Column], empty: str) -> Column:
    """The arrays that ``of`` makes of a value, or of every element of nested arrays, as one array."""
    if isinstance(kind, T.ArrayType):
        inner = F.transform(x, lambda e: each(e, kind.elementType, of, empty))
        return F.coalesce(F.flatten(inner), F.array().cast(empty))
    return F.coalesce(of(x, kind), F.array().cast(empty))


def values(x: Column, kind: T.DataType, path: Path) -> Column:
    """The values at a path as strings, in document order; nulls go."""

    def of(v: Column, k: T.DataType, rest: Path) -> Column:
        if rest:
            return each(v[rest[0]], k[rest[0]].dataType, lambda y, j: of(y, j, rest[1:]), "array<string>")
        return F.array(v.cast("string"))

    return F.array_compact(each(x, kind, lambda v, k: of(v, k, path), "array<string>"))


def top_values(schema: T.StructType, path: Path) -> Column:
    """``values`` of a row's own columns."""
    first = schema[path[0]].dataType
    if len(path) == 1:
        return F.array_compact(each(F.col(f"`{path[0]}`"), first, lambda v, _: F.array(v.cast("string")), "array<string>"))
    return values(F.col(f"`{path[0]}`"), first, path[1:])


def has_nodes(kind: T.DataType, id_field: str = "id") -> bool:
    inner = element(kind)
    return isinstance(inner, T.StructType) and any(f.name == id_field or has_nodes(f.dataType, id_field) for f in inner.fields)


def node_ids(x: Column, kind: T.DataType, id_field: str = "id", unless: str | None = None) -> Column:
    """The ids of all nodes in a value, at any depth; of nodes that have the field ``unless``, none."""

    def of(v: Column, k: T.StructType) -> Column:
        parts = [node_ids(v[f.name], f.dataType, id_field, unless) for f in k.fields if has_nodes(f.dataType, id_field)]
        if id_field in k.names:
            own = v[id_field].cast("string")
            parts.append(F.array(F.when(v[unless].isNull(), own) if unless in k.names else own))
        return F.concat(*parts)

    return F.array_compact(each(x, kind, of, "array<string>"))


def rebuilt(x: Column, kind: T.DataType, field: str, value: Callable[[Column], Column], id_field: str = "id") -> Column:
    """The same value, with ``field`` of every node that lacks it set to ``value`` of its id."""
    if not has_nodes(kind, id_field):
        return x
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: rebuilt(e, kind.elementType, field, value, id_field))
    parts = [rebuilt(x[f.name], f.dataType, field, value, id_field).alias(f.name) for f in kind.fields if not (f.name == field and id_field in kind.names)]
    if id_field in kind.names:
        of_id = F.when(x[id_field].isNotNull(), value(x[id_field].cast("string")))
        parts.append((F.coalesce(x[field], of_id) if field in kind.names else of_id).alias(field))
    return F.when(x.isNotNull(), F.struct(*parts))
