"""Validation of nested records by JSON-schema documents, compiled to Columns.

A schema becomes a list of rules, ``path: keyword``, each a Column that tells whether a record breaks it. All
rules run in one narrow stage. Understood are type, required, enum, const, pattern, format, lengths and bounds,
closed and nested objects, items, contains, counts of items, allOf, anyOf, oneOf, not, and references
to other schemas by name or within a document. A keyword that isn't among these raises an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Test = Callable[[Column], Column]
Rule = tuple[str, Test]

#: Keywords that say nothing about validity.
_NOTES = {"$id", "$schema", "$defs", "$comment", "title", "description", "default", "examples", "definitions"}
#: Shapes of the formats.
_FORMATS = {
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$",
    "url": r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$",
}


def read_schemas(spark: SparkSession, path: str) -> dict[str, dict]:
    """The schema documents of a folder by their ``$id``, else by their file's name."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    found = {r.name: json.loads(r.value) for r in files.collect()}  # a schema's documents, not data
    return {d.get("$id", name): d for name, d in found.items()}


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.IntegralType):
        return "integer"
    return "number" if isinstance(t, T.NumericType) else "null" if isinstance(t, T.NullType) else "string"


def _any(tests: list[Test], x: Column) -> Column:
    return reduce(Column.__or__, (F.coalesce(t(x), F.lit(False)) for t in tests), F.lit(False))


class _Compiler:
    def __init__(self, schemas: dict[str, dict], formats: bool):
        self.schemas, self.formats = schemas, formats

    def target(self, ref: str, here: dict) -> tuple[dict, dict]:
        name, _, inner = ref.partition("#")
        document = self.schemas[name] if name else here
        s = document
        for step in filter(None, inner.split("/")):
            s = s[step.replace("~1", "/").replace("~0", "~")]
        return s, document

    def rules(self, s: dict | bool, t: T.DataType, at: str, here: dict) -> list[Rule]:
        """The rules of a schema for values of a Spark type; null values break none of them."""
        if s is True or s == {}:
            return []
        if s is False:
            return [(f"{at}: false", lambda x: x.isNotNull())]
        out: list[Rule] = []
        kind = _kind(t)

        def add(word: str, test: Test) -> None:
            out.append((f"{at}: {word}", lambda x: x.isNotNull() & test(x)))

        def inside(schema, of=t) -> list[Test]:
            return [f for _, f in self.rules(schema, of, at, here)]

        for word, said in s.items():
            if word == "$ref":
                schema, document = self.target(said, here)
                out += self.rules(schema, t, at, document)
            elif word == "type":
                asked = {said} if isinstance(said, str) else set(said)
                if kind not in asked and not (kind == "integer" and "number" in asked):
                    add("type", lambda x: F.lit(True))
            elif word in ("enum", "const"):
                allowed = [json.dumps(v) if isinstance(v, (bool, dict, list)) else str(v) for v in (said if word == "enum" else [said])]
                text = (lambda x: F.to_json(x)) if kind in ("object", "array") else (lambda x: x.cast("string"))
                add(word, lambda x, allowed=allowed, text=text: ~text(x).isin(allowed))
            elif word == "pattern" and kind == "string":
                add(word, lambda x, said=said: ~x.cast("string").rlike(said))
            elif word == "format" and kind == "string":
                if self.formats and said in _FORMATS:
                    add(word, lambda x, said=said: ~x.cast("string").rlike(_FORMATS[said]))
            elif word in ("minLength", "maxLength") and kind == "string":
                add(word, lambda x, said=said, low=word == "minLength": F.length(x) < said if low else F.length(x) > said)
            elif word in ("minimum", "maximum") and kind in ("integer", "number"):
                add(word, lambda x, said=said, low=word == "minimum": x < said if low else x > said)
            elif word in ("minItems", "maxItems") and kind == "array":
                add(word, lambda x, said=said, low=word == "minItems": F.size(x) < said if low else F.size(x) > said)
            elif word == "uniqueItems" and kind == "array":
                if said:
                    add(word, lambda x: F.size(F.array_distinct(x)) < F.size(x))
            elif word == "required" and kind == "object":
                for f in said:
                    missing = (lambda x, f=f: x[f].isNull()) if f in t.names else (lambda x: F.lit(True))
                    out.append((f"{at}.{f}: required".removeprefix("."), lambda x, missing=missing: x.isNotNull() & missing(x)))
            elif word == "properties" and kind == "object":
                for f, schema in said.items():
                    if f in t.names:
                        out += [(n, lambda x, f=f, r=r: r(x[f])) for n, r in self.rules(schema, t[f].dataType, f"{at}.{f}".removeprefix("."), here)]
            elif word == "additionalProperties" and kind == "object":
                more = [f for f in t.names if f not in s.get("properties", {})]
                if said is False and more:
                    add(word, lambda x, more=more: reduce(Column.__or__, (x[f].isNotNull() for f in more)))
                elif isinstance(said, dict):
                    for f in more:
                        out += [(n, lambda x, f=f, r=r: r(x[f])) for n, r in self.rules(said, t[f].dataType, f"{at}.{f}".removeprefix("."), here)]
            elif word == "items" and kind == "array":
                out += [(n, lambda x, r=r: F.exists(x, lambda e: F.coalesce(r(e), F.lit(False)))) for n, r in self.rules(said, t.elementType, f"{at}[]", here)]
            elif word == "contains" and kind == "array":
                tests = inside(said, t.elementType)
                add(word, lambda x, tests=tests: ~F.exists(x, lambda e: e.isNotNull() & ~_any(tests, e)))
            elif word == "allOf":
                for schema in said:
                    out += self.rules(schema, t, at, here)
            elif word in ("anyOf", "oneOf"):
                branches = [inside(schema) for schema in said]
                least = (lambda n: n == 0) if word == "anyOf" else (lambda n: n != 1)
                add(word, lambda x, branches=branches, least=least: least(reduce(Column.__add__, ((~_any(b, x)).cast("int") for b in branches))))
            elif word == "not":
                tests = inside(said)
                add(word, lambda x, tests=tests: ~_any(tests, x))
            elif word not in _NOTES and word not in _KNOWN:
                raise ValueError(f"{at}: the keyword {word} isn't understood")
        return out


#: Keywords of another type of value than the one at hand say nothing.
_KNOWN = {"pattern", "format", "minLength", "maxLength", "minimum", "maximum", "minItems", "maxItems", "uniqueItems", "required", "properties", "additionalProperties", "items", "contains"}


def compiled(schema: dict, kind: T.StructType, schemas: dict[str, dict] | None = None, formats: bool = True) -> dict[str, Column]:
    """``{rule: whether a row breaks it}``; rules of the same name are one."""
    found = _Compiler(schemas or {}, formats).rules(schema, kind, "", schema)
    rows = F.struct(*(F.col(f"`{n}`") for n in kind.names))
    out: dict[str, Column] = {}
    for name, test in found:
        broken = F.coalesce(test(rows), F.lit(False))
        name = name.removeprefix(": ") if name.startswith(": ") else name
        out[name] = out[name] | broken if name in out else broken
    return out


def broken_rules(df: DataFrame, key: str, schema: dict, schemas: dict[str, dict] | None = None, formats: bool = True) -> DataFrame:
    """``(key, rule)``: a row for each rule that a record breaks."""
    rules = compiled(schema, df.schema, schemas, formats)
    if not rules:
        return df.select(F.col(key).alias("key"), F.lit("").alias("rule")).where(F.lit(False))
    found = F.array_compact(F.array(*(F.when(b, F.lit(n)) for n, b in rules.items())))
    return df.select(F.col(key).alias("key"), F.explode(found).alias("rule"))


def report(df: DataFrame, key: str, schema: dict, schemas: dict[str, dict] | None = None, first: int = 10, formats: bool = True) -> DataFrame:
    """``(rule, records, examples)``: of each broken rule the number of records, and the ``first`` keys.

    The bound lets every task drop what can't be among the first, so that no task sees all records of a rule.
    """
    found = broken_rules(df, key, schema, schemas, formats)
    counts = found.groupBy("rule").agg(F.count(F.lit(1)).alias("records"))
    rank = F.row_number().over(Window.partitionBy("rule").orderBy("key"))
    few = found.withColumn("rank", rank).where(F.col("rank") <= first)
    few = few.groupBy("rule").agg(F.array_sort(F.collect_list("key")).alias("examples"))
    return counts.join(few, "rule").select("rule", "records", "examples")
