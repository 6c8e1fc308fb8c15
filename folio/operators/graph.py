"""Documents as graphs: statements and relations."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import columns as C

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
_STATEMENT = "array<struct<s:string,p:string,o:string,kind:string,datatype:string>>"


class Term(NamedTuple):
    """What a context says of a property: its IRI, ``@list`` or ``@set``, and ``@id`` or a datatype."""

    iri: str
    container: str | None = None
    kind: str | None = None


def read_context(spark: SparkSession, path: str) -> dict[str, Term]:
    """The terms of a JSON-LD context file; keywords' aliases (``id``, ``type``) are terms of their own."""
    text = spark.read.text(path, wholetext=True).first().value
    found = {}
    for name, said in json.loads(text)["@context"].items():
        said = {"@id": said} if isinstance(said, str) else said or {}
        if "@id" in said:
            found[name] = Term(said["@id"], said.get("@container"), said.get("@type"))
    return found


def blank(place: Column) -> Column:
    """The node of a place in a document: the same whenever the document is read again."""
    return F.concat(F.lit("_:b"), F.md5(place))


def _statement(s: Column, p: str, o: Column, kind: Column | str, datatype: Column | str | None = None) -> Column:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), text(kind).alias("kind"), text(datatype).alias("datatype"))


def _datatype(kind: T.DataType) -> str | None:
    if isinstance(kind, T.BooleanType):
        return XSD + "boolean"
    if isinstance(kind, T.IntegralType):
        return XSD + "integer"
    return XSD + "double" if isinstance(kind, T.NumericType) else None


class _Walk:
    def __init__(self, context: dict[str, Term], id_field: str, type_field: str):
        self.context, self.id_field, self.type_field = context, id_field, type_field
        names = [x for n, t in context.items() for x in (F.lit(n), F.lit(t.iri))]
        self.types = F.create_map(*names) if names else None

    def node(self, x: Column | None, kind: T.StructType, subject: Column, place: Column) -> Column:
        """The statements of a node's fields, and of all that hangs on them."""
        parts = [F.array().cast(_STATEMENT)]
        for f in kind.fields:
            value = F.col(f"`{f.name}`") if x is None else x[f.name]
            here = F.concat(place, F.lit("/" + f.name))
            if f.name == self.type_field:
                parts.append(self.many(value, f.dataType, Term(RDF + "type", None, "@type"), subject, here))
            elif f.name != self.id_field and f.name in self.context:
                term = self.context[f.name]
                parts.append((self.ordered if term.container == "@list" else self.many)(value, f.dataType, term, subject, here))
        return F.concat(*parts)

    def many(self, v: Column, kind: T.DataType, term: Term, subject: Column, place: Column) -> Column:
        if isinstance(kind, T.ArrayType):
            inner = F.transform(v, lambda e, i: self.many(e, kind.elementType, term, subject, F.concat_ws("/", place, i.cast("string"))))
            return F.coalesce(F.flatten(inner), F.array().cast(_STATEMENT))
        return self.one(v, kind, term.iri, term, subject, place)

    def one(self, v: Column, kind: T.DataType, predicate: str, term: Term, subject: Column, place: Column) -> Column:
        """A statement with one value as its object, and what the value itself says if it is a node."""
        none = F.array().cast(_STATEMENT)
        if isinstance(kind, T.StructType):
            own = v[self.id_field].cast("string") if self.id_field in kind.names else F.lit(None).cast("string")
            named = F.when(own.isNotNull(), "iri").otherwise("blank")

            def of(sid: Column) -> Column:
                return F.concat(F.array(_statement(subject, predicate, sid, named)), self.node(v, kind, sid, place))

            return F.when(v.isNotNull(), C.let(F.coalesce(own, blank(place)), of)).otherwise(none)
        text = v.cast("string")
        if term.kind == "@type":
            iri = F.coalesce(F.try_element_at(self.types, text) if self.types is not None else F.lit(None), F.when(text.rlike(r"^[A-Za-z][\w+.-]*:"), text))
            return F.when(iri.isNotNull(), F.array(_statement(subject, predicate, iri, "iri"))).otherwise(none)
        if term.kind == "@id":
            return F.when(v.isNotNull(), F.array(_statement(subject, predicate, text, F.when(text.startswith("_:"), "blank").otherwise("iri")))).otherwise(none)
        return F.when(v.isNotNull(), F.array(_statement(subject, predicate, text, "literal", term.kind or _datatype(kind)))).otherwise(none)

    def ordered(self, v: Column, kind: T.DataType, term: Term, subject: Column, place: Column) -> Column:
        """A list: a chain of nodes with ``first`` and ``rest``, ended by ``nil``; without values ``nil`` itself."""
        none = F.array().cast(_STATEMENT)
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        held = F.array_compact(v if isinstance(kind, T.ArrayType) else F.array(v))
        nil = F.lit(RDF + "nil")

        def of(x: Column) -> Column:
            # the names of all cells, each made once, and the end of the list
            a, cells = x["held"], x["cells"]
            kind_of = lambda c: F.when(c == nil, "iri").otherwise("blank")
            head = _statement(subject, term.iri, cells[0], kind_of(cells[0]))

            def link(e: Column, i: Column) -> Column:
                rest = _statement(cells[i], RDF + "rest", cells[i + 1], kind_of(cells[i + 1]))
                return F.concat(self.one(e, inner, RDF + "first", term, cells[i], F.concat_ws("/", place, i.cast("string"))), F.array(rest))

            return F.concat(F.array(head), F.flatten(F.transform(a, link)))

        def named(h: Column) -> Column:
            made = F.transform(h, lambda _, i: blank(F.concat_ws("/", place, F.lit("cell"), i.cast("string"))))
            return F.struct(h.alias("held"), F.concat(made, F.array(nil)).alias("cells"))

        return F.when(v.isNotNull(), C.let(C.let(held, named), of)).otherwise(none)


def statements(df: DataFrame, context: dict[str, Term], id_field: str = "id", type_field: str = "type") -> DataFrame:
    """``(s, p, o, kind, datatype)`` of documents of any depth, by a context's terms; one narrow stage.

    A node's subject is its id, else a blank node named by the document's id and the place in it, so a second
    run names it alike. ``kind`` is ``iri``, ``blank`` or ``literal``. Properties that the context
    doesn't know are no statements; documents without an id are left out.
    """
    walk = _Walk(context, id_field, type_field)
    root = F.col(id_field).cast("string")
    every = walk.node(None, df.schema, root, root)
    return df.where(F.col(id_field).isNotNull()).select(F.inline(every))


def statement_lines(t: DataFrame) -> DataFrame:
    """Statements of ``statements`` as lines of N-Triples."""
    escaped = C.replace_all(F.col("o"), (r'([\\"])', r"\\$1"), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"))
    iri = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    typed = F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^"), iri(F.col("datatype")))).otherwise("")
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), typed)
    subject = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(iri(F.col("s")))
    node = F.when(F.col("kind") == "literal", literal).when(F.col("kind") == "blank", F.col("o")).otherwise(iri(F.col("o")))
    return t.select(F.concat_ws(" ", subject, iri(F.col("p")), node, F.lit(".")).alias("value"))


def triples(df: DataFrame, subject: str, terms: dict[str, str], lists: dict[str, str] | None = None) -> DataFrame:
    """``(s, p, o, pos)``: a statement for each value of each term; ``lists`` keep their positions.

    ``terms`` and ``lists`` map columns to predicates. Values are strings or arrays of strings.
    """
    kinds = dict(df.dtypes)

    def statements(column: str, predicate: str, ordered: bool) -> Column:
        values = F.col(column) if kinds[column].startswith("array") else F.array(F.col(column).cast("string"))
        return F.transform(values, lambda v, i: F.struct(F.lit(predicate).alias("p"), v.cast("string").alias("o"), (i if ordered else F.lit(None).cast("int")).alias("pos")))

    parts = [statements(c, p, False) for c, p in terms.items()] + [statements(c, p, True) for c, p in (lists or {}).items()]
    flat = df.select(F.col(subject).alias("s"), F.explode(F.concat(*parts)).alias("t"))
    return flat.select("s", "t.*").where("o is not null")


def n_triples(t: DataFrame, subject_iri: Column) -> DataFrame:
    """Statements as lines; objects that are IRIs are nodes, others literals. Lists hang on blank nodes."""
    literal = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("o", r'([\\"])', r"\\$1"), "\n", r"\\n"), F.lit('"'))
    node = F.when(F.col("o").rlike(r"^https?://\S+$"), F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(literal)
    blank = lambda n: F.concat(F.lit("_:b"), F.lower(F.hex(F.xxhash64("s", "p"))), F.lit("x"), n.cast("string"))
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    pre = lambda s: F.concat(F.lit("<"), s, F.lit(">"))
    last = F.max("pos").over(Window.partitionBy("s", "p"))
    d = t.withColumn("last", last)
    plain = F.concat_ws(" ", pre(subject_iri), pre(F.col("p")), node, F.lit("."))
    head = F.when(F.col("pos") == 0, F.concat_ws(" ", pre(subject_iri), pre(F.col("p")), blank(F.lit(0)), F.lit(".")))
    first = F.concat_ws(" ", blank(F.col("pos")), F.lit(f"<{rdf}first>"), node, F.lit("."))
    rest = F.concat_ws(" ", blank(F.col("pos")), F.lit(f"<{rdf}rest>"), F.when(F.col("pos") == F.col("last"), F.lit(f"<{rdf}nil>")).otherwise(blank(F.col("pos") + 1)), F.lit("."))
    lines = F.when(F.col("pos").isNull(), F.array(plain)).otherwise(F.array(head, first, rest))
    return d.select(F.explode(F.array_compact(lines)).alias("value"))


def edges(df: DataFrame, source: str, relations: dict[str, Column]) -> DataFrame:
    """``(src, rel, dst)`` of arrays of ids, in one pass over the documents."""

    def named(name: str, ids: Column) -> Column:
        return F.transform(ids, lambda d: F.struct(F.lit(name).alias("rel"), d.alias("dst")))

    arrays = [named(*r) for r in relations.items()]
    return df.select(F.col(source).alias("src"), F.explode(F.concat(*arrays)).alias("e")).select("src", "e.rel", "e.dst").where("dst is not null")
