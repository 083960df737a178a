"""Declared schemas: parsing to field lists and Spark types, strict validation of raw JSON, nested values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.errors import InvalidFormat, NotFound
from lexmill.model import loads

KEYWORDS = {"$type", "$items", "$fields", "type"}
SIMPLE = {"integer": T.IntegerType(), "float": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
#: What a JSON scalar's text must look like; an integer is a signed 32-bit one, a float is written as one.
INTEGER, FLOAT = r"^-?[0-9]{1,10}$", r"^-?[0-9]+(\.[0-9]+([eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+)$"
RESERVED = "seq id"


@dataclass(frozen=True)
class FieldInfo:
    """A node of the schema; array elements are the path part $items."""

    path: str
    kind: str
    attributes: dict[str, Any] = field(default_factory=dict, compare=False)
    members: tuple[FieldInfo, ...] = ()

    @property
    def spark(self) -> T.DataType:
        if self.kind == "array":
            return T.ArrayType(self.members[0].spark)
        if self.kind == "object":
            return T.StructType([T.StructField(m.name, m.spark, True, m.attributes) for m in self.members])
        return SIMPLE[self.kind]

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]

    def walk(self) -> Iterator[FieldInfo]:
        yield self
        for m in self.members:
            yield from m.walk()


def parse(schema: str | dict) -> FieldInfo:
    """The tree of a schema ``{"type": "object", "$fields": {...}}``; the root may leave its type out."""
    body = loads(schema)
    return _node("", {"type": "object", **body})


def _node(path: str, body: Any) -> FieldInfo:
    if not isinstance(body, dict) or not isinstance(body.get("type"), str):
        raise InvalidFormat(f"{path or 'the schema'} needs a type")
    kind = body["type"]
    attributes = {k: v for k, v in body.items() if k not in KEYWORDS}
    if not all(isinstance(v, str | bool | int | float) for v in attributes.values()):
        raise InvalidFormat(f"attributes of {path} must be scalars")
    below = f"{path}." if path else ""
    if kind == "array":
        if "$items" not in body:
            raise InvalidFormat(f"array {path} needs $items")
        return FieldInfo(path, kind, attributes, (_node(f"{below}$items", body["$items"]),))
    if kind == "object":
        if not isinstance(body.get("$fields"), dict):
            raise InvalidFormat(f"object {path} needs $fields")
        return FieldInfo(path, kind, attributes, tuple(_node(below + k, v) for k, v in body["$fields"].items()))
    if kind not in SIMPLE:
        raise InvalidFormat(f"{path} has the unknown type {kind}")
    return FieldInfo(path, kind, attributes)


def fields(root: FieldInfo) -> dict[str, FieldInfo]:
    return {f.path: f for f in root.walk() if f.path}


def indexed(root: FieldInfo) -> list[FieldInfo]:
    return [f for f in root.walk() if f.kind == "string" and f.attributes.get("index") is True]


def suggested(root: FieldInfo) -> list[FieldInfo]:
    return [f for f in indexed(root) if f.attributes.get("suggest") is True]


def numeric(root: FieldInfo) -> list[FieldInfo]:
    return [f for f in root.walk() if f.kind in ("integer", "float")]


def as_map(raw: Column) -> Column:
    """An object's members as raw JSON texts; null unless it is an object."""
    return F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, "map<string,string>"))


def errors(raw: Column, root: FieldInfo) -> Column:
    """Array of the paths that are missing or of another type in a JSON text; ``$`` for a text that is no object.

    Members that the schema does not declare are let through.
    """
    variant = F.try_parse_json(raw)
    kind = F.schema_of_variant(variant)
    found = _errors(variant, root, "$")
    return F.when(variant.isNull() | ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.array(F.lit("$"))).otherwise(F.filter(F.flatten(F.array(*found)) if found else F.array().cast("array<string>"), lambda e: e.isNotNull()))


def _errors(value: Column, node: FieldInfo, label: str) -> list[Column]:
    """One array<string> column for each check below ``node`` of a variant."""
    out = []
    for m in node.members:
        own = F.try_variant_get(value, "$['" + m.name.replace("'", "\\'") + "']", "variant")
        out += _check(own, m)
    return out


def _check(own: Column, m: FieldInfo) -> list[Column]:
    kind = F.coalesce(F.schema_of_variant(own), F.lit("MISSING"))
    fault = F.array(F.lit(m.path))
    none = F.array().cast("array<string>")
    if m.kind == "object":
        inner = _errors(own, m, m.path)
        return [F.when(~kind.startswith("OBJECT"), fault).otherwise(F.flatten(F.array(*inner)) if inner else none)]
    if m.kind == "array":
        item = m.members[0]
        elements = F.try_variant_get(own, "$", "array<variant>")
        inner = F.flatten(F.transform(elements, lambda e: F.flatten(F.array(*_check(e, item)))))
        return [F.when(~kind.startswith("ARRAY"), fault).otherwise(F.array_distinct(F.coalesce(inner, none)))]
    if m.kind == "integer":
        number = F.try_variant_get(own, "$", "bigint")
        good = (kind == "BIGINT") & number.between(-(1 << 31), (1 << 31) - 1)
    elif m.kind == "float":
        good = kind.startswith("DECIMAL") | (kind == "DOUBLE")
    else:
        good = kind == ("STRING" if m.kind == "string" else "BOOLEAN")
    return [F.when(F.coalesce(good, F.lit(False)), none).otherwise(fault)]


def document_id(raw: Column) -> Column:
    """The mandatory ``id`` as a number, null unless it is an unsigned 32-bit integer."""
    variant = F.try_parse_json(raw)
    own = F.try_variant_get(variant, "$.id", "variant")
    number = F.try_variant_get(own, "$", "bigint")
    return F.when((F.schema_of_variant(own) == "BIGINT") & number.between(0, (1 << 32) - 1), number)


def validated(docs: DataFrame, root: FieldInfo, raw_col: str = "_raw") -> DataFrame:
    """``docs`` with ``doc_id`` and ``_errors``: the schema's, ``id`` for a bad id, and the reserved member."""
    id_ = document_id(F.col(raw_col))
    reserved = F.try_variant_get(F.try_parse_json(F.col(raw_col)), f"$['{RESERVED}']", "variant").isNotNull()
    more = F.filter(F.array(F.when(id_.isNull(), F.lit("id")), F.when(reserved, F.lit(RESERVED))), lambda e: e.isNotNull())
    return docs.withColumn("doc_id", id_).withColumn("_errors", F.concat(errors(F.col(raw_col), root), more))


def parsed(docs: DataFrame, root: FieldInfo, raw_col: str = "_raw") -> DataFrame:
    """``docs`` with ``doc``, the declared members as a struct."""
    return docs.withColumn("doc", F.from_json(raw_col, root.spark))


def member(name: str):
    return lambda x: x.getField(name)


def values(doc: Column, root: FieldInfo, path: str) -> Column:
    """All values of a dotted path: an array, elements of nested arrays in order; a plain path gives one."""
    out, many = doc, False
    for part in path.split("."):
        if part == "$items":
            out, many = (F.flatten(out) if many else out), True
        else:
            out = F.transform(out, member(part)) if many else out.getField(part)
    return out if many else F.array(out)


def number(doc: Column, root: FieldInfo, path: str) -> Column:
    """The number by which documents are sorted: of an array, the last."""
    return F.element_at(values(doc, root, path), -1)


def value_at(document: dict[str, Any], path: str) -> Any:
    """A member by dotted path, array elements by number."""
    node: Any = document
    for part in path.split("."):
        if isinstance(node, dict) and part in node:
            node = node[part]
        elif isinstance(node, list) and part.isdigit() and int(part) < len(node):
            node = node[int(part)]
        else:
            raise NotFound(f"no {path}")
    return node
