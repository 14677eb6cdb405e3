"""Schemaless values: MISSING is SQL NULL, JSON null a variant of its own.

`collate_key` gives variants the one order of all types: missing, null, booleans, numbers,
strings, arrays, objects. Variants cannot be compared, grouped or sorted themselves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c

_NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def parse(text) -> Column:
    return F.try_parse_json(_c(text))


def kind(v) -> Column:
    """missing, null, boolean, number, string, array, object or binary."""
    v = _c(v)
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "missing")
        .when(F.is_variant_null(v), "null")
        .when(s == "BOOLEAN", "boolean")
        .when(s.rlike(_NUMERIC), "number")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .when(s == "BINARY", "binary")
        .otherwise("string")
    )


def field(v, path: str) -> Column:
    return F.try_variant_get(_c(v), path, "variant")


def is_missing(v) -> Column:
    return _c(v).isNull()


def is_null(v) -> Column:
    return _c(v).isNotNull() & F.is_variant_null(_c(v))


def is_valued(v) -> Column:
    return _c(v).isNotNull() & ~F.is_variant_null(_c(v))


def number(v) -> Column:
    return F.when(kind(v) == "number", F.try_variant_get(_c(v), "$", "double"))


def string(v) -> Column:
    return F.when(kind(v) == "string", F.try_variant_get(_c(v), "$", "string"))


def canonical(v) -> Column:
    """JSON text that is equal for equal values: object fields are stored in order of their names."""
    return F.to_json(_c(v))


_RANKS = ("missing", "null", "boolean", "number", "string", "array", "object", "binary")


def _scalar_key(v: Column) -> tuple[Column, Column, Column]:
    k = kind(v)
    rank = F.element_at(F.create_map(*[F.lit(x) for p in zip(_RANKS, range(8), strict=True) for x in p]), k)
    num = F.when(k == "number", F.try_variant_get(v, "$", "double")).when(k == "boolean", F.try_variant_get(v, "$", "boolean").cast("double"))
    return rank, num, F.when(k == "string", F.try_variant_get(v, "$", "string"))


def collate_key(v) -> Column:
    """struct(rank, num, len, items, str), ordered as values are.

    Arrays go by their elements, then by length; objects by length, then by their JSON, whose
    fields stand in order of their names. Arrays and objects inside arrays go by their JSON.
    """
    v = _c(v)
    rank, num, text = _scalar_key(v)
    size = F.when(kind(v) == "object", F.size(F.try_variant_get(v, "$", "map<string,variant>")))

    def item(x: Column) -> Column:
        r, n, s = _scalar_key(x)
        return F.struct(r.alias("rank"), n.alias("num"), F.coalesce(s, F.when(kind(x).isin("array", "object"), F.to_json(x))).alias("str"))

    items = F.when(kind(v) == "array", F.transform(F.try_variant_get(v, "$", "array<variant>"), item))
    return F.struct(rank.alias("rank"), num.alias("num"), size.alias("len"), items.alias("items"), F.coalesce(text, F.when(kind(v) == "object", F.to_json(v))).alias("str"))


def truthy(v) -> Column:
    v = _c(v)
    k = kind(v)
    return (
        F.when(k == "boolean", F.try_variant_get(v, "$", "boolean"))
        .when(k == "number", F.try_variant_get(v, "$", "double") != 0)
        .when(k == "string", F.try_variant_get(v, "$", "string") != "")
        .when(k == "array", F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .when(k == "object", F.size(F.try_variant_get(v, "$", "map<string,variant>")) > 0)
        .otherwise(F.lit(False))
    )


def if_null(v, other) -> Column:
    """The other where v is JSON null; MISSING stays MISSING."""
    return F.when(is_null(v), _c(other)).otherwise(_c(v))


def if_missing(v, other) -> Column:
    return F.when(is_missing(v), _c(other)).otherwise(_c(v))


def within(v, depth: int = 6) -> Column:
    """All values at any depth up to `depth`, as canonical JSON; arrays and objects are entered."""
    level = F.array(_c(v))
    out = F.array().cast("array<string>")
    for _ in range(depth):
        inner = lambda x: F.when(kind(x) == "array", F.try_variant_get(x, "$", "array<variant>")).when(kind(x) == "object", F.map_values(F.try_variant_get(x, "$", "map<string,variant>"))).otherwise(F.array().cast("array<variant>"))
        level = F.flatten(F.transform(level, inner))
        out = F.concat(out, F.transform(level, lambda x: F.to_json(x)))
    return out


def type_name(v) -> Column:
    return kind(v)


def is_array(v) -> Column:
    return F.when(is_valued(v), kind(v) == "array")


def is_number(v) -> Column:
    return F.when(is_valued(v), kind(v) == "number")


def is_string(v) -> Column:
    return F.when(is_valued(v), kind(v) == "string")


def is_boolean(v) -> Column:
    return F.when(is_valued(v), kind(v) == "boolean")


def is_object(v) -> Column:
    return F.when(is_valued(v), kind(v) == "object")


def is_atom(v) -> Column:
    return F.when(is_valued(v), kind(v).isin("boolean", "number", "string"))


def as_map(v) -> Column:
    return F.try_variant_get(_c(v), "$", "map<string,variant>")


def as_array(v) -> Column:
    return F.try_variant_get(_c(v), "$", "array<variant>")


def poly_length(v) -> Column:
    """Bytes of a string, elements of an array, fields of an object; NULL of anything else."""
    k = kind(v)
    return F.when(k == "string", F.octet_length(string(v))).when(k == "array", F.size(as_array(v))).when(k == "object", F.size(as_map(v)))


def construct(**fields: Column) -> Column:
    """An object of named values; MISSING (null) ones are left out."""
    return F.parse_json(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))
