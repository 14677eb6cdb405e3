"""Scalar functions with the engine's semantics, as Catalyst expressions.

Bad input gives NULL instead of an error: a division by zero, a position outside the string, a
value that does not convert. Arithmetic promotes to double where 64-bit integers overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- arithmetic -----------------------------------------------------------------------------


def add(a, b) -> Column:
    return F.coalesce(F.try_add(_c(a), _c(b)), _c(a).cast("double") + _c(b).cast("double"))


def sub(a, b) -> Column:
    return F.coalesce(F.try_subtract(_c(a), _c(b)), _c(a).cast("double") - _c(b).cast("double"))


def mult(a, b) -> Column:
    return F.coalesce(F.try_multiply(_c(a), _c(b)), _c(a).cast("double") * _c(b).cast("double"))


def div(a, b) -> Column:
    """Always a double; NULL where the divisor is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def mod(a, b) -> Column:
    return F.try_mod(_c(a).cast("double"), _c(b).cast("double"))


def idiv(a, b) -> Column:
    a, b = _c(a).cast("long"), _c(b).cast("long")
    return F.when(b != 0, F.call_function("div", a, F.nullif(b, F.lit(0))))


def imod(a, b) -> Column:
    return F.try_mod(_c(a).cast("long"), _c(b).cast("long"))


def neg(a) -> Column:
    """NULL for the least long, which has no opposite."""
    return F.try_subtract(F.lit(0), _c(a))


def log(x) -> Column:
    """LOG is base 10; LN is natural."""
    return F.log10(_c(x))


def round_even(x, n: int = 0) -> Column:
    return F.bround(_c(x).cast("double"), n)


def trunc(x, n: int = 0) -> Column:
    x, scale = _c(x).cast("double"), 10.0**n
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


# --- conditions -------------------------------------------------------------------------------


def if_missing_or_null(*xs) -> Column:
    return F.coalesce(*map(_c, xs))


def missing_if(a, b) -> Column:
    return F.nullif(_c(a), _c(b))


def greatest(*xs) -> Column:
    return F.greatest(*map(_c, xs))


def least(*xs) -> Column:
    return F.least(*map(_c, xs))


def is_distinct(a, b) -> Column:
    return ~_c(a).eqNullSafe(_c(b))


def truthy(x, kind: str) -> Column:
    """What WHERE, ON and HAVING keep: true, numbers but 0, and what is not empty."""
    x = _c(x)
    if kind == "boolean":
        out = x
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        out = x != 0
    elif kind == "string":
        out = x != ""
    elif kind.startswith(("array", "map")):
        out = F.size(x) > 0
    else:
        out = x.isNotNull()
    return F.coalesce(out, F.lit(False))


# --- strings: positions and lengths count bytes, MB_ ones characters ------------------------------


def length(s) -> Column:
    return F.octet_length(_c(s))


def mb_length(s) -> Column:
    return F.char_length(_c(s))


def _text(b: Column) -> Column:
    return F.make_valid_utf8(b.cast("string"))


def substr0(s, pos, n=None) -> Column:
    """Bytes from a 0-based position, negative from the end; NULL outside the string."""
    s, raw = _c(s), _c(s).cast("binary")
    size = F.octet_length(s)
    at = F.when(_c(pos) < 0, size + _c(pos)).otherwise(_c(pos))
    rest = F.substring(raw, at + 1, size if n is None else _c(n))
    ok = (at >= 0) & (at < size)
    if n is not None:
        ok = ok & (_c(n) >= 0)
    return F.when(ok, _text(rest))


def substr1(s, pos, n=None) -> Column:
    p = _c(pos)
    return substr0(s, F.when(p > 0, p - 1).otherwise(p), n)


def position0(s, t) -> Column:
    """0-based byte position of the first match, -1 without one."""
    s, t = _c(s), _c(t)
    at = F.instr(s, t)
    return F.when(at == 0, -1).otherwise(F.octet_length(F.substring(s, F.lit(1), at - 1)))


def position1(s, t) -> Column:
    return position0(s, t) + 1


def title(s) -> Column:
    """Upper-case after any non-letter, lower-case elsewhere."""
    parts = F.regexp_extract_all(F.lower(_c(s)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.char_length(p)))), "")


def trim(s, cut: str | None = None) -> Column:
    return F.trim(_c(s)) if cut is None else F.btrim(_c(s), F.lit(cut))


def split(s, sep: str | None = None) -> Column:
    if sep is None:
        return F.filter(F.split(_c(s), r"\s+"), lambda x: x != "")
    return F.split(_c(s), r"\Q" + sep.replace(r"\E", r"\E\\E\Q") + r"\E") if sep else F.split(_c(s), "")


def contains(s, t) -> Column:
    return _c(s).contains(_c(t))


def regexp_contains(s, pattern: str) -> Column:
    return _c(s).rlike(pattern)


def regexp_like(s, pattern: str) -> Column:
    return _c(s).rlike(rf"^(?:{pattern})\z")


def base64_decode_string(s) -> Column:
    return _text(F.unbase64(_c(s)))


def suffixes(s) -> Column:
    s = _c(s)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1))), lambda k: F.substring(s, k, F.char_length(s)))


def tokens(s) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(_c(s)), r"\W+"), lambda x: x != ""))


def slugify(s) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(s)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def celsius_to_fahrenheit(c) -> Column:
    return _c(c) * 9 / 5 + 32


def add_two_numbers(a, b) -> Column:
    return add(a, b)


# --- types ------------------------------------------------------------------------------------


def to_number(x) -> Column:
    return F.try_cast(_c(x), "double") if hasattr(F, "try_cast") else _c(x).try_cast("double")


def to_string(x) -> Column:
    return _c(x).cast("string")


def to_boolean(x, kind: str) -> Column:
    return truthy(x, kind)
