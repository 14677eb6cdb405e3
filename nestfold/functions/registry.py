"""Names for SQL: SQL functions, pandas aggregates and table functions, with checked examples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SqlFunction:
    """A function whose body is an expression, which Catalyst inlines. example: call and result."""

    name: str
    args: str
    returns: str
    body: str
    example: tuple[str, object]


SQL_FUNCTIONS = (
    SqlFunction("slugify", "s STRING", "STRING", "regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-'), '^-+|-+$', '')", ("slugify(' Hello, World ')", "hello-world")),
    SqlFunction("celsius_to_fahrenheit", "c DOUBLE", "DOUBLE", "c * 9 / 5 + 32", ("celsius_to_fahrenheit(100)", 212.0)),
    SqlFunction("add_two_numbers", "a DOUBLE, b DOUBLE", "DOUBLE", "a + b", ("add_two_numbers(1, 2)", 3.0)),
    SqlFunction("position0", "s STRING, t STRING", "INT", "IF(instr(s, t) = 0, -1, octet_length(substring(s, 1, instr(s, t) - 1)))", ("position0('hello', 'l')", 2)),
    SqlFunction("position1", "s STRING, t STRING", "INT", "IF(instr(s, t) = 0, 0, octet_length(substring(s, 1, instr(s, t) - 1)) + 1)", ("position1('hello', 'z')", 0)),
    SqlFunction("mb_length", "s STRING", "INT", "char_length(s)", ("mb_length('é')", 1)),
    SqlFunction("regexp_contains", "s STRING, p STRING", "BOOLEAN", "s RLIKE p", ("regexp_contains('abc', 'b')", True)),
    SqlFunction("trunc_to", "x DOUBLE, n INT", "DOUBLE", "signum(x) * floor(abs(x) * power(10, n)) / power(10, n)", ("trunc_to(-2.789, 1)", -2.7)),
    SqlFunction("vector_l2", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "IF(size(a) = size(b), sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)), NULL)", ("vector_l2(array(0D, 3D), array(4D, 0D))", 5.0)),
    SqlFunction("vector_cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "IF(size(a) = size(b), 1 - try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), NULL)", ("vector_cosine(array(1D, 0D), array(0D, 1D))", 1.0)),
    SqlFunction("ejson_decode", "doc STRING", "STRING", "coalesce(get_json_object(doc, '$.$numberDecimal'), get_json_object(doc, '$.$numberLong'), get_json_object(doc, '$.$date'), get_json_object(doc, '$.$oid'), doc)", ("""ejson_decode('{"$numberDecimal":"1.5"}')""", "1.5")),
)


def _exact(op: str):
    """A pandas function of two columns of decimal texts: exact at any length, trailing zeros trimmed, NULL for bad text."""

    def one(a: str | None, b: str | None):
        from decimal import MAX_EMAX, MAX_PREC, MIN_EMIN, Context, Decimal, InvalidOperation

        if a is None or b is None:
            return None
        exact = Context(prec=min(MAX_PREC, 4 * (len(a) + len(b)) + 50), Emax=MAX_EMAX, Emin=MIN_EMIN)
        try:
            x, y = Decimal(a.strip()), Decimal(b.strip())
            if not (x.is_finite() and y.is_finite()) or max(abs(x.adjusted()), abs(y.adjusted())) > 10_000:
                return None
            if op == "cmp":
                return (x > y) - (x < y)
            made = {"add": exact.add, "sub": exact.subtract, "mul": exact.multiply}[op](x, y)
        except InvalidOperation:
            return None
        text = format(made, "f")
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return "0" if text in ("-0", "") else text

    kind = "Int32" if op == "cmp" else object

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=kind)

    return F.pandas_udf(run, "int" if op == "cmp" else "string")


#: Exact decimals of any length, which no built-in type holds. Name -> operation and an example.
EXACT = {
    "decimal_add": ("add", ("decimal_add('0.001', '0.002')", "0.003")),
    "decimal_sub": ("sub", ("decimal_sub('1', '0.9')", "0.1")),
    "decimal_mul": ("mul", ("decimal_mul('12345678901234567890', '2')", "24691357802469135780")),
    "decimal_cmp": ("cmp", ("decimal_cmp('0.00000000001', '0')", 1)),
}


class Series:
    """Table function series(start, stop, step): one row for each number before stop."""

    def eval(self, start: int, stop: int, step: int) -> Iterator[tuple[int]]:
        yield from ((k,) for k in range(start, stop, step))


def geomean(x: pd.Series) -> float:
    """A grouped-aggregate pandas function: the geometric mean of positive values."""
    import numpy as np

    kept = x[x > 0]
    return float(np.exp(np.log(kept).mean())) if len(kept) else float("nan")


def register_all(spark: SparkSession) -> list[str]:
    """Register every function and return the names. A name that Spark has built in is refused."""
    names = []
    for f in SQL_FUNCTIONS:
        _refuse_builtin(spark, f.name)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f.name}({f.args}) RETURNS {f.returns} RETURN {f.body}")
        names.append(f.name)
    spark.udtf.register("series", F.udtf(Series, returnType="value long"))
    spark.udf.register("geomean", F.pandas_udf(geomean, "double"))
    for name, (op, _) in EXACT.items():
        spark.udf.register(name, _exact(op))
    return [*names, "series", "geomean", *EXACT]


def _refuse_builtin(spark: SparkSession, name: str) -> None:
    found = spark.sql(f"DESCRIBE FUNCTION {name}").collect() if spark.catalog.functionExists(name) else []
    if found and "org.apache.spark" in str(found):
        raise ValueError(f"{name} is a built-in function")


def unregister(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


def failing_examples(spark: SparkSession) -> list[str]:
    """Names of functions whose example does not give its result."""
    examples = {f.name: f.example for f in SQL_FUNCTIONS} | {n: e for n, (_, e) in EXACT.items()}
    return [n for n, (call, result) in examples.items() if spark.sql(f"SELECT {call} AS x").first()["x"] != result]
