"""Query packs: many tagged queries over one scan, with parameters, gates and fixtures."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from graphlib import TopologicalSorter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackQuery:
    """label: name of its results. source: the table it reads. where: predicate. evidence: what a match yields."""

    label: str
    source: str
    where: str
    evidence: tuple[str, ...]
    before: int = 0
    after: int = 0
    gate: str | None = None
    fixtures: tuple[tuple[str, str], ...] = ()
    text: str = ""


def literals(where: str) -> list[str]:
    """Strings of which one must stand in a row's text for the predicate to hold; [] if that is unknown.

    Reads LIKE '%x%' and contains(.., 'x'); a predicate with OR or NOT has none.
    """
    if re.search(r"\b(OR|NOT)\b", where, re.IGNORECASE):
        return []
    found = re.findall(r"LIKE\s+'%([^%_']{3,})%'", where, re.IGNORECASE) + re.findall(r"contains\([^,]+,\s*'([^']{3,})'\)", where, re.IGNORECASE)
    return found[:1]


def broadcast(df: DataFrame, queries: list[PackQuery], prefilter: str | None = None) -> DataFrame:
    """label and result (JSON of the evidence) of every match of every query, in one pass.

    Each row makes an array with an entry for each query that it matches, which is exploded; the
    scan, and expressions that queries share, run once. prefilter: a text column; if every query
    needs some literal, rows with none of them are dropped by one regular expression first.
    """
    needed = [literals(q.where) for q in queries]
    if prefilter and queries and all(needed):
        df = df.filter(F.col(prefilter).rlike("|".join(sorted({re.escape(x) for n in needed for x in n}))))
    hits = [F.when(F.expr(q.where), F.struct(F.lit(q.label).alias("label"), F.to_json(F.struct(*[F.expr(e) for e in q.evidence])).alias("result"))) for q in queries]
    any_hit = reduce(lambda a, b: a | b, [F.coalesce(F.expr(q.where), F.lit(False)) for q in queries])
    return df.filter(any_hit).select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("m")).select("m.*")


def broadcast_context(df: DataFrame, queries: list[PackQuery], partition: list[str], order: list[str]) -> DataFrame:
    """label, result and is_match of every row within a query's context; all queries share one sort."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = df.withColumns({f"_m{k}": F.coalesce(F.expr(q.where), F.lit(False)) for k, q in enumerate(queries)})
    near = {f"_c{k}": F.max(F.col(f"_m{k}").cast("int")).over(w.rowsBetween(-q.after, q.before)) for k, q in enumerate(queries)}
    hits = [F.when(F.col(f"_c{k}") == 1, F.struct(F.lit(q.label).alias("label"), F.to_json(F.struct(*[F.expr(e) for e in q.evidence])).alias("result"), F.col(f"_m{k}").alias("is_match"))) for k, q in enumerate(queries)]
    return marked.withColumns(near).select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("m")).select("m.*")


_TYPES = {"ident": r"[A-Za-z_][A-Za-z0-9_]*", "int": r"-?[0-9]+", "string": r"[^']*", "list": r"[A-Za-z0-9_, -]*"}


def bind(text: str, values: dict[str, str] | None = None) -> str:
    """Fill `${name}` from values or defaults; `-- param: name type [default]` lines declare them.

    A value that is not of its declared type is refused, so a parameter cannot smuggle in SQL.
    """
    values = dict(values or {})
    for name, kind, default in re.findall(r"^--\s*param:\s*(\w+)\s+(\w+)(?:\s+(\S.*))?$", text, re.MULTILINE):
        value = str(values.get(name, default))
        if not re.fullmatch(_TYPES[kind], value):
            raise ValueError(f"{name} must be of type {kind}: {value!r}")
        if kind == "list":
            value = ", ".join("'" + x.strip() + "'" for x in value.split(",") if x.strip())
        text = text.replace("${" + name + "}", value)
    if left := re.search(r"\$\{(\w+)\}", text):
        raise ValueError(f"no parameter named {left[1]}")
    return text


_SHAPE = re.compile(r"^\s*SELECT\s+(?P<evidence>.+?)\s+FROM\s+(?P<source>\w+)\s+WHERE\s+(?P<where>.+?)\s*;?\s*$", re.IGNORECASE | re.DOTALL)


def parse(label: str, text: str, values: dict[str, str] | None = None) -> PackQuery:
    """A query file: comment lines with param, gate, context and fixtures, then SELECT e FROM t WHERE p."""
    bound = bind(text, values)
    notes = dict(re.findall(r"^--\s*(gate|context):\s*(.+)$", bound, re.MULTILINE))
    fixtures = re.findall(r"^--\s*@fixture\s+(.+)\n--\s*@expect\s+(.+)$", bound, re.MULTILINE)
    body = "\n".join(x for x in bound.splitlines() if not x.lstrip().startswith("--"))
    m = _SHAPE.match(body)
    if not m:
        return PackQuery(label, "", "", (), gate=notes.get("gate"), fixtures=tuple(fixtures), text=body)
    before, after = (int(x) for x in notes.get("context", "0 0").split())
    evidence = tuple(x.strip() for x in re.split(r",(?![^()]*\))", m["evidence"]))
    return PackQuery(label, m["source"], m["where"], evidence, before, after, notes.get("gate"), tuple(fixtures), body)


@dataclass
class QueryPack:
    """Queries of one directory or list; those of the shape scan-filter-project share scans."""

    queries: list[PackQuery] = field(default_factory=list)

    @classmethod
    def load(cls, folder: str, values: dict[str, str] | None = None) -> QueryPack:
        return cls([parse(p.stem, p.read_text(), values) for p in sorted(Path(folder).glob("*.sql"))])

    def routes(self) -> dict[str, list[PackQuery]]:
        """Queries that can share a scan, by source."""
        out: dict[str, list[PackQuery]] = {}
        for q in self.queries:
            if q.source:
                out.setdefault(q.source, []).append(q)
        return out

    def lint(self) -> list[dict]:
        """For each query: whether it shares a scan, and whether literals can wake it."""
        return [{"label": q.label, "fused": bool(q.source), "indexed": bool(q.source and literals(q.where)), "gated": bool(q.gate)} for q in self.queries]

    def open(self, spark: SparkSession) -> list[PackQuery]:
        """Queries whose gate, if they have one, finds a row."""
        return [q for q in self.queries if not q.gate or not spark.sql(q.gate).isEmpty()]

    def run(self, spark: SparkSession, tables: dict[str, DataFrame], prefilter: dict[str, str] | None = None) -> DataFrame:
        """label and result of all queries: one scan a source, others by themselves."""
        parts = []
        open_ = QueryPack(self.open(spark))
        for source, found in open_.routes().items():
            parts.append(broadcast(tables[source], found, (prefilter or {}).get(source)))
        for q in open_.queries:
            if not q.source:
                parts.append(spark.sql(q.text, **{n: t for n, t in tables.items() if "{" + n + "}" in q.text}).select(F.lit(q.label).alias("label"), F.to_json(F.struct("*")).alias("result")))
        return reduce(DataFrame.unionByName, parts)

    def check_fixtures(self, spark: SparkSession) -> list[str]:
        """Run each query on its fixtures (JSON rows) and name those that do not give what is expected."""
        bad = []
        for q in self.queries:
            for given, expected in q.fixtures:
                rows = json.loads(given)
                got = [json.loads(r.result) for r in broadcast(spark.createDataFrame(rows), [q]).collect()] if rows else []
                if sorted(map(str, got)) != sorted(map(str, json.loads(expected))):
                    bad.append(q.label)
        return bad


def compose(spark: SparkSession, packs: dict[str, tuple[QueryPack, list[str]]], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Run packs that read each other's results; name -> (pack, names it needs). In topological order."""
    made = dict(tables)
    for name in TopologicalSorter({n: set(need) for n, (_, need) in packs.items()}).static_order():
        if name in packs:
            made[name] = packs[name][0].run(spark, made)
    return {n: made[n] for n in packs}


def multi_matches(spark: SparkSession, folder: str, tables: dict[str, DataFrame], values: dict[str, str] | None = None) -> DataFrame:
    """A pack's results as a table."""
    return QueryPack.load(folder, values).run(spark, tables)


