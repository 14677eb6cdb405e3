"""Extract recipes: how text files are framed into records, and fields taken out of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExtractSpec:
    """framing: line, multiline (start: pattern of a record's first line), section (start: of a heading), json, whole.

    pattern: regular expression with a group for each of `fields` (name -> type). time: the
    field with the record's time and its format; it becomes epoch milliseconds in `_ts`.
    """

    name: str
    framing: str = "line"
    start: str = ""
    pattern: str = ""
    fields: dict[str, str] = field(default_factory=dict)
    time: tuple[str, str] | None = None


def framed(spark: SparkSession, path: str, spec: ExtractSpec) -> DataFrame:
    """file, n (ascending in a file; gapless for multiline and section framing) and record.

    Lines are numbered where they are read. Records of several lines are counted within each
    split and the counts of splits added up, so that a large file is not one task's work.
    """
    if spec.framing == "whole":
        return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as file", "0L as n", "value as record")
    lines = spark.read.text(path).selectExpr("_metadata.file_path as file", "monotonically_increasing_id() as at", "value as line")
    if spec.framing in ("line", "json"):
        return lines.select("file", F.col("at").alias("n"), F.col("line").alias("record"))
    marked = lines.withColumn("split", F.shiftright("at", 33)).withColumn("new", F.col("line").rlike(spec.start).cast("long"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy("file", "split").agg(F.sum("new").alias("c"))
    counts = counts.select("file", "split", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    own = F.sum("new").over(Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.withColumn("own", own).join(counts, ["file", "split"]).withColumn("n", F.col("own") + F.col("off")).filter("n > 0")
    joined = numbered.groupBy("file", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda e: e["line"]), "\n").alias("record"))
    return joined.select("file", (F.col("n") - 1).alias("n"), "record")


def fields(record: Column, spec: ExtractSpec) -> list[Column]:
    out = []
    for k, (name, kind) in enumerate(spec.fields.items(), 1):
        text = F.nullif(F.regexp_extract(record, spec.pattern, k), F.lit(""))
        out.append((text if kind == "string" else text.try_cast(kind)).alias(name))
    if spec.time:
        text = F.regexp_extract(record, spec.pattern, list(spec.fields).index(spec.time[0]) + 1)
        out.append(F.unix_millis(F.try_to_timestamp(text, F.lit(spec.time[1]))).alias("_ts"))
    return out


def extract(spark: SparkSession, path: str, spec: ExtractSpec) -> DataFrame:
    """Records that match the pattern, with their fields; JSON framing gives a variant `value`."""
    records = framed(spark, path, spec)
    if spec.framing == "json":
        return records.select("file", "n", F.try_parse_json("record").alias("value"))
    if not spec.pattern:
        return records
    return records.filter(F.col("record").rlike(spec.pattern)).select("file", "n", *fields(F.col("record"), spec))


APACHE_ACCESS = ExtractSpec(
    "apache_access",
    pattern=r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d{3}) (\d+|-)',
    fields={"ip": "string", "user": "string", "time": "string", "method": "string", "path": "string", "status": "int", "bytes": "long"},
    time=("time", "dd/MMM/yyyy:HH:mm:ss Z"),
)
SERVER_LOG = ExtractSpec(
    "server_log",
    framing="multiline",
    start=r"^\d{4}-\d\d-\d\dT",
    pattern=r"^(\S+) \[?(\w+)\]? (?s)(.*)$",
    fields={"time": "string", "level": "string", "message": "string"},
    time=("time", "yyyy-MM-dd'T'HH:mm:ss[.SSS]X"),
)
CPU_PROFILE = ExtractSpec("cpu_profile", pattern=r"^\s*([0-9.]+)m?s\s+([0-9.]+)%\s+(.+)$", fields={"ms": "double", "percent": "double", "function": "string"})
STANZA = ExtractSpec("stanza", framing="section", start=r"^\[[^\]]+\]\s*$", pattern=r"(?s)^\[([^\]]+)\]\n?(.*)$", fields={"section": "string", "body": "string"})
RECIPES = {s.name: s for s in (APACHE_ACCESS, SERVER_LOG, CPU_PROFILE, STANZA)}


def md_sections(text: Column) -> Column:
    """array of struct(level, title, body) of a markdown text."""
    starts = F.filter(F.split(text, r"(?m)^(?=#{1,6}\s)"), lambda s: s.rlike(r"^#{1,6}\s"))
    return F.transform(
        starts,
        lambda s: F.struct(
            F.length(F.regexp_extract(s, "^(#+)", 1)).alias("level"),
            F.trim(F.regexp_extract(s, r"^#+\s+([^\n]*)", 1)).alias("title"),
            F.btrim(F.regexp_replace(s, r"^[^\n]*\n?", ""), F.lit("\n ")).alias("body"),
        ),
    )


def md_links(text: Column) -> Column:
    """array of struct(text, url)."""
    labels, urls = (F.regexp_extract_all(text, F.lit(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)[^)]*\)"), k) for k in (1, 2))
    return F.transform(F.arrays_zip(labels, urls), lambda e: F.struct(e["0"].alias("text"), e["1"].alias("url")))


def md_code(text: Column) -> Column:
    """array of struct(lang, code) of fenced blocks."""
    langs, codes = (F.regexp_extract_all(text, F.lit(r"(?ms)^```(\w*)[^\n]*\n(.*?)^```"), k) for k in (1, 2))
    return F.transform(F.arrays_zip(langs, codes), lambda e: F.struct(e["0"].alias("lang"), e["1"].alias("code")))
