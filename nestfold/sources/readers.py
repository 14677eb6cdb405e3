"""Files as tables, by extension; every reader takes paths and globs that Spark can list."""

from __future__ import annotations

import io
import json
import re
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META = "struct(_metadata.file_path as path, _metadata.file_name as name, _metadata.file_size as size, _metadata.file_modification_time as mtime)"


def typed_cell(cell: Column) -> Column:
    """The type of one CSV cell: empty is null, then booleans, integers and doubles; as a variant.

    Integers with leading zeros or beyond 64 bits stay strings.
    """
    whole = cell.rlike(r"^-?(0|[1-9][0-9]{0,17})$")
    real = cell.rlike(r"^-?(0|[1-9][0-9]*)?\.[0-9]+([eE][-+]?[0-9]+)?$|^-?(0|[1-9][0-9]*)\.?[eE][-+]?[0-9]+$")
    quoted = F.to_json(F.array(cell))
    text = F.when(whole | cell.isin("true", "false"), cell).when(real, cell.try_cast("double").cast("string")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return F.when((cell != "") & cell.isNotNull(), F.try_parse_json(text))


def read_csv(spark: SparkSession, path: str, sep: str = ",", typed: bool = False, multiline: bool = False) -> DataFrame:
    """Columns of text, or with `typed` of variants whose types are found cell by cell.

    Large files are read in splits; with `multiline` cells may hold line breaks, and a file is one task's.
    """
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", multiline).option("escape", '"').csv(path)
    return df.select(*[typed_cell(F.col(f"`{c}`")).alias(c) for c in df.columns]) if typed else df


def read_json(spark: SparkSession, path: str, variant: bool = False) -> DataFrame:
    """Whole files: one document, several in a row, or an array of them."""
    reader = spark.read.option("multiLine", True)
    return reader.option("singleVariantColumn", "value").json(path) if variant else reader.json(path)


def read_jsonl(spark: SparkSession, path: str, variant: bool = False) -> DataFrame:
    return spark.read.option("singleVariantColumn", "value").json(path) if variant else spark.read.json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _parsed(spark: SparkSession, path: str, parse: Callable[[str], list]) -> DataFrame:
    """name and value (a variant) of the documents that a parser finds in each whole file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(n, k, json.dumps(d, default=str)) for n, t in zip(part["name"], part["value"], strict=True) for k, d in enumerate(parse(t))]
            yield pd.DataFrame(rows, columns=["name", "k", "text"])

    texts = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_name as name", "value")
    return texts.mapInPandas(run, "name string, k int, text string").select("name", "k", F.try_parse_json("text").alias("value"))


def _yaml(text: str) -> list:
    import yaml

    found = [d for d in yaml.safe_load_all(text) if d is not None]
    return found[0] if len(found) == 1 and isinstance(found[0], list) else found


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, _yaml)


def read_toml(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, lambda t: [tomllib.loads(t)])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """name, kind and text of whole text and log files."""
    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_name as name", "'text' as kind", "value as text")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """name, front (variant of the YAML front matter; MISSING without) and body."""
    texts = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_name as name", "value as text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for n, t in zip(part["name"], part["text"], strict=True):
                m = re.match(r"---\r?\n(.*?)\r?\n---\r?\n?(.*)", t, re.DOTALL)
                front = _yaml(m[1]) if m else []
                rows.append((n, json.dumps(front[0], default=str) if front else None, m[2] if m else t))
            yield pd.DataFrame(rows, columns=["name", "front", "body"])

    return texts.mapInPandas(run, "name string, front string, body string").select("name", F.try_parse_json("front").alias("front"), "body")


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+)\??|\\(par|line|tab)\b ?|\{\\\*[^{}]*\}|\{\\(?:fonttbl|colortbl|stylesheet|info)(?:[^{}]|\{[^{}]*\})*\}|\\[a-z]+-?\d* ?|[{}]|\r?\n")


def rtf_text(raw: bytes) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return bytes.fromhex(m[1]).decode("cp1252", "replace")
        if m[2]:
            return chr(int(m[2]) % 65536)
        return {"par": "\n", "line": "\n", "tab": "\t"}.get(m[3], "")

    return _RTF.sub(one, raw.decode("latin-1")).strip()


def _xml_text(raw: bytes, paragraph: str, run: str) -> str:
    out = []
    for p in ElementTree.fromstring(raw).iter():
        if p.tag.endswith(paragraph):
            out.append("".join(t.text or "" for t in p.iter() if t.tag.endswith(run)))
    return "\n".join(out)


def office_text(raw: bytes, kind: str) -> str:
    """Text of docx, pptx (slides in order) and xlsx (rows as tab-separated cells)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        number = lambda n: int((re.findall(r"(\d+)\.xml$", n) or [0])[0])
        if kind == "docx":
            return _xml_text(z.read("word/document.xml"), "}p", "}t")
        if kind == "pptx":
            slides = sorted((n for n in names if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=number)
            return "\n\n".join(_xml_text(z.read(n), "}p", "}t") for n in slides)
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if si.tag.endswith("}si")]
        lines = []
        for sheet in sorted((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=number):
            for row in (r for r in ElementTree.fromstring(z.read(sheet)).iter() if r.tag.endswith("}row")):
                cells = []
                for c in (c for c in row if c.tag.endswith("}c")):
                    v = next((x.text or "" for x in c.iter() if x.tag.endswith(("}v", "}t"))), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                lines.append("\t".join(cells))
        return "\n".join(lines)


def pdf_text(raw: bytes) -> str:
    """Strings that a PDF's (deflated) content streams show; fonts with own encodings are not decoded."""
    import zlib

    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.DOTALL):
        try:
            body = zlib.decompress(m[1])
        except zlib.error:
            body = m[1]
        for block in re.findall(rb"BT(.*?)ET", body, re.DOTALL):
            parts = re.findall(rb"\(((?:[^()\\]|\\.)*)\)", block)
            out.append("".join(re.sub(rb"\\(.)", rb"\1", p).decode("latin-1") for p in parts))
    return "\n".join(out)


def media_meta(raw: bytes, kind: str) -> dict:
    """Width and height of PNG, GIF, BMP and JPEG images; brand and seconds of MP4 files."""
    number = lambda b, order="big": int.from_bytes(b, order)
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return {"format": "png", "width": number(raw[16:20]), "height": number(raw[20:24])}
    if raw[:4] == b"GIF8":
        return {"format": "gif", "width": number(raw[6:8], "little"), "height": number(raw[8:10], "little")}
    if raw[:2] == b"BM":
        return {"format": "bmp", "width": number(raw[18:22], "little"), "height": number(raw[22:26], "little")}
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw):
            marker, size = raw[at + 1], number(raw[at + 2 : at + 4])
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return {"format": "jpeg", "width": number(raw[at + 7 : at + 9]), "height": number(raw[at + 5 : at + 7])}
            at += 2 + size
    if raw[4:8] == b"ftyp":
        out = {"format": "mp4", "brand": raw[8:12].decode("latin-1")}
        k = raw.find(b"mvhd")
        if k > 0 and raw[k + 4] == 0:
            out["seconds"] = number(raw[k + 20 : k + 24]) / max(1, number(raw[k + 16 : k + 20]))
        return out
    return {"format": kind}


def extract_text(raw: bytes, kind: str) -> str:
    """Text of one file; unreadable files give an empty one."""
    try:
        if kind in ("docx", "pptx", "xlsx"):
            return office_text(raw, kind)
        if kind == "pdf":
            return pdf_text(raw)
        if kind == "rtf":
            return rtf_text(raw)
        if kind in ("png", "gif", "bmp", "jpg", "jpeg", "mp4"):
            return json.dumps(media_meta(raw, kind), sort_keys=True)
        return raw.decode("utf-8", "replace")
    except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
        return ""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """filename, kind and text of documents, images and videos (their metadata as JSON)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            kinds = part["path"].str.rsplit(".", n=1).str[-1].str.lower()
            text = [extract_text(bytes(c), k) for c, k in zip(part["content"], kinds, strict=True)]
            yield pd.DataFrame({"filename": part["path"].str.rsplit("/", n=1).str[-1], "kind": kinds, "text": text})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "filename string, kind string, text string")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "json": read_json, "jsonl": read_jsonl, "ndjson": read_jsonl, "csv": read_csv, "tsv": lambda s, p: read_csv(s, p, "\t"),
    "parquet": read_parquet, "yaml": read_yaml, "yml": read_yaml, "toml": read_toml, "txt": read_text, "log": read_text, "md": read_markdown,
    **dict.fromkeys(("docx", "pptx", "xlsx", "pdf", "rtf", "png", "gif", "bmp", "jpg", "jpeg", "mp4"), read_documents),
}


def extension(path: str) -> str:
    """The extension that decides on a reader; a compression suffix is looked through."""
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    if parts[-1] == "zst":
        raise ValueError("zstd files are accepted by name but cannot be decoded")
    return parts[-2] if parts[-1] == "gz" and len(parts) > 2 else parts[-1]


def read(spark: SparkSession, path: str, only: set[str] | None = None) -> DataFrame:
    kind = extension(path)
    if kind not in READERS or (only and kind not in only):
        raise ValueError(f"no reader for {path}")
    return READERS[kind](spark, path)


def with_meta(df: DataFrame) -> DataFrame:
    """Adds _id (file path and, in files of many rows, a row number) and _meta."""
    return df.selectExpr("*", f"{META} as _meta", "concat(_metadata.file_path, '@', monotonically_increasing_id()) as _id")
