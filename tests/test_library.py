"""Readers, sinks, recipes, the engine, packs, cursors and variants on small inputs."""

import io
import json
import random
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from nestfold import queries
from nestfold.functions import arrays, dates, registry, scalar, variants, vectors
from nestfold.operators import aggregates, joins, sets, windows
from nestfold.plans import querypack
from nestfold.session import Engine
from nestfold.sources import catalog, extract, readers, search
from nestfold.streaming import cursors


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


# --- readers and sinks


def test_json_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": null, "b": "x"}]')
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": {"c": [1, 2]}}\n')
    assert spark.read.json(str(tmp_path / "a.json"), multiLine=True).count() == 2
    got = readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), variant=True)
    assert [r[0] for r in got.select(F.to_json("value")).collect()] == ['{"a":1}', '{"a":{"c":[1,2]}}']


def test_csv_cells(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,amount,memo\n1,2.50,"a, ""b"""\n007,,true\n99999999999999999999,-3,x\n')
    got = readers.read_csv(spark, str(tmp_path / "t.csv"), typed=True)
    rows = [tuple(r) for r in got.select(*[variants.kind(F.col(c)) for c in got.columns]).collect()]
    assert rows == [("number", "number", "string"), ("string", "missing", "boolean"), ("string", "number", "string")]
    assert got.select(variants.string(F.col("memo"))).first()[0] == 'a, "b"'


def test_yaml_toml_markdown(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("name: x\nports: [1, 2]\n---\nname: y\n")
    (tmp_path / "b.toml").write_text('title = "t"\n[owner]\nage = 3\n')
    (tmp_path / "c.md").write_text("---\ntype: note\n---\n# Head\nbody [l](http://u)\n")
    y = readers.read_yaml(spark, str(tmp_path / "a.yaml")).select(F.to_json("value")).collect()
    assert [json.loads(r[0])["name"] for r in y] == ["x", "y"]
    t = readers.read_toml(spark, str(tmp_path / "b.toml")).select(F.to_json("value")).first()[0]
    assert json.loads(t) == {"title": "t", "owner": {"age": 3}}
    m = readers.read_markdown(spark, str(tmp_path / "c.md")).select(F.to_json("front"), "body", extract.md_links(F.col("body"))[0]["url"]).first()
    assert json.loads(m[0]) == {"type": "note"} and m[1].startswith("# Head") and m[2] == "http://u"


def office(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_document_text(spark, tmp_path):
    w = 'xmlns:w="w"'
    docx = office(word__document_xml=f"<w:d {w}><w:p><w:t>Hel</w:t><w:t>lo</w:t></w:p><w:p><w:t>x</w:t></w:p></w:d>")
    xlsx = office(xl__sharedStrings_xml='<s:sst xmlns:s="s"><s:si><s:t>cell</s:t></s:si></s:sst>', xl__worksheets__sheet1_xml='<s:w xmlns:s="s"><s:row><s:c t="s"><s:v>0</s:v></s:c><s:c><s:v>5</s:v></s:c></s:row></s:w>')
    pptx = office(ppt__slides__slide1_xml='<a:s xmlns:a="a"><a:p><a:t>Slide</a:t></a:p></a:s>')
    pdf = b"%PDF\nstream\n" + zlib.compress(b"BT (Hi \\(you\\)) Tj ET") + b"\nendstream"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4) + (9).to_bytes(4)
    expected = {"a.docx": (docx, "Hello\nx"), "b.xlsx": (xlsx, "cell\t5"), "c.pptx": (pptx, "Slide"), "d.pdf": (pdf, "Hi (you)"), "e.rtf": (rb"{\rtf1 caf\'e9\par x}", "café\nx"), "f.png": (png, '{"format": "png", "height": 9, "width": 7}'), "g.docx": (b"broken", "")}
    for name, (raw, _) in expected.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["filename"]: r["text"] for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got == {n: t for n, (_, t) in expected.items()}


def test_discover_bind_insert(spark, tmp_path):
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "e1.jsonl").write_text('{"u": "a"}\n')
    (tmp_path / "events" / "e2.jsonl").write_text('{"u": "b"}\n')
    (tmp_path / "t.csv").write_text("x\n1\n")
    (tmp_path / "ns").mkdir()
    (tmp_path / "ns" / "deep").mkdir()
    (tmp_path / "ns" / "deep" / "d.json").write_text('{"z": 1}')
    assert set(catalog.discover(str(tmp_path))) == {"events", "t", "ns_deep"}
    engine = Engine(spark, str(tmp_path))
    assert engine.sql("SELECT count(*) AS n FROM events").first()["n"] == 2
    out = str(tmp_path / "out.jsonl")
    assert engine.sql(f"INSERT INTO '{out}' SELECT u FROM events WHERE u = 'a'").count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        engine.sql(f"INSERT INTO '{out}' SELECT u FROM events")
    engine.sql(f"INSERT INTO '{out}' APPEND SELECT u FROM events")
    engine.bind("events", out)
    assert engine.sql("SELECT count(*) AS n FROM events").first()["n"] == 3
    (tmp_path / "s.toml").write_text('[sources]\nlogs = "events/*.jsonl"\n')
    assert catalog.load_sources(str(tmp_path / "s.toml")) == {"logs": str(tmp_path / "events/*.jsonl")}


def test_statements(spark):
    engine = Engine(spark)
    engine.sql("PREPARE p AS SELECT id FROM range(10) WHERE id > :low")
    assert engine.sql("EXECUTE p", {"low": 7}).count() == 2
    engine.sql("CREATE TEMP KEYSPACE k AS SELECT 1 AS a")
    with pytest.raises(ValueError, match="exists"):
        engine.sql("CREATE TEMP KEYSPACE k AS SELECT 2 AS a")
    assert engine.sql("CREATE OR REPLACE TEMP KEYSPACE k AS SELECT 2 AS a").first()["a"] == 2
    engine.sql("DROP TEMP KEYSPACE k")
    engine.sql("DROP TEMP KEYSPACE IF EXISTS k")
    assert "Range" in engine.explain("SELECT * FROM range(3)")
    with pytest.raises(ValueError, match="built-in"):
        engine.register("upper", str.upper, "string")


def test_recipes(spark, tmp_path):
    (tmp_path / "access.log").write_text('1.2.3.4 - bob [10/Oct/2024:13:55:36 +0000] "GET /x HTTP/1.0" 200 23\nnoise\n')
    got = extract.extract(spark, str(tmp_path / "access.log"), extract.APACHE_ACCESS).first()
    assert (got["ip"], got["status"], got["bytes"], got["_ts"]) == ("1.2.3.4", 200, 23, 1728568536000)
    (tmp_path / "s.log").write_text("2024-01-01T00:00:00Z ERROR boom\n  at x\n2024-01-01T00:00:01Z INFO ok\n")
    multi = extract.extract(spark, str(tmp_path / "s.log"), extract.SERVER_LOG).orderBy("n").collect()
    assert [(r["level"], r["message"]) for r in multi] == [("ERROR", "boom\n  at x"), ("INFO", "ok")]
    (tmp_path / "c.ini").write_text("[one]\na=1\n[two]\nb=2\n")
    assert [(r["section"], r["body"]) for r in extract.extract(spark, str(tmp_path / "c.ini"), extract.STANZA).orderBy("n").collect()] == [("one", "a=1"), ("two", "b=2")]


# --- functions


def test_scalars(spark):
    big = F.lit(2**62)
    got = one(spark, scalar.add(big, big), scalar.div(1, 0), scalar.idiv(7, 0), scalar.idiv(-7, 2), scalar.imod(7, 0), scalar.round_even(2.5), scalar.trunc(-2.7), scalar.log(100.0))
    assert got == (2.0**63, None, None, -3, None, 2.0, -2.0, 2.0)
    s = F.lit("héllo")
    assert one(spark, scalar.length(s), scalar.mb_length(s), scalar.substr0(s, 1, 2), scalar.substr0(s, -1), scalar.substr0(s, 9), scalar.substr1(s, 1, 1), scalar.position0(s, "l"), scalar.position1(s, "z")) == (6, 5, "é", "o", None, "h", 3, 0)
    assert one(spark, scalar.title(F.lit("a-b c1d")), scalar.split(F.lit(" a  b ")), scalar.split(F.lit("a.b"), "."), scalar.suffixes(F.lit("abc"))) == ("A-B C1D", ["a", "b"], ["a", "b"], ["abc", "bc", "c"])


def test_dates(spark):
    ms = F.lit(1706659200123)  # 2024-01-31T00:00:00.123Z
    assert one(spark, dates.date_add_millis(ms, 1, "month"), dates.date_part_millis(ms, "iso_week"), dates.date_part_millis(ms, "millisecond"), dates.str_to_millis(F.lit("2024-01-31T00:00:00.123Z")), dates.str_to_millis(F.lit("junk"))) == (1709164800123, 5, 123, 1706659200123, None)


def test_arrays(spark):
    a = F.array(F.lit(3), F.lit(None).cast("int"), F.lit(1))
    assert one(spark, arrays.element(a, -1), arrays.element(a, 5), arrays.count(a), arrays.position(a, 1), arrays.span(5, 1, -2), arrays.span(3, 3)) == (1, None, 2, 2, [5, 3], [])
    empty = F.array().cast("array<int>")
    assert one(spark, arrays.any_satisfies(empty, lambda x: x > 0), arrays.every_satisfies(empty, lambda x: x > 0), arrays.any_and_every(empty, lambda x: x > 0), arrays.average(empty)) == (False, True, False, None)


def test_variants(spark):
    v = lambda text: variants.parse(F.lit(text))
    assert one(spark, variants.truthy(v("0")), variants.truthy(v('"x"')), variants.truthy(v("[]")), variants.truthy(v('{"a":1}')), variants.truthy(v("null"))) == (False, True, False, True, False)
    doc = v('{"b": null, "a": 1}')
    assert one(spark, variants.is_null(variants.field(doc, "$.b")), variants.is_missing(variants.field(doc, "$.c")), variants.is_valued(variants.field(doc, "$.a")), variants.canonical(doc)) == (True, True, True, '{"a":1,"b":null}')
    same = one(spark, variants.collate_key(v("1")) == variants.collate_key(v("1.0")), variants.collate_key(v('{"a":1,"b":2}')) == variants.collate_key(v('{"b":2,"a":1}')))
    assert same == (True, True)
    assert set(one(spark, variants.within(v('{"a":[1,{"b":"x"}]}')))[0]) == {'[1,{"b":"x"}]', "1", '{"b":"x"}', '"x"'}


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, None, "b"), (1, 5, "0"), (2, None, None)], "g int, k int, r string")
    got = df.groupBy("g").agg(aggregates.min_by(F.col("r"), F.col("k")).alias("m"), aggregates.countn(F.col("r")).alias("n"), aggregates.array_agg(F.col("k")).alias("a")).orderBy("g").collect()
    assert [(r["m"], r["n"], sorted(r["a"], key=str)) for r in got] == [("0", 1, [5, 5, None]), (None, 0, [None])]
    assert aggregates.sparkline(F.col("id").cast("double"), F.col("id")) is not None
    assert spark.range(3).agg(aggregates.sparkline(F.col("id").cast("double"), F.col("id"))).first()[0] == "▁▅█"


def test_recursion_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a int, b int")
    seed = spark.createDataFrame([(1,)], "n int")
    got = sets.recursive(seed, lambda level: level.join(edges, level["n"] == edges["a"]).select(F.col("b").alias("n")))
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3, 4]


def test_late_rows(spark):
    df = spark.createDataFrame([(1, 10), (2, 30), (3, 12), (4, 31)], "pos int, ts int")
    with pytest.raises(sets.LateRows):
        sets.ordered_merge("ts", "pos", 5, {"a": df})
    assert [r["ts"] for r in sets.ordered_merge("ts", "pos", 5, {"a": df}, late="widen").collect()] == [10, 12, 30, 31]


def test_salted_join_refuses_what_it_would_change(spark):
    with pytest.raises(ValueError, match="full"):
        joins.salted_join(spark.range(2), spark.range(2), "id", 2, "full")


# --- packs and cursors

PACK = """-- param: level ident error
-- context: 1 0
-- @fixture [{"id": 1, "kind": "error"}, {"id": 2, "kind": "ok"}]
-- @expect [{"id": 1}]
SELECT id FROM logs WHERE kind = '${level}'
"""


def test_pack_files(spark, tmp_path):
    (tmp_path / "errors.sql").write_text(PACK)
    (tmp_path / "count.sql").write_text("SELECT count(*) AS n FROM {logs} GROUP BY ALL")
    pack = querypack.QueryPack.load(str(tmp_path))
    assert pack.check_fixtures(spark) == []
    logs = spark.createDataFrame([(1, "error"), (2, "ok"), (3, "error")], "id int, kind string")
    got = sorted(map(tuple, pack.run(spark, {"logs": logs}).collect()))
    assert got == [("count", '{"n":3}'), ("errors", '{"id":1}'), ("errors", '{"id":3}')]
    assert {x["label"]: x["fused"] for x in pack.lint()} == {"count": False, "errors": True}
    with pytest.raises(ValueError, match="ident"):
        querypack.parse("x", PACK, {"level": "a' OR '1'='1"})


def test_pack_scans_once(spark, tmp_path):
    spark.range(10).withColumn("s", F.lit("abcdef")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    pack = [querypack.PackQuery(str(k), "t", f"id = {k} AND s LIKE '%abc%'", ("id",)) for k in range(3)]
    found = querypack.broadcast(df, pack, prefilter="s")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert found.count() == 3


def test_compose(spark):
    base = spark.createDataFrame([(1, 5), (2, 50)], "id int, x int")
    first = querypack.QueryPack([querypack.PackQuery("big", "base", "x > 10", ("id",))])
    second = querypack.QueryPack([querypack.PackQuery("seen", "first", "label = 'big'", ("result",))])
    got = querypack.compose(spark, {"second": (second, ["first"]), "first": (first, [])}, {"base": base})
    assert [r["label"] for r in got["second"].collect()] == ["seen"]


def test_append_cursor(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"x": 1}\n')
    cursor = cursors.AppendCursor(spark, str(src), spark.createDataFrame([(1,)], "x long").schema, str(tmp_path / "cp"))
    assert cursor.advance(str(tmp_path / "out")).count() == 1
    assert cursor.advance(str(tmp_path / "out")).count() == 1
    (src / "b.json").write_text('{"x": 2}\n{"x": 3}\n')
    assert cursor.advance(str(tmp_path / "out")).count() == 3


def test_diff_and_anomalies(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "id int, v string")
    assert sorted(map(tuple, cursors.diff(old, new, "id").collect())) == [(2, "update"), (3, "delete"), (4, "insert")]
    a = spark.createDataFrame([("x", 10, "h"), ("y", 10, "h"), ("z", 10, "h"), ("w", 1, "h")], "file string, size int, head string")
    b = spark.createDataFrame([("x", 5, "h"), ("y", 20, "i"), ("w", 9, "h")], "file string, size int, head string")
    assert sorted(map(tuple, cursors.anomalies(a, b).collect())) == [("x", "truncated"), ("y", "rewritten"), ("z", "rotated")]


def test_streaming_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"ts": f"2024-01-01T00:0{m}:00", "k": "x"}) + "\n" for m in (0, 1, 5)))
    stream = spark.readStream.schema("ts timestamp, k string").json(str(tmp_path / "in"))
    query = cursors.windowed_counts(stream, "ts", "2 minutes", "0 seconds", ["k"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]


def test_registry(spark):
    from nestfold.functions import registry

    names = registry.register_all(spark)
    assert registry.failing_examples(spark) == []
    assert [r[0] for r in spark.sql("SELECT * FROM series(0, 7, 3)").collect()] == [0, 3, 6]
    assert spark.sql("SELECT geomean(x) AS g FROM VALUES (2D), (8D), (-1D) AS t(x)").first()["g"] == pytest.approx(4.0)
    for name in names:
        registry.unregister(spark, name)


def test_recursion_that_does_not_end_is_loud(spark):
    step = lambda level: level.select((F.col("n") + 1).alias("n"))
    with pytest.raises(sets.TooDeep):
        sets.recursive(spark.createDataFrame([(1,)], "n int"), step, levels=3)


def test_exact_decimals(spark):
    registry.register_all(spark)
    rows = [("0.1", "0.2"), ("1", "2.50"), ("123456789012345678", "1"), ("1.5", "1.5"), ("abc", "1"), (None, "1"), ("9" * 60, "0." + "0" * 30 + "1"), ("-0.10", "0.1")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = spark.sql("SELECT decimal_add(a, b) AS s, decimal_mul(a, b) AS m, decimal_cmp(a, b) AS c FROM {d}", d=df).collect()
    assert [r["s"] for r in got] == ["0.3", "3.5", "123456789012345679", "3", None, None, "9" * 60 + "." + "0" * 30 + "1", "0"]
    assert [r["m"] for r in got] == ["0.02", "2.5", "123456789012345678", "2.25", None, None, "9" * 29 + "." + "9" * 31, "-0.01"]
    assert [r["c"] for r in got] == [-1, -1, 1, 0, None, None, 1, -1]
    sums = spark.createDataFrame([("0.001",), ("0.002",), ("x",), (None,)], "x string").agg(aggregates.decimal_sum(F.col("x")).cast("string").alias("s")).first()["s"]
    assert sums.rstrip("0") == "0.003"


def test_edges_of_scalars(spark):
    df = spark.createDataFrame([(-(2**63), "abc\n", "añb")], "n long, s string, t string")
    r = df.select(scalar.neg(F.col("n")).alias("n"), scalar.regexp_like(F.col("s"), "abc").alias("l"), scalar.substr0(F.col("t"), 0, 2).alias("t")).first()
    assert r["n"] is None and r["l"] is False and r["t"] == "a�"


def test_exclude_by_subtraction_equals_collected_frames(spark):
    rng = random.Random(3)
    rows = [(k % 3, rng.randrange(6), k, rng.choice([None, 1.0, 2.0, 5.0])) for k in range(90)]
    df = spark.createDataFrame(rows, "p int, o int, u int, x double")
    for unit in ("rows", "groups"):
        for exclude in ("current_row", "group", "ties", "no_others"):
            for before, after in ((2, 1), (None, 0), (0, None)):
                out = windows.exclude_frame(df, ["p"], ["o"], before, after, exclude, "x", "u", "s", "sum", unit)
                out = windows.exclude_frame(out, ["p"], ["o"], before, after, exclude, "x", "u", "c", "count", unit)
                for r in out.collect():
                    part = sorted((q for q in rows if q[0] == r["p"]), key=lambda q: (q[1], q[2]))
                    at = next(k for k, q in enumerate(part) if q[2] == r["u"])
                    groups = sorted({q[1] for q in part})
                    g = groups.index(r["o"])
                    place = (lambda k, q: k - at) if unit == "rows" else (lambda k, q: groups.index(q[1]) - g)  # noqa: B023
                    frame = [q for k, q in enumerate(part) if (before is None or place(k, q) >= -before) and (after is None or place(k, q) <= after)]
                    gone = {"current_row": lambda q: q[2] == r["u"], "group": lambda q: q[1] == r["o"], "ties": lambda q: q[1] == r["o"] and q[2] != r["u"], "no_others": lambda q: False}[exclude]  # noqa: B023
                    xs = [q[3] for q in frame if not gone(q) and q[3] is not None]
                    assert (r["c"], r["s"]) == (len(xs), sum(xs) if xs else None)


def test_vectors_in_cells(spark):
    rows = [(k, [float(k % 7), float(k % 3)]) for k in range(60)] + [(90, None), (91, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    centres = [[0.0, 0.0], [6.0, 2.0]]
    cells = vectors.ivf_cells(df.filter("vec_id < 60"), centres)
    assert sum(r["n"] for r in vectors.ivf_census(cells).collect()) == 60
    near = [r["vec_id"] for r in vectors.ivf_probe(cells, centres, [6.0, 2.0], 3, 1).collect()]
    assert near == [r["vec_id"] for r in vectors.top_k(df, [6.0, 2.0], 3, "l2").collect()] == [20, 41, 5]


def lateral_twins(spark, folder, name):
    """Rows of a lateral query and of its SQL on ties and nulls, and the window that ranks."""
    spark.createDataFrame([(1,), (2,), (3,), (None,)], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    orders = [(10, 1, 5.0), (None, 1, 5.0), (9, 1, 5.0), (8, 1, None), (7, 1, 2.0), (6, 2, None), (5, 2, 1.0), (4, 2, 1.0), (None, 2, 1.0), (3, None, 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    rows = lambda found: sorted(map(tuple, found), key=str)
    return rows(df.collect()), rows(con.execute(queries.ORACLE[name]).fetchall()), df._jdf.queryExecution().optimizedPlan().toString()


def test_lateral_ranks_in_its_order(spark, tmp_path):
    got, want, plan = lateral_twins(spark, tmp_path, "join_lateral")
    assert got == want == [(1, 9), (2, 4)]
    assert "o_totalprice" in next(line for line in plan.splitlines() if "row_number()" in line)


def test_lateral_left_ranks_in_its_order(spark, tmp_path):
    got, want, plan = lateral_twins(spark, tmp_path, "join_lateral_left")
    assert got == want == [(1, 7), (2, 4), (3, None), (None, None)]
    assert "o_totalprice" in next(line for line in plan.splitlines() if "row_number()" in line)


@pytest.mark.parametrize("by", [None, [("g", "h")]])
def test_range_join_cuts_what_a_bin_holds(spark, monkeypatch, by):
    monkeypatch.setattr(joins, "RANGE_BLOCK", (100, 50), raising=False)
    monkeypatch.setattr(joins, "RANGE_PAIRS", 10_000, raising=False)
    points = [(i, i % 3, 5.0 if i % 4 else i / 10) for i in range(1000)] + [(1000, 0, None), (1001, None, 5.0), (5, 2, 5.0), (5, 2, 5.0)]
    spans = [(i, i % 2, float(i % 5), i % 5 + 3.0) for i in range(400)] + [(400, 0, -50.0, 120.0), (401, 0, None, 9.0), (402, 0, 9.0, 1.0), (403, None, 0.0, 9.0), (7, 1, 5.0, 5.0), (7, 1, 5.0, 5.0)]
    left, right = spark.createDataFrame(points, "id long, g long, at double"), spark.createDataFrame(spans, "span long, h long, low double, top double")
    got = joins.range_join(left, right, "at", "low", "top", 50.0, by).withColumn("task", F.spark_partition_id())
    assert got.columns == [*left.columns, *right.columns, "task"]
    rows = got.collect()
    want = [(i, s) for i, g, at in points for s, h, low, top in spans if None not in (at, low) and low <= at <= top and (not by or (g is not None and g == h))]
    assert sorted((r["id"], r["span"]) for r in rows) == sorted(want)
    tasks = [r["task"] for r in rows]
    assert len(set(tasks)) >= 8 and max(map(tasks.count, set(tasks))) < len(rows) / 2


def test_search_index_counts_in_rows(spark, tmp_path):
    texts = [(1, "The nter the"), (2, "the x"), (1, "nter y y"), (3, ""), (4, None), (5, " ... "), (6, "nter, THE"), (7, "z")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    index = search.inverted_index(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text")
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    got = queries.QUERIES["search_bm25"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLE["search_bm25"]).fetchall())
    assert len(got) == 2
