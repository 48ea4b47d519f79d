import pytest
from pyspark.sql import functions as F

from quillforge.functions import script as J
from quillforge.sources import assets as A
from quillforge.streaming import arrivals

RESX = "<?xml version='1.0'?><root><!-- <data name='Sample'><value>no</value></data> --><data name='A'><value>x</value></data><data name='B'></data><data name=' '><value>y</value></data></root>"


def test_scan(spark, tmp_path):
    (tmp_path / "b.css").write_bytes(b"\xef\xbb\xbfa{}")
    (tmp_path / "A.css").write_text("b{}")
    (tmp_path / "c.js").write_text("x")
    specs = [A.Spec(str(tmp_path / "c.js")), A.Spec(" "), A.Spec(str(tmp_path), "*.css"), A.Spec(str(tmp_path / "none"), optional=True)]
    rows = A.scan(spark, specs).withColumn("text", A.decoded(F.col("content"))).orderBy("spec", F.lower("path")).collect()
    assert [(r.spec, r.path[-5:], r.text) for r in rows] == [(0, "/c.js", "x"), (2, "A.css", "b{}"), (2, "b.css", "a{}")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        A.scan(spark, [A.Spec(str(tmp_path / "none"))])


def test_resources(spark, tmp_path):
    (tmp_path / "a.resx").write_text(RESX)
    assert {(r.name, r.value) for r in A.read_resources(spark, str(tmp_path / "a.resx")).collect()} == {("A", "x"), ("B", "")}
    (tmp_path / "d.resx").write_text("<root><data name='A'><value>x</value></data><data name='a'><value>y</value></data></root>")
    with pytest.raises(Exception, match="twice"):
        A.read_resources(spark, str(tmp_path / "d.resx")).collect()
    A.write_resources(spark.createDataFrame([("k", "v")], "name string, value string"), str(tmp_path / "out"))
    assert [(r.name, r.value) for r in A.read_resources(spark, str(tmp_path / "out")).collect()] == [("k", "v")]


def test_rename_log(spark, tmp_path):
    rows = spark.createDataFrame([("x.css", "b"), ("x.css", "a"), ("y.css", "c")], "output string, input string")
    A.write_rename_log(rows, str(tmp_path / "log"))
    got = sorted((r.output, r.inputs) for r in A.read_rename_log(spark, str(tmp_path / "log")).collect())
    assert got == [("/x.css", ["/a", "/b"]), ("/y.css", ["/c"])]
    assert A.read_rename_log(spark, str(tmp_path / "none")).count() == 0


def test_file_sets(spark, tmp_path):
    (tmp_path / "c.xml").write_text("<W><CssFileSet configSource='s.xml' output='o.css'><Inputs><Input>a.css</Input><Input searchPattern='*.css' optional='true'>d</Input></Inputs></CssFileSet></W>")
    row = A.read_file_sets(spark, str(tmp_path / "c.xml")).first()
    assert (row.output, row.config_source, [(i.path, i.search_pattern, i.optional) for i in row.inputs]) == ("o.css", "s.xml", [("a.css", None, False), ("d", "*.css", True)])


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "text string")
    A.store(rows, str(tmp_path / "s"), "css", "text")
    A.store(rows, str(tmp_path / "s"), "css", "text")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_script(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(J.short_name(F.lit(n))) for n in (-1, 0, 20, 21, 461, 462)] == ["", "n", "g", "nt", "gn", "ntt"]
    assert [one(J.vlq(F.lit(n))) for n in (0, 1, -1, 15, 16, -16, 1000)] == ["A", "C", "D", "e", "gB", "hB", "w+B"]
    assert [one(J.json_text(F.lit(s))) for s in ('{ "a b" : [1, 2] }', "{")] == ['{"a b":[1,2]}', None]
    assert [one(J.quoted(F.lit(s))) for s in ("a'b", 'a"b', "\n\\")] == ["\"a'b\"", "'a\"b'", '"\\n\\\\"']
    for op, a, b, want in [("<<", 1, 33, 2), (">>>", -1, 28, 15), (">>", -8, 1, -4), ("|", 4294967297.0, 2, 3), ("/", 1, 0, None), ("%", -5, 3, -2), ("-", 1.5, 1, 0.5)]:
        assert one(J.fold(op, F.lit(a), F.lit(b))) == want


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = arrivals.assets(spark, str(tmp_path / "in"), "text string, ts timestamp")
    for name, out, mode in (("fresh", arrivals.fresh(stream, "text", "ts"), "append"), ("arrived", arrivals.counts(stream, "ts", ["text"]), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
        q.stop()
    assert sorted(r.text for r in spark.table("fresh").collect()) == ["a", "b"]
    assert sorted((r.text, r.n) for r in spark.table("arrived").collect()) == [("a", 2), ("b", 1)]
