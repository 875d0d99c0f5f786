import os
import sqlite3
import time

from pathloom.sources import backend, repo
from pathloom.sources.backend import _Reader, _StreamReader
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith, StringStartsWith

CODE = "int f(int a) {\n  free(p);\n}\n"


def folder(tmp_path, names):
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(CODE)
    return f"file://{tmp_path}"


def test_filters_choose_files(spark, tmp_path):
    root = folder(tmp_path, ["src/a.c", "src/b.c", "lib/c.c", "lib/d.py", "x.h"])
    paths = lambda reader: sorted(p for part in reader.partitions() for p in part.paths)
    reader = _Reader({"root": root})
    assert paths(reader) == ["lib/c.c", "src/a.c", "src/b.c", "x.h"]
    other = GreaterThan(("line_start",), 1)
    assert list(reader.pushFilters([StringStartsWith(("file_path",), "src/"), other])) == [other] and paths(reader) == ["src/a.c", "src/b.c"]
    for f, want in ((EqualTo(("file_path",), "x.h"), ["x.h"]), (In(("file_path",), ("x.h", "lib/c.c")), ["lib/c.c", "x.h"]), (StringEndsWith(("file_path",), "b.c"), ["src/b.c"])):
        reader = _Reader({"root": root, "files": "1"})
        assert list(reader.pushFilters([f])) == [] and paths(reader) == want and len(reader.partitions()) == len(want)
    backend.register(spark)
    found = spark.read.format("pathloom_backend").option("root", root).load()
    assert found.count() == 8 and "ERROR" not in {r.node_type for r in found.collect()}
    # A file that only an unread one would fail on: the filter reaches the source.
    os.chmod(tmp_path / "x.h", 0)
    kept = found.where("file_path LIKE 'src/%' AND line_start = 2")
    assert sorted(tuple(r)[:2] for r in kept.collect()) == [("src/a.c", "free"), ("src/b.c", "free")]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith(file_path" not in plan and "line_start" in plan  # the source did the one, Spark does the other


def test_a_stream_gives_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    root = folder(tmp_path / "in", ["a.c", "b.c"])
    reader = _StreamReader({"root": root})
    first = reader.latestOffset()
    assert [p.paths for p in reader.partitions(reader.initialOffset(), first)] == [["a.c", "b.c"]]
    assert [p.paths for p in reader.partitions(first, first)] == [[]]
    backend.register(spark)
    seen = []

    def drain():
        stream = spark.readStream.format("pathloom_backend").option("root", root).load()
        q = stream.writeStream.foreachBatch(lambda df, _: seen.append(sorted({r.file_path for r in df.collect()}))).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    drain()
    time.sleep(0.05)
    folder(tmp_path / "in", ["sub/c.c", "a.c"])  # a new one and a changed one
    drain()
    assert [s for s in seen if s] == [["a.c", "b.c"], ["a.c", "sub/c.c"]]


def test_sqlite_in_ranges(spark, tmp_path):
    with sqlite3.connect(tmp_path / "some.db") as db:
        db.execute("CREATE TABLE file_change (file_change_id, code_before, code_after, programming_language)")
        db.execute("CREATE TABLE none (file_change_id, code_before, code_after, programming_language)")
        db.executemany("INSERT INTO file_change VALUES (?, ?, ?, ?)", [(i, f"b{i}", None if i % 3 == 0 else f"a{i}", "C") for i in range(1000)])
        db.execute("DELETE FROM file_change WHERE file_change_id BETWEEN 100 AND 700")
    at = f"file://{tmp_path}/some.db"
    got = repo.read_changes(spark, at, rows_per_task=64)
    assert sorted(map(tuple, got.collect())) == sorted((str(i), f"b{i}", None if i % 3 == 0 else f"a{i}", "C") for i in range(1000) if not 100 <= i <= 700)
    assert got.rdd.getNumPartitions() > 4 and repo.read_changes(spark, at, table="none").collect() == []


def test_sarif_document_is_whole_or_as_it_was(spark, tmp_path):
    import json

    import pytest
    from pathloom.sources.sarif_sink import write_sarif
    from pyspark.sql import functions as F

    at = f"file://{tmp_path}/out.sarif"
    rows = lambda n: spark.range(n).repartition(4).select(F.to_json(F.struct(F.col("id").alias("ruleId"))).alias("result"))
    read = lambda: sorted(r["ruleId"] for r in json.loads((tmp_path / "out.sarif").read_text())["runs"][0]["results"])
    write_sarif(rows(0), at)
    assert read() == []
    write_sarif(rows(500), at, batch=7, tool="t")
    assert read() == list(range(500)) and '"name": "t"' in (tmp_path / "out.sarif").read_text()
    write_sarif(rows(3), at, batch=7)
    assert read() == list(range(500))
    # A job that fails leaves the document and no parts.
    broken = rows(500).select(F.when(F.col("result").contains("499"), F.raise_error(F.lit("lost"))).otherwise(F.col("result")).alias("result"))
    with pytest.raises(Exception):
        write_sarif(broken, at, batch=8)
    assert read() == list(range(500)) and sorted(p.name for p in tmp_path.iterdir()) == ["out.sarif", "out.sarif.batch"]
    write_sarif(rows(2), at, batch=8)
    assert read() == [0, 1]


def test_a_failed_load_leaves_the_graph(spark, tmp_path):
    import pytest
    from pathloom.operators.graph_store import GraphStore
    from pyspark.sql import functions as F

    store = GraphStore(spark, f"file://{tmp_path}/graph", buckets=4)
    edges = spark.createDataFrame([], "src string, dst string, type string")
    nodes = spark.range(20).select(F.col("id").cast("string").alias("node_id"), F.lit("f").alias("file_path"), F.lit("n").alias("function_name"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("CALL").alias("node_type"), F.lit("x").alias("code"))
    store.ingest(nodes, edges, "r", "1")
    bad = nodes.withColumn("code", F.when(F.col("node_id") == "7", F.raise_error(F.lit("lost"))).otherwise("y"))
    with pytest.raises(Exception):
        store.ingest(bad, edges, "r", "2", spark.createDataFrame([("f",)], "file_path string"))
    assert store.version() == 1 and {r.code for r in store.load()[0].collect()} == {"x"}


def test_folders_that_a_filter_rules_out_are_not_opened(tmp_path, monkeypatch):
    from pathloom.sources import backend as b
    from pyarrow import fs

    for k in range(30):
        (tmp_path / f"k={k}").mkdir()
        (tmp_path / f"k={k}" / "x.c").write_text("int f() {\n}\n")
    reader = b._Reader({"root": str(tmp_path)})
    assert list(reader.pushFilters([b.StringStartsWith(("file_path",), "k=1")])) == []
    opened, plain = [], fs.FileSelector
    monkeypatch.setattr(fs, "FileSelector", lambda at, **o: opened.append(at) or plain(at, **o))
    assert [p for _, p in reader.listed()] == sorted(f"k={k}/x.c" for k in range(30) if str(k).startswith("1"))
    assert len(opened) == 1 + 11
    reader.prefixes, reader.tests = [], []
    assert len(reader.listed()) == 30
