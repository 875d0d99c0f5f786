import importlib
import json
import subprocess
import sys
from pathlib import Path

from pathloom.functions import catalog, tables
from pathloom.functions.scalars import signature_of
from pathloom.operators import paths
from pathloom.operators.graph_store import GraphStore
from pathloom.cli import main
from pathloom.plans.review import ReviewInputs, run_review
from pathloom.sources.extract import extract_graph
from pathloom.streaming import ingress

ROOT = Path(__file__).resolve().parents[1]
CODE = "int work(char **argv) {\n  char d[8];\n  strcpy(d, argv[1]);\n  char *p = getenv(x);\n  system(p);\n}\n"


def test_review(spark):
    files = spark.createDataFrame([("src/a.c", CODE), ("src/b.c", "int ok(int a) { return 1; }\n")], "file_path string, text string")
    nodes, edges = extract_graph(files, "r")
    changed = spark.createDataFrame([("src/a.c", 0), ("src/b.c", 1)], "file_path string, ord long")
    scans = spark.createDataFrame([("src/b.c", "x", "CRITICAL", 1, "this may well be a bug in the system call at line 1"), ("src/b.c", "y", "ADVISORY", 2, "short")], "file_path string, rule_id string, severity string, line_number int, explanation string")
    given = ReviewInputs(nodes, edges, files, changed, scan_findings=scans, suppressions=catalog.parse_suppressions(spark.createDataFrame([("src/a.c:0:ruby_command_injection",)], "value string")))
    out = run_review(spark, given)
    found = {(r.src_func, r.snk_func, r.rule_id): (r.status, r.confidence) for r in out["findings"].collect()}
    assert found["argv", "strcpy", "no_strcpy_strcat"] == ("PROVEN", 0.95) and not any(k[1] == "system" for k in found)
    assert found["DeepScan", "DeepScan", ""] == ("LIKELY", 0.9)
    card = out["card"].first()
    assert card.risk == "HIGH" and card.exit_code == 1
    assert {r.file_path: r.label for r in out["files"].collect()} == {"src/a.c": "issue", "src/b.c": "note"}
    assert out["unreported"].count() == 0 and out["results"].where("level = 'error'").count() >= 1
    assert out["errors"].collect() == [] and [r.line for r in out["report"].orderBy("ord", "file", "line_no").collect()][:2] == ["| Risk level | HIGH |", f"| Verified bugs | {card.n_verified} |"]
    searched = run_review(spark, ReviewInputs(nodes, edges, files, changed.where("file_path = 'src/b.c'"), scoped=True, unanswered=files.select("file_path")))
    got = {(r.snk_file, r.status, r.confidence) for r in searched["findings"].collect()}
    assert got == {("src/a.c", "LIKELY", 0.72)}
    broken = run_review(spark, ReviewInputs(nodes, spark.createDataFrame([("a", "b")], "src string, dst string"), files, changed))
    assert [r.step for r in broken["errors"].collect()] == ["paths"] and broken["findings"].count() == 0
    scoped = run_review(spark, ReviewInputs(nodes, edges, files, changed.where("file_path = 'src/b.c'"), scoped=True))
    assert scoped["findings"].count() == 0 and scoped["card"].first().risk == "LOW"


def event(body, secret="k", name="issue_comment", action="created"):
    text = json.dumps({"action": action, "comment": {"body": body}})
    return {"event": name, "signature": signature_of(secret, text.encode()), "body": text}


def test_command_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = [event("hey @bot Explain CWE-121 now"), event("x @bot-x help"), event("@bot help"), event("y @bot dance"), event("z @bot help", secret="wrong"), event("x @bot help", name="push"), event("x @bot help", action="edited")]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, events)))
    seen = []
    q = ingress.commands(ingress.read_events(spark, f"file://{tmp_path}/in"), "bot", "k").writeStream.foreachBatch(lambda df, i: seen.extend((r.cmd, r.args, r.known) for r in df.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(seen) == [("dance", "", False), ("explain", "CWE-121 now", True), ("help", "", True)]


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda n, rows: (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "file_path", "text"), r))) for r in rows))
    stream = lambda: ingress.watch_files(spark, spark.readStream.schema("seq long, file_path string, text string").json(f"file://{tmp_path}/in"), f"file://{tmp_path}/g", "r", f"file://{tmp_path}/cp")

    def drain():
        q = stream()
        q.processAllAvailable()
        q.stop()

    write(1, [(1, "a.c", CODE), (2, "b.c", "int f(int a) { free(a); }")])
    drain()
    store = GraphStore(spark, f"file://{tmp_path}/g")
    assert {r.function_name for r in store.load()[0].where("node_type = 'AST_FUNC'").collect()} == {"work", "f"}
    write(2, [(3, "b.c", "int g(int a) { free(a); }"), (4, "a.c", "x"), (5, "a.c", None)])
    drain()
    assert {r.function_name for r in store.load()[0].where("node_type = 'AST_FUNC'").collect()} == {"g"}


def test_entry(spark):
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 70
    assert e.entry(spark).count() > 0


def test_works_without_llm(tmp_path):
    """The library and the entry import without the training-data subpackage, and nothing else imports it."""
    for path in [*ROOT.glob("pathloom/**/*.py")]:
        if "llm" not in path.parts:
            assert "pathloom.llm" not in path.read_text()
    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith(('pathloom.llm', 'corpus_pipeline')) else f(n, *a)\nimport __spark_entry__ as e\nprint(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, has = done.stdout.split()
    assert int(n) > 60 and has == "False"
    assert importlib.util.find_spec("pathloom")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.c").write_text(CODE)
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "r.yaml").write_text("rules:\n  - id: mine\n    severity: CRITICAL\n    pattern: 'call:strcpy'\n")
    code = main([f"{tmp_path}/src", "--rules", f"{tmp_path}/rules", "--sarif", f"{tmp_path}/out.sarif", "--out", f"{tmp_path}/out"], spark)
    assert code == 1 and "| Risk level | HIGH |" in capsys.readouterr().out
    assert '"ruleId": "mine"' in (tmp_path / "out.sarif").read_text() and spark.read.json(f"{tmp_path}/out/findings").count() > 0


def test_many_short_texts_are_extracted_in_several_tasks(spark, tmp_path):
    spark.range(1000).selectExpr("concat('f', id, '.c') file_path", "'int f(int a) {\\n  free(p);\\n}' text").coalesce(1).write.parquet(f"{tmp_path}/files")
    nodes, _ = extract_graph(spark.read.parquet(f"{tmp_path}/files"), "r")
    assert nodes.count() == 2000
    assert len({f.rsplit("/", 1)[1] for f in nodes.inputFiles()}) > 1


def test_a_graph_of_repeated_texts_is_not_sent_whole(spark, tmp_path, monkeypatch):
    """Its files are small for their rows, so that Spark takes it for a small table."""
    text = "int f(int a) {\\n  fgets(p, 9, s);\\n  free(p);\\n}"
    spark.range(500).selectExpr("concat('f', id, '.c') file_path", f"'{text}' text", "concat('f', id) scope").write.parquet(f"{tmp_path}/files")
    monkeypatch.setattr(tables, "SENT", 1000)
    files = spark.read.parquet(f"{tmp_path}/files")
    nodes, edges = extract_graph(files, "r")
    reached = spark.createDataFrame([("x",)], "dst string").join(nodes.selectExpr("node_id dst", "code"), "dst", "left")
    for df in (edges, paths.virtual_hubs(nodes, edges, "scope").enter, reached, nodes.select("file_path").join(tables.unsent(nodes.distinct()), "file_path")):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    assert nodes.count() == 1500 and edges.count() == 1000
