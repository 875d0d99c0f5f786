import json

import pytest
from pathloom.functions import catalog, scalars
from pathloom.sources import extract, repo, scanners
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def values(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


@pytest.mark.parametrize("ext,name", [(".cpp", "cpp"), (".h", "cpp"), (".py", "python"), (".js", "js"), (".tsx", "js"), (".go", "go"), (".java", "java"), (".rb", "ruby"), (".rs", "rust"), (".php", "generic"), (".xyz", "cpp"), ("", "cpp")])
def test_dispatch(spark, ext, name):
    assert one(spark, scanners.backend_for(F.lit("src/file" + ext))) == name


def test_diagnostics(spark):
    lines = values(
        spark, "/r/a.cpp:12:3: warning: Use of memory: use-after-free [clang-analyzer-x]", "b.cpp:1:1: error: call to strcpy [security.insecureAPI.strcpy]", "b.cpp:2:1: note: buffer overflow [x]",
        "b.cpp:3:1: warning: style [readability]", "b.cpp:4:1: warning: Potential leak [cplusplus.NewDeleteLeaks]", "b.cpp:5:1: warning: Buffer OverRun [y]", "junk",
    )
    assert [tuple(r)[:3] for r in scanners.diagnostics(lines, "/r").collect()] == [("a.cpp", "free", 12), ("b.cpp", "strcpy", 1), ("b.cpp", "free", 4), ("b.cpp", "memcpy", 5)]


def test_json_scanners(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "l1\nl2\nl3")], "file_path string, text string")
    sem = {"results": [{"check_id": "x.y.eval-use", "path": "/r/a.py", "start": {"line": 2}, "end": {"line": 3}}]}
    assert [tuple(r) for r in scanners.semgrep(values(spark, json.dumps(sem), "not json", "{}"), files, "/r").collect()] == [("a.py", "eval-use", 2, 3, "CALL_SINK", "l2\nl3")]
    bandit = {"results": [{"filename": "a.py", "test_id": "B102", "line_number": 4, "code": "  exec(x)\n"}]}
    assert tuple(scanners.bandit(values(spark, json.dumps(bandit))).first())[1:] == ("B102", 4, 4, "CALL_SINK", "exec(x)")
    gosec = {"Issues": [{"file": "a.go", "line": "12-15", "rule_id": "G201", "code": "c"}, {"file": "a.go", "line": "?", "rule_id": "G1", "code": "c"}]}
    assert [r.line_start for r in scanners.gosec(values(spark, json.dumps(gosec))).collect()] == [12, 0]
    brakeman = {"warnings": [{"warning_type": "SQL Injection", "file": "a.rb", "line": None, "code": "c"}]}
    assert tuple(scanners.brakeman(values(spark, json.dumps(brakeman))).first())[:3] == ("a.rb", "sql_injection", 0)
    eslint = [{"filePath": "/r/a.js", "messages": [{"ruleId": "security/x/y", "severity": 2, "line": 3, "message": "m"}, {"ruleId": "z", "severity": 1, "line": 1}]}]
    assert [tuple(r)[:4] for r in scanners.eslint(values(spark, json.dumps(eslint)), "/r").collect()] == [("a.js", "security_x_y", 3, 3)]
    audit = {"vulnerabilities": {"list": [{"advisory": {"id": "RUSTSEC-1", "title": "t"}}]}}
    assert tuple(scanners.rust_audit(values(spark, json.dumps(audit))).first())[:3] == ("Cargo.toml", "dep_RUSTSEC-1", 1)
    rust = spark.createDataFrame([("a.rs", "fn x() {\n unsafe {\n}\nunsafe fn")], "file_path string, text string")
    assert [r.line_start for r in scanners.lines_with(rust, ["unsafe", "{"], "unsafe_block").collect()] == [2]
    (tmp_path / "bugs.xml").write_text('<B><BugInstance type="SQL"><LongMessage>m</LongMessage><SourceLine sourcepath="a.java" start="5" end="6"/></BugInstance><BugInstance type="X"><LongMessage>n</LongMessage></BugInstance></B>')
    bugs = spark.read.format("xml").option("rowTag", "BugInstance").load(f"file://{tmp_path}/bugs.xml")
    assert [tuple(r) for r in scanners.spotbugs(bugs).collect()] == [("a.java", "SQL", 5, 6, "CALL_SINK", "m")]
    a, b = scanners.bandit(values(spark, json.dumps(bandit))), scanners.bandit(values(spark, json.dumps(bandit))).withColumn("code", F.lit("second"))
    assert [r.code for r in scanners.union_first([a, b], ["file_path", "line_start", "function_name"], ["code"]).collect()] == ["exec(x)"]
    assert scanners.first_available([a.limit(0), b, a]).first().code == "second"


CODE = """int helper(char *p) {
  if (p) { free(p); }
  return 0;
}
void main_loop(int argc, char **argv) {
  char *x = getData(argv[1]);
  helper(x);
  memcpy(a, x, 3);
"""


def test_extraction(spark):
    nodes, edges = extract.extract_graph(spark.createDataFrame([("src/a.c", CODE), ("b.c", None), ("c.c", "")], "file_path string, text string"), "repo")
    rows = nodes.collect()
    functions = {r.function_name: r for r in rows if r.node_type == "AST_FUNC"}
    assert (functions["helper"].line_start, functions["helper"].line_end, functions["main_loop"].line_start) == (1, 4, 5)
    assert functions["main_loop"].line_end == 9 and functions["helper"].file_path == "src/a.c"  # unbalanced: to the end
    kinds = {(r.function_name, r.node_type, r.line_start) for r in rows}
    assert {("free", "CALL_SINK", 2), ("if", "CALL", 2), ("argv", "CALL_SOURCE", 6), ("getData", "CALL_SOURCE", 6), ("helper", "CALL", 7), ("memcpy", "CALL_SINK", 8)} <= kinds
    ids = {r.node_id: r for r in rows}
    assert len(ids) == len(rows)
    named = {(ids[e.src].function_name, ids[e.dst].function_name) for e in edges.collect()}
    assert {("argv", "main_loop"), ("getData", "main_loop"), ("main_loop", "memcpy"), ("main_loop", "helper"), ("helper", "helper"), ("helper", "free")} <= named
    again = extract.extract_graph(spark.createDataFrame([("src/a.c", CODE)], "file_path string, text string"), "repo")[0]
    assert {r.node_id for r in again.collect()} == set(ids)


def test_repository(spark, tmp_path):
    for name, text in (("a.cpp", "x"), ("sub/b.py", "é"), ("sub/c.txt", "no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = repo.scan_files(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, files.collect())) == [("a.cpp", "x"), ("sub/b.py", "é")]
    listed = lambda *a: [r.file_path for r in repo.changed_files(spark, *a, files).orderBy("ord").collect()]
    assert listed(" b.c, ,a.c", ["z"]) == ["b.c", "a.c"] and listed("", ["z", "y"]) == ["z", "y"] and sorted(listed(None, None)) == ["a.cpp", "sub/b.py"]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"node_id": "1", "file_path": "a", "line_start": -1}], "edges": [{"src": "1", "dst": "2", "type": "CFG"}]}))
    nodes, edges = repo.read_graph(spark, f"file://{tmp_path}/g.json")
    assert nodes.first().line_start == 0 and tuple(edges.first()) == ("1", "2", "CFG")
    (tmp_path / "s.txt").write_text("# x\na.c:3:r\n")
    assert [tuple(r) for r in repo.read_suppressions(spark, f"file://{tmp_path}/s.txt").collect()] == [("a.c", 3, "r")]
    assert repo.build_system(spark.createDataFrame([("x",)], "file_path string")).first()[0] == "unknown"


def test_catalog_files():
    rules = catalog.load_rules(["rules:\n - {id: a, severity: CRITICAL, pattern: 'call:x|type:y'}\n - {severity: x}", ": bad: [", "rules:\n - {id: b, pattern: z, applies_to: ['**/*.c']}"])
    assert [(r.id, r.severity, r.keywords, r.globs) for r in rules] == [("a", "CRITICAL", [("call", "x"), ("type", "y")], ("**/*",)), ("b", "ADVISORY", [("", "z")], ("**/*.c",))]
    assert catalog.load_safe_names("global: [a, b]\nx: [b, c]\ny: 3") == ["a", "b", "c"]


def test_scalars(spark):
    assert one(spark, scalars.fenced(F.lit("x ```diff\n- a\n+ b\n``` y ```diff\nz```"), "diff")) == "- a\n+ b"
    assert tuple(one(spark, scalars.place_of(F.lit("File: a.c \nStart Line: 3\nEnd Line: 9")))) == ("a.c", 3, 9)
    assert one(spark, scalars.ticket_ids(F.lit("AB-1, X2Y-33 ab-4 A-5"))) == ["AB-1", "X2Y-33"]
    assert not one(spark, scalars.may_have_surface(F.lit("#include <a>"))) and one(spark, scalars.may_have_surface(F.lit("#include <a>\n#include <b>"))) and not one(spark, scalars.may_have_surface(F.lit("a::b" + "\x01" * 3)))
    same = spark.createDataFrame([(None, None, "/p"), (None, None, "/p"), (None, None, "/q"), ("u", "x", "/p")], "a string, b string, c string").select(scalars.repo_id(F.col("a"), F.col("b"), F.col("c")))
    ids = [r[0] for r in same.collect()]
    assert ids[0] == ids[1] != ids[2] and all(len(i) == 16 for i in ids)


def test_requests(spark):
    from pathloom.operators import requests

    files = spark.createDataFrame([(f"f{i}.cpp", i, "#include x\n#include y\n" + "z" * 5000) for i in range(12)] + [("big.cpp", 12, "a::b" * 9000)], "file_path string, ord long, text string")
    got = requests.surface_requests(files).collect()
    assert len(got) == 1 or all(len(r.text) == 4000 and r.language == "c++" for r in got) and len(got) == 5
    known = files.limit(1).select(F.sha2("text", 256).alias("content_hash"))
    assert requests.surface_requests(files, known).count() == 0  # all hold the same text
    intent = requests.intent_request(files, "r" * 3000).first()
    assert intent.files[:2] == ["f0.cpp", "f1.cpp"] and len(intent.readme) == 2000
    assert {len(r.text) for r in requests.scan_requests(files, files.where("ord > 10")).collect()} == {5022, 12_000}
    assert requests.remark_requests(files, files).count() == 13
    answers = spark.createDataFrame([("a", i, i, "c", "d", "e") for i in range(9)], "file_path string, ord int, line int, category string, comment string, suggestion string")
    assert [r.line for r in requests.remarks(answers).collect()] == [0, 1, 2, 3, 4]
    assert [one(spark, requests.language(F.lit(f))) for f in ("a.tsx", "b.h")] == ["typescript", "c++"]


def test_workers_find_the_package(spark):
    from pathlib import Path

    from pathloom.functions.tables import ship

    ship(spark)
    ship(spark)
    assert spark.sparkContext.environment["PYTHONPATH"].split(":").count(str(Path(__file__).resolve().parents[1])) == 1


def test_many_cases_are_cut_without_holding_them(spark, monkeypatch):
    monkeypatch.setattr(repo, "FEW", 3)
    rows = [(None if k == 5 else 100 - k, "C", k % 2, f"b{k}", f"a{k}") for k in range(40)]
    made = spark.createDataFrame(rows, "index long, lang string, vul int, func_before string, func_after string").union(spark.createDataFrame([(1, "X", 1, "", "")], "index long, lang string, vul int, func_before string, func_after string"))
    for most in (4, 15, 20, 50):
        first = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])[: 2 * most]
        part = lambda v: [r for r in first if r[2] == v][:most]  # noqa: E731, B023
        want = [("1" if r[0] is None else f"{r[0]}-1", r[3], True) for r in part(1)] + [(f"{r[0]}-0", r[4], False) for r in part(0)]
        got = repo.pair_corpus(made, "C", most)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert "GlobalLimit" not in got._jdf.queryExecution().optimizedPlan().toString() or most in (4, 15)
    assert "Sort" not in repo.first_rows(made, "index", 10)._jdf.queryExecution().optimizedPlan().toString()


def test_csv_corpus_has_every_case(spark, sf, monkeypatch):
    from pathloom.plans.queries import QUERIES

    real, asked = repo.pair_corpus, []
    monkeypatch.setattr(repo, "pair_corpus", lambda rows, lang, most, *a: asked.append(most) or real(rows, lang, most, *a))
    got = QUERIES["csv_corpus"](spark, sf)
    assert asked == [None] and got.count() == spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan
    made = spark.createDataFrame([(k, "C", k % 2, f"b{k}", f"a{k}") for k in range(9)] + [(9, "X", 1, "", "")], "index long, lang string, vul int, func_before string, func_after string")
    assert sorted(map(tuple, real(made, "C", None).collect())) == [(f"{k}-{k % 2}", f"{'ab'[k % 2]}{k}", k % 2 == 1) for k in range(9)]
