import hashlib
import json

import pytest
from pathloom.functions import catalog
from pathloom.operators import constraints, export, filters, metrics, states
from pyspark.sql import functions as F

NODE = "struct<node_id string, file_path string, function_name string, line_number int>"
FINDING = f"vuln_id string, src_id string, snk_id string, src_func string, snk_func string, src_file string, snk_file string, src_line int, snk_line int, rule_id string, status string, confidence double, formula string, summary string, requires_msan boolean, crosses_files boolean, intermediate_nodes array<{NODE}>"


def finding(i="1", src="argv", snk="memcpy", status="PROVEN", confidence=0.95, mid=(), **other):
    row = dict(vuln_id=i, src_id=f"s{i}", snk_id=f"k{i}", src_func=src, snk_func=snk, src_file="a.cpp", snk_file="src/main.cpp", src_line=1, snk_line=10, rule_id="r", status=status, confidence=confidence, formula="f", summary="s", requires_msan=False, crosses_files=False)
    row["intermediate_nodes"] = [("m", "m.cpp", n, 1) for n in mid]
    return row | other


def frame(spark, *rows):
    names = [f.split()[0] for f in FINDING.split(", ")[:16]] + ["intermediate_nodes"]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FINDING)


@pytest.mark.parametrize(
    "sink,code,sat,parts",
    [
        ("memcpy", "char dest[64]; memcpy(dest, src, 1024);", True, ["input_len > dest_size", "input_len == 1024", "dest_size == 64"]),
        ("memcpy", "memcpy(buf, src, 1024)", True, ["input_len == 1024"]),
        ("memcpy", "memcpy(d[64], s, 64)", False, []),
        ("memcpy", "memcpy(d[0], s, 8)", False, []),
        ("memmove", "x", True, ["input_len > dest_size"]),
        ("strcpy", "strcpy(buf[64], input)", True, ["dest_size"]),
        ("free", "free(ptr)", True, ["free_program_point", "access_program_point"]),
        ("free", "free(p) Line 0", False, []),
        ("system", "system(x)", True, ["has_metachar"]),
        ("malloc", "malloc(4)", True, ["is_initialized"]),
        ("calloc", "calloc(a, b)", True, ["count"]),
        ("whatever", None, True, ["whatever_is_reachable"]),
    ],
)
def test_constraints(spark, sink, code, sat, parts):
    r = constraints.evaluate(F.lit(sink), F.lit(code).cast("string"))
    row = spark.range(1).select(r.alias("r"), constraints.outcome(r).alias("o")).first()
    assert row.r.sat is sat and all(p in row.o.formula for p in parts)
    assert (row.o.status, row.o.confidence) == (("PROVEN", 0.95) if sat else ("WARNING", 0.20))
    assert sat or row.o.formula == ""


def test_findings_of_paths(spark):
    path = dict(path_id="p", snk_id="n1", snk_func="memcpy", src_func="read", src_file="a", snk_file="b", crosses_files=True, rule_id="r", rule_severity="CRITICAL")
    rows = [path, path | dict(path_id="q", snk_id="absent"), path | dict(path_id="a", rule_severity="ADVISORY"), path | dict(path_id="m", snk_id="n2", snk_func="malloc")]
    code = spark.createDataFrame([("n1", "memcpy(d[8], s, 9)"), ("n2", "malloc(1)")], "node_id string, code string")
    got = {r.path_id: r for r in constraints.to_findings(spark.createDataFrame(rows), code).collect()}
    assert (got["p"].status, got["p"].summary) == ("PROVEN", "[PROVEN] cross-file memcpy reachable from read (a → b) | witness: dest_size=8, input_len=9")
    assert (got["q"].status, got["q"].confidence) == ("LIKELY", 0.72) and (got["a"].status, got["a"].confidence) == ("ADVISORY", 0.5) and got["m"].requires_msan and not got["p"].requires_msan


def test_cache(spark):
    schema = "key string, status string, formula string, reachability_only boolean, witness array<struct<variable string>>"
    computed = spark.createDataFrame([("a", "WARNING", "", False, [("x",)]), ("b", "PROVEN", "f", False, [("x",)]), ("b", "PROVEN", "f", False, [("x",)]), ("c", None, None, None, [])], schema)
    merged, new = constraints.with_cache(computed, spark.createDataFrame([("a", "PROVEN", "g", True)], "key string, status string, formula string, reachability_only boolean"))
    rows = {r.key: r for r in merged.collect()}
    assert (rows["a"].status, rows["a"].formula, rows["a"].witness) == ("PROVEN", "g", []) and len(rows["b"].witness) == 1 and [r.key for r in new.collect()] == ["b"]


def test_false_positives(spark):
    safe = filters.safe_names(spark)
    lines = spark.createDataFrame([("src/main.cpp", 4, "if (len > 10)"), ("src/main.cpp", 60, "if (n<5)")], "file_path string, line_number int, line string")
    rows = frame(
        spark, finding("1", snk="logging.getLogger"), finding("2", mid=["std::vector::push_back"], snk="custom_sink"), finding("3", mid=["std::vector::push_back"]), finding("4", src_id="x", snk_id="x"),
        finding("5", snk="DeepScan", src_id="x", snk_id="x", status="LIKELY"), finding("6", snk_line=13), finding("7", snk_line=14), finding("8", snk_line=58), finding("9", snk_line=57), finding("10", snk="strcpy", snk_line=13),
    )
    got = {r.vuln_id: (r.dropped, r.status, r.confidence) for r in filters.drop_false_positives(rows, safe, lines).collect()}
    assert got == {
        "1": (True, "PROVEN", 0.95), "2": (False, "LIKELY", 0.72), "3": (False, "WARNING", 0.55), "4": (True, "PROVEN", 0.95), "5": (False, "LIKELY", 0.95), "6": (False, "WARNING", 0.55),
        "7": (False, "PROVEN", 0.95), "8": (False, "WARNING", 0.55), "9": (False, "PROVEN", 0.95), "10": (False, "PROVEN", 0.95),
    }
    assert {r.name for r in filters.safe_names(spark, frameworks=spark.createDataFrame([("gin",)], "framework string")).collect()} >= {"c.JSON", "find_by", "std::clamp"}


def test_suppressions(spark):
    rows = catalog.parse_suppressions(spark.createDataFrame([(x,) for x in ("src/main.cpp:10:r", "# c:1:r", "", "bad", "a:x:r", "z.cpp:0:q:more", " t.cpp : 3 : r ")], "value string"))
    assert sorted(map(tuple, rows.collect())) == [("src/main.cpp", 10, "r"), ("t.cpp", 3, "r"), ("z.cpp", 0, "q")]
    found = frame(spark, finding("1"), finding("2", rule_id="other"), finding("3", snk_line=11), finding("4", snk_file="z.cpp", rule_id="q"), finding("5", rule_id=None, snk_file="e"))
    extra = spark.createDataFrame([("e", 0, "")], rows.schema)
    assert sorted(r.vuln_id for r in filters.suppress(found, rows.union(extra)).collect()) == ["2", "3"]


def test_merge_and_rescore(spark):
    graph = spark.createDataFrame([("a", 1, 0.95), ("a", 2, 0.5), ("b", 1, 0.8)], "k string, o int, confidence double")
    scans = spark.createDataFrame([("a", 0.9), ("a", 0.1), ("c", 0.7), ("d", 0.69)], "k string, confidence double")
    got = sorted((r.k, r.o or 0, round(r.confidence, 2)) for r in filters.merge_scans(graph, scans, ["k"], ["o"]).collect())
    assert got == [("a", 1, 0.99), ("a", 2, 0.5), ("b", 1, 0.8), ("c", 0, 0.7)]
    rows = frame(spark, *[finding(i, status=s, confidence=c) for i, s, c in (("1", "PROVEN", 0.9), ("2", "PROVEN", 0.9), ("3", "PROVEN", 0.95), ("4", "LIKELY", 0.7), ("5", "WARNING", 0.2), ("6", "PROVEN", 0.75))])
    scores = spark.createDataFrame([("1", 0.5), ("2", 0.7), ("3", 0.1), ("4", 0.7), ("5", 0.1)], "vuln_id string, score double")
    assert [(r.status, r.confidence) for r in filters.rescore(rows, scores, "vuln_id").orderBy("vuln_id").collect()] == [("WARNING", 0.5), ("LIKELY", 0.7), ("PROVEN", 0.95), ("LIKELY", 0.7), ("WARNING", 0.2), ("LIKELY", 0.75)]


def test_states(spark):
    rows = frame(spark, *[finding(i, status=s, requires_msan=m) for i, s, m in (("1", "PROVEN", False), ("2", "PROVEN", False), ("3", "LIKELY", True), ("4", "LIKELY", True), ("5", "PROVEN", False), ("6", "ADVISORY", False), ("7", "PROVEN", False))])
    runs = spark.createDataFrame([("1", False, "address", ""), ("2", True, "address", None), ("3", True, "address", ""), ("4", True, "memory", ""), ("5", False, "", "error"), ("6", False, "", "")], "vuln_id string, passed boolean, sanitizer string, compilation_error string")
    got = [r.status for r in states.transition(rows, runs, "vuln_id").orderBy("vuln_id").collect()]
    assert got == ["SANDBOX_VERIFIED", "WARNING", "LIKELY", "WARNING", "LIKELY", "ADVISORY", "PROVEN"]
    assert states.transition(rows, runs, "vuln_id", dry_run=True) is rows
    classify = lambda raw: spark.range(1).select(states.classify_output(F.lit(raw)).alias("r")).first().r
    assert classify("a.c:1: error: x").compilation_error and classify("==1==ERROR: AddressSanitizer: heap-use-after-free\n#0 0x12 in f\n#1 x").crash_type == "use-after-free"
    assert classify("fine").passed and classify("SUMMARY: AddressSanitizer: x").sanitizer == "ASan" and classify("AddressSanitizer double-free\n#0 0x1f in f a.c\n#1 0x2 in g").stack_trace == "#0 0x1f in f a.c"
    route = lambda m, s, k: spark.range(1).select(states.sanitizer_for(F.lit(m), F.lit(s), F.lit(k))).first()[0]
    assert [route(True, "", "x"), route(False, "CWE-457", "x"), route(False, "", "pthread_create"), route(False, "", "mmap"), route(False, "", "free")] == ["memory", "memory", "thread", "memory", "address,undefined"]


def test_export(spark):
    rows = frame(
        spark, finding("1"), finding("2", status="ADVISORY"), finding("3", confidence=0.6), finding("4", formula="No Use-After-Free found"), finding("5", status="WARNING"), finding("6", status="LIKELY"),
        finding("7", status="SANDBOX_VERIFIED", rule_id="", snk_line=0), finding("8", status="LIKELY", confidence=0.7), finding("9", status="FUZZ_VERIFIED"),
    )
    got = sorted((r.rule, r.level, r.start_line) for r in export.result_rows(rows).collect())
    assert got == [("pathloom/memory-safety", "error", 1), ("r", "error", 10), ("r", "note", 10), ("r", "warning", 10)]
    doc = json.loads(export.sarif_document(rows.limit(1)))
    result = doc["runs"][0]["results"][0]
    assert doc["version"] == "2.1.0" and result["partialFingerprints"]["primaryLocationLineHash/v1"] == hashlib.sha256(b"src/main.cpp:10:r").hexdigest()[:32]
    assert export.comment_rows(spark.createDataFrame([("f", 3, "b" * 5000), ("", 3, "b"), ("f", 0, "b")], "file_path string, line_end int, body string")).select(F.length("body")).collect()[0][0] == 3800
    diagram = export.sequence_lines(frame(spark, finding("1", crosses_files=True, mid=["x"]), finding("2")), "vuln_id").collect()
    assert len(diagram) == 1 and diagram[0].diagram.startswith("sequenceDiagram\nparticipant a.cpp\nparticipant m.cpp\nparticipant main.cpp\na.cpp->>m.cpp: x")
    assert [r.section for r in export.report_sections(rows).orderBy("ord", "line_no").collect()].count("Issues") == 5


def test_metrics(spark):
    rows = frame(spark, *[finding(str(i), status=s) for i, s in enumerate(catalog.STATUSES)])
    card = metrics.risk_card(rows).first()
    assert (card.n_verified, card.n_likely, card.risk, card.exit_code) == (3, 1, "HIGH", 1)
    assert metrics.risk_card(rows.limit(0)).first().risk == "LOW" and metrics.risk_card(rows.where("status = 'LIKELY'")).first().exit_code == 2
    cases = spark.createDataFrame([(str(i), i < 4, i == 6) for i in range(8)], "vuln_id string, bad boolean, broke boolean")
    got = metrics.rates(metrics.confusion(cases, rows, "vuln_id", "bad", "broke")).first()
    assert (got.tp, got.fp, got.tn, got.fn, got.recall, got.fpr) == (4, 1, 3, 0, 1.0, 0.25)
    empty = metrics.rates(metrics.confusion(cases.limit(0), rows, "vuln_id", "bad")).first()
    assert (empty.precision, empty.f1, empty.fpr) == (0.0, 0.0, 0.0)


def test_stored_proofs_do_not_move(spark, tmp_path):
    from pathloom.operators.proof_store import ProofStore

    store = ProofStore(spark, "some_proofs", f"file://{tmp_path}/proofs", 4)
    rows = lambda n, status: spark.range(n).selectExpr("'k' || id AS key", f"{status} AS status", "'f' AS formula", "false AS reachability_only", "array(named_struct('variable', 'x', 'value', '1')) AS witness")
    store.add(rows(50, "if(id < 40, 'PROVEN', null)"))
    store.add(rows(45, "'LIKELY'"))
    found = {r.key: (r.status, len(r.witness)) for r in store.resolve(rows(60, "'WARNING'")).collect()}
    assert [found[f"k{i}"] for i in (0, 39, 40, 44, 45, 59)] == [("PROVEN", 0), ("PROVEN", 0), ("LIKELY", 0), ("LIKELY", 0), ("WARNING", 1), ("WARNING", 1)]
    assert store.read().count() == 45
    # A session that does not know the table finds it by its files.
    spark.sql("DROP TABLE some_proofs")
    again = ProofStore(spark, "other_name", f"file://{tmp_path}/proofs", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = again.resolve(rows(60, "'WARNING'"))
        assert joined.where("status = 'PROVEN'").count() == 40
        plan = joined._jdf.queryExecution().sparkPlan().toString(), joined._jdf.queryExecution().executedPlan().toString()
        assert plan[1].count("Exchange") <= 1 and "other_name" in plan[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_first_failures_are_ordered_as_in_sql(spark, tmp_path):
    # Part keys beyond a million: a line of a lower number may come after one of a higher.
    rows = [(1, 1, 1_500_000, "R"), (1, 2, 7, "R"), (2, 3, 5, "N"), (2, 2, 1_900_000, "N"), (3, 1, 9, "N"), (3, 5, None, "N"), (3, None, 4, "R")]
    frame = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string")
    frame.write.parquet(f"{tmp_path}/lineitem.parquet")
    from pathloom.plans.queries import ORACLES, QUERIES

    got = sorted(tuple(r) for r in QUERIES["matrix_early_exit"](spark, str(tmp_path)).collect())
    assert got == [(1, 7, False), (2, 1_900_000, True), (3, 9, False)]
    sql = ORACLES["matrix_early_exit"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    import duckdb

    assert sorted(duckdb.connect().execute(sql).fetchall()) == got


def test_windows_are_shuffled_in_blocks(spark):
    # A test of a size that begins in one line and ends in the next, on both sides of where blocks meet; far more lines than windows would repeat.
    lines = [("a", n, {63: "if (len", 64: "> 3)"}.get(n, f"line {n}")) for n in range(1, 141)]
    text = spark.createDataFrame(lines, "file_path string, line_number int, line string")
    none = F.array().cast("array<struct<function_name string, file_path string>>")
    found = text.select(F.col("file_path").alias("snk_file"), F.col("line_number").alias("snk_line"), F.lit("memcpy").alias("snk_func"), F.lit("PROVEN").alias("status"), F.lit(0.95).alias("confidence"), F.lit("a").alias("src_id"), F.lit("b").alias("snk_id"), none.alias("intermediate_nodes"))
    out = filters.drop_false_positives(found, catalog.names(spark, ["x"]), text)
    # Both lines are in the windows of 62 (53 to 64) to 72 (63 to 74).
    assert sorted(r.snk_line for r in out.where("status = 'WARNING'").collect()) == list(range(62, 73))
    # Text goes through one shuffle, grouped by file and block; no window is grouped.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
    assert "__blk" in [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in x][0].split("]")[0]
