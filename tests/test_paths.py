import random

import pytest
from pathloom.functions import catalog
from pathloom.operators import paths, rules, scoring
from pyspark.sql import functions as F

NODES = "node_id string, file_path string, function_name string, line_start int, line_end int, node_type string, code string"
EDGES = "src string, dst string, type string, summary boolean, resolved_virtual boolean"


def brute(edges, starts, ends, hops, unique, stop):
    out = {}
    for e in edges:
        out.setdefault(e[0], set()).add(e)
    found = []

    def walk(path, used):
        if len(path) > 1 and path[-1] in ends:
            found.append(tuple(path))
            if stop == "any":
                return
        if len(path) <= hops:
            for e in out.get(path[-1], ()):
                if (e[1] not in path) if unique == "node" else (e not in used):
                    walk([*path, e[1]], used | {e})

    for s in starts:
        walk([s], frozenset())
    return sorted(found)


@pytest.mark.parametrize("unique,stop", [("node", "pair"), ("node", "any"), ("edge", "pair")])
def test_expand_against_brute_force(spark, unique, stop):
    rng = random.Random(unique + stop)
    edges = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.choice(["CALL", "CFG"])) for _ in range(26)}
    frame = spark.createDataFrame([(*e, None, None) for e in edges] + [("n1", None, "CALL", None, None)], EDGES)
    ends = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    starts, stops = ["n0", "n1", "n2"], ["n3", "n4", "n0"]
    got = paths.expand(frame, ends(starts), ends(stops), 5, uniqueness=unique, stop=stop)
    assert sorted(tuple(r.path) for r in got.collect()) == brute(edges, starts, set(stops), 5, unique, stop)
    assert all(r.path_len == len(r.path) - 1 for r in got.collect())


def test_expand_edge_cases(spark):
    none = spark.createDataFrame([], EDGES)
    node = spark.createDataFrame([("a",)], "node string")
    assert paths.expand(none, node, node).collect() == []
    with pytest.raises(ValueError):
        paths.expand(none, node, node, uniqueness="x")


def graph(spark):
    nodes = [
        ("r", "main.cpp", "read", 3, 3, "CALL_SOURCE", "read("), ("f", "main.cpp", "work", 1, 9, "AST_FUNC", ""), ("m", "utils.cpp", "memcpy", 7, 7, "CALL_SINK", "memcpy(d[64], s, 1024)"),
        ("g", "utils.cpp", "work", 20, 25, "AST_FUNC", ""), ("c", "main.cpp", "work", 5, 5, "CALL", "work("), ("p", "x.cpp", "printf", 1, 1, "CALL", ""), ("s", "x.cpp", "system", 2, 2, "CALL", ""),
    ]
    edges = [("r", "f", "CALL"), ("f", "m", "CALL"), ("f", "c", "CALL"), ("c", "f", "CALL"), ("g", "s", "CALL"), ("m", "p", "REACHING_DEF"), ("r", "m", "PARAMETER_LINK")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*e, None, None) for e in edges], EDGES)


def test_find_paths(spark):
    nodes, edges = graph(spark)
    got = paths.find_paths(nodes, edges, catalog.names(spark, catalog.SOURCES), catalog.names(spark, catalog.SINKS))
    rows = {(r.src_func, r.snk_func): r for r in got.collect()}
    first = rows["read", "memcpy"]
    assert (first.crosses_files, first.path_len, first.snk_line, [n.function_name for n in first.intermediate_nodes]) == (True, 2, 7, ["work"])
    # The other function named work is reached only through resolved virtual calls.
    assert sorted(r.path for r in got.where("snk_func = 'system'").collect()) == [["r", "f", "c", "g", "s"], ["r", "g", "s"]]
    scope = lambda *f: spark.createDataFrame([(x,) for x in f], "file_path string")
    find = lambda changed: paths.find_paths(nodes, edges, catalog.names(spark, catalog.SOURCES), catalog.names(spark, catalog.SINKS), changed).count()
    assert find(scope("main.cpp")) == got.count() == 3 and find(scope("utils.cpp")) == 0 and find(scope()) == 0


def test_bridge_and_virtual(spark):
    nodes, edges = graph(spark)
    new = lambda df, flag: sorted((r.src, r.dst) for r in df.where(flag).collect())
    assert new(paths.bridge_opaque_calls(nodes, edges), "summary") == [("f", "p")]
    once = paths.bridge_opaque_calls(nodes, edges)
    assert new(paths.bridge_opaque_calls(nodes, once), "summary") == [("f", "p")]
    assert new(paths.resolve_virtual_calls(nodes, edges), "resolved_virtual") == [("c", "g"), ("r", "g")]


def test_rule_of_each_default_sink(spark):
    sinks = catalog.names(spark, catalog.SINKS).withColumnRenamed("name", "snk_func")
    got = {r.snk_func: (r.rule_id, r.rule_severity) for r in rules.annotate(sinks, catalog.keywords_frame(spark)).collect()}
    want = {
        "no_unbounded_memcpy": "memcpy memmove memset", "no_strcpy_strcat": "strcpy strcat sprintf vsprintf", "no_raw_malloc_free": "free", "prefer_unique_ptr": "delete",
        "js_command_injection": "exec execve execl execv execvp", "ruby_command_injection": "system", "python_path_traversal": "popen", "bstr_leak_on_overwrite": "CopyTo Attach",
    }
    expected = {name: rule for rule, names in want.items() for name in names.split()} | {"operator delete": "prefer_unique_ptr"}
    assert got == {s: (expected.get(s, ""), "ADVISORY" if expected.get(s) == "prefer_unique_ptr" else "CRITICAL") for s in catalog.SINKS}
    assert len(catalog.SOURCES) == 38 and len(catalog.SINKS) == 32 and len(catalog.RULES) == 44


def test_globs_and_text_search(spark):
    files = spark.createDataFrame([("a/b/x.cpp",), ("x.py",), ("src/auth/k/y.h",), ("auth.h",)], "file_path string")
    got = sorted((r.file_path, r.rule_id) for r in rules.rules_for_files(files, catalog.rules_frame(spark)).collect())
    of = lambda f: {r for x, r in got if x == f}
    assert "no_raw_malloc_free" in of("a/b/x.cpp") and "python_ssrf" in of("x.py") and "no_raw_pointers_auth" in of("src/auth/k/y.h") and "no_raw_pointers_auth" not in of("auth.h")
    text = spark.createDataFrame([("a.c", "x\ny free(p)\nmalloc(3)"), ("b.c", "nothing"), ("c.c", None)], "file_path string, text string")
    found = {(r.rule_id, r.keyword, r.line_number) for r in rules.search_text(text, catalog.keywords_frame(spark)).collect() if r.file_path == "a.c"}
    assert ("no_raw_malloc_free", "malloc", 3) in found


def test_scores(spark):
    score = lambda cross, sink, sev="CRITICAL", mid=0: spark.range(1).select(scoring.path_score(F.lit(cross), F.lit(sink), F.lit(sev), F.lit(mid))).first()[0]
    assert (score(True, "memcpy"), score(False, "memcpy"), score(False, "printf"), score(False, "printf", "ADVISORY", 9)) == (6.0, 3.0, 1.0, -1.0)
    rows = spark.createDataFrame([(str(i), float(i % 3)) for i in range(50)], "path_id string, pruner_score double")
    assert scoring.prune(rows, ["path_id"], 20).where("not was_pruned").count() == 20
    ranked = spark.createDataFrame([("48", 0), ("3", 1), ("zz", 2)], "path_id string, rank int")
    kept = {r.path_id for r in scoring.prune(rows, ["path_id"], 10, ranked).where("not was_pruned").collect()}
    assert len(kept) == 10 and "48" not in kept and scoring.prune(rows.limit(0), ["path_id"]).count() == 0
    say = lambda sev, text, h=0.05: spark.range(1).select(scoring.explanation_confidence(F.lit(sev), F.lit(text).cast("string"), h)).first()[0]
    long = "this is an explanation of a certain bug"
    assert (say("CRITICAL", long), say("ADVISORY", long), say("CRITICAL", long + " memcpy at line 12"), say("CRITICAL", "short"), say("CRITICAL", long + " may"), say(None, None)) == (0.88, 0.75, 0.95, 0.68, 0.83, 0.68)
    assert [spark.range(1).select(scoring.queue_priority(F.lit(n))).first()[0] for n in (5, 6, 20, 21)] == [9, 5, 5, 1]


def test_chain_equals_expander(spark, sf):
    from pathloom.plans.queries import QUERIES

    assert QUERIES["event_paths"](spark, sf).count() == QUERIES["chain_positions"](spark, sf).count()


def in_order(found):
    return sorted((len(p) - 1, p[0].encode(), p[-1].encode(), [n.encode() for n in p]) for p in found)


@pytest.mark.parametrize("unique,stop,seed", [("node", "pair", 1), ("node", "any", 2), ("edge", "pair", 3), ("node", "pair", 4)])
def test_first_paths_against_brute_force(spark, monkeypatch, unique, stop, seed):
    """Cyclic graphs: the first so many of all paths, from one partial path kept for each asked for on."""
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice(["CALL", "CFG"])) for _ in range(24)}
    frame = spark.createDataFrame([(*e, None, None) for e in edges], EDGES)
    ends = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    starts, stops = ["n0", "n1", "n2", "n8"], ["n3", "n4", "n0"]
    every = in_order(brute(edges, starts, set(stops), 6, unique, stop))
    monkeypatch.setattr(paths, "GROWTH", 3)
    steps = paths._Steps(frame, ends(stops), 6, None, unique, [])
    for most, kept in ((1, 1), (7, 1), (len(every) // 2, 1), (10 * len(every), 4)):
        got = paths.first_paths(steps, ends(starts), stop, most, kept)
        assert in_order(tuple(r.path) for r in got.collect()) == every[:most], (most, len(every))


def test_first_paths_of_a_dense_graph(spark, tmp_path):
    """All of 300 nodes lead to all others, 89,700 edges full of cycles: the first paths are found from a fixed number of rows a hop."""
    n = spark.range(300).select(F.format_string("n%03d", "id").alias("src"))
    edges = n.crossJoin(n.toDF("dst")).where("src <> dst").withColumn("type", F.lit("CALL"))
    far = edges.where("src < 'n290' and dst < 'n290' or src >= 'n290' and dst > src")
    link = spark.createDataFrame([("n289", "n290", "CALL")], "src string, dst string, type string")
    ends = spark.createDataFrame([("n299",), ("n295",)], "node string")
    starts = spark.createDataFrame([("n000",), ("n001",), ("n002",)], "node string")
    steps = paths._Steps(far.union(link), ends, 15, None, "node", [])
    got = in_order(tuple(r.path) for r in paths.first_paths(steps, starts, "pair", 100).collect())
    # n -> 289 -> 290 -> end takes 3 hops; with one more node anywhere, 4.
    want = [(s, "n289", "n290", e) for s in ("n000", "n001", "n002") for e in ("n295", "n299")]
    inner = [f"n{i:03d}" for i in range(290)]
    for s in ("n000", "n001", "n002"):
        for e in ("n295", "n299"):
            want += [(s, x, "n289", "n290", e) for x in inner if x not in (s, "n289")]
            want += [(s, "n289", "n290", f"n{x}", e) for x in range(291, int(e[1:]))]
    assert got == in_order(want)[:100]


def test_hubs_equal_their_edges(spark):
    """Searches through hubs give what a search over the edges one by one gives."""
    rng = random.Random(5)
    nodes = [(f"f{i}", "x.c", rng.choice(["work", "run", None]), 1, 1, "AST_FUNC", "") for i in range(8)]
    nodes += [(f"c{i}", "x.c", rng.choice(["read", "memcpy", "call", "strcpy"]), 1, 1, "CALL", "") for i in range(12)]
    ids = [n[0] for n in nodes]
    edges = {(rng.choice(ids), rng.choice(ids), rng.choice(["CALL", "REACHING_DEF"]), rng.choice([None, None, None, True])) for _ in range(34)}
    nf, ef = spark.createDataFrame(nodes, NODES), spark.createDataFrame([(a, b, t, s if t == "REACHING_DEF" else None, None) for a, b, t, s in edges], EDGES)
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    full = paths.resolve_virtual_calls(nf, paths.bridge_opaque_calls(nf, ef, most=None))
    for unique in ("node", "edge"):
        for most in (None, 15):
            how = dict(max_hops=4, uniqueness=unique, most=most)
            got = paths.find_paths(nf, ef, names("read", "call"), names("strcpy"), most_bridges=None, **how)
            want = paths.find_paths(nf, full, names("read", "call"), names("strcpy"), extend=False, **how)
            assert sorted(r.path for r in got.collect()) == sorted(r.path for r in want.collect())
    hubs = paths.virtual_hubs(nf, ef)
    assert hubs.enter.count() + hubs.leave.count() <= 8 + len(edges)


def test_first_bridges(spark):
    rng = random.Random(6)
    nodes = [("m1", "memcpy"), ("m2", "memcpy"), *[(f"a{i:02d}", "x") for i in range(40)], *[(f"b{i}", "y") for i in range(9)]]
    edges = {(f"a{rng.randrange(40):02d}", rng.choice(["m1", "m2"])) for _ in range(60)} | {(m, f"b{i}") for m in ("m1", "m2") for i in range(9)}
    had = {(f"a{i:02d}", f"b{j}") for i in range(20) for j in range(9)}
    nf = spark.createDataFrame([(i, "f", n, 1, 1, "CALL", "") for i, n in nodes], NODES)
    ef = spark.createDataFrame([(a, b, "CALL", None, None) for a, b in edges] + [(a, b, "REACHING_DEF", True, None) for a, b in had], EDGES)
    every = sorted({(a, b) for a, m in edges for m2, b in edges if m == m2} - had)
    for most in (1, 5, 30, 1000):
        got = paths.bridge_opaque_calls(nf, ef, most=most).where("summary").join(spark.createDataFrame(list(had), "src string, dst string"), ["src", "dst"], "left_anti")
        assert sorted((r.src, r.dst) for r in got.collect()) == every[:most]


def test_edges_a_call_has_already_are_left_out(spark):
    nodes = spark.createDataFrame([("c", "", "CALL"), ("f", "x", "AST_FUNC"), ("g", "x", "AST_FUNC"), ("h", "x", "AST_FUNC")], "node_id string, function_name string, node_type string")
    rows = [("c", "f", "CALL", None), ("c", "g", "REF", True)]
    edges = spark.createDataFrame(rows, "src string, dst string, type string, resolved_virtual boolean")
    more = lambda e: sorted(tuple(r) for r in paths.virtual_hubs(nodes, e).pairs().collect())
    assert more(edges) == [("c", "h")]
    alone = edges.where("resolved_virtual is null")
    assert more(alone) == [("c", "g"), ("c", "h")]
    # What is made is not shuffled again: no join above the one that makes it.
    plan = paths.virtual_hubs(nodes, alone).pairs()._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_hubs_of_few_calls_take_two_shuffles_of_edges(spark):
    names = {f"f{i}": f"n{i % 7}" for i in range(60)}
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(9)}", rng.choice(list(names))) for _ in range(80)] * 2
    nodes = spark.createDataFrame([*((f, n, "AST_FUNC") for f, n in names.items()), *((f"c{i}", "", "CALL") for i in range(8))], "node_id string, function_name string, node_type string")
    edges = spark.createDataFrame([(a, b, "CALL", None) for a, b in rows], "src string, dst string, type string, resolved_virtual boolean")
    had = {(c, n): {f for a, f in rows if a == c and names[f] == n} for c, n in {(a, names[f]) for a, f in rows if a != "c8"}}
    want = {(c, f) for (c, n), direct in had.items() for f in names if names[f] == n and direct != {f}}
    assert {tuple(r) for r in paths.virtual_hubs(nodes, edges).pairs().collect()} == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = paths.virtual_hubs(nodes, edges).enter._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Edges and functions by dst, and what they give by hub.
    assert plan.count("Exchange hashpartitioning") == 3
