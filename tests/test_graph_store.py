import random

import pytest
from pathloom.operators import graph_store as g
from pathloom.operators.graph_store import GraphStore

RAW = "node_id string, file_path string, function_name string, line_start int, line_end int, node_type string, code string, seq long"
E = "src string, dst string, type string"


def raw(spark, *rows):
    return spark.createDataFrame([(i, f, n, 1, 1, None, c, k) for k, (i, f, n, c) in enumerate(rows)], RAW)


def test_full_then_incremental(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/graph")
    assert store.version() == 0 and not store.has("r") and store.load()[0].count() == 0
    nodes = raw(spark, ("1", "a.c", "f", "old"), ("1", "a.c", "f", "new"), ("2", "a.c", "g", None), ("3", "b.c", None, "x"))
    edges = spark.createDataFrame([("1", "2", "call"), ("1", "2", "CALL"), ("2", "3", None), ("3", "9", "CFG"), ("", "1", "REF")], E)
    got = store.ingest(nodes, edges, "r", "run1")
    assert (got["nodes_created"], got["edges_created"], got["ingestion_mode"]) == (3, 3, "full")
    n, e = store.load()
    rows = {r.function_name: r for r in n.collect()}
    assert rows["f"].code == "new" and rows["g"].code == "" and rows[""].node_type == "AST_FUNC" and len(rows["f"].content_hash) == 64
    assert sorted(r.type for r in e.collect()) == ["CALL", "CALL"]  # one of a pair of equal edges, and one without a type
    # Another repository stays apart.
    store.ingest(raw(spark, ("1", "a.c", "other", "")), spark.createDataFrame([], E), "r2", "run1")
    # a.c is replaced, b.c is kept, edges into the old a.c are gone.
    changed = spark.createDataFrame([("a.c",)], "file_path string")
    got = store.ingest(raw(spark, ("5", "a.c", "h", "")), spark.createDataFrame([("5", "5", "CALL")], E), "r", "run2", changed)
    assert got["ingestion_mode"] == "incremental"
    n, e = store.load()
    assert sorted(r.function_name for r in n.where("repo_id = 'r'").collect()) == ["", "h"] and n.where("repo_id = 'r2'").count() == 1 and e.count() == 1
    # Deleting a file, then a full load that purges what it does not have.
    store.ingest(raw(spark), spark.createDataFrame([], E), "r", "run3", spark.createDataFrame([("b.c",)], "file_path string"))
    assert store.nodes_of("b.c").count() == 0
    store.ingest(raw(spark, ("7", "c.c", "k", "")), spark.createDataFrame([], E), "r", "run4", full=True)
    assert [r.function_name for r in store.load()[0].where("repo_id = 'r'").collect()] == ["k"] and store.version() == 5
    assert store.node(store.nodes_of("c.c").first().node_id).count() == 1


def test_ids_do_not_depend_on_order(spark):
    a = g.normalise_nodes(raw(spark, (None, "a.c", "f", ""), (None, "b.c", "f", "")), "r", "x")
    b = g.normalise_nodes(raw(spark, (None, "b.c", "f", ""), (None, "a.c", "f", "")), "r", "y")
    assert {r.node_id for r in a.collect()} == {r.node_id for r in b.collect()} and a.select("node_id").distinct().count() == 2


def test_change_writes_only_its_buckets(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/graph", buckets=64)
    files = [f"f{i}.c" for i in range(12)]
    nodes = raw(spark, *[(str(i), f, f"g{i}", "x") for i, f in enumerate(files)])
    edges = spark.createDataFrame([(str(i), str((i + 1) % 12), "CALL") for i in range(12)], E)
    store.ingest(nodes, edges, "r", "1")
    before = store._parts(1)
    assert store.load()[1].count() == 12
    # f3.c loses its node: the edges 2-3 and 3-4 go; nothing else is written.
    store.ingest(raw(spark), spark.createDataFrame([], E), "r", "2", spark.createDataFrame([("f3.c",)], "file_path string"))
    after = store._parts(2)
    n, e = store.load()
    assert n.count() == 11 and e.count() == 10 and store.nodes_of("f3.c").isEmpty() and store.nodes_of("f4.c").count() == 1
    same = lambda kind: sum(before[kind].get(k) == at for k, at in after[kind].items())
    assert len(before["nodes"]) - same("nodes") == 1 and 1 <= len(before["edges"]) - same("edges") <= 2
    # It comes back, with an edge from a node of another file that was not loaded again.
    other = n.where("function_name = 'g9'").first().node_id
    store.ingest(raw(spark, ("3", "f3.c", "g3", "y")), spark.createDataFrame([(other, "3", "REF")], E), "r", "3", spark.createDataFrame([("f3.c",)], "file_path string"))
    n, e = store.load()
    assert n.count() == 12 and e.count() == 11 and e.where("type = 'REF'").first().src == other
    store.ingest(raw(spark), spark.createDataFrame([], E), "r", "4", spark.createDataFrame([("f5.c",)], "file_path string"))
    n, e = store.load()  # the first version is gone, what later ones share with it is not
    assert n.count() == 11 and e.count() == 9 and store.version() == 4


def test_edges_of_a_changed_file_go(spark, tmp_path):
    """The same nodes without their edges: the edges are gone. Nodes that are as they were are no change."""
    store = GraphStore(spark, f"file://{tmp_path}/graph", buckets=8)
    nodes = [("a", "f1", "a", "x"), ("b", "f1", "b", "x"), ("c", "f1", "c", "x"), ("d", "f2", "d", "x")]
    store.ingest(raw(spark, *nodes), spark.createDataFrame([("a", "b", "CALL"), ("b", "c", "CALL"), ("d", "a", "REF"), ("d", "d", "REF")], E), "r", "1")
    into = store.edges_into("f1")
    assert into.count() == 3 and into.where("type = 'REF'").count() == 1
    changed = spark.createDataFrame([("f1",)], "file_path string")
    before = store._parts(1)
    told = store.ingest(raw(spark, *nodes[:2], ("c", "f1", "c", "y"), ("e", "f1", "e", "z")), spark.createDataFrame([("b", "c", "CALL")], E), "r", "2", changed)
    assert told == {"nodes_created": 1, "nodes_updated": 1, "nodes_unchanged": 2, "edges_created": 1, "ingestion_mode": "incremental"}
    n, e = store.load()
    assert n.count() == 5 and {r.run_id for r in n.where("function_name in ('a', 'b', 'd')").collect()} == {"1"}
    names = {r.node_id: r.function_name for r in n.collect()}
    assert sorted((names[r.src], names[r.dst]) for r in e.collect()) == [("b", "c"), ("d", "d")] and store.edges_into("f1").count() == 1
    assert before["nodes"].keys() - store._parts(2)["nodes"].keys() == set()
    # The same again: nothing is written.
    told = store.ingest(raw(spark, *nodes[:2], ("c", "f1", "c", "y"), ("e", "f1", "e", "z")), spark.createDataFrame([("b", "c", "CALL")], E), "r", "3", changed)
    assert told["nodes_unchanged"] == 4 and store._parts(3) == store._parts(2)
    full = store.ingest(raw(spark, *nodes), spark.createDataFrame([], E), "r", "4", full=True)
    assert (full["nodes_created"], full["nodes_updated"], full["nodes_unchanged"]) == (0, 1, 3)


def test_a_batch_counts_once(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/graph", buckets=4)
    changed = spark.createDataFrame([("f1",)], "file_path string")
    load = lambda code, k, source="s": store.ingest(raw(spark, ("a", "f1", "a", code)), spark.createDataFrame([], E), "r", "1", changed, batch=(source, k))["ingestion_mode"]
    assert [load("x", 0), load("y", 1), load("x", 0), load("x", 1), load("z", 0, "t")] == ["full", "incremental", "repeated", "repeated", "incremental"]
    assert store.version() == 3 and store.load()[0].first().code == "z" and store.last_batch("s") == 1 and store.last_batch("u") == -1


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_equal_a_model(spark, tmp_path, seed):
    """Loads of random files against plain sets: DETACH, then what is offered, where both ends exist."""
    rng = random.Random(seed)
    store = GraphStore(spark, f"file://{tmp_path}/graph", buckets=4)
    files = [f"f{i}" for i in range(6)]
    nodes, edges = {}, set()
    gid = lambda f, i: g.normalise_nodes(raw(spark, (i, f, "", "")), "r", "x").first().node_id
    ids = {(f, str(i)): gid(f, str(i)) for f in files for i in range(4)}
    for step in range(5):
        changed = files if not step else rng.sample(files, 2)
        new = {(f, str(i)): rng.choice("xy") for f in changed for i in range(4) if rng.random() < 0.7}
        known = list(ids.values())
        offered = {(rng.choice(known), rng.choice(known), rng.choice(["CALL", "REF"])) for _ in range(12)}
        # As local ids of one file are mapped before, edges are offered by global ones here.
        told = store.ingest(raw(spark, *[(i, f, "", c) for (f, i), c in new.items()]), spark.createDataFrame(sorted(offered), E), "r", str(step), spark.createDataFrame([(f,) for f in changed], "file_path string"))
        old = {k: c for k, c in nodes.items() if k[0] in changed}
        assert told["nodes_created"] == len(new.keys() - old.keys()) and told["nodes_unchanged"] == sum(old.get(k) == c for k, c in new.items())
        was = {ids[k] for k in old}
        nodes = {k: c for k, c in nodes.items() if k[0] not in changed} | new
        there = {ids[k] for k in nodes}
        edges = {e for e in edges if e[0] not in was and e[1] not in was} | {e for e in offered if e[0] in there and e[1] in there}
        n, e = store.load()
        assert {(r.node_id, r.code) for r in n.collect()} == {(ids[k], c) for k, c in nodes.items()}
        assert sorted((r.src, r.dst, r.type) for r in e.collect()) == sorted(edges)
        assert sorted(r[0] for r in store._read("ids", store._parts(store.version())).select("node_id").collect()) == sorted(there)
        some = next(iter(there))
        assert store.node(some).count() == 1
