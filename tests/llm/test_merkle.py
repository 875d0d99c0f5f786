import hashlib
from collections import defaultdict
from zlib import crc32

import duckdb
import pytest
from pathloom.llm.merkle import FIELDS, ORACLES, build, checked, folded, joined, leaf_digest, op13_merkle, proofs, steps
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp int, `id.` string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root of nodes, and each node's path: (place, the run's others) per level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, i in enumerate(at):
            run, place = runs[i // 3], i % 3
            paths[k].append((place, run[:place] + run[place + 1 :]))
            at[k] = i // 3
        nodes = [h(*r) for r in runs]
    return nodes[0], paths


def brute(rows):
    leaf = lambda r: h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    if not names:
        return []
    root, tops = tree([subs[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (*_, own, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), subs[s][1], strict=True):
            whole = path + top
            cut = r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            now = leaf((*r[:4], r[4].replace("\n", ""))) if cut else own
            for place, others in whole:
                now = h(*others[:place], now, *others[place:])
            out.append((r[0], own, subs[s][0], root, h(*[d for _, others in whole for d in others]), now, now == root))
    return out


def result(docs, **how):
    cut = [F.replace(docs[c], F.lit("\n"), F.lit("")) if c == "text" else docs[c] for c in FIELDS]
    return checked(build(docs, claim=F.when(F.crc32(docs["doc_id"].cast("string")) % 2 == 0, leaf_digest(cut)), **how))


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, *map(str, r)))


@pytest.mark.parametrize("stride", [1, 2, 7])
def test_against_brute_force(spark, stride):
    sizes = {None: 4, "": 1, "a": 28, "aé": 9, "b": 3, "b\x00": 27, "Z": 82, "日": 2, **{f"s{i}": 1 for i in range(12)}}
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k * 7 % 301, s, [None, "en", "é:1"][k % 3], None if k % 5 == 0 else k, [None, "", "a\nb", "plain", "\n", "é\n" * 1000][k % 6]))
            k += 1
    rows += [(None, "a", None, None, None), (None, None, "x", 1, "t\n"), *[(5, "b", "en", 3, "copy\n")] * 9]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)
    assert in_order(result(docs, stride=stride).collect()) == in_order(brute(rows))


def test_small_tables(spark):
    docs = spark.createDataFrame([(3, "a", "en", 2, "x\ny", "", 0, "")], SCHEMA)
    assert in_order(result(docs).collect()) == in_order(brute([(3, "a", "en", 2, "x\ny")]))
    assert result(docs.limit(0)).collect() == []


def test_store_and_proofs(spark):
    docs = spark.range(0, 1000, 1, 7).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    made = build(docs, stride=2)
    levels = {(r.tree, r.level): r.n for r in spark.read.parquet(made.path).groupBy("tree", "level").agg(F.count("*").alias("n")).collect()}
    assert [levels["rows", k] for k in range(7)] == [1000, 334, 112, 39, 15, 6, 3] and ("rows", 7) not in levels
    assert levels["groups", 0] == 3 and levels["groups", 1] == 1
    for r in proofs(made).limit(50).collect():
        path = steps(bytes(r.proof))
        assert len(path) == 7 and folded(bytes(r.leaf).hex(), path) == made.root
        assert folded(bytes(r.leaf).hex(), path[:6]) == bytes(r.subroot).hex()
    assert joined([]) == h()


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = in_order(op13_merkle(spark, "/root/testdata/sf0.01").collect())
    assert got == in_order(brute([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]))
    assert 0 < sum(not r[-1] for r in got) < len(got)
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert in_order(db.execute(ORACLES["op13_merkle"]).fetchall()) == got
