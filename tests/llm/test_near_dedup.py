import re
from collections import defaultdict

import numpy as np
import pytest
from pathloom.llm.components import connected_components
from pathloom.llm.near_dedup import _lists, keep_one_of_each, link_near_duplicates, matches_for
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(set)
    for k, (i, s) in enumerate(sets):
        for x in s if i is not None else ():
            held[x].add(k)
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        for j in {j for x in s for j in held[x] if j < k}:
            common = len(s & sets[j][1])
            if 100 * common >= percent * len(s | sets[j][1]):
                a, b = root(i), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=repr)


def corpus():
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(3000)]
    doc = lambda n: rng.choice(vocab, n).tolist()
    rows = [" ".join(doc(int(rng.integers(1, 200)))) for _ in range(100)]
    hub = doc(150)
    for _ in range(220):  # copies with few to many changed words: some link to the pivot, some to each other only, some to none
        copy = list(hub)
        for at in rng.integers(0, len(copy), int(rng.integers(0, 7))):
            copy[at] = f"x{rng.integers(1 << 30)}"
        rows.append(" ".join(copy))
    chain = doc(120)
    for step in range(25):  # each links to the next, ends do not
        rows.append(" ".join(chain))
        chain[step * 4] = f"c{step}"
    rows += [rows[3].upper(), rows[3] + "\n", "two words", "Two\tWORDS", "a b c d", "a b c d e", "É É É É É É", "é é é é é é", None, "", " \n", "é " * 20_000]
    order = rng.permutation(len(rows)).tolist()
    return [(i, rows[k]) for i, k in enumerate(order)] + [(None, rows[3]), (None, None), (5, rows[order[5]]), (6, rows[130]), (6, rows[330])]


@pytest.mark.parametrize("block_rows", [512, 25])
def test_against_brute_force(spark, block_rows):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, node int, component_id string")
    want = brute(rows)
    got = link_near_duplicates(docs, block_rows=block_rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len({r[2] for r in want}) < len(rows) - 100
    if block_rows == 512:
        kept = keep_one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r[0]) for r in want if r[3])
        assert link_near_duplicates(docs.limit(0)).collect() == []


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, int(x)) for x in rng.integers(1001, 1200, 150)] + [(7, 7), (None, 3)] + [(500, 40), (501, 500)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, **{b: 1000 for a, b in edges if a == 1000}, 500: 0, 501: 0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_matches_follow_percent(spark):
    # 58 of 106 shingles in common, 0.547: 15 of 32 coordinates would be too many to ask for.
    rows = []
    for k in range(60):
        w = [f"k{k}w{i}" for i in range(86)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:62], *[f"k{k}x{i}" for i in range(24)]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one_of_each(docs, percent=50).collect()) == list(range(0, 120, 2))
    assert keep_one_of_each(docs).count() == 120
    assert [matches_for(p) for p in (80, 85)] == [12, 15]


def test_a_large_cluster_is_read_in_proportion(spark):
    """Groups of texts that all share half their words, so that every list holds all of them, with no link but to their own copy:
    what is copied and compared with full sets are the classes that collide, not residual times all."""
    rng = np.random.default_rng(8)
    hub = [f"h{i}" for i in range(60)]
    rows = []
    for k in range(400):
        own = [f"k{k}w{i}" for i in range(200)]
        rows += [(2 * k, " ".join(hub + own)), (2 * k + 1, " ".join(hub + own[:-4] + [f"z{k}"]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), str(t)) for i, t in rows], "doc_id long, text string")
    got = sorted((r.id, r.component_id) for r in link_near_duplicates(docs, block_rows=64).collect())
    assert got == [(i, i - i % 2) for i in range(800)]


def test_rows_sent_follow_the_others_of_a_list(spark):
    """A list of n classes with r outside its main component sends about n rows for each block of the r."""
    token = F.array(*[F.struct(F.lit(9).cast("long").alias("df"), F.lit(k).cast("long").alias("token")) for k in range(3)])
    sent = {}
    for n, r in ((10_000, 1), (40_000, 1), (10_000, 600)):
        state = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") >= n - r, F.col("id")).otherwise(0).alias("comp"), token.alias("tokens"))
        sent[n, r] = _lists(state, 3, 512).count()
    assert sent[10_000, 1] == 10_000 + 20 and sent[40_000, 1] == 40_000 + 79 and sent[10_000, 600] == 2 * 10_000 + 20 * 600
