import random

import pytest
from pathloom.operators import distances, paths


def brute(edges, ends, most):
    found, layer = {e: 0 for e in ends}, set(ends)
    for d in range(1, most + 1):
        layer = {a for a, b in edges if b in layer and a not in found}
        found |= dict.fromkeys(layer, d)
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_updates_equal_a_full_computation(spark, seed):
    rng, most = random.Random(seed), 5
    names = [f"n{i}" for i in range(40)]
    pairs = lambda n: {(rng.choice(names), rng.choice(names)) for _ in range(n)}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "src string, dst string")
    nodes = lambda rows: spark.createDataFrame([(r,) for r in sorted(rows)], "node string")
    edges, ends = pairs(60), set(rng.sample(names, 3))
    known = paths.distances_to(frame(edges), nodes(ends), most)
    assert {r.node: r.dist for r in known.collect()} == brute(edges, ends, most)
    for _ in range(2):
        before = brute(edges, ends, most)
        cut, new = set(rng.sample(sorted(edges), 8)), pairs(5)
        new -= edges
        gone, come = {rng.choice(sorted(ends))}, {rng.choice(names)} - ends
        edges, ends = (edges - cut) | new, (ends - gone) | come
        known, changed = distances.updated(known, frame(edges), nodes(ends), most, frame(cut), frame(new), nodes(come))
        want = brute(edges, ends, most)
        assert {r.node: r.dist for r in known.collect()} == want
        assert {r.node: r.dist for r in changed.collect()} == {n: want.get(n) for n in names if want.get(n) != before.get(n)}


def test_only_what_changes_is_written(spark):
    """A long chain cut near its far end: the rest is not looked at."""
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    end = spark.createDataFrame([("n300",)], "node string")
    known = paths.distances_to(frame(edges), end, 12)
    lost = distances.lost_nodes(known, frame(edges[:-5] + edges[-4:]), frame([edges[-5]]), end, 12)
    assert sorted((r.node, r.dist) for r in lost.collect()) == [(f"n{300 - d:03d}", d) for d in range(12, 4, -1)]
    now, changed = distances.updated(known, frame(edges), end, 12)
    assert changed.count() == 0 and now.count() == 13
