import hashlib
import re
import tracemalloc

import numpy as np
from pathloom.llm.decontaminate import TestIndex, drop_contaminated, find_contamination, shard_columns, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, names, best = words(text), set(), set(), (0, 0, "", 0)
        for name, item in items:
            v = words(item)
            n = min(window, len(v))
            for j in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit.update(range(i, i + n))
                        names.add(str(name))
                        k = n
                        while n == window and i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                            k += 1
                        best = min(best, (-k, i, str(name), j))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        found = (-best[0], best[2], best[3], best[1]) if best[0] else (0, None, None, None)
        out.append((doc_id, len(w), len(hit), len(names), sha, bool(hit), *found))
    return sorted(out, key=repr)


def cases():
    rng = np.random.default_rng(3)
    pick = lambda n: " ".join(rng.choice(["a", "B", "c", "dé", "日", "x9"], n))
    items = [(i, pick(int(rng.integers(3, 30)))) for i in range(12)] + [(50, ""), (51, None), (52, "one two three"), (53, "one two three"), (7, "z " * 15)]
    docs = [(i, pick(int(rng.integers(0, 60)))) for i in range(60)]
    docs += [(100 + i, f"{pick(5)}; {t} -- {pick(4)}") for i, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "z " * 40), (203, "One,TWO three!"), (203, "One,TWO three!"), (204, "q " * 30_000 + "one two three")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert sorted(map(tuple, find_contamination(d, b).collect()), key=repr) == want
    # Several blocks of items give the same hits and items.
    blocks = find_contamination(d, b, block_bytes=100)
    assert sorted(map(tuple, blocks.collect()), key=repr) == want
    assert find_contamination(d.limit(0), b).collect() == []
    assert not any(r.contaminated for r in find_contamination(d, b.limit(0)).collect())


def test_items_without_a_name(spark):
    text = " ".join(f"t{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {text} b"), (2, "clean words"), (3, f"{text} one two three"), (4, "x one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (None, "t0 t1 t2 t3"), (7, "one two three"), (8, None)], "item_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [
        (1, 14, 12, 1, sha(""), True, 12, None, 0, 1), (2, 2, 0, 0, sha(""), False, 0, None, None, None),
        (3, 15, 15, 2, sha("7"), True, 12, None, 0, 0), (4, 4, 3, 1, sha("7"), True, 3, "7", 0, 1),
    ]
    assert sorted(map(tuple, find_contamination(docs, items).collect())) == want
    assert sorted(map(tuple, find_contamination(docs, items, block_bytes=20).collect())) == want
    assert [r.doc_id for r in drop_contaminated(docs, items).collect()] == [2]


def test_a_prompt_that_many_items_share():
    """Documents times items are not listed: 6,000 of each have one prompt."""
    prompt = " ".join(f"p{i}" for i in range(25))
    n = 6000
    items = [(f"i{k:05d}", words_of(f"{prompt} question {k}")) for k in range(n)]
    docs = [words_of(f"lead {k} {prompt} tail") for k in range(n - 1)] + [words_of(f"x {prompt} question 77 y")]
    index = TestIndex(items, 10)
    tracemalloc.start()
    n_words, n_hit, n_items, sha, bad, longest, item, item_start, start = shard_columns(docs, [index], 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    whole = hashlib.sha256(",".join(name for name, _ in items).encode()).hexdigest()
    assert set(n_hit[:-1]) == {25} and set(n_items) == {n} and set(sha) == {whole} and all(bad)
    assert {*zip(longest[:-1], item[:-1], item_start[:-1], start[:-1])} == {(25, "i00000", 0, 2)}
    assert (n_hit[-1], longest[-1], item[-1], item_start[-1], start[-1]) == (27, 27, "i00077", 0, 1)
