import hashlib
import re
import time
from fractions import Fraction
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pathloom.llm.periodic_runs import branching_repeats, find_runs, maximal_runs, op12_periodic_runs, rewritten, summary

DOCS = "/root/testdata/sf0.01/documents.parquet"


def brute_runs(words, least=24, times=3):
    """All maximal stretches by trying every period, smallest first."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(least, times * q):
                found.setdefault((at, end + q), q)
            at = end
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, change=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if change and doc_id is not None and n and crc32(str(doc_id).encode()) % 10 == 0:
        g = crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.array([numbers[w] for w in words], np.int64)
    runs = []
    for q in range(1, n // 3 + 1):  # as brute_runs, a period at a time
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e + q - s >= max(24, 3 * q) and not any(r[0] == s and r[1] == e + q - s for r in runs):
                runs.append((s, e + q - s, q))
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def found(docs, least, times):
    offsets = np.cumsum([0, *map(len, docs)])
    runs = maximal_runs(np.array([w for d in docs for w in d], np.int64), offsets, least, times)
    return [runs.get(i, []) for i in range(len(docs))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.integers(2, 12), st.integers(2, 4))
def test_runs_of_any_sequence(docs, least, times):
    assert found(docs, least, times) == [brute_runs(d, least, times) for d in docs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
def test_runs_of_repetitive_sequences(parts):
    words = [w for part, n in parts for w in part * n]
    assert found([words], 24, 3) == [brute_runs(words)]


def test_every_branching_repeat_is_found_once():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 300):
        words = rng.integers(1, 3, n)
        want = sorted((i, d) for d in range(1, n // 2 + 1) for i in range(n - 2 * d + 1) if (words[i : i + d] == words[i + d : i + 2 * d]).all() and (i + 2 * d == n or words[i + d] != words[i + 2 * d]))
        symbols = np.unique(words, return_inverse=True)[1] + 1
        got = sorted(zip(*(x.tolist() for x in branching_repeats(symbols)), strict=True))
        assert got == want


def test_fibonacci_words_have_many_runs():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    assert found([b], 24, 3) == [brute_runs(b)] and len(brute_runs(b)) > 20


def test_long_texts_take_time_in_proportion():
    took = []
    for n in (100_000, 400_000):
        for words in (np.zeros(n, np.int64), np.tile(np.arange(n // 5), 5)[:n]):
            began = time.process_time()
            (runs,) = maximal_runs(words, np.array([0, n])).values()
            took.append(time.process_time() - began)
            assert runs == [(0, n, 1)] if not words.any() else runs[0][2] == n // 5
    assert sum(took[2:]) < 8 * sum(took[:2]) + 1


def test_rows_of_all_kinds(spark):
    rng = np.random.default_rng(4)
    words = ["a", "B", "b", "é", "日本", "x.", "\x00", "\xa0y"]
    texts = [None, "", " \n\t", "one", "la " * 24, "la " * 23, "a b c " * 8 + "z " + "a b c " * 8, "word\x0bword\fword\r" * 20]
    for _ in range(300):
        part = list(rng.choice(words, rng.integers(1, 12)))
        texts.append(" ".join(list(rng.choice(words, rng.integers(0, 9))) + part * int(rng.integers(1, 9)) + list(rng.choice(words, rng.integers(0, 9)))))
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(7, "la " * 30, 1)] * 2 + [(None, "la " * 30, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long").repartition(3)
    got = summary(find_runs(docs, rewrite=rewritten))
    order = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted((brute_row(i, t) for i, t, _ in rows), key=order)
    assert summary(find_runs(docs.limit(0))).collect() == []
    out = find_runs(docs.where("doc_id = 6"), collapsed=True).collect()[0]
    assert out.collapsed == "a b c z a b c" and [tuple(r) for r in out.runs] == [(0, 24, 3), (25, 24, 3)]


def test_documents(spark):
    docs = spark.read.parquet(DOCS).collect()
    got = sorted(map(tuple, op12_periodic_runs(spark, DOCS.rpartition("/")[0]).collect()))
    assert got == sorted(brute_row(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 60
