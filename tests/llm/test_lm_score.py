import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pathloom.llm.lm_score import LAM, LEVELS, MEANS, CountFilter, _packed, _squeeze, _unpacked, _unsqueeze, level_of, score_documents, slice_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows, lam=LAM):
    words, pairs = Counter(), Counter()
    for i, text in rows:
        if not held(i):
            words.update(t := tokens(text))
            pairs.update(zip([None, *t], t))
    n, v = sum(words.values()), len(words)
    about = lambda c: float(MEANS[level_of(np.array([c]))[0]])
    out = []
    for i, text in rows:
        t, base, model = tokens(text), 0.0, 0.0
        for a, b in zip([None, *t], t):
            base += math.log10((words[b] + 1) / (n + v + 1))
            p = (about(words[b]) + 1) / (n + v + 1)
            if words[a]:
                p = lam * min(1, about(pairs[a, b]) / max(about(words[a]), 1)) + (1 - lam) * p
            model += math.log10(p)
        out.append((i, held(i), len(t), sum(words[b] > 0 for b in t), n, base, model))
    return sorted(out, key=repr)


def rows_of_words():
    rng = np.random.default_rng(6)
    vocab = np.array([f"w{i}" for i in range(400)] + ["É", "é", "The", "the", "日本"])
    weight = 1 / np.arange(1, len(vocab) + 1)
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 80)), p=weight / weight.sum()))) for i in range(200)]
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "x " * 60_000), (5, rows[5][1]), (None, "the the")]


@pytest.mark.parametrize("head", [200_000, 20, 0])
def test_against_brute_force(spark, head):
    rows = rows_of_words()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    got = sorted(map(tuple, score_documents(docs, head=head).collect()), key=repr)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    # Scores differ from exact counts' only where a probe is a false positive.
    off = [abs(g[6] - w[6]) / w[2] for g, w in zip(got, want)]
    assert np.median(off) < 1e-9 and max(off) < 1
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])


def test_small_filter_and_empty(spark):
    rows = rows_of_words()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, score_documents(docs, filter_bytes=4096).collect()), key=repr)
    assert np.allclose([g[5] for g in got], [w[5] for w in brute(rows)], rtol=1e-9)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)
    assert score_documents(docs.limit(0)).collect() == []
    only = next(i for i in range(100) if held(i))
    none = score_documents(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r)[:5] for r in none] == [(only, True, 3, 0, 0)]


def test_filter_holds_what_was_added():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    levels = level_of(rng.zipf(1.5, len(keys)).clip(1, 10**9))
    f = CountFilter.empty(int(levels.sum()) * 10 // 8 // 64 + 1)
    f.add(keys, levels)
    assert (f.levels(keys) >= levels).all() and (f.levels(keys) != levels).mean() < 0.05
    other = np.setdiff1d(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64), keys)
    assert (f.levels(other) > 0).mean() < 0.05
    assert (_unsqueeze(_squeeze(keys)) == keys).all() and (np.diff(LEVELS) > 0).all()


def test_pairs_seen_once_stay_where_copies_abound(spark):
    # Many tokens but few distinct pairs: all fit, so those seen once count too.
    rows = [(i, "a b c d e f g h") for i in range(3000) if not held(i)] + [(5000 + i, f"p{i} q{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, score_documents(docs, filter_bytes=16 << 10).collect()), key=repr)
    off = [abs(g[6] - w[6]) for g, w in zip(got, brute(rows)) if g[0] >= 5000]
    assert np.median(off) < 1e-9


def test_small_slices_leave_nothing_out(spark):
    rows = rows_of_words()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, score_documents(docs, filter_bytes=512).collect()), key=repr)
    assert np.mean([abs(g[6] - w[6]) / w[2] for g, w in zip(got, brute(rows))]) < 0.03
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64))
    parts = _packed(keys, 192)
    assert len(parts) == 192 and (np.concatenate([_unpacked(p[3]) for p in parts]) == keys).all()
    assert all((slice_of(keys[i:j], 192) == s).all() for s, i, j, _ in parts)


def test_keys_that_differ_in_low_bits_stay_apart():
    """All 64 bits of a key count: neighbours of what was added are not found."""
    keys = np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64)
    f = CountFilter.empty(20_000, 64)
    f.add(keys, np.full(len(keys), 2, np.uint8))
    assert (f.levels(keys) >= 2).all()
    for bit in (0, 1, 12, 23, 24, 40):
        assert (f.levels(keys ^ np.uint64(1 << bit)) > 0).mean() < 0.02
    edges = np.array([0, 1, (1 << 64) - 1], np.uint64)
    assert [(p[0], p[1], p[2]) for p in _packed(edges, 7)] == [(0, 0, 2), (6, 2, 3)]
