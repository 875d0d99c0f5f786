import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pathloom.llm.quality import BUCKETS, MIN_SCORE, SMOOTHING, keep_good, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    hit = {j for i, x in enumerate(windows) if many[x] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


def grams(text):
    w = WORD.findall(text or "")
    h = lambda x, seed: xxhash.xxh64_intdigest(x.encode(), seed)
    one = [h(x, 42) for x in w]
    two = [h(b, a) for a, b in zip(one, w[1:])]
    return [(x - (x >> 63 << 64)) % BUCKETS for x in one + two]


def brute(docs, labels):
    bad = {d for d, q in labels if q != 1}
    good = {d for d, _ in labels} - bad
    raw, own = Counter(), Counter()
    for d, t in docs:
        raw.update(g := grams(t))
        if d in good:
            own.update(g)
    n, m = sum(raw.values()), sum(own.values())
    out = []
    for d, t in docs:
        g, b = grams(t), base(t)
        s = sum(math.log((own[x] + SMOOTHING) / (raw[x] * m / n + SMOOTHING)) for x in g) / len(g) if g and m else 0.0
        out.append((d, *b, not b[5] and s >= MIN_SCORE, round(s, 9)))
    return sorted(out, key=repr)


def got(docs, labels):
    q = [f"__quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")]
    return sorted(((*r[:-1], round(r[-1], 9)) for r in map(tuple, score(docs, labels).select("doc_id", *q).collect())), key=repr)


def test_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()])
    assert got(docs, labels) == want
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r[0] for r in want if r[7])


@pytest.mark.parametrize("labelled", [True, False])
def test_edge_texts(spark, labelled):
    texts = [None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n\n \nx", "é|日 #$ \x0b\x0cz z", "w " * 70_000, " ".join(f"v{i}" for i in range(60)), "\n".join(f"line {i} of text" for i in range(30))]
    rows = [(i, t, 5, "q") for i, t in enumerate(texts)] + [(3, "one", 5, "q"), (None, "t " * 60, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, `raw.b` string")
    labels = [(11, 1), (11, 1), (12, 1), (12, 0), (5, 0), (77, 1)] if labelled else []
    want = brute([r[:2] for r in rows], labels)
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    assert got(docs, frame) == want
    assert keep_good(docs, frame).columns == docs.columns
    assert score(docs.limit(0), frame).collect() == []


def test_threshold_is_learned_from_labels(spark):
    # Junk between good words scores above MIN_SCORE, but below every good document.
    rng = np.random.default_rng(5)
    good = [f"word{i}" for i in range(30)]
    text = lambda junk: " ".join(f"j{rng.integers(1 << 40)}%%%" if rng.random() < junk else rng.choice(good) for _ in range(300))
    rows = [(i, text(0.2 if i % 3 == 0 else 0)) for i in range(240)]
    labels = [(i, int(i % 3 > 0)) for i in range(200)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    assert all(r[7] for r in brute(rows, labels) if r[0] % 3 == 0)
    assert sorted(r.doc_id for r in keep_good(docs, marks).collect()) == [i for i in range(240) if i % 3]
    assert keep_good(docs, marks, min_score=MIN_SCORE).count() == 240


def test_every_labelled_document_counts_for_the_threshold(spark):
    rng = np.random.default_rng(9)
    text = lambda: " ".join(f"v{min(int(rng.exponential(40)), 400)}" for _ in range(rng.integers(60, 120)))
    rows = [(i, text()) for i in range(500)]
    labels = [(i, i % 2) for i in range(450)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    raw, own = Counter(), Counter()
    for i, x in rows:
        raw.update(grams(x))
        if i < 450 and i % 2:
            own.update(grams(x))
    n, m, scores = sum(raw.values()), sum(own.values()), {0: [], 1: []}
    for i, x in rows[:450]:
        g, t = Counter(grams(x)), i % 2
        size = sum(g.values())
        scores[t].append(sum(k * math.log((own[b] - t * k + SMOOTHING) / (raw[b] * (m - t * size) / n + SMOOTHING)) for b, k in g.items()) / size)
    good, bad = np.percentile(scores[1], 1), np.percentile(scores[0], 99)
    least = min((good + bad) / 2, good)
    got = {r.doc_id: r["__quality"] for r in score(docs, marks, keep=["doc_id"]).collect()}
    assert len(got) == 500 and all(q.kept == (q.score >= least) for q in got.values())
    assert 0 < sum(q.kept for q in got.values()) < 500


def test_no_label_is_left_out(spark):
    # More labels than the 2,000 of each kind that the threshold was learned from, and than the 20,000 trusted at most.
    rows = spark.range(24_000).selectExpr("id doc_id", "repeat(concat('w', id % 7, ' '), 2) text")
    from pathloom.llm import quality

    labels = rows.selectExpr("doc_id", "1 quality")
    counts = quality.bucket_counts(rows, labels.selectExpr("doc_id id"), "doc_id", "text", 1 << 10).first()
    assert counts.n == counts.m == 24_000 * 3
    assert not hasattr(quality, "THRESHOLD_ROWS") and not hasattr(quality, "TRUSTED_ROWS")
    assert quality.edge(rows, "doc_id", [0.0, 0.01, 0.5, 0.99, 1.0]) == pytest.approx(list(np.percentile(range(24_000), [0, 1, 50, 99, 100])))
