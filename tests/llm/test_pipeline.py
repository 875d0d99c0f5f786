import math
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_decontaminate import brute as brute_contamination
from test_lines_spans import brute_lines
from test_near_dedup import brute as brute_near
from test_quality import brute as brute_quality
from test_quality import grams
from tokenizers import Tokenizer

from pathloom.llm import quality
from pathloom.llm._bpe import vocabulary
from pathloom.llm.line_dedup import MIN_PAGES, RATIO
from pathloom.llm.quality import EDGE, SMOOTHING


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r.doc_id: r for r in docs.collect()}
    text = {i: r.text for i, r in want.items()}
    kept = {r[0] for r in brute_quality(list(text.items()), labels) if r[7]}
    assert 0.7 * len(text) < len(kept) < len(text)
    text = {r[0]: r[2] for r in brute_lines([(i, want[i].source, text[i]) for i in kept], RATIO, MIN_PAGES)}
    text = {r[0]: text[r[0]] for r in brute_near(list(text.items()), 80) if r[3]}
    text = {r[0]: text[r[0]] for r in brute_contamination(list(text.items()), items) if not r[5]}
    tokens = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    sizes = {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in text.items()}

    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == docs.columns, name
    left = at.collect()
    assert {r.doc_id: r.text for r in left} == text
    assert all(r.n_chars == len(r.text) and r.source == want[r.doc_id].source for r in left)
    packed = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == sizes
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty(spark, sf):
    at = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
    assert at.collect() == []


def test_odd_rows_and_columns(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(60_000))
    plain = [" ".join(f"v{k}x{i}" for i in range(70)) for k in range(6)]
    rows = [(1, None, "en", "a", 3), (2, "", "en", "a", 0), (3, plain[0], None, None, 1), (3, plain[0], None, None, 1), (4, plain[0] + " tail", "en", "a", 1), (None, plain[1], "en", "b", None), (5, plain[2], "fr", "b", 1), (6, long, "fr", "b", 1), (7, plain[3], "de", "c", 1)]
    extra = "`raw.name` string, id long, n_words int, kept boolean, token string, `__t` string, tags array<string>"
    docs = spark.createDataFrame([(*r, "x", 9, 1, False, "t", "u", ["p"]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "q " * 20), (2, plain[3])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf_dir, at, ids = f"file://{tmp_path}", spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns
        ids.append(sorted(map(str, (r.doc_id for r in at.collect()))))
    assert ids[0] == ids[1] and ids[0] == ["3", "3", "4", "5", "6", "7", "None"]  # null, empty and short texts fail the base rules
    assert ids[2] == ["3", "3", "5", "6", "7", "None"]  # 4 is a near copy of 3; rows of one id stay together
    assert ids[3] == ["3", "3", "5", "6", "None"]  # 7 is a benchmark passage
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted({str(r.doc_id) for r in packed}) == ["3", "5", "6", "None"]


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder with 2,600 labelled documents of either kind, more than the 2,000 that the threshold was learned from, and the ids that all of them let pass."""
    at, rng = tmp_path_factory.mktemp("labelled"), np.random.default_rng(31)
    rows = [(i, " ".join(f"v{x}" for x in np.minimum(rng.exponential(40 - i % 2 * 10, rng.integers(55, 75)).astype(int), 400))) for i in range(5400)]
    labels = [(i, i % 2) for i in range(5200)]
    found = [Counter(grams(t)) for _, t in rows]
    raw, own = Counter(), Counter()
    for i, g in enumerate(found):
        raw.update(g)
        own.update(g if i < 5200 and i % 2 else {})
    n, m = raw.total(), own.total()

    def told(g, alone):
        k = g.total() * alone
        return sum(c * math.log((own[b] - alone * c + SMOOTHING) / (raw[b] * (m - k) / n + SMOOTHING)) for b, c in g.items()) / g.total()

    scores = [[told(g, t) for g, (_, x) in zip(found, labels) if x == t] for t in (0, 1)]
    bad, good = np.percentile(scores[0], 100 - 100 * EDGE), np.percentile(scores[1], 100 * EDGE)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return f"file://{at}", [i for (i, _), g in zip(rows, found) if told(g, 0) >= min((good + bad) / 2, good)]


@pytest.mark.parametrize("sent", [10_000, 0])
def test_quality_learns_from_every_labelled_document(spark, labelled, monkeypatch, sent):
    sf_dir, want = labelled
    monkeypatch.setattr(quality, "SENT", sent, raising=False)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least if sent else "-1")  # joined by a shuffle, as many labels are
    try:
        stage = dict(corpus_pipeline.STAGES)["quality"]
        got = sorted(r.doc_id for r in stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).select("doc_id").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert 0 < len(want) < 5400 and got == want
