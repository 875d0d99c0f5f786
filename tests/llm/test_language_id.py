import unicodedata
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pathloom.llm import language_id
from pathloom.llm.language_id import BITS, DRAWN, GRAMS, Model, drawn, fit, op11_language, predict, sample, subwords, train
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def mixed(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & MASK
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & MASK
    return x ^ (x >> 33)


def brute(text):
    """Buckets of all subwords, word by word, and the number of letters."""
    words, now = [], []
    for c in [*(text or "").lower(), " "]:
        if unicodedata.category(c)[0] in "LM":
            now.append(ord(c))
        elif now:
            words.append(now)
            now = []
    found = Counter()
    for w in words:
        edged = [0, *w, 0]
        for n in GRAMS:
            for i in range(len(edged) - n + 1):
                h = edged[i]
                for c in edged[i + 1 : i + n]:
                    h = (h * 0xD6E8FEB86659FD93 + c) & MASK
                found[mixed((h + n) & MASK) >> (64 - BITS)] += 1
    return found, sum(unicodedata.category(chr(c))[0] == "L" for w in words for c in w)


def vectorised(texts):
    found, letters = [Counter() for _ in texts], [0] * len(texts)
    for first, rows, row, bucket, own in subwords(pa.array(texts, pa.string())):
        for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
            found[first + r][b] += 1
        for i in range(rows):
            letters[first + i] += int(own[i])
    return list(zip(found, letters, strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab éÉ1.\nя日́\x00", max_size=12)), max_size=6))
def test_subwords(texts):
    assert vectorised(texts) == [brute(t) for t in texts]


def test_subwords_of_long_texts(monkeypatch):
    texts = ["short", "ab cd. efg " * 3000, None, "éa日 " * 5000, "", "x1y"]
    whole = vectorised(texts)
    assert whole == [brute(t) for t in texts]
    monkeypatch.setattr(language_id, "_PIECE", 1000)
    assert vectorised(texts) == whole
    (f, n), = vectorised(["日本" * 5000])
    assert n == 10_000 and len(f) < 40


def batches(spark, n=120):
    rng = np.random.default_rng(2)
    kinds = {"aa": "qwert", "bb": "asdfg", "cc": "zxcvb"}
    rows = []
    for i in range(n):
        lang = list(kinds)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(list(kinds[lang]), 5)) for _ in range(30)), lang, "no"))
    return rows, "doc_id long, text string, lang string, lang_pred string"


def test_rows_of_all_kinds(spark):
    rows, schema = batches(spark)
    odd = [(1000, None, "aa", ""), (1001, "", "aa", ""), (1002, "12 .. \n", "bb", ""), (None, "qwert qw", None, ""), (1003, "qqq www eee", None, ""), (1003, "qqq www eee", None, ""), (1004, "asdfg " * 300_000, "bb", "")]
    odd += [(1005 + i, rows[1][1], "bb", "") for i in range(50)]  # copies
    docs = spark.createDataFrame(rows + odd, schema).repartition(4)
    learned = train(docs, F.crc32(docs["doc_id"].cast("string")) % 3 != 1)
    assert learned.langs == ["aa", "bb", "cc"] and 0 < learned.temperature
    got = {(r.doc_id, r.lang_pred, round(r.score, 6), r.accepted) for r in predict(docs, learned).collect()}
    assert predict(docs, learned).count() == len(rows + odd)
    by_id = {g[0]: g for g in got}
    assert len(got) == len(by_id)
    assert all(by_id[i][1:] == ("und", 0.0, False) for i in (1000, 1001, 1002))
    assert by_id[None][1] == by_id[1003][1] == "aa" and by_id[1004][1] == "bb"
    assert all(by_id[i][1] == lang for i, _, lang, _ in rows)
    # Cyrillic is no language of these: no subword is known.
    other = predict(spark.createDataFrame([(1, "это другой язык совсем")], "doc_id long, text string"), learned).first()
    assert not other.accepted and other.known_share < 0.2
    # The same sample, however rows are dealt.
    again = train(docs.repartition(7), F.crc32(docs["doc_id"].cast("string")) % 3 != 1)
    assert (again.vectors == learned.vectors).all() and again.least_score == learned.least_score
    assert predict(docs.limit(0), learned).collect() == []


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert train(docs, F.lit(True)) is None
    assert tuple(predict(docs, None).first()) == (1, "und", 0.0, False, 0.0)


def test_sample_is_bounded_and_of_different_texts(spark):
    docs = spark.range(3000).select((F.col("id") % 700).cast("string").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("lang"))
    got = sample(docs, F.lit(True), "lang", "text", 100).collect()
    assert Counter(r.lang for r in got) == {"rare": 50, "often": 50} and len({(r.lang, r.text) for r in got}) == 100
    long = drawn(spark.createDataFrame([("x", 5, "abc def " * 5000)], "lang string, h long, text string")).first()
    assert len(long.buckets) == 2 * DRAWN


def test_scores_are_probabilities():
    """Of two languages that share most subwords, scores say how often they are right."""
    rng = np.random.default_rng(8)
    texts = []
    for i in range(1500):
        g = i % 2
        texts.append(("ab"[g], np.where(rng.random(60) < 0.06, 1000 * (g + 1) + rng.integers(0, 5, 60), rng.integers(0, 300, 60)).astype(np.uint16)))
    model = fit(["a", "b"], texts[:1000])
    scores, right = [], []
    for lang, b in texts[1000:]:
        p = model.probabilities(model.vectors[:, b.astype(int)[:20]].mean(1)[None])[0]
        scores.append(p.max())
        right.append(model.langs[p.argmax()] == lang)
    assert abs(np.mean(scores) - np.mean(right)) < 0.08
    sure = np.array(scores) >= model.least_score
    assert sure.any() and np.mean(np.array(right)[sure]) > 0.95


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_language(spark, sf).collect()
    assert len(got) == len(truth) and all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.97
    sure = [r for r in held if r.accepted]
    assert len(sure) > 0.9 * len(held) and np.mean([r.lang_pred == truth[r.doc_id].lang for r in sure]) > 0.985
