import random
import time

import pytest
from pathloom.functions import catalog
from pathloom.functions.matching import Words, match_words
from pathloom.operators import rules, scan_runner
from pathloom.operators.scan_runner import Budget, run_scans
from pathloom.sources import repo


def brute(texts, words):
    return sorted((k, i, t.index(w), t[: t.index(w)].count("\n") + 1) for k, t in texts if t is not None for i, w in words if w is not None and w in t)


@pytest.mark.parametrize("most_chars", [1_000_000, 20])
def test_words_against_brute_force(spark, most_chars):
    rng = random.Random(most_chars)
    some = lambda n: "".join(rng.choice("abé\n日") for _ in range(n))
    texts = [(k, some(rng.randrange(40))) for k in range(60)] + [(60, None), (61, ""), (3, "abab")]
    words = [(i, some(rng.randrange(1, 5))) for i in range(40)] + [(100, ""), (101, None), (102, "ab"), (103, "ab")]
    got = match_words(spark.createDataFrame(texts, "key long, text string").repartition(3), spark.createDataFrame(words, "word_id long, word string"), most_chars)
    assert sorted(map(tuple, got.collect())) == brute(texts, words)
    assert match_words(spark.createDataFrame([], "key long, text string"), spark.createDataFrame(words, "word_id long, word string"), most_chars).collect() == []
    assert match_words(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([], "word_id long, word string"), most_chars).collect() == []


def test_time_does_not_depend_on_the_number_of_words():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(12))
    text = " ".join(word() for _ in range(30_000))
    took = []
    for n in (1_000, 100_000):
        tree = Words([(i, word()) for i in range(n)] + [(n, text[1000:1012])])
        began = time.process_time()
        for _ in range(3):
            assert tree.first(text)[n] == 1000
        took.append(time.process_time() - began)
    assert took[1] < 6 * took[0] + 0.1


def test_no_nested_loops(spark):
    """Rules, text search and build settings meet their texts in one pass each."""
    keywords = catalog.keywords_frame(spark)
    frames = [
        rules.annotate(spark.createDataFrame([("memcpy",)], "snk_func string"), keywords),
        rules.search_text(spark.createDataFrame([("a.c", "free(p)")], "file_path string, text string"), keywords),
        repo.compile_settings(spark.createDataFrame([("a.c",), ("b.c",)], "file_path string"), spark.createDataFrame([(2, "x/a.c", "cc -O2 x/a.c"), (1, "y", "gcc -O3 -g a.c")], "ord long, file string, command string")),
    ]
    for df in frames:
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and df.count()
    assert sorted((r.file_path, r.compiler, r.opt_level) for r in frames[2].collect()) == [("a.c", "gcc", "-O3"), ("b.c", "c++", "-O1")]


def scan_function():
    def look(path, text):
        if text == "bad":
            raise ValueError(path)
        return [("r", "CRITICAL", n + 1, "x") for n in range(int(text))]

    return look


look = scan_function()


def test_scans_under_a_budget(spark):
    files = spark.createDataFrame([(f"f{i:02d}", "bad" if i == 4 else str(i % 3), -i) for i in range(20)], "file_path string, text string, ord int")
    told = run_scans(files, look, Budget(slots=3, requests=5), ["ord"])
    outcome = {r.file_path: r.outcome for r in told.collect()}
    # The last fifteen by number come first.
    assert [f for f, o in sorted(outcome.items()) if o == "refused"] == [f"f{i:02d}" for i in range(5)] and "failed" not in outcome.values()
    every = run_scans(files, look, Budget(slots=4), ["ord"])
    assert {r.file_path: r.message for r in every.where("outcome = 'failed'").collect()} == {"f04": "ValueError: f04"}
    assert scan_runner.answers_of(every).count() == sum(i % 3 for i in range(20) if i != 4) and every.where("outcome = 'answered' and rule_id is null").count() == 7
    assert [r.file_path for r in scan_runner.unanswered(every).collect()] == ["f04"]
    assert run_scans(files.limit(0), look).collect() == []


def test_scans_stop_when_time_is_up(spark):
    """Each look at the clock is a second later; what was found before the time was up stays."""

    class Clock:
        def __init__(self):
            self.now = 0.0

        def __call__(self):
            self.now += 1.0
            return self.now

    files = spark.createDataFrame([(f"f{i}", "1") for i in range(9)], "file_path string, text string")
    told = run_scans(files, look, Budget(seconds=8.0), clock=Clock())
    outcomes = [r.outcome for r in told.orderBy("file_path").collect()]
    assert outcomes == ["answered"] * 4 + ["refused"] * 5
