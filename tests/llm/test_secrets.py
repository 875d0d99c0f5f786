import hashlib
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pathloom.llm.automaton import Matcher, TooManyStates, compile_rules, scan
from pathloom.llm.secrets import BASE_RULES, RULES, Rule, find_secrets

# The base kinds as their definition has them: greedy regexes, matches of short values dropped.
BASE = [
    (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    (r"(AKIA[A-Z0-9]+)", 16),
    (r"([0-9a-f]+)", 32),
]
ALL = BASE + [(r.pattern, r.least) for r in RULES[len(BASE) :]]


def brute(text, rules=ALL):
    spans = []
    for k, (pattern, least) in enumerate(rules):
        for m in re.finditer(pattern, text or ""):
            if len(m[1]) >= least:
                spans.append((m.start(), k, m.end()))
    return sorted(spans)


def row(doc_id, text):
    spans = brute(text)
    own = ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in spans if k < len(BASE_RULES))
    return (doc_id, *(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(own.encode()).hexdigest(), ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in spans))


PIECES = ["token", "API_KEY", "apikey", "passwd", "=", ":", " ", "  ", '"', "'", "AKIA", "Z9Q", "deadbeef", "0123", "é", ",", "\n", "ghp_", "a" * 36, "eyJ", ".", "-----BEGIN ", "RSA PRIVATE KEY-----", "secret", "x", "日"]


def found(matcher, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return sorted((a, k, b) for k, a, b in matcher.matches(raw, np.array([0, len(raw)])))


def test_default_rules_are_one_automaton():
    assert len(Matcher([r.pattern for r in RULES]).banks) == 1


def test_matches_agree():
    patterns = ["a(b|c)*d", "[0-9]{3,5}x?", "abc[0-9]+"]
    matchers = [Matcher(patterns), Matcher(patterns, most=12)]
    assert [len(m.banks) for m in matchers] == [1, 3]

    @settings(max_examples=300, deadline=None)
    @given(st.text("abcd0123x,", max_size=40))
    def agrees(text):
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text))
        raw = np.frombuffer(text.encode(), np.uint8)
        for matcher in matchers:
            assert found(matcher, text) == want
        for lane, few in ((4, 1), (4, 48), (512, 2)):
            segments = scan(compile_rules(patterns), raw, np.array([0, len(raw)]), lane, few)
            assert sorted({k for _, _, m in segments for k in range(3) if m >> k & 1}) == sorted({k for _, k, _ in want})

    agrees()


def test_rules_of_any_bytes_and_number(spark):
    assert found(Matcher(["abc[0-9]+"]), "x abc123 y") == [(2, 0, 8)]
    rules = [Rule(f"k{i}", rf"key{i}-[a-z]+") for i in range(200)]
    docs = spark.createDataFrame([(1, "key7-abc key199-z key70-"), (2, "key1999-x")], "doc_id long, text string")
    rows = find_secrets(docs, rules=rules, base=0).collect()
    assert sorted((r.doc_id, r.spans) for r in rows) == [(1, "k7:0:8,k199:9:17"), (2, "")]
    with pytest.raises(ValueError):
        compile_rules(["a*"])
    with pytest.raises(TooManyStates):
        compile_rules(["a[ab]{12}"], most=100)


def test_long_text_without_a_break():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ABCdef0123+/"), 1_000_000)) + " token=" + "ab12" * 1000
    matcher = Matcher([r.pattern for r in RULES])
    found(matcher, text[-5000:])
    began = time.process_time()
    assert [s for s in found(matcher, text) if s[1] == 0] == [s for s in brute(text) if s[1] == 0]
    assert time.process_time() - began < 5  # about half a second


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", *("".join(rng.choice(PIECES, rng.integers(1, 40))) for _ in range(1500)), "token = " + "ab12" * 50_000, "é" * 3000 + "0123456789abcdef" * 2]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1, "token=abcdefgh", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    assert sorted(map(tuple, find_secrets(docs).collect())) == sorted(row(i, t) for i, t, _ in rows)
    assert find_secrets(docs.limit(0)).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, find_secrets(docs).collect()))
    assert got == sorted(row(r.doc_id, r.text) for r in docs.collect())
    assert sum(r[1] + r[2] + r[3] for r in got) > 0
