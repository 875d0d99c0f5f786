import re
import textwrap
import time

from pathloom.llm.licenses import TEMPLATES, THRESHOLD, scan_licenses


def words(text):
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if x]


def bigrams(text):
    w = words(text)
    return set(zip(w, w[1:]))


def brute(text, templates=TEMPLATES):
    lines = (text or "").split("\n")
    out = []
    for i, line in [(0, text)] * (len(lines) > 1) + list(enumerate(lines, 1)):
        a = bigrams(line)
        for k, (name, t) in enumerate(templates):
            b = bigrams(t)
            dice = 2 * len(a & b) / (len(a) + len(b))
            if dice >= THRESHOLD:
                out.append((name, k, i, 0, dice))
    found, every = {m[1] for m in out}, words(text)
    for k, (name, t) in enumerate(templates):
        m, b, best = len(words(t)), bigrams(t), (0, 0)
        high = len(b) * (2 - THRESHOLD) / THRESHOLD
        if k not in found and len(bigrams(text)) > high:
            for s in range(len(every) - m + 1):
                a = set(zip(every[s : s + m], every[s + 1 : s + m]))
                best = max(best, (2 * len(a & b) / (len(a) + len(b)), -s - 1))
            if best[0] >= THRESHOLD:
                out.append((name, k, -1, -best[1], best[0]))
    return out


def test_against_brute_force(spark):
    mit = TEMPLATES[16][1]
    wrapped = "\n".join(textwrap.wrap(mit, 60))
    prose = " ".join(f"p{i}" for i in range(150))
    texts = [f"# header\n{wrapped}\n{prose}\n{prose}", f"{prose} Released under the MIT License. {prose}", None, "", "\n\n", "word", "All rights reserved.", "all RIGHTS\treserved", "x\nReleased under the MIT license!\ny", "Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC 3.0.", mit, mit.replace(". ", ".\n"), mit[:700], mit + " More words follow here.", "Licensed é under the Apache License Version 2.0", "a b " * 30_000, "\n".join(t for _, t in TEMPLATES)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(4, "All rights reserved.", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = scan_licenses(docs)
    assert got.columns == [*docs.columns, "__licenses"]
    assert sorted((r.doc_id, [tuple(m) for m in r["__licenses"]]) for r in got.collect()) == sorted((i, brute(t)) for i, t, _ in rows)
    assert scan_licenses(docs.limit(0)).collect() == []
    assert brute(mit)[0][0] == "MIT" and brute(texts[12])[0][2] == 0
    assert [m[:3] for m in brute(texts[0])] == [("MIT", 16, -1)] and [m[0] for m in brute(texts[1])] == ["MIT"]


def test_templates_as_a_table(spark):
    many = [(f"L{i}", " ".join(f"t{i}w{j}" for j in range(8))) for i in range(400)]
    docs = spark.createDataFrame([(1, f"so {many[7][1]} on and on and on and on and on"), (2, many[399][1]), (3, "none")], "doc_id long, text string")
    got = scan_licenses(docs, templates=spark.createDataFrame(many, "license string, text string").orderBy("license").coalesce(1)).collect()
    assert sorted((r.doc_id, [m.license for m in r["__licenses"]]) for r in got) == [(1, ["L7"]), (2, ["L399"]), (3, [])]
    assert [r["__licenses"] for r in scan_licenses(docs, templates=[("empty", "")]).collect()] == [[]] * 3


def test_broken_licences_in_long_texts_cost_little(spark):
    """A million words with the halves of a licence far apart: nothing is found, and no window is compared."""
    text = dict(t for t in TEMPLATES if len(t[1]) > 500)["MIT"].split()
    filler = [f"w{k % 997} x{k % 1009}" for k in range(250_000)]
    rows = [(1, " ".join([*text[:80], *filler, *text[80:], *filler])), (2, " ".join([*filler[:9], *text, *filler]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).persist()
    docs.count()
    scan_licenses(spark.createDataFrame([(0, "warm up " * 50)], "doc_id long, text string")).collect()
    began = time.time()
    got = {r.doc_id: [(m.license, m.unit, m.word) for m in r["__licenses"]] for r in scan_licenses(docs).select("doc_id", "__licenses").collect()}
    took = time.time() - began
    assert got == {1: [], 2: [("MIT", -1, 19)]}
    assert took < 20
