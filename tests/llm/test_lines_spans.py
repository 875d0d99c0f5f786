from collections import Counter, defaultdict

import numpy as np
import pytest
from pathloom.llm.line_dedup import drop_lines
from pathloom.llm.span_dedup import remove_repeats, sentences
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"


def brute_lines(rows, ratio, least):
    pages, counts = Counter(), Counter()
    for _, host, text in rows:
        pages[host] += 1
        for key in {x.strip(BLANK) for x in (text or "").split("\n")} - {""}:
            counts[host, key] += 1
    bad = {k for k, n in counts.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, host, text in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if (host, x.strip(BLANK)) not in bad]
        out.append((i, host, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng = np.random.default_rng(0)
    rows = [(i, rng.choice(["a", "b", "hot", "hot", "hot"]), "\n".join([f"own {i}", *rng.choice(["menu", " menu\t", "foot", "", "rare é", "x"], 4)])) for i in range(150)]
    return rows + [(200, None, "menu\nn"), (201, None, "menu\nm"), (202, None, "menu"), (203, "a", None), (204, "b", ""), (205, "hot", "menu"), (205, "hot", "menu"), (206, "one", "z\n" * 9000)]


@pytest.mark.parametrize("broadcast_lines", [1000, 0])
def test_lines(spark, broadcast_lines):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, host string, text string, n_lines string")
    clean = drop_lines(docs, F.col("host"), ratio=0.3, min_pages=3, broadcast_lines=broadcast_lines, salts=3)
    assert clean.columns[:4] == docs.columns
    got = sorted(map(tuple, clean.select("doc_id", "host", "text", "__cut.n_lines", "__cut.n_dropped").collect()), key=repr)
    assert got == brute_lines([tuple(map(lambda x: str(x) if isinstance(x, np.str_) else x, r)) for r in rows], 0.3, 3)
    assert drop_lines(docs.limit(0), F.col("host")).collect() == []


def test_lines_of_sites(spark, sf):
    """Pages by the host of their address."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("html", F.concat("html", F.lit("\nmenu")))
    host = F.parse_url("url", F.lit("HOST"))
    got = sorted(map(tuple, drop_lines(pages, host, "html", ratio=0.3, min_pages=2).select("page_id", host, "html", "__cut.n_lines", "__cut.n_dropped").collect()), key=repr)
    assert got == brute_lines([(r[0], r[1], r[2]) for r in pages.select("page_id", host, "html").collect()], 0.3, 2)
    assert len({r[1] for r in got}) > 1 and sum(r[4] for r in got) > 0


def brute_spans(rows, run=3, least=120):
    where = defaultdict(list)
    parts = {i: sentences(t) for i, t in rows}
    for i, p in parts.items():
        keys = [x.rstrip(BLANK + ".!?") for x in p]
        for k in range(len(p)):
            ends = [e for e in range(k + run, len(p) + 1) if len("|".join(keys[k:e])) >= least]
            if i is not None and keys[k] and ends:
                where["|".join(keys[k : ends[0]])].append((i, k, ends[0]))
    gone, firsts = defaultdict(set), defaultdict(set)
    for at in where.values():
        for i, k, e in sorted(at)[1:]:
            gone[i].update(range(k, e))
            if i != min(at)[0]:
                firsts[i].add(min(at)[0])
    return sorted(((i, "".join(x for k, x in enumerate(p) if k not in gone[i]) if t is not None else None, len(gone[i]), sorted(firsts[i])) for (i, t), p in zip(rows, parts.values())), key=repr)


def test_spans(spark):
    rng = np.random.default_rng(1)
    lines = ["A fairly long sentence stands here.", "Short one!", "What is the question, then? ", "Nothing\n", "words without end " * 8, "é ü 3.14 is here. ", "\n\n", "Ok."]
    rows = [(i, "".join(rng.choice(lines, int(rng.integers(1, 9))))) for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(55))  # one long sentence
    rows += [(200, None), (201, ""), (202, "..."), (206, " " * 100 + "Led in by much. ... And " + "then what? " * 20), (203, f"Start here. {passage}. End."), (204, f"Other start. {passage}."), (None, f"Third. {passage}."), (205, "same again and again and again. " * 300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_removed int")
    done = remove_repeats(docs)
    assert done.columns[:3] == docs.columns
    got = sorted(map(tuple, done.select("doc_id", "text", "__removed.n_removed", "__removed.first_doc_ids").collect()), key=repr)
    assert got == brute_spans(rows)
    by_id = {r[0]: r for r in got}
    assert by_id[203][2] == 0 and by_id[204][2] >= 5 and 203 in by_id[204][3]
    assert remove_repeats(docs.limit(0)).collect() == []
    assert all("".join(sentences(t)) == t for _, t in rows if t)


def test_spans_line_up_wherever_they_stand(spark):
    rng = np.random.default_rng(6)
    vocab = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9)))) for _ in range(4000)]
    some = lambda n: " ".join(rng.choice(vocab, n))
    rows, shared = [], {}
    for k in range(60):  # 60 words that repeat, with other words before them in the same sentence, whose number differs
        shared[k] = some(60)
        rows += [(2 * k, f"{some(9)} {shared[k]} {some(8)}."), (2 * k + 1, f"{some(11 + k % 7)} {shared[k]} {some(5)}.")]
    wide = "".join(f"这是第{i}个句子。" for i in range(30))
    rows += [(500, wide), (501, "前言" + wide)]
    clean = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = [sum(w in clean[2 * k + 1].text.split() for w in shared[k].split()) for k in range(60)]
    assert sum(left) < 0.25 * 60 * 60 and max(left) < 40
    assert len(sentences(wide)) == 30 and clean[501]["__removed"].n_removed >= 28
    assert sentences("Pi is 3.14 here. So!") == ["Pi is 3.14 here. ", "So!"]


def test_only_long_sentences_are_cut():
    """Words that end in b, g, l, q or v end no sentence; in a sentence of more than sixteen words they may end a part."""
    text = 'I am going home to read all the big books. "Will you bring all?" Yes…\nNothing else all along'
    assert sentences(text) == ["I am going home to read all the big books. ", '"Will you bring all?" ', "Yes…\n", "Nothing else all along"]
    assert sentences("all big " * 8) == ["all big " * 8]
    parts = sentences("Well, all big books " * 5 + "end. Short one, all told.")
    assert parts[-1] == "Short one, all told." and len(parts) > 6 and "".join(parts[:-1]) == "Well, all big books " * 5 + "end. "
    assert [len(p.split()) for p in sentences("one " * 70)] == [32, 32, 6]
