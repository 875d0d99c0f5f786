"""Operator 10: quality rules by a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials are counted over them, one over
trusted documents and one over all documents, and a document's score is the mean of log(trusted / raw) over its
n-grams. Every document below the threshold, and every document that fails the base rules, is rejected. The threshold is
learned from labelled documents (see learned_threshold), or MIN_SCORE where too few are labelled.

The bucket weights are one array of `buckets` doubles, whatever the corpus. All good labelled documents are trusted, all labelled
ones count for the threshold, and counts and scores cover every row. Documents are read twice and, up to SENT labels, never shuffled (with more, twice); what is measured is
written once, since the threshold is known only then.

Null and empty text have no words: counts 0, score 0, base_failed. A very long text is one row of arrays like any other. A score at the
threshold passes; labelled rows of equal hash are taken by their id. Repeated rows each count and each give a row. With no
trusted document all weights are 0. An empty table gives an empty result. Working columns begin with __pl_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import values_at
from ._shared import SPACES, let, store

BUCKETS = 1 << 16
#: Added to a bucket's count on both sides, the raw one scaled to the trusted total, so that rare n-grams weigh little.
SMOOTHING = 5.0
#: The threshold where fewer than LEAST_LABELLED good or bad documents pass the base rules.
MIN_SCORE = -0.25
LEAST_LABELLED = 50
#: How much of the good and of the bad labelled documents is left aside at the edge.
EDGE = 0.01
#: Labelled ids that are sent to all executors, at most, in lists of about LISTED, so that each takes little more than its 8 bytes.
SENT = 12_000_000
LISTED = 256
MIN_WORDS = 50
MAX_REPEATED = 50  # of 100 words
_BLANK = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANK))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>"))


def _bucket(buckets: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def _part(array: Column, first: int, less: int) -> Column:
    """The elements from `first` on, `less` fewer than there are."""
    return F.slice(array, first + 1, F.greatest(F.size(array) - less, F.lit(0)))


def _grams(rows: DataFrame, buckets: int, *keep: str) -> DataFrame:
    """keep and b, a bucket, for each word and each pair of neighbouring words of rows' column w. Words are paired before they are
    dealt into rows, so that hashing is compiled code."""
    pairs = F.arrays_zip(F.col("w").alias("x"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("y"))
    each = rows.select(*keep, F.explode(pairs).alias("z")).select(*keep, "z.x", "z.y")
    both = F.array(_bucket(buckets, F.col("x")), F.when(F.col("y").isNotNull(), _bucket(buckets, F.col("x"), F.col("y"))))
    return each.select(*keep, F.explode(both).alias("b")).where("b is not null")


def marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows with a column __pl_good: the mark (column `good`: 1, 0) of their __pl_id, else null. marks: one for each of its ids (column `id`).

    They go to all executors in lists by hash of the id where they are few enough, else both sides are joined as Spark sees fit.
    """
    n = marks.count()
    if n > SENT:
        return rows.join(marks.select(F.col("id").alias("__pl_id"), F.col("good").alias("__pl_good")), "__pl_id", "left")
    group = lambda x: F.pmod(F.xxhash64(x), F.lit(n // LISTED + 1)).alias("__pl_g")
    own = lambda t: F.collect_list(F.when(F.col("good") == t, F.col("id"))).alias(f"__pl_{t}")
    lists = marks.groupBy(group("id")).agg(own(1), own(0))
    mark = F.when(F.array_contains("__pl_1", F.col("__pl_id")), 1).when(F.array_contains("__pl_0", F.col("__pl_id")), 0)
    return rows.select("*", group("__pl_id")).join(F.broadcast(lists), "__pl_g", "left").select(*[F.col(f"`{c}`") for c in rows.columns], mark.alias("__pl_good"))


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """One row: an array of (b, raw, own) for each bucket, and the totals n and m. trusted: ids (column `id`)."""
    # Words are cut after the join: where it shuffles, texts are smaller.
    flagged = marked(docs.select(docs[id_col].cast("long").alias("__pl_id"), docs[text_col].cast("string").alias("text")), trusted.select("id", F.lit(1).alias("good")))
    flagged = flagged.select(words(F.col("text")).alias("w"), F.coalesce("__pl_good", F.lit(0)).alias("t"))
    counts = _grams(flagged, buckets, "t").groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("own"))
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    return every.agg(
        F.sort_array(F.collect_list(F.struct("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("own", F.lit(0)).alias("own")))).alias("rows"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("own"), F.lit(0)).alias("m"),
    )


def bucket_weights(rows: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    """Of bucket_counts(), one row, one array: the log ratio of each bucket."""
    ratio = F.transform(
        "rows",
        lambda r: F.log((r["own"] + smoothing) / (r["raw"] * F.col("m") / F.col("n") + smoothing)),
    )
    return rows.select(F.when(F.col("m") > 0, ratio).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("weights"))


def _counts(rows: DataFrame) -> DataFrame:
    """Of bucket_counts(), one row, a struct: raw and own as arrays by bucket, n and m."""
    return rows.select(F.struct(F.transform("rows", lambda r: r["raw"]).alias("raw"), F.transform("rows", lambda r: r["own"]).alias("own"), "n", "m").alias("counts"))


def _alone(buckets: int, smoothing: float) -> Column:
    """The score of a trusted document (column __pl_w) by counts (__pl_k) without its own n-grams, so that it stands for one that was not trained on."""
    pairs = lambda w: F.zip_with(_part(w, 0, 1), _part(w, 1, 1), lambda x, y: _bucket(buckets, x, y))
    grams = F.sort_array(F.concat(F.transform("__pl_w", lambda x: _bucket(buckets, x)), pairs(F.col("__pl_w"))))
    # Equal buckets are neighbours: where each begins, and how often it comes.
    firsts = lambda g: F.filter(F.transform(g, lambda x, i: F.when(~x.eqNullSafe(F.get(g, i - 1)), i)), lambda i: i.isNotNull())
    runs = lambda g: let(firsts(g), lambda f: F.transform(f, lambda p, j: F.struct(F.get(g, p).alias("b"), (F.coalesce(F.get(f, j + 1), F.size(g)) - p).alias("k"))))
    told = lambda v: lambda g: F.transform(runs(g), lambda r: r["k"] * F.log((F.get(v["own"], r["b"]) - r["k"] + smoothing) / (F.get(v["raw"], r["b"]) * (v["m"] - F.size(g)) / v["n"] + smoothing)))
    return let(F.col("__pl_k"), lambda v: let(grams, lambda g: F.aggregate(told(v)(g), F.lit(0.0), lambda a, x: a + x) / F.size(g)))


def edge(values: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact quantiles, linear between neighbours, of a column that no task holds whole."""
    last = values.count() - 1
    at = [q * last for q in shares]
    found = values_at(values, column, [int(p + up) if p % 1 else int(p) for p in at for up in (0, 1)])
    return [low + (high - low) * (p % 1) for p, low, high in zip(at, found[::2], found[1::2], strict=True)]


def learned_threshold(measured: DataFrame) -> float:
    """Midway between the scores of all good and all bad labelled documents that pass the base rules, EDGE of each left aside; never above the good ones' edge.

    measured: __pl_good (1 good, 0 bad, else null) and __pl_loo, the score of a good document by counts without its own n-grams.
    """
    passed = measured.where("not __quality.base_failed").select("__pl_good", F.when(F.col("__pl_good") == 1, F.col("__pl_loo")).otherwise(F.col("__quality.score")).alias("s"))
    good, bad = passed.where("__pl_good = 1"), passed.where("__pl_good = 0")
    if min(good.count(), bad.count()) < LEAST_LABELLED:
        return MIN_SCORE
    (low,), (high,) = edge(good, "s", [EDGE]), edge(bad, "s", [1 - EDGE])
    return min((low + high) / 2, low)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING, min_score: float | None = None, trusted_rows: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (of them the columns `keep`, if given) with one more column `__quality`: a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    score, base_failed, kept.

    labels: doc_id and quality; a document is trusted if all its labels are 1, or the first trusted_rows of them. min_score: learned where not given. Then what is
    measured is a table, from which the threshold is taken before it is read again.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q")).where("q in (0, 1) and id is not null")
    trusted = marks.where("q = 1").select("id")
    if trusted_rows is not None:
        trusted = trusted.orderBy(F.xxhash64("id"), "id").limit(trusted_rows)
    rows = store(bucket_counts(docs, trusted, id_col, text_col, buckets), "buckets")
    weights = bucket_weights(rows, buckets, smoothing)
    names = [F.col(f"`{c}`") for c in (keep or docs.columns)]
    if min_score is not None:
        return _measured(docs, weights, text_col, buckets, min_score).select(*names, "__quality")
    given = trusted.select("id", F.lit(1).alias("good")).unionByName(marks.where("q = 0").select("id", F.lit(0).alias("good")))
    told = marked(docs.withColumn("__pl_id", docs[id_col].cast("long")), given).select(*[F.col(f"`{c}`") for c in docs.columns], "__pl_good")
    measured = store(_measured(told, weights, text_col, buckets, MIN_SCORE, (_counts(rows), _alone(buckets, smoothing))).select(*names, "__pl_good", "__pl_loo", "__quality"), "measured")
    least = learned_threshold(measured)
    passed = ~F.col("__quality.base_failed") & (F.col("__quality.score") >= least)
    return measured.select(*names, F.col("__quality").withField("kept", passed).alias("__quality"))


def _measured(docs: DataFrame, weights: DataFrame, text_col: str, buckets: int, min_score: float, alone: tuple[DataFrame, Column] | None = None) -> DataFrame:
    """docs with the column `__quality` of score(). alone: counts (__pl_k), and a score of __pl_w by them for those with __pl_good = 1, as __pl_loo."""
    text = F.coalesce(F.col("__pl_q.text"), F.lit(""))
    kept_names = [F.col(f"`{c}`") for c in docs.columns]
    step = docs.select("*", F.struct(docs[text_col].cast("string").alias("text")).alias("__pl_q"))
    step = step.select(*kept_names, text.alias("__pl_t"), words(text).alias("__pl_w"))
    lines = F.filter(F.split(F.col("__pl_t"), "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANK))) > 0)
    # Windows of three words: a hash above, the position below; equal hashes meet in sorted order.
    n = F.greatest(F.size("__pl_w") - 2, F.lit(0))
    hashed = lambda w: F.zip_with(F.zip_with(_part(w, 0, 2), _part(w, 1, 2), lambda x, y: F.xxhash64(x, y)), _part(w, 2, 2), lambda h, z: F.xxhash64(h, z))
    step = step.select(
        *kept_names,
        "__pl_w",
        F.length(F.array_join("__pl_w", "")).cast("long").alias("__pl_chars"),
        F.length(F.regexp_replace("__pl_t", "[^#*$%&|<>]+", "")).cast("long").alias("__pl_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("__pl_dups"),
        F.length(F.bin(n)).alias("__pl_b"),
        F.when(n > 0, let(F.col("__pl_w"), hashed)).alias("__pl_h"),
    )
    place = lambda b: F.transform("__pl_h", lambda h, i: F.call_function("shiftleft", h, b).bitwiseOR(i.cast("long")))
    step = step.withColumn("__pl_h", let(F.col("__pl_b"), place))
    step = step.withColumn("__pl_h", F.sort_array("__pl_h"))
    over = lambda x, b: F.call_function("shiftright", x, b)
    apart = lambda x, y, b: F.call_function("shiftrightunsigned", x.bitwiseXOR(y), b)
    met = let(F.col("__pl_h"), lambda h: let(F.col("__pl_b"), lambda b: F.filter(h, lambda x, i: (apart(x, F.get(h, i + 1), b) == 0) | (apart(x, F.get(h, i - 1), b) == 0))))
    # The few that met are compared as text, so that a chance meeting of hashes does not count.
    step = step.withColumn("__pl_m", met)
    exact = let(
        F.struct(F.col("__pl_w").alias("w"), F.col("__pl_b").alias("b")),
        lambda s: F.transform(F.col("__pl_m"), lambda x: let((x - F.call_function("shiftleft", over(x, s["b"]), s["b"])).cast("int"), lambda p: F.struct(F.concat_ws(" ", F.get(s["w"], p), F.get(s["w"], p + 1), F.get(s["w"], p + 2)).alias("k"), p.alias("p")))),
    )
    step = step.withColumn("__pl_m", F.sort_array(exact))
    same = let(F.col("__pl_m"), lambda m: F.transform(F.filter(m, lambda x, i: (x["k"] == F.get(m, i + 1)["k"]) | (x["k"] == F.get(m, i - 1)["k"])), lambda x: x["p"]))
    covered = let(F.sort_array(same), lambda q: F.aggregate(F.transform(q, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    add = lambda a, x: a + x
    total = let(
        F.struct(F.col("__pl_w").alias("w"), F.col("__pl_v").alias("v")),
        lambda s: let(
            s["v"],
            lambda v: F.aggregate(F.zip_with(s["w"], F.slice(s["w"], 2, F.greatest(F.size(s["w"]), F.lit(1))), lambda x, y: F.get(v, _bucket(buckets, x)) + F.when(y.isNotNull(), F.get(v, _bucket(buckets, x, y))).otherwise(0.0)), F.lit(0.0), add),
        ),
    )
    count = F.size("__pl_w").cast("long")
    # Used once below, so that the optimiser puts the subquery's value there and no row carries the array.
    step = step.select("*", weights.scalar().alias("__pl_v"), *([] if alone is None else [alone[0].scalar().alias("__pl_k")]))
    step = step.select(
        *kept_names,
        count.alias("__pl_n"),
        "__pl_chars",
        "__pl_symbols",
        "__pl_dups",
        F.coalesce(covered.cast("long"), F.lit(0).cast("long")).alias("__pl_rep"),
        F.when(count > 0, total / (2 * count - 1)).otherwise(0.0).alias("__pl_score"),
        *([] if alone is None else [F.when((F.col("__pl_good") == 1) & (count > 0), alone[1]).alias("__pl_loo")]),
    )
    failed = (F.col("__pl_n") < MIN_WORDS) | (100 * F.col("__pl_rep") > MAX_REPEATED * F.col("__pl_n"))
    return step.select(
        *kept_names,
        *([] if alone is None else ["__pl_loo"]),
        F.struct(
            F.col("__pl_n").alias("n_words"), F.col("__pl_chars").alias("word_chars"), F.col("__pl_symbols").alias("n_symbols"), F.col("__pl_dups").alias("n_dup_lines"),
            F.col("__pl_rep").alias("n_repeat_words"), F.col("__pl_score").alias("score"), failed.alias("base_failed"), (~failed & (F.col("__pl_score") >= min_score)).alias("kept"),
        ).alias("__quality"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that pass, with their own columns.

    A plain filter would be pushed below the steps above and repeat each of them where it is used; a generator is not.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    return score(docs, labels, **options).select(*names, F.explode(F.when(F.col("__quality.kept"), F.array(F.lit(1)))).alias("__pl_one")).select(*names)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    q = [F.col(f"__quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")]
    return score(docs.select("doc_id", "text"), labels, keep=["doc_id"]).select("doc_id", *q)


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
