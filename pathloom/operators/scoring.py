"""Scores, cuts and confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sinks that weigh more; words that raise or lower the confidence in an explanation.
WEIGHTY_SINKS = ["memcpy", "free", "strcpy", "strcat", "sprintf", "system"]
SINK_WORDS = ["memcpy", "strcpy", "strcat", "sprintf", "system", "free", "malloc", "eval", "exec", "deserialize", "readfile", "delete"]
HEDGES = ["may", "might", "could", "possibly", "potentially", "unclear", "uncertain", "not sure", "depends"]


def path_score(crosses_files: Column, sink: Column, severity: Column, inner: Column) -> Column:
    """3 across files, 2 for a weighty sink, 1 if critical, less 1 beyond ten nodes."""
    one = lambda test, weight: F.when(test, F.lit(weight)).otherwise(0.0)
    return one(crosses_files, 3.0) + one(sink.isin(WEIGHTY_SINKS), 2.0) + one(severity == "CRITICAL", 1.0) - one(inner + 2 > 10, 1.0)


def prune(paths: DataFrame, order: list[Column | str], keep: int = 100, ranking: DataFrame | None = None, key: str = "path_id") -> DataFrame:
    """paths (with pruner_score) and was_pruned: all but the first `keep` by score, then `order` (a total one).

    ranking (key, rank): for more than `keep` paths, an outside order of the first 2 * keep; those without a rank follow.
    The cut is a top-k, so no task holds all paths in order.
    """
    if keep >= (1 << 31) - 2:
        return paths.withColumn("was_pruned", F.lit(False))
    best = [F.desc("pruner_score"), *order]
    if ranking is None or paths.count() <= keep:
        top = paths.orderBy(*best).limit(keep).select(key)
    else:
        first = paths.orderBy(*best).limit(2 * keep).withColumn("__ord", F.row_number().over(Window.orderBy(*best)))
        top = first.join(ranking, key, "left").orderBy(F.col("rank").asc_nulls_last(), "__ord").limit(keep).select(key)
    return paths.join(F.broadcast(top.withColumn("__in", F.lit(True))), key, "left").withColumn("was_pruned", F.col("__in").isNull()).drop("__in")


def scan_priority(files: DataFrame, changed: DataFrame, file_rules: DataFrame, most: int = 40) -> DataFrame:
    """The files to scan first: 10 if changed, 3 for C and C++, 2 for Python and scripts, a half per critical rule."""
    critical = file_rules.where("severity = 'CRITICAL'").groupBy("file_path").agg(F.count("*").alias("n_critical"))
    ext = F.regexp_extract("file_path", r"(\.[^./]+)$", 1)
    by_type = F.when(ext.isin(".cpp", ".cc", ".c"), 3.0).when(ext.isin(".py", ".ts", ".js"), 2.0).otherwise(0.0)
    rows = files.select("file_path").join(changed.select("file_path").distinct().withColumn("__changed", F.lit(10.0)), "file_path", "left").join(critical, "file_path", "left")
    score = F.coalesce("__changed", F.lit(0.0)) + by_type + 0.5 * F.coalesce("n_critical", F.lit(0))
    return rows.select("file_path", score.alias("score")).orderBy(F.desc("score"), "file_path").limit(most)


def queue_priority(n_files: Column) -> Column:
    return F.when(n_files <= 5, 9).when(n_files <= 20, 5).otherwise(1)


def explanation_confidence(severity: Column, explanation: Column, hedge: float = 0.05) -> Column:
    """Confidence in an outside finding from its words, in four steps, each with its own bound; two digits."""
    text = F.lower(F.coalesce(explanation, F.lit("")))
    has = lambda words: F.greatest(*[F.contains(text, F.lit(w)).cast("int") for w in words]) == 1
    c = F.when(F.upper(F.coalesce(severity, F.lit(""))) == "ADVISORY", F.lit(0.75)).otherwise(0.88)
    c = F.when(has(SINK_WORDS), F.least(c + 0.07, F.lit(0.95))).otherwise(c)
    c = F.when(text.rlike(r"\bline\s+[0-9]+\b"), F.least(c + 0.03, F.lit(0.95))).otherwise(c)
    c = F.when(F.length(F.trim(text)) < 30, F.greatest(c - 0.20, F.lit(0.50))).otherwise(c)
    c = F.when(has(HEDGES), F.greatest(c - hedge, F.lit(0.55))).otherwise(c)
    return F.round(c, 2)
