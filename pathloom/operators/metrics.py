"""Counts over findings and quality measures over labelled corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.catalog import POSITIVE, VERIFIED


def status_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("status").agg(F.count("*").alias("n"), F.bool_or(F.col("status").isin(VERIFIED)).alias("verified"))


def findings_per_file(changed: DataFrame, findings: DataFrame) -> DataFrame:
    """Each changed file with its number of findings and a label: issue if any is verified, note if any, else clean."""
    by = findings.groupBy(F.col("snk_file").alias("file_path")).agg(F.count("*").alias("n"), F.bool_or(F.col("status").isin(VERIFIED)).alias("v"))
    label = F.when(F.col("v"), "issue").when(F.col("n") > 0, "note").otherwise("clean")
    return changed.select("file_path").distinct().join(by, "file_path", "left").select("file_path", F.coalesce("n", F.lit(0)).alias("n_findings"), label.alias("label"))


def risk_card(findings: DataFrame) -> DataFrame:
    """One row: verified, likely and advisory counts, the level and the exit code."""
    n = findings.agg(
        F.count_if(F.col("status").isin(VERIFIED)).alias("n_verified"), F.count_if(F.col("status") == "LIKELY").alias("n_likely"), F.count_if(F.col("status") == "ADVISORY").alias("n_advisory")
    )
    v, k = F.col("n_verified") > 0, F.col("n_likely") > 0
    return n.select("*", F.when(v, "HIGH").when(k, "MEDIUM").otherwise("LOW").alias("risk"), F.when(v, 1).when(k, 2).otherwise(0).alias("exit_code"))


def confusion(cases: DataFrame, findings: DataFrame, key: str, truth: str, failed: str | None = None, least_confidence: float | None = None) -> DataFrame:
    """One row of tp, fp, tn, fn. A case is predicted positive if any finding of it is; a failed case counts against us.

    least_confidence: findings of less count for cases that are false only.
    """
    sure = F.lit(True) if least_confidence is None else F.coalesce(F.col("confidence") >= least_confidence, F.lit(False))
    found = findings.where(F.col("status").isin(POSITIVE)).groupBy(key).agg(F.max(sure).alias("__sure"), F.lit(True).alias("__p"))
    said = F.when(F.col(truth), F.coalesce("__sure", F.lit(False))).otherwise(F.coalesce("__p", F.lit(False)))
    if failed:
        said = F.when(F.col(failed), ~F.col(truth)).otherwise(said)
    rows = cases.join(found, key, "left").select(F.col(truth).alias("t"), said.alias("p"))
    return rows.agg(
        F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(~F.col("t") & ~F.col("p")).alias("tn"), F.count_if(F.col("t") & ~F.col("p")).alias("fn")
    )


def rates(counts: DataFrame, digits: int = 3) -> DataFrame:
    """precision, recall, f1 and fpr, 0 where nothing was counted."""
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = part(F.col("tp"), F.col("tp") + F.col("fp")), part(F.col("tp"), F.col("tp") + F.col("fn"))
    f1, fpr = part(2 * p * r, p + r), part(F.col("fp"), F.col("fp") + F.col("tn"))
    return counts.select("*", *[F.round(c, digits).alias(n) for n, c in (("precision", p), ("recall", r), ("f1", f1), ("fpr", fpr))])


def participants(path_files: Column) -> Column:
    """Distinct base names in the order of their first appearance."""
    return F.array_distinct(F.transform(path_files, lambda f: F.element_at(F.split(f, "/"), -1)))


def adjacent_pairs(paths: DataFrame, key: list[str], nodes: str) -> DataFrame:
    """(key.., pos, a, b, crosses): neighbouring elements of an array of (name, file)."""
    n = F.size(nodes)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(i.alias("pos"), F.element_at(nodes, i).alias("a"), F.element_at(nodes, i + 1).alias("b"))))
    return paths.select(*key, F.explode(pairs).alias("p")).select(*key, "p.pos", "p.a", "p.b")


def case_groups(files: DataFrame, column: str, suffix: str) -> DataFrame:
    """Files by the name that is left without a suffix."""
    return files.groupBy(F.regexp_replace(column, suffix, "").alias("case_id")).agg(F.count("*").alias("n_files"))


def chain_edges(events: DataFrame, key: list[str], order: list[str], node: str) -> DataFrame:
    """Edges from each row of a key to the next."""
    return events.select(F.col(node).alias("src"), F.lead(node).over(Window.partitionBy(*key).orderBy(*order)).alias("dst")).where("dst is not null")
