"""Reviews of labelled cases, and how often they are right."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.tables import written
from pathloom.operators import metrics
from pathloom.plans.review import ReviewInputs, run_review
from pathloom.sources.extract import extract_graph


def evaluate(spark: SparkSession, cases: DataFrame, given: ReviewInputs | None = None, ending: str = ".c", least_confidence: float | None = None) -> dict[str, DataFrame]:
    """cases: case_id, code, is_vulnerable, as the corpora give them. Frames by name: findings, confusion, rates.

    All cases are one review in which each is a file of its own, and a scope: names resolve inside their case, so no path leaves it and
    cases that define equal names are judged as each would be alone. given: a review's further inputs; its graph, files and changed files
    are replaced. least_confidence: what a finding must have to count for a vulnerable case (for a sound one any counts); by default none.
    """
    rows = written(cases.select("case_id", "code", "is_vulnerable"), "cases")
    files = rows.select(F.concat("case_id", F.lit(ending)).alias("file_path"), F.col("code").alias("text"), F.col("case_id").alias("scope"))
    nodes, edges = extract_graph(files, "cases")
    changed = files.select("file_path", F.monotonically_increasing_id().alias("ord"))
    inputs = ReviewInputs(nodes, edges, files, changed) if given is None else replace(given, nodes=nodes, edges=edges, files=files, changed=changed)
    inputs.most_paths = None
    found = written(run_review(spark, inputs)["findings"], "found")
    found = found.withColumn("case_id", F.expr(f"substring(snk_file, 1, length(snk_file) - {len(ending)})"))
    counts = metrics.confusion(rows, found, "case_id", "is_vulnerable", least_confidence=least_confidence)
    return {"findings": found, "confusion": counts, "rates": metrics.rates(counts)}
