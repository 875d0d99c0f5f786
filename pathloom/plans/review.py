"""A whole review: graph in, findings and reports out, as plain composition of the operators.

What comes from outside (model answers, scanners, sandbox runs, context scores) are input tables; where one is absent,
its step changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import catalog
from pathloom.functions.tables import dealt_over, written
from pathloom.operators import constraints, export, filters, metrics, paths, requests, rules, scan_runner, scoring, states


#: Kept paths where no number is given: the most that a top-k takes.
MANY = (1 << 31) - 2


@dataclass
class ReviewInputs:
    """nodes, edges: the graph. files: file_path, text. changed: file_path, ord. The rest is optional, as is a column scope of nodes, inside of which calls resolve:

    scan_findings: file_path, rule_id, severity, line_number, explanation. unanswered: file_path of scans that were asked for and
    refused; the texts of these files are searched for the words of their critical rules instead. context_scores: finding_id, score.
    sandbox_runs: finding_id, passed, sanitizer, compilation_error. suppressions: file_path, line_number, rule_id.
    fuzz: path_id, crashed. ranking: path_id, rank. manifests: file_name, text. scan: a function (file_path, text) -> (rule_id, severity,
    line_number, explanation) each, called for the first scan_files files by priority under scan_budget; what it refuses or fails on counts as unanswered.
    """

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    changed: DataFrame
    rules: list[catalog.Rule] = field(default_factory=lambda: list(catalog.DEFAULT_RULES))
    sources: list[str] = field(default_factory=list)
    sinks: list[str] = field(default_factory=list)
    scan_findings: DataFrame | None = None
    context_scores: DataFrame | None = None
    sandbox_runs: DataFrame | None = None
    suppressions: DataFrame | None = None
    fuzz: DataFrame | None = None
    ranking: DataFrame | None = None
    manifests: DataFrame | None = None
    scoped: bool = False
    unanswered: DataFrame | None = None
    scan: Callable[[str, str], Iterable[tuple]] | None = None
    scan_budget: scan_runner.Budget = scan_runner.Budget()
    scan_files: int = 40
    max_hops: int = 15
    most_paths: int | None = 100


def _scans(spark: SparkSession, given: ReviewInputs) -> DataFrame:
    """What the scan function says of the files that come first."""
    mine = rules.rules_for_files(given.files, catalog.rules_frame(spark, given.rules))
    chosen = scoring.scan_priority(given.files, given.changed, mine, given.scan_files)
    asked = requests.scan_requests(given.files, chosen).join(chosen.select("file_path", (-F.col("score")).alias("ord")), "file_path")
    return scan_runner.run_scans(asked, given.scan, given.scan_budget, ["ord"])


def run_review(spark: SparkSession, given: ReviewInputs, dry_run: bool = False) -> dict[str, DataFrame]:
    """Frames by name: paths, findings, dropped, results, card, files, unreported, report, errors.

    errors (step, message): a failed path search is told there, and the review goes on without paths.
    """
    frameworks = catalog.detect_frameworks(given.manifests) if given.manifests is not None else None
    sources = catalog.names(spark, [*catalog.SOURCES, *given.sources])
    sinks = catalog.names(spark, [*catalog.SINKS, *given.sinks])
    if frameworks is not None:
        extra = catalog.framework_frame(spark).where("kind = 'sink'").join(frameworks, "framework", "left_semi").select("name")
        sinks = sinks.union(extra).distinct()
    failed = []
    try:
        found = paths.find_paths(given.nodes, given.edges, sources, sinks, given.changed if given.scoped else None, given.max_hops, most=given.most_paths, within="scope" if "scope" in given.nodes.columns else None)
    except AnalysisException as e:
        # The inputs cannot be searched. What else may fail, a lost executor for one, is no result and goes up.
        failed.append(("paths", f"{type(e).__name__}: {e.getCondition() or ''} {str(e).splitlines()[0]}"))
        empty = spark.createDataFrame([], "node_id string, file_path string, function_name string, line_start int, node_type string")
        found = paths.project(spark.createDataFrame([], "path array<string>, path_len int"), empty)
    found = found.withColumn("path_id", F.sha2(F.concat_ws(">", "path"), 256))
    ruled = rules.annotate(found, catalog.keywords_frame(spark, given.rules))
    score = scoring.path_score(F.col("crosses_files"), F.col("snk_func"), F.col("rule_severity"), F.size("intermediate_nodes"))
    pruned = scoring.prune(ruled.withColumn("pruner_score", score), ["path_len", "path_id"], keep=given.most_paths or MANY, ranking=given.ranking)
    if given.most_paths is None:
        pruned = pruned.repartition(dealt_over(spark), "path_id")  # constraints cost far more than their rows are large
    pruned = written(pruned, "paths")
    findings = constraints.to_findings(pruned.where("not was_pruned"), given.nodes.select("node_id", "code"), given.fuzz).withColumn("finding_id", F.col("path_id"))

    columns = ["file_path", "rule_id", "severity", "line_number", "explanation", "confidence"]
    answers, told, unanswered = None, given.scan_findings, given.unanswered
    if given.scan is not None:
        ran = _scans(spark, given)
        either = lambda a, b: b if a is None else a.select(b.columns).unionByName(b)
        told, unanswered = either(told, scan_runner.answers_of(ran)), either(unanswered, scan_runner.unanswered(ran))
    if told is not None:
        answers = told.withColumn("confidence", scoring.explanation_confidence(F.col("severity"), F.col("explanation"))).select(columns)
    if unanswered is not None:
        asked = given.files.join(unanswered.select("file_path"), "file_path", "left_semi")
        mine = rules.rules_for_files(asked, catalog.rules_frame(spark, given.rules)).select("file_path", "rule_id")
        hits = rules.search_text(asked, catalog.keywords_frame(spark, given.rules)).join(mine, ["file_path", "rule_id"], "left_semi")
        told = F.concat(F.lit("text search: "), "rule_id", F.lit(" — "), "keyword", F.lit(" in "), "file_path")
        hits = hits.select("file_path", "rule_id", F.lit("CRITICAL").alias("severity"), "line_number", told.alias("explanation"), "confidence")
        answers = hits if answers is None else answers.unionByName(hits)
    if answers is not None:
        scans = filters.deep_scan_findings(answers, F.col("confidence"))
        none = findings.schema["intermediate_nodes"].dataType
        scans = scans.withColumns(
            {"finding_id": F.col("src_id"), "path_id": F.col("src_id"), "intermediate_nodes": F.array().cast(none), "crosses_files": F.lit(False), "formula": F.lit(""), "requires_msan": F.lit(False)}
        )
        findings = filters.merge_scans(findings, scans, ["snk_file", "snk_line", "snk_func"], ["finding_id"])
    lines = given.files.select("file_path", F.posexplode(F.split("text", "\r?\n")).alias("p", "line")).select("file_path", (F.col("p") + 1).alias("line_number"), "line")
    checked = written(filters.drop_false_positives(findings, filters.safe_names(spark, frameworks=frameworks), lines), "findings")
    kept = checked.where("not dropped").drop("dropped")
    if given.context_scores is not None:
        kept = filters.rescore(kept, given.context_scores, "finding_id")
    unreported = filters.unreported_files(given.changed, kept)
    if given.sandbox_runs is not None:
        kept = states.transition(kept, given.sandbox_runs, "finding_id", dry_run)
    if given.suppressions is not None:
        kept = filters.suppress(kept, given.suppressions)
    return {
        "paths": pruned,
        "findings": kept,
        "dropped": checked.where("dropped"),
        "results": export.result_rows(kept),
        "card": metrics.risk_card(kept),
        "files": metrics.findings_per_file(given.changed, kept),
        "unreported": unreported,
        "report": export.report_sections(kept, given.changed),
        "errors": spark.createDataFrame(failed, "step string, message string"),
    }
