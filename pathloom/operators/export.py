"""Findings as exchange documents and report parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.catalog import POSITIVE, VERIFIED
from pathloom.operators.metrics import findings_per_file, participants, risk_card
from pathloom.operators.requests import WALKTHROUGH_FILES

# Least confidence, level by status, and phrases of proofs that deny a finding.
LEAST_CONFIDENCE = 0.85
LEVEL_OF = {"PROVEN": "error", "SANDBOX_VERIFIED": "error", "FUZZ_VERIFIED": "warning", "LIKELY": "note"}
DENIALS = [
    "no use-after-free", "no double-free", "no uninitialized", "not detected", "no raw malloc", "no bstr", "no complex com", "no c-style cast", "no raw new", "no exception",
]


def reportable(status: Column, confidence: Column, proof: Column) -> Column:
    low = F.lower(F.coalesce(proof, F.lit("")))
    denied = F.lit(False)
    for phrase in DENIALS:
        denied = denied | F.contains(low, F.lit(phrase))
    return status.isin(POSITIVE) & (confidence >= LEAST_CONFIDENCE) & ~denied


def fingerprint(file: Column, line: Column, rule: Column, default: str = "memory-safety") -> Column:
    return F.substring(F.sha2(F.concat_ws(":", file, line.cast("string"), F.when(F.coalesce(rule, F.lit("")) == "", default).otherwise(rule)), 256), 1, 32)


def result_rows(findings: DataFrame, tool: str = "pathloom") -> DataFrame:
    """One flat row per reportable finding."""
    level = F.create_map(*[F.lit(x) for pair in LEVEL_OF.items() for x in pair])
    rule = F.coalesce("rule_id", F.lit(""))
    return findings.where(reportable(F.col("status"), F.col("confidence"), F.col("formula"))).select(
        F.when(rule == "", f"{tool}/memory-safety").otherwise(rule).alias("rule"), level[F.col("status")].alias("level"), F.col("summary").alias("message"), F.col("snk_file").alias("uri"),
        F.greatest("snk_line", F.lit(1)).alias("start_line"), F.col("src_file").alias("source_uri"), F.greatest("src_line", F.lit(1)).alias("source_line"),
        fingerprint(F.col("snk_file"), F.col("snk_line"), F.col("rule_id")).alias("fingerprint"), F.round("confidence", 2).alias("confidence"), F.col("formula").alias("proof"),
    )


def sarif_results(findings: DataFrame, tool: str = "pathloom") -> DataFrame:
    """Each result of the SARIF 2.1.0 format as a JSON string `result`; the document is sarif_document()."""
    place = lambda uri, line: F.struct(F.struct(F.col(uri).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct(F.col(line).alias("startLine")).alias("region"))
    text = lambda c: F.struct(c.alias("text"))
    row = F.struct(
        F.col("rule").alias("ruleId"), "level", text(F.col("message")).alias("message"), F.array(F.struct(place("uri", "start_line").alias("physicalLocation"))).alias("locations"),
        F.array(F.struct(F.lit(0).alias("id"), text(F.lit("taint source")).alias("message"), place("source_uri", "source_line").alias("physicalLocation"))).alias("relatedLocations"),
        F.struct(F.col("fingerprint").alias("primaryLocationLineHash/v1")).alias("partialFingerprints"), F.struct("confidence", F.col("proof").alias("z3Proof")).alias("properties"),
    )
    return result_rows(findings, tool).select(F.to_json(row).alias("result"))


def sarif_document(findings: DataFrame, tool: str = "pathloom", version: str = "0.1.0") -> str:
    """The whole document. Findings of one review are few; for more, write sarif_results() as files."""
    import json

    results = [json.loads(r.result) for r in sarif_results(findings, tool).toLocalIterator()]
    driver = {"name": tool, "version": version}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=2)


def sequence_lines(findings: DataFrame, key: str) -> DataFrame:
    """Per verified finding across files and of two nodes or more: participants and numbered arrows, as diagram lines."""
    nodes = F.concat(F.array(F.struct(F.col("src_func").alias("name"), F.col("src_file").alias("file"))), F.transform("intermediate_nodes", lambda n: F.struct(n["function_name"].alias("name"), n["file_path"].alias("file"))), F.array(F.struct(F.col("snk_func").alias("name"), F.col("snk_file").alias("file"))))
    base = lambda f: F.element_at(F.split(f, "/"), -1)
    arrow = lambda i: F.concat(base(F.element_at("n", i)["file"]), F.when(F.element_at("n", i)["file"] == F.element_at("n", i + 1)["file"], "->>+").otherwise("->>"), base(F.element_at("n", i + 1)["file"]), F.lit(": "), F.element_at("n", i + 1)["name"])
    rows = findings.where(F.col("status").isin(VERIFIED) & F.col("crosses_files")).select(key, nodes.alias("n")).where("size(n) >= 2")
    parts = F.transform(participants(F.transform("n", lambda x: x["file"])), lambda p: F.concat(F.lit("participant "), p))
    return rows.select(key, F.array_join(F.concat(F.array(F.lit("sequenceDiagram")), parts, F.transform(F.sequence(F.lit(1), F.size("n") - 1), arrow)), "\n").alias("diagram"))


def comment_rows(fixes: DataFrame, most: int = 3800) -> DataFrame:
    """Review comments (file_path, line_end, body) of fixes with a file and a line; bodies are cut."""
    return fixes.where("coalesce(file_path, '') <> '' and coalesce(line_end, 0) > 0").select("file_path", "line_end", F.substring("body", 1, most).alias("body"))


def advisory_line(sink: Column, file: Column, rule: Column, summary: Column) -> Column:
    return F.format_string("- `%s` in `%s` (rule `%s`): %s", sink, file, F.coalesce(rule, F.lit("")), summary)


def file_walkthrough(changed: DataFrame, findings: DataFrame, summaries: DataFrame | None = None, most: int = WALKTHROUGH_FILES, order: str = "ord") -> DataFrame:
    """A table row (ord, line) for each of the first changed files (file_path, ord): what it is (summaries: file_path,
    summary; a dash where unknown) and what was found in it."""
    first = changed.orderBy(order).limit(most).select("file_path", F.col(order).alias("ord"))
    per = findings_per_file(first, findings)
    rows = first.join(per, "file_path")
    if summaries is not None:
        rows = rows.join(summaries.select("file_path", F.replace("summary", F.lit("|"), F.lit("·")).alias("summary")), "file_path", "left")
    else:
        rows = rows.withColumn("summary", F.lit(None).cast("string"))
    found = F.when(F.col("label") == "issue", F.format_string("%d issue(s)", "n_findings")).when(F.col("label") == "note", F.format_string("%d note(s)", "n_findings")).otherwise("clean")
    return rows.select("ord", F.format_string("| `%s` | %s | %s |", "file_path", F.coalesce("summary", F.lit("—")), found).alias("line"))


def card_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """The lines (ord, line) of the card at a report's head."""
    counts = risk_card(findings).crossJoin(changed.agg(F.count_distinct("file_path").alias("n_files")))  # one row each
    parts = [("Risk level", F.col("risk")), ("Verified bugs", F.col("n_verified")), ("Likely bugs", F.col("n_likely")), ("Advisory notes", F.col("n_advisory")), ("Files reviewed", F.col("n_files"))]
    lines = F.array(*[F.struct(F.lit(k).cast("long").alias("ord"), F.format_string(f"| %s | %s |", F.lit(n), c.cast("string")).alias("line")) for k, (n, c) in enumerate(parts)])
    return counts.select(F.explode(lines).alias("l")).select("l.*")


def report_sections(findings: DataFrame, changed: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """(ord, section, file, line_no, line): a report's lines; in order of ord, file, line_no. Lines are numbered per file, so that a section
    meets no single task. Each finding stands in one section only. changed (file_path, ord): adds the card and the walkthrough."""
    status = F.col("status")
    section = F.when(status.isin(VERIFIED), F.struct(F.lit(3).alias("ord"), F.lit("Issues").alias("section"))).when(status == "LIKELY", F.struct(F.lit(4).alias("ord"), F.lit("Likely issues").alias("section"))).when(status == "ADVISORY", F.struct(F.lit(5).alias("ord"), F.lit("Advice").alias("section")))
    issue = F.format_string("- %s:%d %s (%.2f)", "snk_file", "snk_line", "summary", "confidence")
    line = F.when(status == "ADVISORY", advisory_line(F.col("snk_func"), F.col("snk_file"), F.col("rule_id"), F.col("summary"))).otherwise(issue)
    rows = findings.select(section.alias("s"), F.col("snk_file").alias("file"), line.alias("line")).where("s is not null").select("s.*", "file", "line")
    rows = rows.withColumn("line_no", F.row_number().over(Window.partitionBy("ord", "file").orderBy("line")))
    columns = ["ord", "section", "file", "line_no", "line"]
    if changed is None:
        return rows.select(columns)
    head = card_lines(findings, changed).select(F.lit(1).alias("ord"), F.lit("Card").alias("section"), F.lit("").alias("file"), (F.col("ord") + 1).cast("int").alias("line_no"), "line")
    walk = file_walkthrough(changed, findings, summaries).select(F.lit(2).alias("ord"), F.lit("Walkthrough").alias("section"), F.lit("").alias("file"), (F.col("ord") + 1).cast("int").alias("line_no"), "line")
    return head.unionByName(walk).unionByName(rows.select(columns))


def write_json(frames: dict[str, DataFrame], to: str) -> None:
    """Each frame of a review, or of an evaluation, as JSON lines below `to`."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{to}/{name}")
