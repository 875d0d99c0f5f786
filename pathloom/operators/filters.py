"""Findings that are dropped, demoted, merged, re-scored or suppressed.

A finding is a row with at least status, confidence, snk_func, snk_file, snk_line, src_id, snk_id, intermediate_nodes,
rule_id. Each operator reads the columns it names and leaves the rest alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import catalog
from pathloom.functions.tables import written

# Sinks that a safe call on the way does not excuse, sinks that a size test may guard, and such a test.
CERTAIN_SINKS = ["memcpy", "strcpy", "free", "system", "exec", "execve", "sprintf", "gets", "strcat", "pickle.loads", "yaml.load", "eval", "child_process.exec", "Marshal.load"]
GUARDED_SINKS = ["memcpy", "memmove", "strncpy", "memset"]
GUARD = r"(?i)if\s*\([^)]*(len|size|length|sizeof|strlen|count|n)\s*[<>=!]=?\s*[0-9]"

#: Lines of a block, lines that a window reaches beyond its first, and the most files whose names are sent to all executors.
BLOCK, REACH, FILES = 64, 11, 100_000


def safe_names(spark, extra: list[str] | None = None, frameworks: DataFrame | None = None) -> DataFrame:
    """`name`: the global list, the listed ones (extra, else the defaults), and the safe calls of detected frameworks."""
    base = catalog.names(spark, [*catalog.SAFE_CALLS, *(catalog.SAFE_LISTED if extra is None else extra)])
    if frameworks is None:
        return base
    table = catalog.framework_frame(spark).where("kind = 'safe'")
    return base.union(table.join(frameworks, "framework", "left_semi").select("name")).distinct()


def drop_false_positives(findings: DataFrame, safe: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """findings with `dropped`, and status and confidence after demotion. safe: name. lines: file_path, line_number, line.

    In order: a safe sink is dropped; a proven finding that passes a safe call becomes LIKELY at 0.72 at most, unless its
    sink is certain; a node that is its own source and sink is dropped, unless it is a DeepScan finding, which is done
    here; a proven one whose sink is visibly guarded within ten lines above it becomes WARNING at 0.55 at most.
    """
    names = safe.select(F.collect_set("name").alias("names"))  # a list of names, small by nature
    rows = findings.select("*", F.monotonically_increasing_id().alias("__row"))
    if lines is not None:
        rows = written(rows, "findings")  # the row numbers meet each other below
    listed = [r for r in names.first()["names"]]
    known = F.array(*[F.lit(n) for n in listed]) if listed else F.array().cast("array<string>")
    is_safe = F.array_contains(known, F.col("snk_func"))
    via = F.arrays_overlap(F.transform("intermediate_nodes", lambda n: n["function_name"]), known)
    demoted = F.coalesce(via, F.lit(False)) & ~F.col("snk_func").isin(CERTAIN_SINKS) & (F.col("status") == "PROVEN")
    loop = (F.col("src_id") == F.col("snk_id")) & (F.size("intermediate_nodes") == 0)
    deep = loop & (F.col("snk_func") == "DeepScan")
    rows = rows.withColumns(
        {
            "dropped": is_safe | (loop & ~deep),
            "__deep": deep,
            "confidence": F.when(demoted, F.least("confidence", F.lit(0.72))).otherwise(F.col("confidence")),
            "status": F.when(demoted, "LIKELY").otherwise(F.col("status")),
        }
    )
    if lines is not None:
        rows = _demote_guarded(rows, lines)
    return rows.drop("__row", "__deep")


def _demote_guarded(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines line-9 .. line+2 (from 1) around a guarded sink.

    Lines meet once in blocks, each with as many of the next as a window that begins in it may reach, so that a line is shuffled once or
    twice and not for each window; a window is taken from its block, and only the number of its finding goes on.
    """
    asked = rows.where(F.col("snk_func").isin(GUARDED_SINKS) & (F.col("status") == "PROVEN") & ~F.col("dropped") & ~F.col("__deep"))
    first, last = F.greatest(F.col("snk_line") - 9, F.lit(1)), F.col("snk_line") + 2
    block = lambda c: F.floor(c / BLOCK)
    asked = asked.select("__row", F.col("snk_file").alias("file_path"), first.alias("__a"), last.alias("__b")).withColumn("__blk", block(F.col("__a")))
    files, text = asked.select("file_path").distinct(), lines
    if files.limit(FILES + 1).count() <= FILES:  # before anything is shuffled, only files asked for; more are told apart where blocks meet
        text = text.join(F.broadcast(files), "file_path", "left_semi")
    blocks = F.array_distinct(F.array(block(F.col("line_number")), block(F.greatest(F.col("line_number") - REACH, F.lit(0)))))
    text = text.where("line_number is not null").select("file_path", "line_number", "line", F.explode(blocks).alias("__blk"))
    held = text.groupBy("file_path", "__blk").agg(F.sort_array(F.collect_list(F.struct("line_number", "line"))).alias("__l"))
    held = held.where(F.exists("__l", lambda s: F.coalesce(s["line"].rlike("(?i)if"), F.lit(False))))
    inside = lambda s: s["line_number"].between(F.col("__a"), F.col("__b"))
    window = F.array_join(F.transform(F.filter("__l", inside), lambda s: s["line"]), "\n")
    guarded = asked.join(held, ["file_path", "__blk"]).where(window.rlike(GUARD)).select("__row", F.lit(True).alias("__g"))
    hit = F.col("__g").isNotNull()
    return (
        rows.join(guarded, "__row", "left")
        .withColumns({"status": F.when(hit, "WARNING").otherwise(F.col("status")), "confidence": F.when(hit, F.least("confidence", F.lit(0.55))).otherwise(F.col("confidence"))})
        .drop("__g")
    )


def snippet(text: Column, line: Column, around: int = 15) -> Column:
    """Lines max(0, line - around) .. line + around (from 0, end exclusive), joined."""
    every = F.split(text, "\n")
    first = F.greatest(line - around, F.lit(0))
    return F.array_join(F.slice(every, first + 1, F.greatest(F.least(line + around, F.size(every)) - first, F.lit(0))), "\n")


def deep_scan_findings(responses: DataFrame, confidence: Column) -> DataFrame:
    """Outside findings (file_path, rule_id, severity, line_number, explanation) as findings: CRITICAL is LIKELY, others
    ADVISORY; source and sink are one node named DeepScan, and no rule is set on the path."""
    node = F.sha2(F.concat_ws(":", "file_path", F.col("line_number").cast("string"), "rule_id"), 256)
    critical = F.upper(F.coalesce("severity", F.lit(""))) == "CRITICAL"
    return responses.select(
        node.alias("src_id"), node.alias("snk_id"), F.lit("DeepScan").alias("src_func"), F.lit("DeepScan").alias("snk_func"), F.col("file_path").alias("src_file"), F.col("file_path").alias("snk_file"),
        F.col("line_number").alias("src_line"), F.col("line_number").alias("snk_line"), F.lit("").alias("rule_id"), F.col("severity").alias("rule_severity"),
        F.when(critical, "LIKELY").otherwise("ADVISORY").alias("status"), confidence.alias("confidence"), F.col("explanation").alias("summary"),
    )


def merge_scans(graph: DataFrame, scans: DataFrame, key: list[str], order: list[str], least: float = 0.70, boost: float = 0.10, most: float = 0.99) -> DataFrame:
    """graph findings and the scan findings whose key graph lacks and that are confident enough. The first graph
    finding of a key (by order, a total one) gains `boost` for each scan finding of the key, up to `most`."""
    matched = scans.groupBy(*key).agg(F.count("*").alias("__n"))
    ranked = graph.withColumn("__o", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).join(matched, key, "left")
    raised = F.when((F.col("__o") == 1) & F.col("__n").isNotNull(), F.least(F.col("confidence") + boost * F.col("__n"), F.lit(most))).otherwise(F.col("confidence"))
    kept = ranked.withColumn("confidence", raised).select(*graph.columns)
    new = scans.where(F.col("confidence") >= least).join(graph.select(*key).distinct(), key, "left_anti").select(*scans.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def rescore(findings: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """scores (key, score): PROVEN and LIKELY findings below 0.93 are demoted by their context score: below 0.60 to WARNING,
    a PROVEN one below 0.80 to LIKELY, each at that score. Without a score the finding's own confidence counts."""
    joined = findings.join(scores.select(key, F.col("score").alias("__s")), key, "left")
    asked = F.col("status").isin("PROVEN", "LIKELY") & (F.col("confidence") < 0.93)
    score = F.coalesce("__s", "confidence")
    low, mid = asked & (score < 0.60), asked & (score < 0.80) & (F.col("status") == "PROVEN")
    return joined.withColumns(
        {"status": F.when(low, "WARNING").when(mid, "LIKELY").otherwise(F.col("status")), "confidence": F.when(low | mid, score).otherwise(F.col("confidence"))}
    ).drop("__s")


def unreported_files(changed: DataFrame, findings: DataFrame, most: int | None = 20, order: str = "ord") -> DataFrame:
    """Changed files (file_path, ord) that hold no positive finding, the first `most` of the changed ones."""
    first = changed if most is None else changed.orderBy(order).limit(most)
    bad = findings.where(F.col("status").isin(catalog.POSITIVE)).select(F.col("snk_file").alias("file_path")).distinct()
    return first.join(bad, "file_path", "left_anti")


def suppress(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings that no suppression (file_path, line_number, rule_id) names; line 0 stands for any."""
    r = rules.select(F.col("file_path").alias("__f"), F.col("line_number").alias("__l"), F.col("rule_id").alias("__r")).distinct()
    rule = F.coalesce(findings["rule_id"], F.lit(""))
    same = (findings["snk_file"] == F.col("__f")) & (rule == F.col("__r"))
    return findings.join(r, same & ((F.col("__l") == 0) | (F.col("__l") == findings["snk_line"])), "left_anti")
