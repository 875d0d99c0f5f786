"""Rule matching: which rule a path falls under, which rules a file, and a text search when nothing better is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.catalog import glob_to_regex
from pathloom.functions.matching import match_words


def annotate(paths: DataFrame, keywords: DataFrame, sink: str = "snk_func") -> DataFrame:
    """paths with rule_id and rule_severity of the first rule (rule_ord) that has a call word inside the sink's name;
    '' and CRITICAL where none has. Distinct sink names are matched, so the work does not grow with the paths."""
    calls = keywords.where("kind = 'call'").select("rule_ord", "rule_id", "severity", "word")
    names = paths.select(F.col(sink).alias("key"), F.col(sink).alias("text")).distinct()
    words = calls.select(F.xxhash64("word").alias("word_id"), "word").distinct()
    met = match_words(names, words).select(F.col("key").alias("__sink"), "word_id").join(calls.withColumn("word_id", F.xxhash64("word")), "word_id")
    first = met.groupBy("__sink").agg(F.min_by(F.struct("rule_id", "severity"), "rule_ord").alias("r"))
    out = paths.join(first, paths[sink] == first["__sink"], "left")
    return out.select(*[paths[c] for c in paths.columns], F.coalesce("r.rule_id", F.lit("")).alias("rule_id"), F.coalesce("r.severity", F.lit("CRITICAL")).alias("rule_severity"))


def rules_for_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_path, rule_ord, rule_id, severity) of every rule with a glob that fits the file."""
    rows = rules.select("rule_ord", "rule_id", "severity", F.explode("globs").alias("glob")).collect()  # the rule table is small by nature
    table = files.sparkSession.createDataFrame([(*r, glob_to_regex(r.glob)) for r in rows], "rule_ord int, rule_id string, severity string, glob string, rx string")
    return files.select("file_path").join(F.broadcast(table), F.expr("regexp_replace(file_path, '/+', '/') rlike rx")).select("file_path", "rule_ord", "rule_id", "severity").distinct()


def by_severity(rules: DataFrame, severity: str) -> DataFrame:
    return rules.where(F.col("severity") == severity)


def search_text(files: DataFrame, keywords: DataFrame, confidence: float = 0.72) -> DataFrame:
    """files (file_path, text): a LIKELY finding per CRITICAL rule whose text holds one of its words, for the first such
    word in the rule's order, at the first line that holds it. Words of kinds other than call and pdg are sought with their kind."""
    word = F.when(F.col("kind").isin("call", "pdg", ""), F.col("word")).otherwise(F.concat_ws(":", "kind", "word"))
    sought = keywords.where("severity = 'CRITICAL'").select("rule_ord", "rule_id", "kw_ord", word.alias("needle"))
    sought = sought.withColumn("word_id", F.xxhash64("needle"))
    found = match_words(files.select(F.col("file_path").alias("key"), "text"), sought.select("word_id", F.col("needle").alias("word")).distinct())
    met = found.select(F.col("key").alias("file_path"), "word_id", F.col("line").cast("int").alias("line")).join(sought, "word_id")
    return met.groupBy("file_path", "rule_ord", "rule_id").agg(F.min_by(F.struct("needle", "line"), "kw_ord").alias("m")).select(
        "file_path", "rule_id", F.col("m.needle").alias("keyword"), F.col("m.line").alias("line_number"), F.lit("LIKELY").alias("status"), F.lit(confidence).alias("confidence")
    )
