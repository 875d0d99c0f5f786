"""Validation: what a sandbox run says, and what it does to a finding's status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Crash signs in the order of their test: sign, crash type, sanitizer. Letters in either case.
CRASH_SIGNS = [
    ("heap-buffer-overflow", "heap-buffer-overflow", "ASan"),
    ("stack-buffer-overflow", "stack-buffer-overflow", "ASan"),
    ("use-after-free", "use-after-free", "ASan"),
    ("double-free", "double-free", "ASan"),
    ("heap-use-after-free", "heap-use-after-free", "ASan"),
    ("data race", "data-race", "TSan"),
    ("use of uninitialized value", "uninit-value", "MSan"),
    ("SUMMARY: UndefinedBehaviorSanitizer", "undefined-behavior", "UBSan"),
    ("SUMMARY: MemorySanitizer", "msan-crash", "MSan"),
    ("SUMMARY: AddressSanitizer", "asan-crash", "ASan"),
]
_STACK = r"(?s)(#[0-9]+\s+0x[0-9a-f]+ in .+?)(?=\n#|\z)"


def transition(findings: DataFrame, runs: DataFrame, key: str, dry_run: bool = False) -> DataFrame:
    """runs (key, passed, sanitizer, compilation_error): ADVISORY stays; a crash verifies; a compile error makes PROVEN
    LIKELY; a pass under the right sanitizer makes WARNING; a pass that could not see uninitialised reads, or no run, changes nothing."""
    if dry_run:
        return findings
    r = runs.select(key, F.col("passed").alias("__p"), F.col("sanitizer").alias("__s"), F.coalesce("compilation_error", F.lit("")).alias("__e"))
    failed = F.col("__e") != ""
    blind = F.col("requires_msan") & (F.coalesce("__s", F.lit("")) != "memory")
    status = (
        F.when((F.col("status") == "ADVISORY") | F.col("__p").isNull(), F.col("status"))
        .when(~F.col("__p") & ~failed, "SANDBOX_VERIFIED")
        .when(failed & (F.col("status") == "PROVEN"), "LIKELY")
        .when(failed | blind, F.col("status"))
        .otherwise("WARNING")
    )
    return findings.join(r, key, "left").withColumn("status", status).drop("__p", "__s", "__e")


def sanitizer_for(requires_msan: Column, summary: Column, sink: Column) -> Column:
    text, name = F.lower(summary), F.lower(sink)
    has = lambda c, *words: F.greatest(*[F.contains(c, F.lit(w)).cast("int") for w in words]) == 1 if len(words) > 1 else F.contains(c, F.lit(words[0]))
    return (
        F.when(requires_msan | has(text, "cwe-457", "uninitialized"), "memory")
        .when(has(name, "thread", "pthread", "fork", "atomic"), "thread")
        .when(has(name, "malloc", "realloc", "mmap"), "memory")
        .otherwise("address,undefined")
    )


def classify_output(raw: Column) -> Column:
    """A struct of passed, crash_type, sanitizer, stack_trace and compilation_error of a run's output."""
    failed = raw.rlike(r"\berror:\s") & ~F.contains(raw, F.lit("AddressSanitizer"))
    low = F.lower(raw)
    crash, tool = F.when(failed, ""), F.when(failed, "")
    for sign, kind, sanitizer in CRASH_SIGNS:
        seen = F.contains(low, F.lit(sign.lower()))
        crash, tool = crash.when(seen, kind), tool.when(seen, sanitizer)
    crash, tool = crash.otherwise(""), tool.otherwise("")
    trace = F.regexp_extract(raw, _STACK, 1)
    return F.struct(
        (~failed & (crash == "")).alias("passed"),
        crash.alias("crash_type"),
        tool.alias("sanitizer"),
        F.when(crash == "", "").when(trace != "", F.substring(trace, 1, 3000)).otherwise(F.substring(raw, 1, 1000)).alias("stack_trace"),
        F.when(failed, F.substring(raw, 1, 2000)).otherwise("").alias("compilation_error"),
    )


def first_failure(runs: DataFrame, key: list[str], order: str, passed: str, value: str) -> DataFrame:
    """Per key the value of the first run that did not pass, else of the last. Runs without a place or a value are neither; of equal
    places the first has the least value, the last the greatest."""
    known = F.when(F.col(order).isNotNull() & F.col(value).isNotNull(), F.struct(F.col(order), F.col(value).alias("__v")))
    first, last = F.min(F.when(~F.col(passed), known)), F.max(known)
    return runs.groupBy(*key).agg(F.coalesce(first["__v"], last["__v"]).alias(value), F.bool_and(passed).alias(passed))


def script_passed(output: Column, language: Column) -> Column:
    """Scripts pass with exit code 0 and no error word (Go: FAIL, others: Error)."""
    return F.contains(output, F.lit("EXIT:0")) & ~F.when(language == "go", F.contains(output, F.lit("FAIL"))).otherwise(F.contains(output, F.lit("Error")))
