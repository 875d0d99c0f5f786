"""Analyser output as graph nodes: one sink node per reported place, no edges.

Each adapter takes raw output as a frame and gives SCANNED rows. Paths below `root` are made relative to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.graph_store import latest

SCANNED = ["file_path", "function_name", "line_start", "line_end", "node_type", "code"]
# File extension to backend; others go to the C and C++ one.
BACKENDS = {
    ".cpp": "cpp", ".cc": "cpp", ".c": "cpp", ".h": "cpp", ".hpp": "cpp", ".py": "python", ".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js",
    ".mjs": "js", ".cjs": "js", ".go": "go", ".java": "java", ".rb": "ruby", ".rs": "rust", ".php": "generic", ".kt": "generic",
}
# Fixed value: a line of a compiler's diagnostics.
_DIAGNOSTIC = r"^([^:]+):([0-9]+):[0-9]+:\s+(?:warning|error):\s+(.+?)\s+\[([^\]]+)\]"


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def backend_for(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BACKENDS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("cpp"))


def _relative(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path) if root else path


def _node(file: Column, name: Column, first: Column, last: Column, code: Column) -> list[Column]:
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    return [
        file.alias("file_path"), F.coalesce(name, F.lit("")).alias("function_name"), number(first).alias("line_start"), number(last).alias("line_end"),
        F.lit("CALL_SINK").alias("node_type"), F.coalesce(code, F.lit("")).alias("code"),
    ]


def sink_of_check(check: Column, message: Column) -> Column:
    """The sink that a diagnostic stands for; null for others. The first test that holds decides."""
    low = F.lower(message)
    says = lambda *words: F.greatest(*[F.contains(low, F.lit(w)).cast("int") for w in words]) == 1 if len(words) > 1 else F.contains(low, F.lit(words[0]))
    named = lambda word: F.contains(check, F.lit(word))
    insecure = named("insecureAPI")
    return (
        F.when(says("use-after-free") | named("NewDelete") | says("double-free"), "free")
        .when(says("malloc") | named("MallocOverflow"), "malloc")
        .when((says("buffer") & says("overflow", "overrun")) | named("ArrayBound"), "memcpy")
        .when(insecure & says("strcpy"), "strcpy")
        .when(insecure & says("sprintf"), "sprintf")
        .when(insecure & says("gets"), "gets")
        .when(insecure & says("system"), "system")
    )


def diagnostics(lines: DataFrame, root: str = "", column: str = "value") -> DataFrame:
    """Lines `file:line:col: warning|error: message [check]` that stand for a sink."""
    part = lambda i: F.regexp_extract(column, _DIAGNOSTIC, i)
    rows = lines.select(part(1).alias("file"), part(2).alias("line"), part(3).alias("msg"), part(4).alias("check")).where("check <> ''")
    rows = rows.withColumn("sink", sink_of_check(F.col("check"), F.col("msg"))).where("sink is not null")
    return rows.select(*_node(_relative(F.col("file"), root), F.col("sink"), F.col("line"), F.col("line"), F.col("msg")))


def _parsed(raw: DataFrame, schema: str, column: str) -> DataFrame:
    return raw.select(F.from_json(column, schema).alias("j"))


def semgrep(raw: DataFrame, files: DataFrame | None = None, root: str = "", column: str = "value") -> DataFrame:
    """results[]: name is the last part of check_id; code is the reported lines of files (file_path, text), if given."""
    schema = "results array<struct<check_id string, path string, start struct<line int>, `end` struct<line int>, extra struct<lines string>>>"
    r = _parsed(raw, schema, column).select(F.explode("j.results").alias("r")).select(
        _relative(F.col("r.path"), root).alias("file"), F.element_at(F.split("r.check_id", r"\."), -1).alias("name"), F.col("r.start.line").alias("a"), F.col("r.end.line").alias("b"), F.col("r.extra.lines").alias("code")
    )
    if files is not None:
        r = r.join(files.select(F.col("file_path").alias("file"), F.split("text", "\r?\n").alias("lines")), "file", "left")
        r = r.withColumn("code", F.coalesce(F.array_join(F.slice("lines", F.greatest("a", F.lit(1)), F.greatest(F.col("b") - F.col("a") + 1, F.lit(0))), "\n"), "code"))
    return r.select(*_node(F.col("file"), F.col("name"), F.col("a"), F.coalesce("b", "a"), F.col("code")))


def bandit(raw: DataFrame, root: str = "", column: str = "value") -> DataFrame:
    schema = "results array<struct<filename string, test_id string, line_number int, code string>>"
    r = _parsed(raw, schema, column).select(F.explode("j.results").alias("r"))
    return r.select(*_node(_relative(F.col("r.filename"), root), F.col("r.test_id"), F.col("r.line_number"), F.col("r.line_number"), F.regexp_replace("r.code", r"^\s+|\s+$", "")))


def gosec(raw: DataFrame, root: str = "", column: str = "value") -> DataFrame:
    """Issues[]: a line such as 12-15 counts as 12, an unreadable one as 0."""
    schema = "Issues array<struct<file string, line string, rule_id string, code string>>"
    r = _parsed(raw, schema, column).select(F.explode("j.Issues").alias("r"))
    line = F.split("r.line", "-")[0]
    return r.select(*_node(_relative(F.col("r.file"), root), F.col("r.rule_id"), line, line, F.col("r.code")))


def spotbugs(bugs: DataFrame, root: str = "") -> DataFrame:
    """Rows of BugInstance elements (format 'xml', rowTag BugInstance); those without a source line are left out."""
    b = bugs.where("SourceLine is not null")
    return b.select(*_node(_relative(F.col("SourceLine._sourcepath"), root), F.col("_type"), F.col("SourceLine._start"), F.coalesce("SourceLine._end", "SourceLine._start"), F.col("LongMessage")))


def brakeman(raw: DataFrame, root: str = "", column: str = "value") -> DataFrame:
    schema = "warnings array<struct<warning_type string, file string, line int, code string, message string>>"
    r = _parsed(raw, schema, column).select(F.explode("j.warnings").alias("r"))
    return r.select(*_node(_relative(F.col("r.file"), root), F.translate(F.lower("r.warning_type"), " ", "_"), F.col("r.line"), F.col("r.line"), F.coalesce("r.code", "r.message")))


def rust_audit(raw: DataFrame, manifest: str = "Cargo.toml", column: str = "value") -> DataFrame:
    schema = "vulnerabilities struct<list array<struct<advisory struct<id string, title string>>>>"
    r = _parsed(raw, schema, column).select(F.explode("j.vulnerabilities.list").alias("r"))
    return r.select(*_node(F.lit(manifest), F.concat(F.lit("dep_"), "r.advisory.id"), F.lit(1), F.lit(1), F.col("r.advisory.title")))


def lines_with(files: DataFrame, words: list[str], name: str) -> DataFrame:
    """Lines of files (file_path, text) that hold all words, such as `unsafe` and `{`."""
    at = files.select("file_path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    for w in words:
        at = at.where(F.contains("line", F.lit(w)))
    return at.select(*_node(F.col("file_path"), F.lit(name), F.col("pos") + 1, F.col("pos") + 1, F.trim("line")))


def eslint(raw: DataFrame, root: str = "", column: str = "value") -> DataFrame:
    """Messages of severity 2 or more; slashes in rule names become underscores."""
    schema = "array<struct<filePath string, messages array<struct<ruleId string, severity int, line int, endLine int, message string>>>>"
    f = raw.select(F.explode(F.from_json(column, schema)).alias("f")).select(F.col("f.filePath").alias("file"), F.explode("f.messages").alias("m")).where("m.severity >= 2")
    return f.select(*_node(_relative(F.col("file"), root), F.replace("m.ruleId", F.lit("/"), F.lit("_")), F.col("m.line"), F.coalesce("m.endLine", "m.line"), F.col("m.message")))


def union_first(branches: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """All branches; of rows with an equal key the one of the first branch, then the first by order."""
    every = None
    for i, b in enumerate(branches):
        b = b.withColumn("__b", F.lit(i))
        every = b if every is None else every.unionByName(b)
    return latest(every, key, F.struct("__b", *order), first=True).drop("__b")


def first_available(tiers: list[DataFrame]) -> DataFrame:
    """The first tier with any row, else the last."""
    for tier in tiers[:-1]:
        if not tier.isEmpty():
            return tier
    return tiers[-1]
