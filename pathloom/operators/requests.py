"""What is asked of outside models, as tables: which files, how much of them, and which answers are known already.

The answers come back as tables (see plans.review); nothing here calls a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.scalars import content_hash, may_have_surface
from pathloom.sources.scanners import extension

# Most files and characters of each kind of request.
INTENT_FILES, README_CHARS = 50, 2000
SURFACE_FILES, SURFACE_CALLS, SURFACE_CHARS = 10, 5, 4000
SCAN_CHARS = 12_000
REMARK_FILES, REMARK_BYTES, REMARK_CHARS, REMARKS = 20, 50_000, 8000, 5
WALKTHROUGH_FILES = 30
# The language that a request names, by extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".java": "java", ".rb": "ruby", ".rs": "rust",
    ".php": "php", ".kt": "kotlin",
}


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("c++"))


def _asked(files: DataFrame, chars: int) -> DataFrame:
    text = F.substring("text", 1, chars)
    return files.select("file_path", content_hash(F.col("text")).alias("content_hash"), language(F.col("file_path")).alias("language"), text.alias("text"))


def intent_request(changed: DataFrame, readme: Column | str, order: str = "ord") -> DataFrame:
    """One row: the first changed files' names and the head of the readme."""
    first = changed.orderBy(order).limit(INTENT_FILES)
    names = F.transform(F.sort_array(F.collect_list(F.struct(order, "file_path"))), lambda s: s["file_path"])
    return first.agg(names.alias("files")).select("files", F.substring(readme if isinstance(readme, Column) else F.lit(readme), 1, README_CHARS).alias("readme"))


def surface_requests(files: DataFrame, known: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Of the first files those that pass the guards and whose content (content_hash) has no known answer; the first few."""
    first = files.orderBy(order).limit(SURFACE_FILES).where(may_have_surface(F.col("text")))
    asked = first.withColumn("content_hash", content_hash(F.col("text")))
    if known is not None:
        asked = asked.join(known.select("content_hash").distinct(), "content_hash", "left_anti")
    return _asked(asked.orderBy(order).limit(SURFACE_CALLS), SURFACE_CHARS)


def scan_requests(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """The head of each chosen file (file_path), as scoring.scan_priority chooses them."""
    return _asked(files.join(chosen.select("file_path"), "file_path", "left_semi"), SCAN_CHARS)


def remark_requests(files: DataFrame, unreported: DataFrame) -> DataFrame:
    """The head of each small file without a positive finding (filters.unreported_files)."""
    small = files.where(F.octet_length("text") < REMARK_BYTES)
    return _asked(small.join(unreported.select("file_path"), "file_path", "left_semi"), REMARK_CHARS)


def remarks(answers: DataFrame, order: str = "ord") -> DataFrame:
    """The first remarks of each file."""
    rows = answers.groupBy("file_path").agg(F.slice(F.sort_array(F.collect_list(F.struct(order, "line", "category", "comment", "suggestion"))), 1, REMARKS).alias("r"))
    return rows.select("file_path", F.explode("r").alias("r")).select("file_path", "r.*")
