"""Repository content as frames: files, graph exports, rule files, manifests, build settings and labelled corpora."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.catalog import parse_suppressions
from pathloom.functions.matching import match_words
from pathloom.functions.tables import values_at

# Extensions of C and C++ and of all scanned languages; build files by system in the order of their
# test; compiler flags by prefix.
CPP_EXTENSIONS = ["cpp", "cc", "c", "h", "hpp"]
SCAN_EXTENSIONS = ["cpp", "cc", "c", "py", "js", "ts", "jsx", "tsx", "go", "java", "rb"]
BUILD_FILES = [
    ("cmake", ["CMakeLists.txt"]), ("bazel", ["BUILD", "BUILD.bazel", "WORKSPACE", "WORKSPACE.bazel"]),
    ("meson", ["meson.build"]), ("make", ["Makefile", "GNUmakefile", "makefile"]),
]
ALLOWED_FLAGS = ["-O", "-std=", "-I", "-D", "-W", "-f", "-m", "-g", "-march=", "-mtune=", "-target"]
BLOCKED_FLAGS = ["-fplugin", "-B", "--sysroot", "-rpath", "-Wl,", "-load", "-pass-plugin"]
LEVELS = ["-O0", "-O1", "-O2", "-O3", "-Os", "-Oz"]


def scan_files(spark: SparkSession, root: str, extensions: list[str] = SCAN_EXTENSIONS) -> DataFrame:
    """(file_path relative to root, text) of all files below root with one of the extensions."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    return raw.select(F.regexp_replace(F.substring_index("path", base, -1), "^/+", "").alias("file_path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def changed_files(spark: SparkSession, listed: str | None, diff: list[str] | None, every: DataFrame) -> DataFrame:
    """(file_path, ord): the comma list if there is one, else the diff, else all files."""
    names = [x.strip() for x in (listed or "").split(",") if x.strip()] or (diff or [])
    if names:
        return spark.createDataFrame(list(dict.fromkeys(names)), "string").toDF("file_path").withColumn("ord", F.monotonically_increasing_id())
    return every.select("file_path").distinct().withColumn("ord", F.monotonically_increasing_id())


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of {nodes: [...], edges: [...]} documents; unknown lines (-1) become 0."""
    node = "struct<node_id string, file_path string, function_name string, line_start int, line_end int, node_type string, code string>"
    doc = spark.read.schema(f"nodes array<{node}>, edges array<struct<src string, dst string, type string>>").option("multiLine", "true").json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    nodes = nodes.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in ("line_start", "line_end")})
    return nodes, doc.select(F.explode("edges").alias("e")).select("e.*")


def read_suppressions(spark: SparkSession, path: str) -> DataFrame:
    return parse_suppressions(spark.read.text(path))


def build_system(files: DataFrame) -> DataFrame:
    """One row `build_system`: the first system of which a build file stands among file_path; unknown if none."""
    rows = [(k, s, f) for k, (s, names) in enumerate(BUILD_FILES) for f in names]
    table = files.sparkSession.createDataFrame(rows, "k int, build_system string, file_path string")
    met = files.join(F.broadcast(table), "file_path")
    return met.agg(F.coalesce(F.min_by("build_system", "k"), F.lit("unknown")).alias("build_system"))


def compile_settings(files: DataFrame, commands: DataFrame, compiler: str = "c++") -> DataFrame:
    """Per file (file_path): compiler, opt_level and flags of the first command (ord, file, command) whose file or
    command contains its path; defaults where there is none."""
    paths = files.select("file_path").distinct().select(F.xxhash64("file_path").alias("word_id"), "file_path")
    # Every path is sought in every command's two texts, all paths in one pass.
    both = commands.select(F.struct("ord", "command").alias("key"), F.explode(F.array("file", "command")).alias("text"))
    met = match_words(both, paths.select("word_id", F.col("file_path").alias("word"))).groupBy("word_id").agg(F.min("key").alias("first"))
    rows = paths.join(met, "word_id", "left").select("file_path", F.col("first.command").alias("command"))
    parts = F.filter(F.split("command", r"\s+"), lambda x: x != "")
    flags = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.startswith(x, F.lit("-")))
    level = F.filter(flags, lambda x: x.isin(LEVELS))
    return rows.select(
        "file_path", F.coalesce(F.get(parts, 0), F.lit(compiler)).alias("compiler"), F.coalesce(F.try_element_at(level, F.lit(-1)), F.lit("-O1")).alias("opt_level"),
        F.coalesce(F.filter(flags, _allowed), F.array().cast("array<string>")).alias("flags"),
    )


def _starts(flag: Column, prefixes: list[str]) -> Column:
    test = F.lit(False)
    for p in prefixes:
        test = test | F.startswith(flag, F.lit(p))
    return test


def _allowed(flag: Column) -> Column:
    return _starts(flag, ALLOWED_FLAGS) & ~_starts(flag, BLOCKED_FLAGS)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of pair_corpus() from CSV files with a header; quoted fields may hold line ends."""
    schema = "index long, lang string, vul int, func_before string, func_after string"
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*[(F.col(n).try_cast(t) if n in rows.columns else F.lit(None).cast(t)).alias(n) for n, t in (f.split() for f in schema.split(", "))])


def read_changes(spark: SparkSession, path: str, table: str = "file_change", id_col: str = "file_change_id", rows_per_task: int = 10_000) -> DataFrame:
    """The rows of change_corpus() from a SQLite file, read by tasks in ranges of row numbers. Spark has no reader for this format without a
    driver of its own, so the file goes to each executor once; path may be in any file system that Spark reads."""
    import sqlite3

    spark.sparkContext.addFile(path)
    name, names = path.rstrip("/").rpartition("/")[2], ("id", "code_before", "code_after", "programming_language")
    with sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro", uri=True) as db:
        least, most = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    schema = ", ".join(f"{n} string" for n in names)
    if least is None:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro", uri=True) as db:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    rows = db.execute(f'SELECT "{id_col}", code_before, code_after, programming_language FROM "{table}" WHERE rowid BETWEEN ? AND ?', (first, first + rows_per_task - 1)).fetchall()
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([None if v is None else str(v) for v in c], pa.string()) for c in zip(*rows, strict=True)], names=list(names))

    ranges = spark.range(least, most + 1, rows_per_task)
    return ranges.repartition(min(10_000, (most - least) // rows_per_task + 1)).mapInArrow(read, schema)


#: Rows that a task may hold whole to find the first ones.
FEW = 10_000


def first_rows(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first `most` rows by order, nulls first. If these are many, the last one's place is found by the order alone, and no task holds them."""
    if most <= FEW:
        return rows.orderBy(order).limit(most)
    if rows.count() <= most:
        return rows
    (last,) = values_at(rows, order, [most - 1])
    before = F.lit(False) if last is None else F.col(order).isNull() | (F.col(order) < F.lit(last))
    rest = most - rows.where(before).count()
    return rows.where(before).unionByName(rows.where(F.col(order).eqNullSafe(F.lit(last))).limit(rest))


def pair_corpus(rows: DataFrame, lang: str, most: int | None, order: str = "index") -> DataFrame:
    """Rows (index, lang, vul, func_before, func_after) of a language, the first 2 * most; of these the first `most`
    vulnerable and the first `most` sound ones, as (case_id, code, is_vulnerable). most None: all of the language."""
    mine = rows.where(F.col("lang") == lang)
    as_case = lambda df, v, code: df.select(F.concat_ws("-", F.col(order).cast("string"), v.cast("string")).alias("case_id"), code.alias("code"), (v == 1).alias("is_vulnerable"))
    v = F.col("vul").cast("int")
    every = as_case(mine.where(v.isin(0, 1)), v, F.when(v == 1, F.col("func_before")).otherwise(F.col("func_after")))
    if most is None:
        return every
    if most > FEW:
        n = mine.agg(F.count("*").alias("all"), F.count_if(F.col("vul") == 1).alias("bad"), F.count_if(F.col("vul") == 0).alias("good")).first()
        if n["all"] <= 2 * most and max(n.bad, n.good) <= most:
            return every
    first = first_rows(mine, order, 2 * most)
    part = lambda v, code: as_case(first_rows(first.where(F.col("vul") == v), order, most), F.lit(v), F.col(code))
    return part(1, "func_before").unionByName(part(0, "func_after"))


def change_corpus(rows: DataFrame, lang: str, most: int, order: str = "id") -> DataFrame:
    """Rows (id, code_before, code_after, programming_language): each of the first `most` with both codes gives two cases."""
    kept = rows.where((F.lower("programming_language") == lang.lower()) & F.col("code_before").isNotNull() & F.col("code_after").isNotNull()).orderBy(order).limit(most)
    both = F.array(F.struct(F.col("code_before").alias("code"), F.lit(True).alias("v")), F.struct(F.col("code_after").alias("code"), F.lit(False).alias("v")))
    return kept.select(F.col(order), F.explode(both).alias("c")).select(F.concat_ws("-", F.col(order).cast("string"), F.col("c.v").cast("string")).alias("case_id"), "c.code", F.col("c.v").alias("is_vulnerable"))
