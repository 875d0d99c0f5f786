"""Operator 3: drop boilerplate lines by their frequency on their own site, in DataFrame functions only.

Rows are grouped by host (a column of docs, or an expression such as parse_url(url, 'HOST')). For each host, the pages
that contain a line are divided by the host's pages; lines above `ratio` that stand on at least `min_pages` pages are
dropped from all its pages. Lines are compared without white space at their ends; blank lines are never dropped.

Line counts are summed inside each task before the shuffle. A host has at most (lines per page / ratio) such lines;
all hosts' lists are broadcast where their measured number of lines is below `broadcast_lines`, and otherwise joined by host
with the documents of each host dealt over `salts` parts, so that a hot host meets no single task.

A line at just the ratio stays; very long texts are split like any other. Null text stays null and has no lines; rows with a null host form a site of their own. Repeated rows count as pages
each. An empty table gives an empty result. Working columns begin with __pl_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import let, store

RATIO = 0.1
MIN_PAGES = 5
BROADCAST_LINES = 200_000
BROADCAST_HOSTS = 200_000
SALTS = 32
_BLANK = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host with any: `__pl_host`, `__pl_drop` (an array of the keys of its boilerplate lines)."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANK)))
    distinct = F.array_distinct(F.filter(trimmed, lambda x: F.length(x) > 0))
    pages = docs.select(host.alias("__pl_host"), distinct.alias("__pl_lines"))
    totals = pages.groupBy("__pl_host").agg(F.count("*").alias("__pl_pages"))
    lines = pages.select("__pl_host", F.explode("__pl_lines").alias("__pl_line")).select("__pl_host", _key(F.col("__pl_line")).alias("__pl_key"))
    counts = lines.groupBy("__pl_host", "__pl_key").agg(F.count("*").alias("__pl_n")).where(F.col("__pl_n") >= min_pages)
    # The hosts' totals go to every task while they are few, so that a hot host's lines are not brought together; more of them are joined.
    totals = store(totals, "totals")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_HOSTS else totals
    found = counts.alias("c").join(totals.alias("t"), F.col("c.__pl_host").eqNullSafe(F.col("t.__pl_host"))).where(F.col("__pl_n") > ratio * F.col("__pl_pages"))
    return found.groupBy(F.col("c.__pl_host").alias("__pl_host")).agg(F.collect_list("__pl_key").alias("__pl_drop"))


def drop_lines(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES, salts: int = SALTS) -> DataFrame:
    """docs with text_col cleaned, and one more column `__cut`: a struct of n_lines and n_dropped."""
    found = store(boilerplate(docs, host, docs[text_col].cast("string"), ratio, min_pages), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("__pl_drop")), F.lit(0))).first()[0]
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    left = docs.select("*", host.alias("__pl_own_host"))
    met = F.col("d.__pl_own_host").eqNullSafe(F.col("b.__pl_host"))
    if size <= broadcast_lines:
        both = left.alias("d").join(F.broadcast(found).alias("b"), met, "left")
    else:
        left = left.withColumn("__pl_salt", F.pmod(F.xxhash64(docs[text_col].cast("string")), F.lit(salts)).cast("int"))
        right = found.withColumn("__pl_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = left.alias("d").join(right.alias("b"), met & (F.col("d.__pl_salt") == F.col("b.__pl_salt")), "left")
    both = both.select(*names, F.split(F.col(f"d.`{text_col}`").cast("string"), "\n").alias("__pl_lines"), F.col("b.__pl_drop").alias("__pl_drop"))
    keys = lambda lines: F.transform(lines, lambda x: _key(F.btrim(x, F.lit(_BLANK))))
    hit = F.when(F.col("__pl_drop").isNotNull(), F.array_intersect(keys(F.col("__pl_lines")), F.col("__pl_drop")))
    both = both.select(*[F.col(f"`{c}`") for c in docs.columns], "__pl_lines", hit.alias("__pl_hit"))
    kept = F.when(
        F.size("__pl_hit") > 0,
        let(F.col("__pl_hit"), lambda h: F.filter(F.col("__pl_lines"), lambda x: (F.length(F.btrim(x, F.lit(_BLANK))) == 0) | ~F.array_contains(h, _key(F.btrim(x, F.lit(_BLANK)))))),
    ).otherwise(F.col("__pl_lines"))
    both = both.withColumn("__pl_kept", kept)
    cut = F.struct(
        F.coalesce(F.size("__pl_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__pl_lines") - F.size("__pl_kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return both.select(*[F.array_join("__pl_kept", "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], cut.alias("__cut"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    clean = drop_lines(docs, F.col("source"))
    return clean.select("doc_id", "source", F.col("__cut.n_lines").alias("n_lines"), F.col("__cut.n_dropped").alias("n_dropped"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
_TRIM = r"trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
ORACLES = {
    "op3_line_dedup": f"""
WITH l AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT *, {_TRIM.format("line")} AS key FROM l),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT k.source, key FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WHERE key <> ''
      GROUP BY k.source, key, pages HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) > {RATIO} * pages),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (b.key IS NOT NULL) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (b.key IS NULL), '') AS clean
      FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.key = b.key GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN length(clean) END AS n_chars, CASE WHEN d.text IS NOT NULL THEN sha256(clean) END AS text_sha256
FROM documents d LEFT JOIN r USING (doc_id)"""
}
