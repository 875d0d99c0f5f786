"""What is read from files, kept in a graph store, streamed, asked or written, over files made of the supplied tables.

Each query writes its input to the shared folder in the format that its operator reads, so the readers themselves are compared with SQL.
"""

from __future__ import annotations

import sqlite3
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import catalog, scalars
from pathloom.functions.tables import dealt_over, shared_dir, ship
from pathloom.operators import constraints, export, filters, graph_store, paths, requests, rules, scan_runner, scoring
from pathloom.operators.graph_store import GraphStore
from pathloom.operators.proof_store import ProofStore
from pathloom.plans.evaluate import evaluate
from pathloom.plans.review import ReviewInputs, run_review
from pathloom.sources import backend, extract, repo, sarif_sink, scanners
from pathloom.streaming import ingress

from .registry import query, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pathloom/{name}-{uuid.uuid4().hex}"


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _one_file_each(rows: DataFrame, key: str, at: str, kind: str) -> str:
    """rows in one file for each value of key, below at."""
    getattr(rows.repartition(1).write.partitionBy(key), kind)(at)
    return at


def _many_files(rows: DataFrame, key: str, text: str, at: str) -> str:
    """rows' texts in a file for each value of key, below at, as partitionBy would place them; for so many that the writer's own steps for a file count."""
    ship(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(at)
        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system.create_dir(f"{base}/{key}={name}")
                with system.open_output_stream(f"{base}/{key}={name}/part.txt") as f:
                    f.write(f"{body}\n".encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows.select(F.col(key).cast("string"), text).repartition(dealt_over(rows.sparkSession), key).mapInArrow(work, "n long").agg(F.sum("n")).collect()
    return at


# ---- files and listings ----


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name || chr(10) AS text FROM nation")
def repo_scan(spark, sf_dir):
    at = _one_file_each(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", _folder(spark, "repo"), "text")
    return repo.scan_files(spark, at, ["txt"]).select(F.regexp_extract("file_path", "^n_nationkey=([0-9]+)/", 1).alias("key"), "text")


@query("""SELECT 'listed' AS mode, f AS file_path FROM (VALUES ('a.c'), ('b.c')) t(f) UNION ALL SELECT 'diff', f FROM (VALUES ('d.c'), ('e.c')) t(f) UNION ALL SELECT DISTINCT 'all', source FROM documents""")
def changed_listing(spark, sf_dir):
    every = table(spark, sf_dir, "documents").select(F.col("source").alias("file_path"))
    given = [("listed", " a.c, ,b.c,a.c", ["x.c"]), ("diff", "", ["d.c", "e.c"]), ("all", None, None)]
    out = [repo.changed_files(spark, listed, diff, every).select(F.lit(mode).alias("mode"), "file_path") for mode, listed, diff in given]
    return out[0].union(out[1]).union(out[2])


@query("""SELECT 'node' AS kind, 'n' || n_nationkey AS a, n_name AS b, CAST(greatest(n_nationkey - 3, 0) AS INT) AS line FROM nation
UNION ALL SELECT 'edge', 'n' || n_nationkey, 'r' || n_regionkey, 0 FROM nation""")
def graph_json(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    line = (F.col("n_nationkey") - 3).cast("int")
    node = F.struct(_cat("n", F.col("n_nationkey")).alias("node_id"), F.lit("f.c").alias("file_path"), F.col("n_name").alias("function_name"), line.alias("line_start"), line.alias("line_end"), F.lit("CALL").alias("node_type"), F.lit("").alias("code"))
    edge = F.struct(_cat("n", F.col("n_nationkey")).alias("src"), _cat("r", F.col("n_regionkey")).alias("dst"), F.lit("CALL").alias("type"))
    docs = n.groupBy("n_regionkey").agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges"))
    nodes, edges = repo.read_graph(spark, _one_file_each(docs, "n_regionkey", _folder(spark, "graph"), "json"))
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("function_name").alias("b"), F.col("line_start").alias("line")).union(edges.select(F.lit("edge"), "src", "dst", F.lit(0)))


@query("""SELECT 's' || s_suppkey || '.java' AS file_path, 'T' || s_nationkey AS function_name, CAST(s_suppkey AS INT) AS line_start, CAST(CASE WHEN s_nationkey > 12 THEN s_suppkey + 2 ELSE s_suppkey END AS INT) AS line_end, s_name AS code FROM supplier WHERE s_nationkey <> 3""")
def spotbugs_xml(spark, sf_dir):
    """Bugs as XML; those of one nation have no source line."""
    s = table(spark, sf_dir, "supplier")
    end = F.when(F.col("s_nationkey") > 12, F.col("s_suppkey") + 2)
    place = F.struct(_cat("/r/s", F.col("s_suppkey"), ".java").alias("_sourcepath"), F.col("s_suppkey").alias("_start"), end.alias("_end"))
    at = _folder(spark, "bugs")
    s.select(_cat("T", F.col("s_nationkey")).alias("_type"), F.when(F.col("s_nationkey") != 3, place).alias("SourceLine"), F.col("s_name").alias("LongMessage")).write.format("xml").option("rootTag", "BugCollection").option("rowTag", "BugInstance").save(at)
    schema = "_type string, SourceLine struct<_sourcepath string, _start int, _end int>, LongMessage string"
    bugs = spark.read.format("xml").option("rowTag", "BugInstance").schema(schema).load(at)
    return scanners.spotbugs(bugs, "/r").select("file_path", "function_name", "line_start", "line_end", "code")


@query("""SELECT 'Cargo.toml' AS file_path, 'dep_R' || o_orderkey AS function_name, CAST(1 AS INT) AS line_start, o_orderpriority AS code FROM orders WHERE o_orderstatus = 'F'""")
def rust_advisories(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    entry = F.struct(F.struct(_cat("R", F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("title")).alias("advisory"))
    raw = o.select(F.to_json(F.struct(F.struct(F.array(entry).alias("list")).alias("vulnerabilities"))).alias("value"))
    return scanners.rust_audit(raw).select("file_path", "function_name", "line_start", "code")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def tier_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return scanners.first_available([d.where("lang = 'none'"), d.where("lang = 'fr'"), d])


@query("""SELECT CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS INT) AS rule_ord, 'r_' || n_nationkey AS rule_id, CASE WHEN n_nationkey % 2 = 0 THEN 'CRITICAL' ELSE 'ADVISORY' END AS severity,
'call:f' || n_nationkey || '|pdg:g' AS pattern, CASE WHEN n_nationkey % 3 = 0 THEN '**/*.c,src/*' ELSE '**/*' END AS globs FROM nation WHERE n_regionkey <> 3""")
def rule_files(spark, sf_dir):
    """Rules of one YAML file a region; one file is malformed and left out."""
    k = F.col("n_nationkey")
    entry = _cat("  - id: r_", k, "\n", F.when(k % 2 == 0, "    severity: CRITICAL\n").otherwise(""), "    pattern: 'call:f", k, "|pdg:g'\n", F.when(k % 3 == 0, "    applies_to: ['**/*.c', 'src/*']\n").otherwise(""))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, entry.alias("e")))), lambda s: s["e"]), "")
    whole = F.when(F.col("n_regionkey") == 3, "rules: [").otherwise(_cat("rules:\n", F.col("t")))
    texts = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(text.alias("t")).select("n_regionkey", whole.alias("text"))
    found = catalog.load_rule_files(spark, _one_file_each(texts, "n_regionkey", _folder(spark, "rules"), "text"))
    return catalog.rules_frame(spark, found).select("rule_ord", "rule_id", "severity", "pattern", F.array_join("globs", ",").alias("globs"))


@query("SELECT DISTINCT r_name AS name FROM region UNION SELECT n_name FROM nation WHERE n_regionkey = 1")
def safe_lists(spark, sf_dir):
    """Safe names of a YAML mapping of lists, whatever their keys."""
    regions, nations = table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_name")
    some = [[r[0] for r in f.collect()] for f in (regions, nations)]  # five names each
    text = f"cpp: {some[0]}\nother: {some[1] + some[0][:2]}\nnote: no list\n"
    return catalog.names(spark, catalog.load_safe_names(text))


@query("SELECT 'r' || p_partkey AS rule_id, p_type AS pattern FROM part WHERE p_size % 3 = 1")
def rules_by_severity(spark, sf_dir):
    """Parts as rules of three severities, one of them unknown."""
    size = F.col("p_size") % 3
    made = table(spark, sf_dir, "part").select(_cat("r", F.col("p_partkey")).alias("rule_id"), F.col("p_type").alias("pattern"), F.when(size == 1, "CRITICAL").when(size == 2, "ADVISORY").alias("severity"))
    return rules.by_severity(made, "CRITICAL").select("rule_id", "pattern")


@query("""SELECT doc_id || '-' || CAST(n_chars % 2 AS INT) AS case_id, CASE WHEN n_chars % 2 = 1 THEN sha256(text) ELSE sha256(source) END AS code, n_chars % 2 = 1 AS is_vulnerable FROM documents WHERE lang = 'en'""")
def csv_corpus(spark, sf_dir):
    """A CSV corpus whose fields hold line ends and quotes."""
    d = table(spark, sf_dir, "documents")
    at = _folder(spark, "csv")
    d.select(F.col("doc_id").alias("index"), "lang", (F.col("n_chars") % 2).alias("vul"), F.col("text").alias("func_before"), F.col("source").alias("func_after")).write.option("header", True).option("escape", '"').csv(at)
    return repo.pair_corpus(repo.read_pairs(spark, at), "en", None).withColumn("code", F.sha2("code", 256))


@query("""SELECT doc_id || '-' || v AS case_id, CASE WHEN v THEN sha256(text) ELSE source || lang END AS code, v AS is_vulnerable FROM documents, (VALUES (true), (false)) t(v) WHERE n_chars % 5 > 0 AND doc_id % 7 > 0""")
def sqlite_corpus(spark, sf_dir):
    """A SQLite corpus of the documents, read in ranges of row numbers; a part has no code after, a part another language."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string"), F.sha2("text", 256), F.when(F.col("n_chars") % 5 > 0, F.concat("source", "lang")), F.when(F.col("doc_id") % 7 > 0, "Python").otherwise("C"))
    with tempfile.NamedTemporaryFile(suffix=".db", delete=False) as f:  # written by the driver, sent to executors by Spark
        with sqlite3.connect(f.name) as db:
            db.execute("CREATE TABLE file_change (file_change_id, code_before, code_after, programming_language)")
            db.executemany("INSERT INTO file_change VALUES (?, ?, ?, ?)", (tuple(r) for r in rows.toLocalIterator()))
    return repo.change_corpus(repo.read_changes(spark, f.name, rows_per_task=500), "python", 1_000_000)


# ---- extraction and search ----

_G = "void g{0}(char *p) {{\n  strcpy(b, p);\n}}\n"
_F = "int f{0}(int n) {{\n  fgets(x, 9, s);\n  g{0}(x);\n}}\n"


def _c_files(spark, sf_dir) -> DataFrame:
    """Two files a document: one reads input and calls a function of the other, which copies it."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("k"))
    made = lambda name, text: F.struct(_cat(name, F.col("k"), ".c").alias("file_path"), F.replace(F.lit(text.replace("{{", "{").replace("}}", "}")), F.lit("{0}"), F.col("k")).alias("text"))
    return d.select(F.explode(F.array(made("e", _G), made("d", _F))).alias("f")).select("f.*")


@query("""SELECT 'd' || doc_id || '.c' AS src_file, 'fgets' AS src_func, CAST(2 AS INT) AS src_line, 'e' || doc_id || '.c' AS snk_file, 'strcpy' AS snk_func, CAST(2 AS INT) AS snk_line, CAST(4 AS INT) AS path_len, true AS crosses_files,
'f' || doc_id || ',g' || doc_id || ',g' || doc_id AS via FROM documents""")
def extracted_paths(spark, sf_dir):
    """From source text to paths: extraction, source and sink predicates, search, projection."""
    nodes, edges = extract.extract_graph(_c_files(spark, sf_dir), "r")
    found = paths.find_paths(nodes, edges, catalog.names(spark, catalog.SOURCES), catalog.names(spark, catalog.SINKS), most=None)
    via = F.array_join(F.transform("intermediate_nodes", lambda n: n["function_name"]), ",")
    return found.select("src_file", "src_func", "src_line", "snk_file", "snk_func", "snk_line", "path_len", "crosses_files", via.alias("via"))


@query("""WITH f AS (SELECT doc_id, 'd' || doc_id || '.c' AS d, 'e' || doc_id || '.c' AS e FROM documents)
SELECT e AS file_path, 'g' || doc_id AS function_name, CAST(1 AS INT) AS line_start, CAST(3 AS INT) AS line_end, 'AST_FUNC' AS node_type FROM f UNION ALL SELECT e, 'strcpy', 2, 2, 'CALL_SINK' FROM f
UNION ALL SELECT d, 'f' || doc_id, 1, 4, 'AST_FUNC' FROM f UNION ALL SELECT d, 'fgets', 2, 2, 'CALL_SOURCE' FROM f UNION ALL SELECT d, 'g' || doc_id, 3, 3, 'CALL' FROM f""")
def extracted_nodes(spark, sf_dir):
    return extract.extract_graph(_c_files(spark, sf_dir), "r")[0].select("file_path", "function_name", "line_start", "line_end", "node_type")


@query("""SELECT s_suppkey || '.c' AS file_path, 'f' AS function_name, CAST(1 AS INT) AS line_start, 'AST_FUNC' AS node_type FROM supplier WHERE s_suppkey BETWEEN 10 AND 19 OR s_suppkey BETWEEN 100 AND 199
UNION ALL SELECT s_suppkey || '.c', 'free', 2, 'CALL_SINK' FROM supplier WHERE s_suppkey BETWEEN 10 AND 19 OR s_suppkey BETWEEN 100 AND 199""")
def backend_source(spark, sf_dir):
    """The extractor as a pluggable backend behind a Python data source; the filter on paths chooses the files that are read."""
    n = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("int f(int a) {\n  free(p);\n}").alias("text"))
    at = _many_files(n, "s_suppkey", "text", _folder(spark, "backend"))
    backend.register(spark)
    found = spark.read.format("pathloom_backend").option("root", at).option("extensions", "txt").load().where("file_path LIKE 's_suppkey=1%'")
    out = found.select(F.regexp_extract("file_path", "s_suppkey=([0-9]+)/", 1).alias("key"), "function_name", "line_start", "node_type")
    return out.where("length(key) > 1 and cast(key as int) < 200").select(_cat(F.col("key"), ".c").alias("file_path"), "function_name", "line_start", "node_type")


_KIND_SQL = "SELECT 'p' || p_partkey AS node_id, p_brand AS file_path, ['fgets', 'strcpy', 'memcpy', 'recv', 'foo', 'argv'][1 + p_size % 6] AS name, ['CALL', 'AST_FUNC', 'CALL_SINK', 'MY_SOURCE'][1 + p_partkey % 4] AS kind FROM part"


@query(f"""WITH n AS ({_KIND_SQL})
SELECT 'source' AS role, node_id FROM n WHERE name IN ('fgets', 'recv', 'argv') AND kind IN ('CALL', 'CALL_SINK', 'MY_SOURCE') AND file_path IN ('Brand#11', 'Brand#12', 'Brand#13')
UNION ALL SELECT 'sink', node_id FROM n WHERE name IN ('strcpy', 'memcpy') AND kind IN ('CALL', 'CALL_SINK')""")
def source_and_sink_nodes(spark, sf_dir):
    """Which nodes may start a path (in changed files only) and which may end one."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    nodes = table(spark, sf_dir, "part").select(_cat("p", F.col("p_partkey")).alias("node_id"), F.col("p_brand").alias("file_path"), pick(["fgets", "strcpy", "memcpy", "recv", "foo", "argv"], F.col("p_size") % 6).alias("function_name"), pick(["CALL", "AST_FUNC", "CALL_SINK", "MY_SOURCE"], F.col("p_partkey") % 4).alias("node_type"))
    changed = spark.createDataFrame([("Brand#11",), ("Brand#12",), ("Brand#13",)], "file_path string")
    starts = paths.source_nodes(nodes, catalog.names(spark, catalog.SOURCES), changed)
    ends = paths.sink_nodes(nodes, catalog.names(spark, catalog.SINKS))
    return starts.select(F.lit("source").alias("role"), "node_id").union(ends.select(F.lit("sink"), "node_id"))


def _nation_chain(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Nations in order as a chain of nodes, some with unknown values, some missing."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    name = F.when(k % 4 == 0, "fgets").when(k % 4 == 3, "strcpy").otherwise(F.col("n_name"))
    nodes = n.where("n_nationkey % 5 <> 2").select(k.cast("string").alias("node_id"), F.when(k % 2 == 1, _cat("f", F.col("n_regionkey"))).alias("file_path"), name.alias("function_name"), F.when(k % 3 > 0, k).cast("int").alias("line_start"), F.lit("CALL").alias("node_type"))
    edges = n.where("n_nationkey < 24").select(k.cast("string").alias("src"), (k + 1).cast("string").alias("dst"), F.lit("CALL").alias("type"))
    return nodes, edges


@query("""WITH n AS (SELECT n_nationkey AS k, n_nationkey % 5 <> 2 AS known, CASE WHEN n_nationkey % 2 = 1 AND n_nationkey % 5 <> 2 THEN 'f' || n_regionkey ELSE '' END AS file, CASE WHEN n_nationkey % 3 > 0 AND n_nationkey % 5 <> 2 THEN n_nationkey ELSE 0 END AS line,
CASE WHEN n_nationkey % 5 = 2 THEN '' WHEN n_nationkey % 4 = 0 THEN 'fgets' WHEN n_nationkey % 4 = 3 THEN 'strcpy' ELSE n_name END AS name FROM nation)
SELECT a.k || '' AS src_id, a.file AS src_file, a.name AS src_func, CAST(a.line AS INT) AS src_line, b.file AS snk_file, CAST(b.line AS INT) AS snk_line, a.file <> b.file AS crosses_files, c.name || '|' || d.name AS via
FROM n a JOIN n b ON b.k = a.k + 3 JOIN n c ON c.k = a.k + 1 JOIN n d ON d.k = a.k + 2 WHERE a.k % 4 = 0""")
def path_records(spark, sf_dir):
    """Paths as records: ends stripped, unknown values and missing nodes as '' and 0."""
    nodes, edges = _nation_chain(spark, sf_dir)
    at = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    ends = lambda r: at.where(F.col("k") % 4 == r).select(F.col("k").cast("string").alias("node"))
    found = paths.project(paths.expand(edges, ends(0), ends(3), 3), nodes)
    via = F.array_join(F.transform("intermediate_nodes", lambda n: n["function_name"]), "|")
    return found.select("src_id", "src_file", "src_func", "src_line", "snk_file", "snk_line", "crosses_files", via.alias("via"))


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 5 <> 2), t(tier, hops) AS (VALUES ('node', 15), ('edge', 20))
SELECT tier, a.k || '' AS src_id, b.k || '' AS snk_id, CAST(b.k - a.k AS INT) AS path_len FROM t, n a, n b WHERE a.k % 4 = 0 AND b.k % 4 = 3 AND b.k - a.k BETWEEN 1 AND hops""")
def path_tiers(spark, sf_dir):
    """The whole search in both of its tiers: uniqueness and hops are settings, no capability is probed."""
    nodes, edges = _nation_chain(spark, sf_dir)
    names = catalog.names(spark, ["fgets"]), catalog.names(spark, ["strcpy"])
    out = [paths.find_paths(nodes, edges, *names, max_hops=hops, uniqueness=tier, most=None, extend=False).select(F.lit(tier).alias("tier"), "src_id", "snk_id", "path_len") for tier, hops in (("node", 15), ("edge", 20))]
    return out[0].union(out[1])


@query("SELECT a.n_nationkey || '' AS src_id, (a.n_nationkey + 3) || '' AS snk_id, CAST(3 AS INT) AS path_len FROM nation a WHERE a.n_nationkey % 4 = 0 AND a.n_nationkey <= 8")
def nearest_paths(spark, sf_dir):
    """The first three paths, found best-first; ids of two digits are in the order of their numbers."""
    nodes, edges = _nation_chain(spark, sf_dir)
    wide = lambda c: F.lpad(c, 2, "0").alias(c)
    nodes, edges = nodes.withColumn("node_id", wide("node_id")), edges.withColumns({c: wide(c) for c in ("src", "dst")})
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    ends = lambda r: n.where(F.col("k") % 4 == r).select(F.lpad(F.col("k").cast("string"), 2, "0").alias("node"))
    found = paths.project(paths.expand(edges, ends(0), ends(3), most=3), nodes)
    number = lambda c: F.col(c).cast("int").cast("string").alias(c)
    return paths.shortest(found, 3).select(number("src_id"), number("snk_id"), "path_len")


@query("SELECT 'paths' AS step, CAST(0 AS BIGINT) AS n_paths")
def failed_search(spark, sf_dir):
    """A search that can't run is a row of `errors`, and the review ends without paths."""
    nodes, _ = _nation_chain(spark, sf_dir)
    files = table(spark, sf_dir, "nation").select(F.col("n_name").alias("file_path"), F.col("n_name").alias("text"))
    broken = spark.createDataFrame([("a", "b")], "src string, dst string")
    out = run_review(spark, ReviewInputs(nodes.withColumn("code", F.lit("")), broken, files, files.select("file_path", F.monotonically_increasing_id().alias("ord"))))
    return out["errors"].select("step", F.lit(out["paths"].count()).cast("long").alias("n_paths"))


@query("""SELECT n_name || '.c' AS snk_file, 'LIKELY' AS status, 0.72::DOUBLE AS confidence, CAST(2 AS INT) AS snk_line, 'text search: no_strcpy — strcpy in ' || n_name || '.c' AS summary FROM nation WHERE n_regionkey = 1""")
def refused_scans(spark, sf_dir):
    """Files whose scan was refused are searched for the words of their critical rules, inside the whole review."""
    nodes, edges = _nation_chain(spark, sf_dir)
    n = table(spark, sf_dir, "nation")
    files = n.select(_cat(F.col("n_name"), ".c").alias("file_path"), F.lit("x\n strcpy(a, b)\n").alias("text"), "n_regionkey")
    made = [catalog.Rule("no_strcpy", "CRITICAL", "call:gets|call:strcpy", ("**/*.c",)), catalog.Rule("py", "CRITICAL", "call:strcpy", ("**/*.py",)), catalog.Rule("advice", "ADVISORY", "call:strcpy")]
    given = ReviewInputs(nodes.where("false").withColumn("code", F.lit("")), edges, files.select("file_path", "text"), files.select("file_path", F.monotonically_increasing_id().alias("ord")), rules=made, unanswered=files.where("n_regionkey = 1").select("file_path"))
    return run_review(spark, given)["findings"].select("snk_file", "status", "confidence", "snk_line", "summary")


@query("""WITH r AS (SELECT 'd' || doc_id AS f, text, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
s AS (SELECT f, text, CASE WHEN (k - 1) // 4 >= 150 THEN 'refused' WHEN contains(text, '%%%') THEN 'failed' ELSE 'answered' END AS outcome FROM r),
l AS (SELECT f, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM s WHERE outcome = 'answered')
SELECT s.f AS file_path, outcome, CAST(l.n AS INT) AS line_number, CASE WHEN l.n IS NOT NULL THEN 'secret' END AS rule_id FROM s LEFT JOIN (SELECT f, n FROM l WHERE contains(line, 'token')) l ON l.f = s.f""")
def scan_runs(spark, sf_dir):
    """Documents scanned by a function in four slots of 150 requests each: what it finds, what it fails on, and what is refused."""

    def look(path: str, text: str):
        if "%%%" in text:
            raise ValueError("not a text")
        return [("secret", "CRITICAL", n, line) for n, line in enumerate(text.split("\n"), 1) if "token" in line]

    asked = table(spark, sf_dir, "documents").select(_cat("d", F.col("doc_id")).alias("file_path"), "text", "doc_id")
    return scan_runner.run_scans(asked, look, scan_runner.Budget(slots=4, requests=150), ["doc_id"]).select("file_path", "outcome", "line_number", "rule_id")


@query("""WITH c AS (SELECT c_custkey, 'c' || c_custkey || '.c' AS f, c_custkey % 3 AS m, row_number() OVER (ORDER BY 'c' || c_custkey || '.c') AS k FROM customer)
SELECT f AS snk_file, 'LIKELY' AS status, CAST(1 AS INT) AS snk_line, 0.88::DOUBLE AS confidence FROM c WHERE k <= 1000 AND m = 1
UNION ALL SELECT f, 'LIKELY', 2, 0.72 FROM c WHERE k > 1000 OR m = 0""")
def scanned_review(spark, sf_dir):
    """A review whose scans run under a budget of 1,000 requests: files that are refused or fail are searched for the words of their critical rules."""

    def look(path: str, text: str):
        n = int(path[1:-2])
        if n % 3 == 0:
            raise TimeoutError(path)
        return [("no_strcpy", "CRITICAL", 1, "this is an explanation of a certain bug")] if n % 3 == 1 else []

    nodes, edges = _nation_chain(spark, sf_dir)
    files = table(spark, sf_dir, "customer").select(_cat("c", F.col("c_custkey"), ".c").alias("file_path"), F.lit("x\n strcpy(a, b)\n").alias("text"))
    made = [catalog.Rule("no_strcpy", "CRITICAL", "call:gets|call:strcpy", ("**/*.c",))]
    given = ReviewInputs(nodes.where("false").withColumn("code", F.lit("")), edges, files, files.select("file_path", F.monotonically_increasing_id().alias("ord")), rules=made, scan=look, scan_budget=scan_runner.Budget(requests=1000), scan_files=1_000_000)
    return run_review(spark, given)["findings"].select("snk_file", "status", "snk_line", "confidence")


@query("""WITH c AS (SELECT c_nationkey % 5 <> 2 AS bad, c_custkey % 3 <> 0 AS said FROM customer), n AS (SELECT count(*) FILTER (bad AND said) AS tp, count(*) FILTER (NOT bad AND said) AS fp, count(*) FILTER (NOT bad AND NOT said) AS tn, count(*) FILTER (bad AND NOT said) AS fn FROM c)
SELECT tp, fp, tn, fn, round(tp / (tp + fp), 3) AS precision, round(tp / (tp + fn), 3) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 3) AS f1, round(fp / (fp + tn), 3) AS fpr FROM n""")
def evaluation(spark, sf_dir):
    """Labelled cases through the whole review, all of equal function names: of three, two have a helper that copies what was read, and one a helper that
    does not."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    body = _cat("void helper(int n) {\n  ", F.when(k % 3 != 0, "strcpy(b, x);").otherwise("look(x);"), "\n}\nint work(int n) {\n  fgets(x, 9, s);\n  helper(n);\n}\n")
    return evaluate(spark, c.select(_cat("c", k).alias("case_id"), body.alias("code"), (F.col("c_nationkey") % 5 != 2).alias("is_vulnerable")))["rates"]


@query("""SELECT n AS n_verified, CAST(0 AS BIGINT) AS n_likely, CAST(0 AS BIGINT) AS n_advisory, 'HIGH' AS risk, CAST(1 AS INT) AS exit_code FROM (SELECT least(count(*), 100) AS n FROM documents)""")
def whole_review(spark, sf_dir):
    """Two files a document from text to card: extraction, search, rules, constraints, filters."""
    files = _c_files(spark, sf_dir)
    nodes, edges = extract.extract_graph(files, "r")
    changed = files.select("file_path", F.monotonically_increasing_id().alias("ord"))
    return run_review(spark, ReviewInputs(nodes, edges, files, changed))["card"]


# ---- scores, answers and requests ----


@query("""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part),
k AS (SELECT p_partkey FROM p WHERE r <= 200 ORDER BY CASE WHEN p_partkey % 7 = 0 THEN -p_partkey END NULLS LAST, r LIMIT 100)
SELECT p_partkey, p_partkey NOT IN (SELECT * FROM k) AS was_pruned FROM part""")
def reranked(spark, sf_dir):
    """An outside order of the first two hundred decides which hundred stay."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("path_id"), F.col("p_size").cast("double").alias("pruner_score"))
    ranking = p.where("p_partkey % 7 = 0").select("path_id", (-F.col("p_partkey")).alias("rank"))
    return scoring.prune(p, ["p_partkey"], ranking=ranking).select("p_partkey", "was_pruned")


@query("""SELECT sha256('d' || doc_id || ':' || (doc_id % 50) || ':q' || quality) AS src_id, 'd' || doc_id AS snk_file, CAST(doc_id % 50 AS INT) AS snk_line, 'DeepScan' AS snk_func, '' AS rule_id, CASE WHEN toxic = 1 THEN 'LIKELY' ELSE 'ADVISORY' END AS status,
CAST(CASE WHEN toxic = 1 THEN 0.95 ELSE 0.55 END AS DOUBLE) AS confidence FROM labels""")
def scan_answers(spark, sf_dir):
    """Outside answers as findings: critical ones are likely, others advice."""
    x = table(spark, sf_dir, "labels")
    toxic = F.col("toxic") == 1
    rows = x.select(_cat("d", F.col("doc_id")).alias("file_path"), _cat("q", F.col("quality")).alias("rule_id"), F.when(toxic, "critical").otherwise("ADVISORY").alias("severity"), (F.col("doc_id") % 50).cast("int").alias("line_number"), F.when(toxic, "user data goes into memcpy without a test of its size").otherwise("unclear").alias("explanation"))
    found = filters.deep_scan_findings(rows, scoring.explanation_confidence(F.col("severity"), F.col("explanation")))
    return found.select("src_id", "snk_file", "snk_line", "snk_func", "rule_id", "status", "confidence")


@query("""SELECT string_agg(c_name, ',' ORDER BY c_custkey) AS files, (SELECT substr(text, 1, 2000) FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1) AS readme FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50)""")
def intent_request(spark, sf_dir):
    """The first fifty changed files and the head of the readme."""
    readme = table(spark, sf_dir, "documents").orderBy(F.desc(F.length("text")), "doc_id").select("text").first()[0]
    changed = table(spark, sf_dir, "customer").select(F.col("c_name").alias("file_path"), F.col("c_custkey").alias("ord"))
    return requests.intent_request(changed, readme).select(F.array_join("files", ",").alias("files"), "readme")


@query("""SELECT 'd' || doc_id || CASE lang WHEN 'en' THEN '.rs' WHEN 'fr' THEN '.tsx' WHEN 'de' THEN '.kt' ELSE '.xx' END AS file_path, sha256(text) AS content_hash, CASE lang WHEN 'en' THEN 'rust' WHEN 'fr' THEN 'typescript' WHEN 'de' THEN 'kotlin' ELSE 'c++' END AS language, length(substr(text, 1, 12000)) AS n_chars
FROM documents WHERE source IN ('src1', 'src2', 'src3')""")
def scan_requests(spark, sf_dir):
    """The head of each chosen file, and the language that its request names."""
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", ".rs").when(F.col("lang") == "fr", ".tsx").when(F.col("lang") == "de", ".kt").otherwise(".xx")
    files = d.select(_cat("d", F.col("doc_id"), ext).alias("file_path"), "text", "source")
    asked = requests.scan_requests(files.select("file_path", "text"), files.where("source in ('src1', 'src2', 'src3')"))
    return asked.select("file_path", "content_hash", "language", F.length("text").cast("long").alias("n_chars"))


@query("""SELECT file_path, CAST(turn AS BIGINT) AS ord, category FROM (SELECT 'c' || conv_id % 40 AS file_path, conv_id * 100 + turn AS turn, role AS category, row_number() OVER (PARTITION BY conv_id % 40 ORDER BY conv_id * 100 + turn) AS r FROM conversations) WHERE r <= 5""")
def kept_remarks(spark, sf_dir):
    """The first five remarks of each file."""
    c = table(spark, sf_dir, "conversations")
    answers = c.select(_cat("c", F.col("conv_id") % 40).alias("file_path"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.lit(1).alias("line"), F.col("role").alias("category"), F.col("text").alias("comment"), F.lit("").alias("suggestion"))
    return requests.remarks(answers).select("file_path", "ord", "category")


@query("""SELECT doc_id, substr(sha256(coalesce(CASE WHEN lang = 'en' THEN source END, CASE WHEN n_chars > 500 THEN lang END, text)), 1, 16) AS repo_id FROM documents""")
def repo_ids(spark, sf_dir):
    remote, root = F.when(F.col("lang") == "en", F.col("source")), F.when(F.col("n_chars") > 500, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.repo_id(remote, root, F.col("text")).alias("repo_id"))


# ---- the graph store ----


@query("""WITH n AS (SELECT 'o' || o_orderkey AS node_id, o_orderpriority AS repo, o_orderstatus AS run FROM orders), k AS (SELECT node_id FROM n WHERE repo <> '1-URGENT' OR run = 'O')
SELECT 'node' AS kind, node_id AS a, '' AS b FROM k UNION ALL SELECT 'edge', 'o' || o_orderkey, 'o' || (o_orderkey + 1) FROM orders WHERE 'o' || o_orderkey IN (SELECT * FROM k) AND 'o' || (o_orderkey + 1) IN (SELECT * FROM k)""")
def stale_purge(spark, sf_dir):
    """Nodes of earlier runs go, and the edges at them."""
    o = table(spark, sf_dir, "orders")
    nodes = o.select(_cat("o", F.col("o_orderkey")).alias("node_id"), F.col("o_orderpriority").alias("repo_id"), F.col("o_orderstatus").alias("run_id"))
    kept = graph_store.purge(nodes, "1-URGENT", "O")
    edges = o.select(_cat("o", F.col("o_orderkey")).alias("src"), _cat("o", F.col("o_orderkey") + 1).alias("dst"))
    return kept.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.lit("").alias("b")).union(graph_store.live_edges(edges, kept).select(F.lit("edge"), "src", "dst"))


def _customer_graph(spark, sf_dir, where: str, code: Column) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").where(where)
    name = lambda k: _cat("c", k)
    nodes = c.select(name(F.col("c_custkey")).alias("node_id"), _cat("f", F.col("c_nationkey")).alias("file_path"), F.col("c_mktsegment").alias("function_name"), F.col("c_custkey").cast("int").alias("line_start"), F.col("c_custkey").cast("int").alias("line_end"), F.lit("CALL").alias("node_type"), code.alias("code"))
    edges = c.select(name(F.col("c_custkey")).alias("src"), name(F.col("c_custkey") + 1).alias("dst"), F.lit("call").alias("type"))
    return nodes, edges


def _twice(spark, sf_dir) -> tuple[GraphStore, list]:
    """A store after a full load and one of two changed files, of which one is gone; and what was told on the way."""
    store, told = GraphStore(spark, _folder(spark, "store"), buckets=16), []
    told.append(store.has("r"))
    told.append(store.ingest(*_customer_graph(spark, sf_dir, "true", F.col("c_name")), "r", "1")["ingestion_mode"])
    told.append(store.has("r"))
    changed = spark.createDataFrame([("f1",), ("f2",)], "file_path string")
    told.append(store.ingest(*_customer_graph(spark, sf_dir, "c_nationkey = 1 and c_acctbal > 0", F.upper("c_name")), "r", "2", changed)["ingestion_mode"])
    return store, told


_KEPT_SQL = """(SELECT c_custkey AS k, 'f' || c_nationkey AS f, sha256('r:f' || c_nationkey || ':c' || c_custkey) AS node_id, CASE WHEN c_nationkey = 1 THEN upper(c_name) ELSE c_name END AS code, c_mktsegment AS name FROM customer WHERE c_nationkey NOT IN (1, 2) OR c_nationkey = 1 AND c_acctbal > 0)"""


@query(f"""WITH n AS {_KEPT_SQL} SELECT 'node' AS kind, node_id AS a, f AS b, sha256(code) AS c FROM n
UNION ALL SELECT 'edge', x.node_id, y.node_id, 'CALL' FROM n x JOIN n y ON y.k = x.k + 1 WHERE (x.f = 'f1') = (y.f = 'f1')""")
def stored_graph(spark, sf_dir):
    """Loaded in full, then for two changed files: what the store holds. Edges between a changed file and others go with the file's old nodes."""
    nodes, edges = _twice(spark, sf_dir)[0].load()
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("file_path").alias("b"), F.col("content_hash").alias("c")).union(edges.select(F.lit("edge"), "src", "dst", "type"))


def _document_graph(spark, sf_dir, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as functions of their sources, each calling the next of its language that the same file loads."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    line = F.col("n_chars").cast("int")
    nodes = rows.select(name.alias("node_id"), F.col("source").alias("file_path"), F.col("lang").alias("function_name"), line.alias("line_start"), line.alias("line_end"), F.lit("AST_FUNC").alias("node_type"), F.col("code"))
    after = lambda k: F.concat(F.lit("d"), (F.col("doc_id") + k).cast("string"))
    edges = rows.select(name.alias("src"), F.explode(F.array(after(1), after(2), after(20))).alias("dst"), F.lit("CALL").alias("type"))
    return nodes, edges


_CHANGED_SQL = """c AS (SELECT doc_id, source, 'd' || doc_id AS name, text AS was, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN text || '!' ELSE text END AS now FROM documents WHERE source IN ('src1', 'src2', 'src7')),
o AS (SELECT doc_id, source, sha256('r:' || source || ':d' || doc_id) AS node_id FROM documents),
e AS (SELECT a.node_id AS src, b.node_id AS dst, a.source AS sf, b.source AS df, a.doc_id AS sk, b.doc_id AS dk FROM o a JOIN o b ON b.doc_id - a.doc_id IN (1, 2, 20))"""


@query(f"""WITH {_CHANGED_SQL},
n AS (SELECT doc_id FROM c WHERE now IS NOT NULL)
SELECT 'state' AS kind, s AS a, CAST(count(*) FILTER (s = 'created' AND now IS NOT NULL AND was IS NULL OR s = 'updated' AND now <> was OR s = 'unchanged' AND now = was) AS VARCHAR) AS b
  FROM c, (VALUES ('created'), ('updated'), ('unchanged')) t(s) GROUP BY s
UNION ALL SELECT 'edge', src, dst FROM e WHERE sf NOT IN ('src1', 'src2', 'src7') AND df NOT IN ('src1', 'src2', 'src7') OR sk IN (SELECT doc_id FROM n) AND dk IN (SELECT doc_id FROM n)""")
def graph_changes(spark, sf_dir):
    """Three files loaded again: of their nodes a third is gone, a third has other code and a third is as it was. All edges between these files and others
    go, those of nodes that stay too; edges among the nodes loaded come."""
    docs, store = table(spark, sf_dir, "documents"), GraphStore(spark, _folder(spark, "store"), buckets=16)
    store.ingest(*_document_graph(spark, sf_dir, docs.withColumn("code", F.col("text"))), "r", "1")
    again = docs.where("source in ('src1', 'src2', 'src7') and doc_id % 3 > 0").withColumn("code", F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    told = store.ingest(*_document_graph(spark, sf_dir, again), "r", "2", spark.createDataFrame([("src1",), ("src2",), ("src7",)], "file_path string"))
    states = [("state", s, str(told[f"nodes_{s}"])) for s in ("created", "updated", "unchanged")]
    return spark.createDataFrame(states, "kind string, a string, b string").union(store.load()[1].select(F.lit("edge"), "src", "dst"))


@query(f"""WITH n AS {_KEPT_SQL} SELECT 'file' AS what, node_id, name FROM n WHERE f = 'f1' UNION ALL SELECT 'id', node_id, name FROM n WHERE k = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 7)
UNION ALL SELECT v, '', '' FROM (VALUES ('false'), ('full'), ('true'), ('incremental')) t(v)""")
def point_lookups(spark, sf_dir):
    """Nodes by file and by id, and whether a repository is there, before and after it is loaded."""
    store, told = _twice(spark, sf_dir)
    key = table(spark, sf_dir, "customer").where("c_nationkey = 7").agg(F.min("c_custkey")).first()[0]
    node_id = spark.range(1).select(F.sha2(F.lit(f"r:f7:c{key}"), 256)).first()[0]
    found = store.nodes_of("f1").select(F.lit("file").alias("what"), "node_id", F.col("function_name").alias("name")).union(store.node(node_id).select(F.lit("id"), "node_id", "function_name"))
    return found.union(spark.createDataFrame([(str(t).lower(), "", "") for t in told], "what string, node_id string, name string"))


@query("""WITH n AS (SELECT doc_id, doc_id % 4 = 0 AS gone, doc_id % 4 = 1 AS same FROM documents)
SELECT 'd' || doc_id || '.c' AS file_path, CASE WHEN same THEN 'f' ELSE 'g' END || doc_id AS caller, CASE WHEN same THEN 'recv' ELSE 'free' END AS callee FROM n WHERE NOT gone""")
def watched_files(spark, sf_dir):
    """A stream of changed files keeps a stored graph current. Each document's file comes in a first batch; in a second one, of four one is deleted, one
    is left out and two come with another text, twice, of which the last counts. What calls what in the graph."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    code = lambda name, call: _cat("int ", name, k, "(int a) {\n  ", call, "(a);\n}")
    at, store, checkpoint = _folder(spark, "changes"), _folder(spark, "watched"), _folder(spark, "stream")
    path = _cat("d", k, ".c").alias("file_path")
    first = d.select(path, code("f", "recv").alias("text"), F.lit(1).cast("long").alias("seq"))
    later = d.where(k % 4 != 1).select(path, F.explode(F.array(F.struct(code("h", "recv").alias("text"), F.lit(2).cast("long").alias("seq")), F.struct(F.when(k % 4 > 0, code("g", "free")).alias("text"), F.lit(3).cast("long").alias("seq")))).alias("r")).select("file_path", "r.*")
    for rows in (first, later):
        rows.write.mode("append").json(at)
        stream = spark.readStream.schema("file_path string, text string, seq long").json(at)
        ingress.watch_files(spark, stream, store, "r", checkpoint, once=True, buckets=16).awaitTermination()
    nodes, edges = GraphStore(spark, store).load()
    name = lambda end: nodes.select(F.col("node_id").alias(end), F.col("file_path").alias(f"{end}_file"), F.col("function_name").alias(f"{end}_name"), F.col("node_type").alias(f"{end}_type"))
    ends = edges.join(name("src"), "src").join(name("dst"), "dst")
    source = F.col("src_type") == "CALL_SOURCE"
    return ends.select(F.col("src_file").alias("file_path"), F.when(source, F.col("dst_name")).otherwise(F.col("src_name")).alias("caller"), F.when(source, F.col("src_name")).otherwise(F.col("dst_name")).alias("callee"))


_PROOFS_SQL = "SELECT l_suppkey, sha256(l_partkey || '|' || l_suppkey || '|' || l_returnflag) AS key, l_linestatus, l_quantity FROM lineitem"


@query(f"""WITH c AS ({_PROOFS_SQL}), k AS (SELECT DISTINCT key FROM c WHERE l_suppkey % 2 = 0 AND l_quantity > 10)
SELECT key, CASE WHEN key IN (SELECT key FROM k) THEN 'PROVEN' ELSE 'WARNING' END AS status, count(*) AS n FROM c GROUP BY 1, 2""")
def stored_proofs(spark, sf_dir):
    """Proofs of one review, kept in buckets, in place of what the next one computes."""
    li = table(spark, sf_dir, "lineitem")
    key = constraints.proof_key(F.lit(None), F.lit(None), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_returnflag"))
    none = F.array(F.struct(F.lit("x").alias("variable"), F.lit("1").alias("value"))).alias("witness")
    rows = lambda some, status: some.select(key.alias("key"), F.lit(status).alias("status"), F.lit("f").alias("formula"), F.lit(False).alias("reachability_only"), none)
    store = ProofStore(spark, f"proofs_{uuid.uuid4().hex}", _folder(spark, "proofs"), 8)
    first = li.where("l_suppkey % 2 = 0 and l_quantity > 10")
    store.add(rows(first, "PROVEN"))
    store.add(rows(first, "LIKELY"))  # known already
    return store.resolve(rows(li, "WARNING")).groupBy("key", "status").agg(F.count("*").alias("n"))


# ---- outputs ----


def _findings(spark, sf_dir) -> DataFrame:
    li, flag = table(spark, sf_dir, "lineitem"), F.col("l_returnflag")
    status = F.when(flag == "A", "PROVEN").when(flag == "N", "LIKELY").otherwise("ADVISORY")
    return li.select(_cat("f", F.col("l_suppkey")).alias("snk_file"), F.col("l_linenumber").cast("int").alias("snk_line"), F.lit("memcpy").alias("snk_func"), F.lit("r1").alias("rule_id"), status.alias("status"), F.lit(0.9).alias("confidence"), _cat("s", F.col("l_orderkey")).alias("summary"))


@query("""WITH f AS (SELECT 'f' || l_suppkey AS file, l_linenumber, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 4 ELSE 5 END AS ord, l_orderkey FROM lineitem),
l AS (SELECT ord, file, CASE WHEN ord < 5 THEN '- ' || file || ':' || l_linenumber || ' s' || l_orderkey || ' (0.90)' ELSE '- `memcpy` in `' || file || '` (rule `r1`): s' || l_orderkey END AS line FROM f),
p AS (SELECT s_suppkey, 'f' || s_suppkey AS file, count(f.file) AS n, coalesce(bool_or(ord = 3), false) AS v FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 30) LEFT JOIN f ON f.file = 'f' || s_suppkey GROUP BY 1, 2)
SELECT CAST(ord AS INT) AS ord, CASE ord WHEN 3 THEN 'Issues' WHEN 4 THEN 'Likely issues' ELSE 'Advice' END AS section, file, CAST(row_number() OVER (PARTITION BY ord, file ORDER BY line) AS INT) AS line_no, line FROM l
UNION ALL SELECT 2, 'Walkthrough', '', CAST(s_suppkey + 1 AS INT), '| `' || file || '` | — | ' || CASE WHEN v THEN n || ' issue(s)' WHEN n > 0 THEN n || ' note(s)' ELSE 'clean' END || ' |' FROM p
UNION ALL SELECT 1, 'Card', '', CAST(k AS INT), '| ' || t || ' | ' || v || ' |' FROM (VALUES (1, 'Risk level', 'HIGH'), (2, 'Verified bugs', (SELECT count(*) || '' FROM f WHERE ord = 3)), (3, 'Likely bugs', (SELECT count(*) || '' FROM f WHERE ord = 4)),
(4, 'Advisory notes', (SELECT count(*) || '' FROM f WHERE ord = 5)), (5, 'Files reviewed', (SELECT count(*) || '' FROM supplier))) x(k, t, v)""")
def report_lines(spark, sf_dir):
    """A report: card, walkthrough of the first thirty files, issues, likely issues, advice."""
    changed = table(spark, sf_dir, "supplier").select(_cat("f", F.col("s_suppkey")).alias("file_path"), F.col("s_suppkey").alias("ord"))
    return export.report_sections(_findings(spark, sf_dir), changed)


@query("""SELECT p_partkey, 'sequenceDiagram' || chr(10) || 'participant x' || p_size || '.c' || chr(10) || 'participant m' || p_size % 3 || '.c' || chr(10) || 'participant y.c' || chr(10) ||
'x' || p_size || '.c->>m' || p_size % 3 || '.c: g' || chr(10) || 'm' || p_size % 3 || '.c->>+m' || p_size % 3 || '.c: k' || chr(10) || 'm' || p_size % 3 || '.c->>y.c: h' AS diagram FROM part WHERE p_size > 25""")
def sequence_diagrams(spark, sf_dir):
    size = F.col("p_size")
    middle = lambda name: F.struct(F.lit("i").alias("node_id"), _cat("b/m", size % 3, ".c").alias("file_path"), F.lit(name).alias("function_name"), F.lit(1).alias("line_number"))
    found = table(spark, sf_dir, "part").select("p_partkey", F.when(size > 25, "PROVEN").otherwise("LIKELY").alias("status"), F.lit(True).alias("crosses_files"), F.lit("f").alias("src_func"), _cat("a/x", size, ".c").alias("src_file"), F.array(middle("g"), middle("k")).alias("intermediate_nodes"), F.lit("h").alias("snk_func"), F.lit("c/y.c").alias("snk_file"))
    return export.sequence_lines(found, "p_partkey")


@query("""SELECT 'f' || c_nationkey AS uri, CAST(greatest(c_custkey % 50, 1) AS INT) AS line, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'error' ELSE 'note' END AS level, c_name AS message, CAST(2 AS BIGINT) AS batch
FROM customer WHERE c_acctbal > 0""")
def sarif_document(spark, sf_dir):
    """Findings written as one SARIF document by all tasks, twice; a batch that comes again changes nothing. The document read back."""
    c, at = table(spark, sf_dir, "customer"), f"{_folder(spark, 'sarif')}.sarif"
    status = F.when(F.col("c_mktsegment") == "MACHINERY", "PROVEN").otherwise("LIKELY")
    found = c.where("c_acctbal > 0").select(_cat("f", F.col("c_nationkey")).alias("snk_file"), (F.col("c_custkey") % 50).cast("int").alias("snk_line"), _cat("s", F.col("c_nationkey")).alias("src_file"), F.lit(1).alias("src_line"), F.lit("r").alias("rule_id"), status.alias("status"), F.lit(0.9).alias("confidence"), F.col("c_name").alias("summary"), F.lit("").alias("formula"))
    results = export.sarif_results(found).repartition(6)
    for batch, rows in ((1, results.limit(3)), (2, results), (2, results.limit(5)), (1, results.limit(1))):
        sarif_sink.write_sarif(rows, at, batch=batch)
    one = "struct<level string, message struct<text string>, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int>>>>>"
    back = spark.read.schema(f"runs array<struct<results array<{one}>>>").json(at, multiLine=True).select(F.explode(F.flatten("runs.results")).alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    told = spark.read.text(f"{at}.batch").select(F.col("value").cast("long").alias("batch"))
    return back.select(place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("line"), "r.level", F.col("r.message.text").alias("message")).join(told)


@query("SELECT source AS file_path, CAST(n_chars % 7 AS INT) AS line_end, sha256(substr(text, 1, 3800)) AS body FROM documents WHERE lang <> 'fr' AND n_chars % 7 > 0")
def review_comments(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    fixes = d.select(F.when(F.col("lang") != "fr", F.col("source")).otherwise("").alias("file_path"), (F.col("n_chars") % 7).cast("int").alias("line_end"), F.col("text").alias("body"))
    return export.comment_rows(fixes).withColumn("body", F.sha2("body", 256))


@query("""SELECT 'findings' AS name, 'f' || l_suppkey AS key, CASE l_returnflag WHEN 'A' THEN 'PROVEN' WHEN 'N' THEN 'LIKELY' ELSE 'ADVISORY' END AS status, count(*) AS n FROM lineitem GROUP BY 1, 2, 3
UNION ALL SELECT 'rates', 'all', '', count(*) FROM lineitem""")
def state_json(spark, sf_dir):
    """A review's frames and an evaluation's figures, written as JSON and read back."""
    found, at = _findings(spark, sf_dir), _folder(spark, "state")
    export.write_json({"findings": found, "rates": found.agg(F.count("*").alias("n"))}, at)
    back = spark.read.schema(found.schema).json(f"{at}/findings")
    counts = back.groupBy(F.col("snk_file").alias("key"), "status").agg(F.count("*").alias("n")).select(F.lit("findings").alias("name"), "key", "status", "n")
    return counts.union(spark.read.schema("n long").json(f"{at}/rates").select(F.lit("rates"), F.lit("all"), F.lit(""), "n"))
