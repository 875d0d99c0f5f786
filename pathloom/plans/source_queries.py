"""Scanner output, repository content and events over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import catalog, scalars
from pathloom.operators import filters, requests
from pathloom.sources import extract, repo, scanners
from pathloom.streaming import ingress

from .registry import query, table


@query(r"""SELECT doc_id, CAST(i - 1 AS INT) AS pos, calls[i] AS name FROM (SELECT doc_id, calls, unnest(range(1, len(calls) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Za-z0-9_]+)\s*[(|=]', 1) AS calls FROM documents))""")
def call_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z0-9_])([A-Za-z0-9_]+)\s*[(|=]"), 1)).alias("pos", "name"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS file_path, CAST(n AS INT) AS line_start, trim(line) AS code FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, 'The') AND contains(line, ', and')""")
def line_scan(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text")
    return scanners.lines_with(files, ["The", ", and"], "unsafe_block").select("file_path", "line_start", "code")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""")
def json_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'js' WHEN 'de' THEN 'go' ELSE 'cpp' END AS backend FROM documents""")
def ext_dispatch(spark, sf_dir):
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".tsx").when(F.col("lang") == "de", ".go").otherwise(".xyz")
    return table(spark, sf_dir, "documents").select("doc_id", scanners.backend_for(F.concat("source", F.lit("/a.b/"), "lang", ext)).alias("backend"))


DIAG_SQL = "'/r/d' || user_id || '.c:' || event_id || ':4: ' || CASE WHEN value > 50 THEN 'warning' ELSE 'note' END || ': ' || CASE event_type WHEN 'click' THEN 'Buffer overflow seen' WHEN 'view' THEN 'call to strcpy' WHEN 'error' THEN 'double-free of x' ELSE 'style' END || ' [' || CASE event_type WHEN 'view' THEN 'security.insecureAPI.strcpy' ELSE 'core.X' END || ']'"


@query("""SELECT 'd' || user_id || '.c' AS file_path, CASE event_type WHEN 'click' THEN 'memcpy' WHEN 'view' THEN 'strcpy' ELSE 'free' END AS function_name, CAST(event_id AS INT) AS line_start, CASE event_type WHEN 'click' THEN 'Buffer overflow seen' WHEN 'view' THEN 'call to strcpy' ELSE 'double-free of x' END AS code
FROM events WHERE value > 50 AND event_type IN ('click', 'view', 'error')""")
def diagnostics(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.expr(DIAG_SQL.replace("user_id", "CAST(user_id AS STRING)").replace("event_id", "CAST(event_id AS STRING)")).alias("value"))
    return scanners.diagnostics(lines, "/r").select("file_path", "function_name", "line_start", "code")


@query("""SELECT 'f' || o_custkey || '.py' AS file_path, 'rule_' || o_orderpriority AS function_name, CAST(o_orderkey AS INT) AS line_start, CAST(o_orderkey + 1 AS INT) AS line_end FROM orders""")
def json_scanner(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = F.struct(F.concat(F.lit("a.b.rule_"), "o_orderpriority").alias("check_id"), F.concat(F.lit("/r/f"), F.col("o_custkey").cast("string"), F.lit(".py")).alias("path"), F.struct(F.col("o_orderkey").alias("line")).alias("start"), F.struct((F.col("o_orderkey") + 1).alias("line")).alias("end"))
    raw = o.select(F.to_json(F.struct(F.array(r).alias("results"))).alias("value"))
    return scanners.semgrep(raw, root="/r").select("file_path", "function_name", "line_start", "line_end")


@query("""SELECT 'f' || o_custkey AS file_path, CAST(CASE WHEN o_orderstatus = 'O' THEN o_orderkey ELSE 0 END AS INT) AS line_start FROM orders""")
def gosec_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderstatus") == "O", F.concat(F.col("o_orderkey").cast("string"), F.lit("-99"))).otherwise("x")
    r = F.struct(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file"), line.alias("line"), F.lit("G1").alias("rule_id"), F.lit("c").alias("code"))
    return scanners.gosec(o.select(F.to_json(F.struct(F.array(r).alias("Issues"))).alias("value"))).select("file_path", "line_start")


@query("""SELECT 'f' || o_custkey AS file_path, 'sql_injection' AS function_name, CAST(0 AS INT) AS line_start, o_orderpriority AS code FROM orders
UNION ALL SELECT 'f' || o_custkey, 'a_b', CAST(o_orderkey AS INT), 'm' FROM orders WHERE o_totalprice > 100000
UNION ALL SELECT 'f' || o_custkey, 'B1', CAST(o_orderkey AS INT), 'x' FROM orders""")
def other_scanners(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f, n = F.concat(F.lit("f"), F.col("o_custkey").cast("string")), F.col("o_orderkey").cast("int")
    brakeman = scanners.brakeman(o.select(F.to_json(F.struct(F.array(F.struct(F.lit("SQL Injection").alias("warning_type"), f.alias("file"), F.col("o_orderpriority").alias("code"))).alias("warnings"))).alias("value")))
    severity = F.when(F.col("o_totalprice") > 100000, 2).otherwise(1)
    eslint = scanners.eslint(o.select(F.to_json(F.array(F.struct(f.alias("filePath"), F.array(F.struct(F.lit("a/b").alias("ruleId"), severity.alias("severity"), n.alias("line"), F.lit("m").alias("message"))).alias("messages")))).alias("value")))
    bandit = scanners.bandit(o.select(F.to_json(F.struct(F.array(F.struct(f.alias("filename"), F.lit("B1").alias("test_id"), n.alias("line_number"), F.lit(" x\n").alias("code"))).alias("results"))).alias("value")))
    return brakeman.unionByName(eslint).unionByName(bandit).select("file_path", "function_name", "line_start", "code")


@query("""WITH b AS (SELECT 0 AS o, source, n_chars, doc_id FROM documents WHERE lang = 'fr' UNION ALL SELECT 1, source, n_chars, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 2, source, n_chars, doc_id FROM documents)
SELECT source, n_chars, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, n_chars ORDER BY o, doc_id) AS r FROM b) WHERE r = 1""")
def union_dedup_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "n_chars", "doc_id", "lang")
    branches = [d.where("lang = 'fr'"), d.where("lang = 'en'"), d]
    return scanners.union_first(branches, ["source", "n_chars"], ["doc_id"]).select("source", "n_chars", "doc_id")


@query("""SELECT source || '/m.c' AS file_path, CAST(doc_id AS INT) AS line_number, lang AS rule_id FROM documents WHERE n_chars > 500 GROUP BY ALL""")
def suppression_lines(spark, sf_dir):
    """Suppression lines made of documents; short ones make malformed lines."""
    d = table(spark, sf_dir, "documents")
    line = F.when(F.col("n_chars") > 500, F.concat(F.lit("  "), "source", F.lit("/m.c:"), F.col("doc_id").cast("string"), F.lit(" :"), "lang", F.lit(":extra"))).when(F.col("lang") == "en", "# note:1:x").when(F.col("lang") == "fr", "a:b:c").otherwise("a:1")
    return catalog.parse_suppressions(d.select(line.alias("value")))


@query("""SELECT framework FROM (SELECT DISTINCT CASE WHEN contains(lower(text), 'the') THEN 'django' END AS framework FROM documents UNION SELECT CASE WHEN contains(lower(text), 'und ') THEN 'gin' END FROM documents) WHERE framework IS NOT NULL""")
def framework_detect(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    manifests = d.select(F.lit("requirements.txt").alias("file_name"), "text").union(d.select(F.lit("go.mod"), "text"))
    return catalog.detect_frameworks(manifests, [("django", "requirements.txt", "The"), ("gin", "go.mod", "UND "), ("rails", "Gemfile", "the")])


@query("""SELECT DISTINCT 'f' || c_nationkey || '.c' AS file_path, CASE WHEN c_nationkey < 10 THEN 'clang' ELSE 'c++' END AS compiler, CASE WHEN c_nationkey < 10 THEN '-O3' ELSE '-O1' END AS opt_level, CASE WHEN c_nationkey < 10 THEN '-O2,-DX=1,-O3' ELSE '' END AS flags FROM customer""")
def compile_settings(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = lambda n: F.concat(F.lit("f"), n.cast("string"), F.lit(".c"))
    files = c.select(name(F.col("c_nationkey")).alias("file_path"))
    commands = table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("/"), name(F.col("n_nationkey"))).alias("file"), F.lit("clang -O2 -DX=1 -fplugin=x -B/y --sysroot=/z -O3 in.c").alias("command"))
    found = repo.compile_settings(files.withColumn("file_path", F.col("file_path")), commands)
    return found.select("file_path", "compiler", "opt_level", F.array_join("flags", ",").alias("flags"))


@query("""SELECT 'meson' AS build_system""")
def build_system(spark, sf_dir):
    files = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") == 3, "Makefile").when(F.col("n_nationkey") == 5, "meson.build").otherwise("x").alias("file_path"))
    return repo.build_system(files)


@query("""WITH f AS (SELECT * FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 200), v AS (SELECT *, CAST(n_chars % 2 AS INT) AS vul FROM f)
SELECT doc_id || '-1' AS case_id, sha256(text) AS code, true AS is_vulnerable FROM (SELECT * FROM v WHERE vul = 1 ORDER BY doc_id LIMIT 100)
UNION ALL SELECT doc_id || '-0', sha256(source), false FROM (SELECT * FROM v WHERE vul = 0 ORDER BY doc_id LIMIT 100)""")
def pair_corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), "lang", (F.col("n_chars") % 2).cast("int").alias("vul"), F.col("text").alias("func_before"), F.col("source").alias("func_after"))
    return repo.pair_corpus(d, "en", 100).withColumn("code", F.sha2("code", 256))


@query("""SELECT doc_id || '-' || v AS case_id, CASE WHEN v THEN source ELSE lang END AS code, v AS is_vulnerable FROM (SELECT * FROM documents WHERE lang = 'fr' AND n_chars > 300 ORDER BY doc_id LIMIT 50), (VALUES (true), (false)) t(v)""")
def change_corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 300, F.col("source")).alias("code_before"), F.col("lang").alias("code_after"), F.upper("lang").alias("programming_language"))
    return repo.change_corpus(d, "fr", 50)


@query(r"""SELECT conv_id, turn, lower(regexp_extract(x, '(?i) @bot(?:-x)?\s+(\S+)(?:\s+(.+))?', 1)) AS cmd, regexp_extract(x, '(?i) @bot(?:-x)?\s+(\S+)(?:\s+(.+))?', 2) AS args, lower(regexp_extract(x, '(?i) @bot(?:-x)?\s+(\S+)(?:\s+(.+))?', 1)) IN ('explain', 'generate-fix', 'summarize', 'ignore', 'help') AS known
FROM (SELECT conv_id, turn, text || CASE WHEN role = 'user' THEN ' @Bot-x  Explain CWE-' || turn ELSE ' @bot ' || split_part(text, ' ', 1) END AS x FROM conversations) WHERE regexp_extract(x, '(?i) @bot(?:-x)?\s+(\S+)(?:\s+(.+))?', 1) <> ''""")
def webhook_commands(spark, sf_dir):
    tail = F.when(F.col("role") == "user", F.concat(F.lit(" @Bot-x  Explain CWE-"), F.col("turn").cast("string"))).otherwise(F.concat(F.lit(" @bot "), F.split_part("text", F.lit(" "), F.lit(1))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("x"))
    return ingress.parse_commands(rows, F.col("x"), "bot").drop("x")


@query("""SELECT o_custkey, n_files, CAST(CASE WHEN n_files <= 5 THEN 9 WHEN n_files <= 20 THEN 5 ELSE 1 END AS INT) AS priority FROM (SELECT o_custkey, count(*) AS n_files FROM orders GROUP BY 1) ORDER BY priority DESC, o_custkey""")
def job_queue(spark, sf_dir):
    return ingress.queue(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_files")), "o_custkey")


@query("""SELECT doc_id, strlen(x) <= 16384 AND contains(x, '::') AS asked FROM (SELECT doc_id, text || CASE WHEN lang = 'en' THEN ' a::b' ELSE ' #include' END AS x FROM documents)""")
def surface_guards(spark, sf_dir):
    text = F.concat("text", F.when(F.col("lang") == "en", " a::b").otherwise(" #include"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.may_have_surface(text).alias("asked"))


@query()
def extracted_calls(spark, sf_dir):
    """Functions, sources and sinks of C-like text made of documents; brace matching has no SQL counterpart."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("int f"), F.col("doc_id").cast("string"), F.lit("(int a) {\n  read(argv[1]);\n"), F.regexp_replace("text", "[(){}]", " "), F.lit("\n  if (a) { memcpy(a, b, 3); }\n}\n"))
    nodes, edges = extract.extract_graph(d.select(F.col("doc_id").cast("string").alias("file_path"), body.alias("text")))
    return nodes.join(edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n_out")), "node_id", "left").select("file_path", "function_name", "line_start", "line_end", "node_type", F.coalesce("n_out", F.lit(0)).alias("n_out"))


@query("""WITH f AS (SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.go' ELSE '.cc' END AS file_path, doc_id, lang, text || CASE WHEN lang = 'en' THEN ' a::b' ELSE '' END AS text FROM documents ORDER BY doc_id LIMIT 10)
SELECT file_path, sha256(text) AS content_hash, 'go' AS language, substr(text, 1, 4000) AS text FROM f WHERE lang = 'en' AND strlen(text) <= 16384 AND doc_id <> 1 ORDER BY doc_id LIMIT 5""")
def surface_requests(spark, sf_dir):
    """The first files that pass the guards and have no answer yet."""
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", ".go").otherwise(".cc")
    files = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("file_path"), F.col("doc_id").alias("ord"), F.concat("text", F.when(F.col("lang") == "en", " a::b").otherwise("")).alias("text"))
    known = files.where("ord = 1").select(scalars.content_hash(F.col("text")).alias("content_hash"))
    return requests.surface_requests(files, known)


@query("""SELECT source || '/' || doc_id AS file_path, sha256(text) AS content_hash, 'c++' AS language, substr(text, 1, 8000) AS text FROM documents WHERE strlen(text) < 50000 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def remark_requests(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("doc_id").alias("ord"), "text")
    bad = files.join(table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("ord")), "ord", "left_semi").select(F.col("file_path").alias("snk_file"), F.lit("PROVEN").alias("status"))
    return requests.remark_requests(files, filters.unreported_files(files, bad, most=None))
