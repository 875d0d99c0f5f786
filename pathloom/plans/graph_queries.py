"""Graph storage, path search and scoring over the supplied tables.

The tables stand in for a code graph: events of a user form a chain of nodes, foreign keys are edges, event types and
part types are function names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import catalog
from pathloom.functions.scalars import content_hash
from pathloom.functions.tables import written
from pathloom.operators import distances, graph_store, metrics, paths, rules, scoring

from .registry import query, table

HOPS, TRAIL_HOPS = 15, 20
CHAIN_SQL = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"
PATHS_SQL = f"""(SELECT a.user_id, a.event_id AS src, b.event_id AS snk, a.event_type AS src_type, b.event_type AS snk_type, a.pos AS src_pos, b.pos AS snk_pos, CAST(b.pos - a.pos AS INT) AS path_len
 FROM {CHAIN_SQL} a JOIN {CHAIN_SQL} b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos + 1 AND a.pos + {{hops}} WHERE a.event_type = 'signup' AND b.event_type = 'purchase')"""


def event_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (file: the user; name: the event type) and edges to the user's next event."""
    e = table(spark, sf_dir, "events")
    nodes = e.select(F.col("event_id").cast("string").alias("node_id"), F.col("user_id").cast("string").alias("file_path"), F.col("event_type").alias("function_name"), F.lit(0).alias("line_start"), F.lit("CALL").alias("node_type"))
    edges = metrics.chain_edges(e, ["user_id"], ["ts", "event_id"], "event_id")
    return nodes, edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("CFG").alias("type"))


def _ends(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("function_name") == name).select(F.col("node_id").alias("node"))


@query("SELECT doc_id, sha256(text) AS content_hash, substr(sha256(source), 1, 16) AS repo_id FROM documents")
def content_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", content_hash(F.col("text")).alias("content_hash"), F.substring(F.sha2("source", 256), 1, 16).alias("repo_id"))


@query("""WITH o AS (SELECT c_custkey, c_name, c_acctbal FROM customer), n AS (SELECT c_custkey, upper(c_name) AS c_name, 0.0::DOUBLE AS c_acctbal FROM customer WHERE c_acctbal < 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)""")
def upsert_nodes(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_acctbal < 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return graph_store.upsert(old, new, ["c_custkey"])


@query("""SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC) r FROM lineitem) WHERE r = 1""")
def last_write_wins(spark, sf_dir):
    return graph_store.latest(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], "l_linenumber").select("l_orderkey", "l_partkey", "l_linenumber")


@query("""SELECT CAST(doc_id AS VARCHAR) AS node_id, source AS file_path, 'r' AS repo_id, n_chars FROM documents WHERE source NOT IN ('src3', 'src5')
UNION ALL SELECT 'new-' || doc_id, source, 'r', n_chars FROM documents WHERE source = 'src3' AND lang = 'en'""")
def incremental_replace(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    row = lambda name: [name.alias("node_id"), F.col("source").alias("file_path"), F.lit("r").alias("repo_id"), "n_chars"]
    old = d.select(*row(F.col("doc_id").cast("string")))
    new = d.where("source = 'src3' and lang = 'en'").select(*row(F.concat(F.lit("new-"), F.col("doc_id").cast("string"))))
    return graph_store.replace_files(old, new, spark.createDataFrame([("src3",), ("src5",)], "file_path string"), "r").select("node_id", "file_path", "repo_id", "n_chars")


@query("""WITH n AS (SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'o' || o_orderkey FROM orders UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size < 40),
e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'CALL' AS type FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey, 'REF' FROM lineitem)
SELECT DISTINCT src, dst, type FROM e WHERE src IN (SELECT node_id FROM n) AND dst IN (SELECT node_id FROM n)""")
def edge_write(spark, sf_dir):
    c, o, p, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "part", "lineitem"))
    name = lambda k, col: F.concat(F.lit(k), F.col(col).cast("string"))
    nodes = c.where("c_acctbal > 0").select(name("c", "c_custkey").alias("node_id")).union(o.select(name("o", "o_orderkey"))).union(p.where("p_size < 40").select(name("p", "p_partkey")))
    edges = o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.lit("call").alias("type")).union(li.select(name("o", "l_orderkey"), name("p", "l_partkey"), F.lit("Ref")))
    return graph_store.write_edges(edges, nodes)[0].select("src", "dst", "type")


@query("""WITH i AS (SELECT l_partkey AS local_id, max('s' || l_suppkey) AS node_id FROM lineitem WHERE l_quantity > 49 GROUP BY 1)
SELECT coalesce(i.node_id, 'l' || o.p_partkey) AS src, o.p_brand AS dst FROM part o LEFT JOIN i ON i.local_id = o.p_partkey""")
def id_remap(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy(F.concat(F.lit("l"), F.col("l_partkey").cast("string")).alias("local_id")).agg(F.max(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("node_id"))
    edges = table(spark, sf_dir, "part").select(F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("src"), F.col("p_brand").alias("dst"))
    return graph_store.remap(edges, ids).select("src", "dst")


@query("""SELECT event_type AS backend, count(*) AS n_files, sum(user_id) AS nodes_created FROM events GROUP BY 1""")
def backend_groups(spark, sf_dir):
    return graph_store.group_by_backend(table(spark, sf_dir, "events").select(F.col("event_type").alias("backend"), F.col("user_id").alias("n_nodes")))


@query("""SELECT n_name AS source, o_orderkey, l_linenumber, p_brand AS sink, CAST(4 AS INT) AS path_len, n_name || '>' || c_name || '>' || o_orderkey || '>' || l_linenumber || '>' || p_name AS path
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#13' AND c_mktsegment = 'BUILDING'""")
def fk_paths(spark, sf_dir):
    """Rows as nodes, foreign keys as edges: the expander from nations to parts of a brand."""
    n, c, o, li, p = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem", "part"))
    node = lambda kind, *cols: F.concat_ws("|", F.lit(kind), *[F.col(x).cast("string") for x in cols])
    some = c.where("c_mktsegment = 'BUILDING'")
    line, sold = li.withColumn("l", node("l", "l_orderkey", "l_linenumber")), p.select("p_partkey", node("p", "p_partkey", "p_name").alias("part"), "p_brand")
    edges = n.join(some, n["n_nationkey"] == c["c_nationkey"]).select(node("n", "n_name").alias("src"), node("c", "c_custkey", "c_name").alias("dst"))
    edges = edges.union(some.join(o, c["c_custkey"] == o["o_custkey"]).select(node("c", "c_custkey", "c_name"), node("o", "o_orderkey")))
    edges = edges.union(line.select(node("o", "l_orderkey"), "l")).union(line.join(sold, line["l_partkey"] == sold["p_partkey"]).select("l", "part"))
    starts, ends = n.select(node("n", "n_name").alias("node")), sold.where("p_brand = 'Brand#13'").select(F.col("part").alias("node"))
    found = paths.expand(edges.withColumn("type", F.lit("REF")), starts, ends, 4)
    last = lambda x: F.element_at(F.split(x, r"\|"), -1)
    names = F.transform("path", last)
    return found.select(names[0].alias("source"), names[2].cast("long").alias("o_orderkey"), names[3].cast("int").alias("l_linenumber"), F.lit("Brand#13").alias("sink"), "path_len", F.array_join(names, ">").alias("path"))


@query(f"SELECT CAST(src AS VARCHAR) AS src, CAST(snk AS VARCHAR) AS snk, path_len FROM {PATHS_SQL.format(hops=HOPS)}")
def event_paths(spark, sf_dir):
    """The general expander: nodes at most once, paths may pass other sinks."""
    nodes, edges = event_graph(spark, sf_dir)
    found = paths.expand(edges, _ends(nodes, "signup"), _ends(nodes, "purchase"), HOPS)
    return found.select(F.col("path")[0].alias("src"), F.element_at("path", -1).alias("snk"), "path_len")


@query(f"SELECT CAST(src AS VARCHAR) AS src, min_by(CAST(snk AS VARCHAR), path_len) AS snk, min(path_len) AS path_len FROM {PATHS_SQL.format(hops=HOPS)} GROUP BY src")
def event_first_sinks(spark, sf_dir):
    """The general expander, stopping at the first sink."""
    nodes, edges = event_graph(spark, sf_dir)
    found = paths.expand(edges, _ends(nodes, "signup"), _ends(nodes, "purchase"), HOPS, stop="any")
    return found.select(F.col("path")[0].alias("src"), F.element_at("path", -1).alias("snk"), "path_len")


@query(f"SELECT CAST(src AS VARCHAR) AS src, CAST(snk AS VARCHAR) AS snk, path_len FROM {PATHS_SQL.format(hops=TRAIL_HOPS)}")
def event_trails(spark, sf_dir):
    """The general expander over trails: edges at most once."""
    nodes, edges = event_graph(spark, sf_dir)
    found = paths.expand(edges, _ends(nodes, "signup"), _ends(nodes, "purchase"), TRAIL_HOPS, catalog.TRAIL_EDGES, uniqueness="edge")
    return found.select(F.col("path")[0].alias("src"), F.element_at("path", -1).alias("snk"), "path_len")


def _chain(spark, sf_dir, hops=HOPS, events=None):
    e = table(spark, sf_dir, "events") if events is None else events
    return paths.chain_paths(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase", hops)


@query(f"SELECT user_id, src_pos, snk_pos, path_len FROM {PATHS_SQL.format(hops=HOPS)}")
def chain_positions(spark, sf_dir):
    """The same paths by positions on the chain, without a loop."""
    return _chain(spark, sf_dir).select("user_id", "src_pos", "snk_pos", "path_len")


SCORED_SQL = f"""SELECT user_id, src_pos, snk_pos, path_len, '' AS rule_id, 'CRITICAL' AS rule_severity,
CAST(1.0 - CASE WHEN path_len + 1 > 10 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS pruner_score FROM {PATHS_SQL.format(hops=HOPS)}"""


@query(f"SELECT * FROM ({SCORED_SQL}) ORDER BY pruner_score DESC, path_len, user_id, src_pos, snk_pos LIMIT 100")
def event_paths_scored(spark, sf_dir):
    """Flagship: paths, the first rule of the sink's name, score, and the best hundred."""
    found = _chain(spark, sf_dir).withColumn("snk_func", F.lit("purchase"))
    ruled = rules.annotate(found, catalog.keywords_frame(spark))
    score = scoring.path_score(F.lit(False), F.col("snk_func"), F.col("rule_severity"), F.col("path_len") - 1)
    scored = ruled.withColumn("pruner_score", score).drop("snk_func")
    return scored.orderBy(F.desc("pruner_score"), "path_len", "user_id", "src_pos", "snk_pos").limit(100)


@query(f"SELECT user_id, src_pos, snk_pos, path_len FROM {PATHS_SQL.format(hops=HOPS)} WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)")
def scoped_paths(spark, sf_dir):
    """Sources only in changed files: here, users with a large error."""
    e = table(spark, sf_dir, "events")
    changed = e.where("event_type = 'error' and value > 90").select("user_id").distinct()
    return _chain(spark, sf_dir, events=e.join(changed, "user_id", "left_semi")).select("user_id", "src_pos", "snk_pos", "path_len")


@query(f"""SELECT CAST(event_id AS VARCHAR) AS node, CAST(min(d) AS INT) AS dist FROM (SELECT a.event_id, b.pos - a.pos AS d FROM {CHAIN_SQL} a JOIN {CHAIN_SQL} b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos AND a.pos + 6 WHERE b.event_type = 'purchase') GROUP BY 1""")
def sink_distances(spark, sf_dir):
    """Least hops to a sink, up to six."""
    nodes, edges = event_graph(spark, sf_dir)
    return paths.distances_to(edges.select("src", "dst"), _ends(nodes, "purchase"), 6)


@query("""WITH e AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem), n AS (SELECT 'p' || p_partkey AS p, p_size FROM part)
SELECT a.p || '>' || a.s || '>' || b.p AS path, CAST(2 AS INT) AS path_len FROM e a JOIN e b ON a.s = b.s AND a.p <> b.p WHERE a.p IN (SELECT p FROM n WHERE p_size <= 3) AND b.p IN (SELECT p FROM n WHERE p_size >= 48)
ORDER BY a.p, b.p, a.s LIMIT 100""")
def first_dense_paths(spark, sf_dir):
    """Parts and suppliers lead to each other both ways, so that paths of up to fifteen hops are past counting: the first hundred."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    there = li.select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst")).distinct()
    edges = there.union(there.select("dst", "src")).withColumn("type", F.lit("CALL"))
    node = lambda where: p.where(where).select(name("p", "p_partkey").alias("node"))
    found = paths.expand(edges, node("p_size <= 3"), node("p_size >= 48"), most=100)
    return found.select(F.array_join("path", ">").alias("path"), "path_len")


_STEPS_SQL = """SELECT c_custkey AS a, c_custkey + 1 AS b, c_custkey % 11 = 0 AS cut, false AS new FROM customer UNION ALL SELECT c_custkey, c_custkey + 7, c_custkey % 5 = 0, false FROM customer
UNION ALL SELECT c_custkey, c_custkey - 30, false, true FROM customer WHERE c_custkey % 13 = 0"""


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_STEPS_SQL}) WHERE NOT cut),
r AS (SELECT c_custkey AS k, CAST(0 AS INT) AS d FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0 OR c_nationkey = 4 AND c_acctbal > 5000 UNION SELECT e.a, r.d + 1 FROM r JOIN e ON e.b = r.k WHERE r.d < 12)
SELECT 'n' || k AS node, min(d) AS dist FROM r GROUP BY k""")
def distance_updates(spark, sf_dir):
    """Distances to some customers, brought up to date after edges and ends went and came."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = lambda x: F.concat(F.lit("n"), x.cast("string"))
    step = lambda where, by: c.where(where).select(name(k).alias("src"), name(k + by).alias("dst"))
    node = lambda where: c.where(where).select(name(k).alias("node"))
    before, new = step("true", 1).union(step("true", 7)), step("c_custkey % 13 = 0", -30)
    cut = step("c_custkey % 11 = 0", 1).union(step("c_custkey % 5 = 0", 7))
    known = paths.distances_to(before, node("c_nationkey = 3"), 12)
    now = written(step("c_custkey % 11 > 0", 1).union(step("c_custkey % 5 > 0", 7)).union(new), "edges")
    ends = node("c_nationkey = 3 and c_acctbal > 0 or c_nationkey = 4 and c_acctbal > 5000")
    return distances.updated(known, now, ends, 12, cut, new, node("c_nationkey = 4 and c_acctbal > 5000"))[0]


_BRIDGE_SQL = """WITH h AS (SELECT p_partkey FROM part WHERE p_size = 7), i AS (SELECT DISTINCT 'o' || l_orderkey AS a, l_partkey FROM lineitem WHERE l_partkey IN (SELECT * FROM h)),
o AS (SELECT DISTINCT l_partkey, 's' || l_suppkey AS b FROM lineitem WHERE l_partkey IN (SELECT * FROM h))
SELECT DISTINCT a AS src, b AS dst FROM i JOIN o USING (l_partkey) WHERE (a, b) NOT IN (SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem WHERE l_quantity > 40)"""


@query(_BRIDGE_SQL)
def summary_bridge(spark, sf_dir):
    """Parts of one size are opaque calls from orders to suppliers; large quantities already have a summary edge."""
    nodes, edges, had = _opaque_parts(spark, sf_dir)
    return paths.bridge_opaque_calls(nodes, edges, most=None).where("summary").join(had, ["src", "dst"], "left_anti").select("src", "dst")


@query(_BRIDGE_SQL + " ORDER BY 1, 2 LIMIT 500")
def first_bridges(spark, sf_dir):
    """The first 500 of them."""
    nodes, edges, had = _opaque_parts(spark, sf_dir)
    return paths.bridge_opaque_calls(nodes, edges).where("summary").join(had, ["src", "dst"], "left_anti").select("src", "dst")


def _opaque_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, and the summary edges among them."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    nodes = p.select(name("p", "p_partkey").alias("node_id"), F.when(F.col("p_size") == 7, "memcpy").otherwise("other").alias("function_name"), F.lit("CALL").alias("node_type"))
    flow = li.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")).union(li.select(name("p", "l_partkey"), name("s", "l_suppkey"))).select("src", "dst", F.lit("REACHING_DEF").alias("type"), F.lit(None).cast("boolean").alias("summary"))
    had = li.where("l_quantity > 40").select(name("o", "l_orderkey").alias("src"), name("s", "l_suppkey").alias("dst"), F.lit("REACHING_DEF").alias("type"), F.lit(True).alias("summary"))
    return nodes, flow.unionByName(had), had


@query("""WITH f AS (SELECT p_partkey, p_brand || p_size AS name FROM part), d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT DISTINCT 's' || l_suppkey AS src, 'p' || g.p_partkey AS dst FROM d JOIN f ON f.p_partkey = d.l_partkey JOIN f g ON g.name = f.name AND g.p_partkey <> f.p_partkey""")
def virtual_dispatch(spark, sf_dir):
    """Suppliers call parts; each call may reach all other parts of equal brand and size."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    calls = li.select(name("s", "l_suppkey").alias("node_id")).distinct().select("node_id", F.lit("").alias("function_name"), F.lit("CALL").alias("node_type"))
    nodes = p.select(name("p", "p_partkey").alias("node_id"), F.concat("p_brand", F.col("p_size").cast("string")).alias("function_name"), F.lit("AST_FUNC").alias("node_type")).unionByName(calls)
    edges = li.select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"), F.lit("CALL").alias("type"), F.lit(None).cast("boolean").alias("resolved_virtual"))
    return paths.resolve_virtual_calls(nodes, edges).where("resolved_virtual").select("src", "dst")


WORDS = [("steel_rule", "CRITICAL", "call:STEEL|call:BRASS"), ("promo_rule", "ADVISORY", "call:PROMO"), ("tin_rule", "CRITICAL", "type:X|call:TIN|call:ECONOMY")]
WORD_RULES = [catalog.Rule(i, s, p) for i, s, p in WORDS]
WORD_SQL = "(VALUES (0, 'steel_rule', 'CRITICAL', 'STEEL'), (0, 'steel_rule', 'CRITICAL', 'BRASS'), (1, 'promo_rule', 'ADVISORY', 'PROMO'), (2, 'tin_rule', 'CRITICAL', 'TIN'), (2, 'tin_rule', 'CRITICAL', 'ECONOMY')) k(o, rule, sev, word)"


@query(f"""SELECT p_partkey, coalesce(rule_id, '') AS rule_id, coalesce(rule_severity, 'CRITICAL') AS rule_severity FROM part LEFT JOIN
(SELECT p_partkey, arg_min(rule, o) AS rule_id, arg_min(sev, o) AS rule_severity FROM part JOIN {WORD_SQL} ON contains(p_type, word) GROUP BY 1) USING (p_partkey)""")
def rule_annotate(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("snk_func"))
    return rules.annotate(p, catalog.keywords_frame(spark, WORD_RULES)).select("p_partkey", "rule_id", "rule_severity")


@query(r"""SELECT DISTINCT url AS file_path, rule_id FROM pages, (VALUES ('en_pages', '(^|/)([^/]*/)?en/[^/]*$'), ('any_com', '(^|/)[^/]*\.com/([^/]*/)?[^/]*$'), ('secure', '(^|/)https:/([^/]*/)?[^/]*\.org/de/[^/]*$')) r(rule_id, rx)
WHERE regexp_matches(regexp_replace(url, '/+', '/', 'g'), rx)""")
def glob_rules(spark, sf_dir):
    made = [catalog.Rule("en_pages", "CRITICAL", "", ("**/en/*",)), catalog.Rule("any_com", "CRITICAL", "", ("*.com/**/*",)), catalog.Rule("secure", "ADVISORY", "", ("https:/**/*.org/de/*",))]
    return rules.rules_for_files(table(spark, sf_dir, "pages").select(F.col("url").alias("file_path")), catalog.rules_frame(spark, made)).select("file_path", "rule_id")


TEXT_RULES = [catalog.Rule("secret_rule", "CRITICAL", "call:token|call:password"), catalog.Rule("license_rule", "CRITICAL", "call:License|pdg:licensed"), catalog.Rule("note", "ADVISORY", "call:the"), catalog.Rule("kind_rule", "CRITICAL", "type:the|call:worthless")]


@query("""WITH k(o, rule_id, j, w) AS (VALUES (0, 'secret_rule', 0, 'token'), (0, 'secret_rule', 1, 'password'), (1, 'license_rule', 0, 'License'), (1, 'license_rule', 1, 'licensed'), (3, 'kind_rule', 0, 'type:the'), (3, 'kind_rule', 1, 'worthless')),
m AS (SELECT doc_id, o, rule_id, arg_min(w, j) AS w FROM documents, k WHERE contains(text, w) GROUP BY ALL)
SELECT CAST(m.doc_id AS VARCHAR) AS file_path, m.rule_id, m.w AS keyword, CAST(list_position(list_transform(string_split(text, chr(10)), lambda x: contains(x, m.w)), true) AS INT) AS line_number, 'LIKELY' AS status, 0.72::DOUBLE AS confidence
FROM m JOIN documents d ON d.doc_id = m.doc_id""")
def keyword_fallback(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text")
    return rules.search_text(files, catalog.keywords_frame(spark, TEXT_RULES))


@query(f"""SELECT user_id, src_pos, snk_pos, r > 100 AS was_pruned FROM (SELECT *, row_number() OVER (ORDER BY s DESC, user_id, src_pos, snk_pos) AS r FROM
(SELECT *, CASE WHEN path_len % 3 = 0 THEN 3 ELSE 0 END + 1 - CASE WHEN path_len + 1 > 10 THEN 1 ELSE 0 END AS s FROM {PATHS_SQL.format(hops=HOPS)}))""")
def prune_topk(spark, sf_dir):
    found = _chain(spark, sf_dir).withColumn("path_id", F.concat_ws("-", *[F.col(c).cast("string") for c in ("user_id", "src_pos", "snk_pos")]))
    scored = found.withColumn("pruner_score", scoring.path_score(F.col("path_len") % 3 == 0, F.lit("purchase"), F.lit("CRITICAL"), F.col("path_len") - 1))
    return scoring.prune(scored, ["user_id", "src_pos", "snk_pos"]).select("user_id", "src_pos", "snk_pos", "was_pruned")


@query(f"""SELECT user_id, src_pos, snk_pos, path_len FROM {PATHS_SQL.format(hops=HOPS)} ORDER BY path_len, user_id, src_pos, snk_pos LIMIT 100""")
def shortest_paths(spark, sf_dir):
    return paths.shortest(_chain(spark, sf_dir), 100, ["user_id", "src_pos", "snk_pos"]).select("user_id", "src_pos", "snk_pos", "path_len")


@query("""WITH f AS (SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.cpp' ELSE '.txt' END AS file_path, source, lang FROM documents)
SELECT file_path, CAST(CASE WHEN source IN ('src1', 'src2') THEN 10 ELSE 0 END + CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 3 ELSE 0 END + 0.5 * CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END AS DOUBLE) AS score
FROM f ORDER BY score DESC, file_path LIMIT 40""")
def scan_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".cpp").otherwise(".txt")
    files = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("file_path"), "source")
    made = [catalog.Rule("a", "CRITICAL", "", ("**/*.py",)), catalog.Rule("b", "CRITICAL", "", ("**/*.py", "**/*.cpp")), catalog.Rule("c", "ADVISORY", "", ("**/*",))]
    return scoring.scan_priority(files, files.where("source in ('src1', 'src2')"), rules.rules_for_files(files, catalog.rules_frame(spark, made)))


@query("SELECT o_custkey, count(*) AS n_files, CAST(CASE WHEN count(*) <= 5 THEN 9 WHEN count(*) <= 20 THEN 5 ELSE 1 END AS INT) AS priority FROM orders GROUP BY 1")
def queue_priority(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_files")).withColumn("priority", scoring.queue_priority(F.col("n_files")))


@query(f"""SELECT user_id, src_pos, snk_pos, array_to_string(list_distinct_ordered, ',') AS participants FROM (SELECT user_id, src_pos, snk_pos,
(SELECT list(t ORDER BY p) FROM (SELECT event_type AS t, min(pos) AS p FROM {CHAIN_SQL} e WHERE e.user_id = q.user_id AND e.pos BETWEEN q.src_pos AND q.snk_pos GROUP BY 1)) AS list_distinct_ordered FROM {PATHS_SQL.format(hops=4)} q)""")
def participants(spark, sf_dir):
    """Event types along each path, in the order of their first appearance."""
    nodes, edges = event_graph(spark, sf_dir)
    found = paths.project(paths.expand(edges, _ends(nodes, "signup"), _ends(nodes, "purchase"), 4), nodes)
    at = table(spark, sf_dir, "events").selectExpr("cast(event_id as string) AS src_id", "user_id", "row_number() over (partition by user_id order by ts, event_id) AS src_pos")
    names = metrics.participants(F.transform("path_nodes", lambda n: n["function_name"]))
    return found.join(at, "src_id").select("user_id", "src_pos", (F.col("src_pos") + F.col("path_len")).alias("snk_pos"), F.array_join(names, ",").alias("participants"))


@query(f"""SELECT q.user_id, src_pos, snk_pos, CAST(a.pos - src_pos + 1 AS INT) AS pos, a.event_type AS a, b.event_type AS b FROM {PATHS_SQL.format(hops=4)} q
JOIN {CHAIN_SQL} a ON a.user_id = q.user_id AND a.pos BETWEEN src_pos AND snk_pos - 1 JOIN {CHAIN_SQL} b ON b.user_id = a.user_id AND b.pos = a.pos + 1""")
def adjacent_pairs(spark, sf_dir):
    nodes, edges = event_graph(spark, sf_dir)
    found = paths.project(paths.expand(edges, _ends(nodes, "signup"), _ends(nodes, "purchase"), 4), nodes)
    at = table(spark, sf_dir, "events").selectExpr("cast(event_id as string) AS src_id", "user_id", "row_number() over (partition by user_id order by ts, event_id) AS src_pos")
    rows = found.join(at, "src_id").select("user_id", "src_pos", (F.col("src_pos") + F.col("path_len")).alias("snk_pos"), F.transform("path_nodes", lambda n: n["function_name"]).alias("names"))
    return metrics.adjacent_pairs(rows, ["user_id", "src_pos", "snk_pos"], "names")
