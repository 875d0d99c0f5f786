"""Names, rules and profiles that decide what counts as a source, a sink, a rule match or a safe call.

All of it is data: the constants below are defaults, every operator takes frames or lists of its own, and the
loaders at the end read further rules and safe names from files.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions that return data from outside.
SOURCES = [
    "argv", "getenv", "read", "fread", "recv", "recvfrom", "recvmsg", "scanf", "fscanf", "sscanf", "fgets", "gets", "getline", "readlink", "getopt", "getopt_long",
    "accept", "socket", "connect", "getData", "getInput", "helperBad", "CWE121_bad_source", "CWE416_bad_source", "CWE415_bad_source", "CWE457_bad_source", "malloc",
    "calloc", "realloc", "mmap", "SysAllocString", "SysAllocStringLen", "SysAllocStringByteLen", "CoTaskMemAlloc", "std::cin", "std::ifstream", "std::getline",
    "std::unique_ptr::release",
]

# Functions that are dangerous to reach ("operator delete" has a blank).
SINKS = [
    "memcpy", "memmove", "memset", "memccpy", "memalign", "strcpy", "strcat", "sprintf", "vsprintf", "snprintf", "strncpy", "strncat", "strtok", "system", "popen",
    "exec", "execve", "execl", "execv", "execvp", "free", "delete", "SysFreeString", "CoTaskMemFree", "CopyTo", "Attach", "Detach", "std::unique_ptr::reset",
    "std::thread", "pthread_create", "fork", "operator delete",
]

# Copies that hide a flow, and node types that may start a path.
OPAQUE_COPIES = ["memcpy", "memmove", "strcpy", "strncpy", "std::copy", "std::copy_n"]
SOURCE_TYPES = ["CALL_SOURCE", "CALL", "IDENTIFIER", "METHOD_PARAMETER_IN", "METHOD"]
SINK_TYPES = ["CALL_SINK", "CALL"]
FLOW_EDGES = ["CALL", "REACHING_DEF", "REF", "ALIAS", "CFG", "AST", "ARGUMENT", "RECEIVER"]
TRAIL_EDGES = [e for e in FLOW_EDGES if e != "ALIAS"]

# Statuses from strongest to weakest, and those that count as verified, positive or reportable.
STATUSES = ["PROVEN", "FUZZ_VERIFIED", "SANDBOX_VERIFIED", "LIKELY", "WARNING", "ADVISORY", "FALSE_POSITIVE"]
VERIFIED = ["PROVEN", "SANDBOX_VERIFIED", "FUZZ_VERIFIED"]
POSITIVE = [*VERIFIED, "LIKELY"]

# The default rules in load order: id, severity, pattern, globs.
RULES = [
    ("no_raw_malloc_free", "CRITICAL", "call:malloc|call:free|call:calloc|call:realloc", ["**/*.cpp", "**/*.cc", "**/*.c", "**/*.h", "**/*.hpp"]),
    ("no_unbounded_memcpy", "CRITICAL", "call:memcpy|call:memset|call:memmove", ["**/*.cpp", "**/*.cc", "**/*.c"]),
    ("no_raw_pointers_auth", "CRITICAL", "type:RawPointer", ["**/auth/**/*.cpp", "**/auth/**/*.h", "**/auth/**/*.hpp"]),
    ("no_strcpy_strcat", "CRITICAL", "call:strcpy|call:strcat|call:sprintf|call:gets", ["**/*.cpp", "**/*.cc", "**/*.c"]),
    ("use_after_free_check", "CRITICAL", "pdg:use_after_free", ["**/*.cpp", "**/*.cc"]),
    ("double_free_check", "CRITICAL", "pdg:double_free", ["**/*.cpp", "**/*.cc"]),
    ("uninitialized_read", "CRITICAL", "pdg:uninit_read", ["**/*.cpp", "**/*.cc", "**/*.c"]),
    ("bstr_leak_on_overwrite", "CRITICAL", "call:SysAllocString|call:CopyTo|call:Attach", ["**/*.cpp", "**/*.h"]),
    ("com_bstr_pattern_review", "ADVISORY", "type:BSTR|type:CComBSTR", ["**/*.cpp", "**/*.h"]),
    ("prefer_string_view", "ADVISORY", "param:const_string_ref", ["**/*.cpp", "**/*.h", "**/*.hpp"]),
    ("prefer_span", "ADVISORY", "param:ptr_size_pair", ["**/*.cpp", "**/*.h", "**/*.hpp"]),
    ("prefer_unique_ptr", "ADVISORY", "call:new|call:delete", ["**/*.cpp", "**/*.cc"]),
    ("prefer_expected", "ADVISORY", "return:bool_error_code", ["**/*.cpp", "**/*.h", "**/*.hpp"]),
    ("avoid_c_style_casts", "ADVISORY", "cast:c_style", ["**/*.cpp", "**/*.cc"]),
    ("python_command_injection", "CRITICAL", "call:os.system|call:subprocess.run", ["**/*.py"]),
    ("js_eval_injection", "CRITICAL", "call:eval", ["**/*.js", "**/*.jsx", "**/*.ts", "**/*.tsx", "**/*.mjs"]),
    ("js_command_injection", "CRITICAL", "call:exec|call:execSync|call:spawn|call:spawnSync", ["**/*.js", "**/*.jsx", "**/*.ts", "**/*.tsx"]),
    ("js_prototype_pollution", "CRITICAL", "assign:__proto__|assign:constructor.prototype", ["**/*.js", "**/*.jsx", "**/*.ts", "**/*.tsx"]),
    ("js_path_traversal", "CRITICAL", "call:readFile|call:writeFile|call:readFileSync|call:writeFileSync", ["**/*.js", "**/*.jsx", "**/*.ts", "**/*.tsx"]),
    ("js_sql_injection", "CRITICAL", "call:query|call:execute|call:raw", ["**/*.js", "**/*.jsx", "**/*.ts", "**/*.tsx"]),
    ("js_insecure_deserialization", "CRITICAL", "call:deserialize|call:unserialize", ["**/*.js", "**/*.jsx", "**/*.ts", "**/*.tsx"]),
    ("js_no_console_log_secrets", "ADVISORY", "call:console.log|call:console.error|call:console.warn", ["**/*.js", "**/*.jsx", "**/*.ts", "**/*.tsx"]),
    ("ts_any_type_usage", "ADVISORY", "type:any", ["**/*.ts", "**/*.tsx"]),
    ("python_sql_injection", "CRITICAL", "call:execute|call:executemany|call:raw|call:RawSQL", ["**/*.py"]),
    ("python_deserialization", "CRITICAL", "call:pickle.loads|call:pickle.load|call:yaml.load|call:marshal.loads", ["**/*.py"]),
    ("python_path_traversal", "CRITICAL", "call:open|call:Path", ["**/*.py"]),
    ("python_ssrf", "CRITICAL", "call:requests.get|call:requests.post|call:urllib.request.urlopen", ["**/*.py"]),
    ("python_hardcoded_secret", "CRITICAL", "assign:password|assign:secret|assign:api_key|assign:token", ["**/*.py"]),
    ("django_orm_injection", "CRITICAL", "call:raw|call:extra|call:RawSQL|call:from_db", ["**/models.py", "**/views.py", "**/*.py"]),
    ("django_xss_render", "CRITICAL", "call:render_to_string|call:mark_safe", ["**/*.py"]),
    ("flask_template_injection", "CRITICAL", "call:render_template_string", ["**/*.py"]),
    ("python_weak_crypto", "CRITICAL", "call:md5|call:sha1|call:hashlib.md5|call:hashlib.sha1", ["**/*.py"]),
    ("go_sql_injection", "CRITICAL", "call:Sprintf|call:fmt.Sprintf", ["**/*.go"]),
    ("go_command_injection", "CRITICAL", "call:exec.Command|call:exec.CommandContext", ["**/*.go"]),
    ("go_tls_insecure", "CRITICAL", "assign:InsecureSkipVerify", ["**/*.go"]),
    ("go_integer_overflow", "CRITICAL", "cast:int32|cast:int16|cast:uint32|cast:uint16", ["**/*.go"]),
    ("java_sql_injection", "CRITICAL", "call:execute|call:executeQuery|call:executeUpdate", ["**/*.java"]),
    ("java_deserialization", "CRITICAL", "call:readObject|call:readUnshared", ["**/*.java"]),
    ("java_xxe", "CRITICAL", "call:DocumentBuilderFactory|call:SAXParserFactory|call:XMLInputFactory", ["**/*.java"]),
    ("java_path_traversal", "CRITICAL", "call:new File|call:Paths.get|call:FileInputStream", ["**/*.java"]),
    ("ruby_command_injection", "CRITICAL", "call:system|call:exec|call:popen|call:spawn", ["**/*.rb"]),
    ("ruby_sql_injection", "CRITICAL", "call:where|call:find_by_sql|call:execute", ["**/*.rb"]),
    ("ruby_unsafe_deserialization", "CRITICAL", "call:Marshal.load|call:Marshal.restore", ["**/*.rb"]),
    ("ruby_open_redirect", "CRITICAL", "call:redirect_to", ["**/*.rb", "**/*.erb"]),
]

# Frameworks with their sinks and safe calls.
FRAMEWORKS = {
    "django": (["raw", "extra", "RawSQL", "render_to_string", "execute"], ["filter", "exclude", "get", "create", "update", "delete", "annotate", "aggregate", "values", "values_list"]),
    "flask": (["render_template_string", "make_response", "send_file", "redirect", "Markup"], ["render_template", "jsonify", "abort"]),
    "fastapi": (["HTMLResponse", "StreamingResponse", "FileResponse"], ["JSONResponse", "Response"]),
    "express": (["send", "render", "set", "redirect", "sendFile", "exec", "execSync", "spawn", "spawnSync"], ["json", "sendStatus", "end"]),
    "nextjs": (["dangerouslySetInnerHTML", "eval", "Function"], ["createElement", "cloneElement"]),
    "spring": (["query", "update", "execute", "Runtime.exec", "ProcessBuilder.start", "ScriptEngine.eval"], ["queryForObject", "queryForList"]),
    "rails": (["find_by_sql", "execute", "connection.execute", "send_file", "send_data", "render"], ["where", "find", "find_by", "create", "update"]),
    "laravel": (["DB::select", "DB::statement", "exec", "shell_exec", "system", "passthru", "eval"], ["DB::table", "Model::where", "Model::find"]),
    "gin": (["c.String", "c.Data", "exec.Command"], ["c.JSON", "c.XML", "c.Status"]),
}
# Fixed values: (framework, manifest, text that reveals it); letters in either case.
FRAMEWORK_SIGNALS = [
    ("django", "requirements.txt", "django"), ("flask", "requirements.txt", "flask"), ("fastapi", "requirements.txt", "fastapi"),
    ("express", "package.json", '"express"'), ("nextjs", "package.json", '"next"'), ("spring", "pom.xml", "spring-boot"),
    ("spring", "pom.xml", "spring-webmvc"), ("spring", "build.gradle", "spring-boot"), ("rails", "Gemfile", "rails"),
    ("rails", "Gemfile", "railties"), ("laravel", "composer.json", "laravel/framework"), ("gin", "go.mod", "gin-gonic/gin"),
]
# Calls that are safe in any repository.
SAFE_CALLS = [
    "std::vector::push_back", "std::string::append", "std::copy_n", "std::min", "std::max", "std::clamp", "filter", "exclude", "get", "create", "update_or_create",
    "values", "values_list", "annotate", "aggregate", "JSON.stringify", "encodeURIComponent", "escape", "res.json", "res.status", "res.sendStatus",
]
# The default safe list file's entries, whatever their framework.
SAFE_LISTED = [
    "std::vector::push_back", "std::make_unique", "std::string_view", "logging.getLogger", "console.log", "filter", "exclude", "get", "create", "bulk_create",
    "update_or_create", "values", "values_list", "prefetch_related", "select_related", "annotate", "aggregate", "render_template", "jsonify", "abort", "res.json",
    "res.status", "res.sendStatus", "next", "where", "find", "find_by", "update", "destroy",
]


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    pattern: str
    globs: tuple[str, ...] = ("**/*",)

    @property
    def keywords(self) -> list[tuple[str, str]]:
        """(kind, word) in order; a part without a kind has kind ''."""
        parts = [p.partition(":") for p in self.pattern.split("|")]
        return [(kind, word) if sep else ("", kind) for kind, sep, word in parts]


DEFAULT_RULES = [Rule(i, s, p, tuple(g)) for i, s, p, g in RULES]
RULE_SCHEMA = "rule_ord int, rule_id string, severity string, pattern string, globs array<string>"
KEYWORD_SCHEMA = "rule_ord int, rule_id string, severity string, kw_ord int, kind string, word string"


def names(spark: SparkSession, values: list[str]) -> DataFrame:
    """A frame `name` of distinct values."""
    return spark.createDataFrame([(v,) for v in dict.fromkeys(values)], "name string")


def rules_frame(spark: SparkSession, rules: list[Rule] = DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame([(k, r.id, r.severity, r.pattern, list(r.globs)) for k, r in enumerate(rules)], RULE_SCHEMA)


def keywords_frame(spark: SparkSession, rules: list[Rule] = DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame([(k, r.id, r.severity, j, *kw) for k, r in enumerate(rules) for j, kw in enumerate(r.keywords)], KEYWORD_SCHEMA)


def glob_to_regex(glob: str) -> str:
    """A regex for rlike over a path without doubled slashes: the glob as it is, or without its `**/`, fits the path's last parts.
    `*`, also doubled, and `?` stay inside one folder."""

    def parts(g: str) -> str:
        return re.sub(r"\*+|\?|[.\\+(){}|^$\[\]]", lambda m: "[^/]*" if m[0][0] == "*" else "[^/]" if m[0] == "?" else "\\" + m[0], g)

    return "|".join(f"(^|/){parts(g)}$" for g in dict.fromkeys((glob, glob.replace("**/", ""))))


def framework_frame(spark: SparkSession) -> DataFrame:
    """(framework, kind 'sink' or 'safe', name)."""
    rows = [(f, kind, n) for f, lists in FRAMEWORKS.items() for kind, words in zip(("sink", "safe"), lists, strict=True) for n in words]
    return spark.createDataFrame(rows, "framework string, kind string, name string")


def detect_frameworks(manifests: DataFrame, signals: list[tuple[str, str, str]] = FRAMEWORK_SIGNALS) -> DataFrame:
    """manifests (file_name, text) -> distinct `framework`, found by a text in its manifest, letters in either case."""
    table = manifests.sparkSession.createDataFrame(signals, "framework string, manifest string, signal string")
    met = manifests.join(F.broadcast(table), manifests["file_name"] == table["manifest"])
    return met.where(F.contains(F.lower("text"), F.lower("signal"))).select("framework").distinct()


def load_rules(texts: list[str]) -> list[Rule]:
    """Rules of YAML texts in order; a text or an entry that can't be read is left out."""
    import yaml

    found: list[Rule] = []
    for text in texts:
        try:
            entries = (yaml.safe_load(text) or {}).get("rules") or []
        except (yaml.YAMLError, AttributeError):
            continue
        for e in entries:
            if isinstance(e, dict) and e.get("id"):
                found.append(Rule(e["id"], e.get("severity", "ADVISORY"), e.get("pattern", ""), tuple(e.get("applies_to") or ["**/*"])))
    return found


def load_rule_files(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of all YAML files below path, in the order of their paths. Rule files are few and small by nature."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("at")).collect()
    return load_rules([r.value for r in sorted(rows, key=lambda r: r["at"])])


def load_safe_names(text: str) -> list[str]:
    """All lists of a YAML mapping, whatever their keys, in order and once each."""
    import yaml

    found = yaml.safe_load(text) or {}
    return list(dict.fromkeys(n for v in found.values() if isinstance(v, list) for n in v))


def parse_suppressions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines `file:line:rule` -> (file_path, line_number, rule_id). Blank lines, comments, lines of fewer than three
    parts and lines without a whole number are left out; parts after the third are ignored."""
    text = F.trim(column)
    parts = F.split(text, ":")
    kept = lines.where((text != "") & ~text.startswith("#")).select(parts.alias("p")).where("size(p) >= 3")
    rows = kept.select(F.trim(F.col("p")[0]).alias("file_path"), F.trim(F.col("p")[1]).try_cast(T.IntegerType()).alias("line_number"), F.trim(F.col("p")[2]).alias("rule_id"))
    return rows.where("line_number is not null").distinct()
