"""Per-sink constraints in closed form: whether they can hold, the formula, a least witness, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEN, _SIZE, _LINE = r",\s*([0-9]+)\s*\)", r"\[([0-9]+)\]", r"(?i)line[_\s]?([0-9]+)"

# Sink families in the order of their test.
BOUNDED_COPY = ["memcpy", "strncpy", "memmove"]
UNBOUNDED_COPY = ["strcpy", "strcat", "gets"]
RELEASE = ["free", "delete", "operator delete", "std::unique_ptr::reset"]
RELEASE_PARTS = [
    "alloc_program_point >= 0",
    "free_program_point > alloc_program_point",
    "access_program_point > free_program_point  (use-after-free ordering)",
]
# Families that hold whenever they are reached: names, formula parts, and the witness, which is the least one
# by its variables in order.
ALWAYS = [
    (
        ["SysFreeString", "CoTaskMemFree"],
        ["alloc_program_point >= 0", "first_free_program_point > alloc_program_point", "second_free_program_point > first_free_program_point  (double-free)"],
        [("alloc_program_point", "0"), ("first_free_program_point", "1"), ("second_free_program_point", "2")],
    ),
    (
        ["malloc", "realloc", "mmap"],
        ["is_initialized == False", "is_read == True"],
        [("is_initialized", "False"), ("is_read", "True")],
    ),
    (
        ["calloc", "operator new", "new"],
        ["count > 0", "element_size > 0", "count > MAX_SIZE_T / element_size  (overflow)"],
        [("count", "3"), ("element_size", "6148914691236517206")],
    ),
    (
        ["system", "popen", "exec", "execve", "execl", "execv"],
        ["has_metachar == True (input contains ; | & $ ` etc.)", "is_user_controlled == True"],
        [("has_metachar", "True"), ("is_user_controlled", "True")],
    ),
    (
        ["CopyTo", "Attach", "SysAllocString"],
        ["prev_bstr_allocated == True", "freed_before_overwrite == False  (leak path)"],
        [("prev_allocated", "True"), ("freed_before_overwrite", "False")],
    ),
    (
        ["os.system", "subprocess.run", "subprocess.call", "subprocess.Popen", "eval"],
        ["shell_input_user_controlled == True", "input_sanitized == False  (no shlex.quote or allowlist)"],
        [("shell_input_user_controlled", "True"), ("input_sanitized", "False")],
    ),
    (
        ["pickle.loads", "pickle.load", "yaml.load", "marshal.loads", "jsonpickle.decode"],
        ["data_from_untrusted_source == True", "uses_safe_loader == False  (missing Loader=yaml.SafeLoader)"],
        [("untrusted", "True"), ("safe_loader", "False")],
    ),
    (
        ["requests.get", "requests.post", "requests.put", "urllib.request.urlopen", "httpx.get", "aiohttp.ClientSession"],
        ["url_user_controlled == True", "url_in_allowlist == False"],
        [("user_url", "True"), ("allowlisted", "False")],
    ),
    (
        ["__proto__", "constructor.prototype", "Object.assign", "lodash.merge", "_.merge", "deepmerge"],
        ["object_key_user_controlled == True", "key_sanitized_against_proto == False  (no __proto__ check)"],
        [("key_user_controlled", "True"), ("key_sanitized", "False")],
    ),
    (
        ["Function", "setTimeout", "setInterval", "new Function"],
        ["eval_arg_user_controlled == True"],
        [("eval_arg_user_controlled", "True")],
    ),
    (
        ["db.Query", "db.QueryRow", "db.Exec", "tx.Query", "tx.Exec"],
        ["query_uses_string_concat == True  (fmt.Sprintf or + concatenation)", "query_uses_placeholders == False  (no $1/$2 placeholders)"],
        [("concat_query", "True"), ("parameterized", "False")],
    ),
    (
        ["readObject", "readUnshared", "XStream.fromXML", "ObjectMapper.readValue"],
        ["stream_from_untrusted_source == True", "has_deserialization_allowlist == False"],
        [("untrusted_stream", "True"), ("has_allowlist", "False")],
    ),
]
UNKNOWN_SINK = "sink_is_reachable"


def _number(code: Column, pattern: str) -> Column:
    return F.regexp_extract(code, pattern, 1).try_cast("bigint")


def evaluate(sink: Column, code: Column, known: Column | None = None) -> Column:
    """A struct of sat, formula, witness (array of variable, value) and reachability_only.

    known: whether the sink's node is in the graph; where it is not, only reachability is claimed.
    """
    code = F.coalesce(code, F.lit(""))
    length, size, line = _number(code, _LEN), _number(code, _SIZE), _number(code, _LINE)
    dest = F.coalesce(size, F.lit(64))
    pair = lambda name, value: F.struct(F.lit(name).alias("variable"), value.cast("string").alias("value"))
    none = F.array().cast("array<struct<variable string, value string>>")
    bounded, unbounded, release = sink.isin(BOUNDED_COPY), sink.isin(UNBOUNDED_COPY), sink.isin(RELEASE)
    sat = (
        F.when(bounded, (dest > 0) & (length.isNull() | ((length > 0) & (length > dest))))
        .when(unbounded, dest > 0)
        .when(release, line.isNull() | (line >= 1))
        .otherwise(True)
    )
    extra = lambda name, value: F.when(value != 0, F.concat(F.lit(f"{name} == "), value.cast("string")))
    formula = (
        F.when(bounded, F.concat_ws(" ∧ ", F.lit("input_len > dest_size"), extra("input_len", length), extra("dest_size", size)))
        .when(unbounded, "input_len >= dest_size")
        .when(release, " ∧ ".join(RELEASE_PARTS))
    )
    witness = (
        F.when(bounded, F.array(pair("dest_size", dest), pair("input_len", F.coalesce(length, dest + 1))))
        .when(unbounded, F.array(pair("dest_size", dest), pair("input_len", dest)))
        .when(release, F.array(pair("alloc_program_point", F.lit(0)), pair("free_program_point", F.coalesce(line, F.lit(1))), pair("access_program_point", F.coalesce(line, F.lit(1)) + 1)))
    )
    for family, parts, least in ALWAYS:
        formula = formula.when(sink.isin(family), " ∧ ".join(parts))
        witness = witness.when(sink.isin(family), F.array(*[pair(n, F.lit(v)) for n, v in least]))
    formula = formula.otherwise(F.concat(sink, F.lit("_is_reachable")))
    reached = F.struct(F.concat(sink, F.lit("_reachable")).alias("variable"), F.lit("True").alias("value"))
    witness = witness.otherwise(F.array(reached))
    missing = F.lit(False) if known is None else ~known
    return F.struct(
        F.when(missing, True).otherwise(sat).alias("sat"),
        F.when(missing, UNKNOWN_SINK).otherwise(formula).alias("formula"),
        F.when(missing, none).when(sat, witness).otherwise(none).alias("witness"),
        missing.alias("reachability_only"),
    )


def needs_msan(formula: Column, rule_id: Column) -> Column:
    return F.contains(formula, F.lit("is_initialized")) | F.contains(F.lower(formula), F.lit("uninit")) | F.contains(F.coalesce(rule_id, F.lit("")), F.lit("CWE457"))


def outcome(result: Column, fuzz_crashed: Column | None = None) -> Column:
    """Status, confidence and formula. A null sat is unknown: fuzzing decides."""
    sat, only = result["sat"], result["reachability_only"]
    crashed = F.lit(False) if fuzz_crashed is None else F.coalesce(fuzz_crashed, F.lit(False))
    status = F.when(sat & only, "LIKELY").when(sat, "PROVEN").when(~sat, "WARNING").when(crashed, "FUZZ_VERIFIED").otherwise("WARNING")
    confidence = F.when(sat & only, 0.72).when(sat, 0.95).when(~sat, 0.20).when(crashed, 0.80).otherwise(0.15)
    return F.struct(status.alias("status"), confidence.alias("confidence"), F.when(sat, result["formula"]).otherwise("").alias("formula"))


def proof_key(src_hash: Column, snk_hash: Column, src: Column, snk: Column, rule_id: Column) -> Column:
    """Digest of both code hashes (names where unknown) and the rule."""
    return F.sha2(F.concat_ws("|", F.coalesce(src_hash, src), F.coalesce(snk_hash, snk), F.coalesce(rule_id, F.lit(""))), 256)


def with_cache(computed: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """computed (key, status, formula, reachability_only, witness, ..): rows as a cache (key, status, formula,
    reachability_only) has them, without witnesses, and the rows the cache lacks, once a key. Unknown results stay out."""
    c = cache.select("key", F.col("status").alias("__status"), F.col("formula").alias("__formula"), F.col("reachability_only").alias("__only"))
    hit = F.col("__status").isNotNull()
    merged = computed.join(c, "key", "left").withColumns(
        {
            "status": F.coalesce("__status", "status"),
            "formula": F.coalesce("__formula", "formula"),
            "reachability_only": F.coalesce("__only", "reachability_only"),
            "witness": F.when(hit, F.array().cast(computed.schema["witness"].dataType)).otherwise(F.col("witness")),
        }
    )
    new = computed.where("status is not null").join(cache, "key", "left_anti").groupBy("key").agg(F.min(F.struct("status", "formula", "reachability_only")).alias("r")).select("key", "r.*")
    return merged.drop("__status", "__formula", "__only"), new


def summary_text(status: Column, crosses: Column, sink: Column, source: Column, src_file: Column, snk_file: Column, witness: Column) -> Column:
    shown = F.array_join(F.transform(witness, lambda w: F.concat(w["variable"], F.lit("="), w["value"])), ", ")
    return F.concat(
        F.lit("["), status, F.lit("] "), F.when(crosses, "cross-file ").otherwise(""), sink, F.lit(" reachable from "), source,
        F.lit(" ("), src_file, F.lit(" → "), snk_file, F.lit(")"), F.when(F.length(shown) > 0, F.concat(F.lit(" | witness: "), shown)).otherwise(""),
    )


def to_findings(paths: DataFrame, code: DataFrame, fuzz: DataFrame | None = None) -> DataFrame:
    """Annotated paths (src_*, snk_*, rule_*, intermediate_nodes, ..) to findings. code: node_id, code of the graph's nodes.
    fuzz: path_id, crashed. Advisory rules skip the constraints and stand at 0.5."""
    keyed = paths.join(code.select(F.col("node_id").alias("snk_id"), F.col("code").alias("__code"), F.lit(True).alias("__known")), "snk_id", "left")
    if fuzz is not None:
        keyed = keyed.join(fuzz.select("path_id", F.col("crashed").alias("__crashed")), "path_id", "left")
    result = evaluate(F.col("snk_func"), F.col("__code"), F.coalesce("__known", F.lit(False)))
    solved = keyed.withColumn("__r", result).withColumn("__o", outcome(F.col("__r"), F.col("__crashed") if fuzz is not None else None))
    advisory = F.col("rule_severity") == "ADVISORY"
    status = F.when(advisory, "ADVISORY").otherwise(F.col("__o.status"))
    none = F.array().cast("array<struct<variable string, value string>>")
    witness = F.when(advisory, none).otherwise(F.col("__r.witness"))
    formula = F.when(advisory, "").otherwise(F.col("__o.formula"))
    return solved.select(
        *[paths[c] for c in paths.columns], status.alias("status"), F.when(advisory, 0.5).otherwise(F.col("__o.confidence")).alias("confidence"), formula.alias("formula"),
        witness.alias("witness"), (~advisory & needs_msan(formula, F.col("rule_id"))).alias("requires_msan"),
        summary_text(status, F.col("crosses_files"), F.col("snk_func"), F.col("src_func"), F.col("src_file"), F.col("snk_file"), witness).alias("summary"),
    )
