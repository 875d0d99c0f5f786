"""Operator 5: remove sentences covered by a repeated run of sentences.

A sentence ends after . ! ? or an ellipsis (and closing quotes or brackets) before white space, after a full-width stop, and at a
line end. Sentences of more than LONG_WORDS words, and only these, are cut by their content, so that an equal passage is cut equally wherever it
stands in them: after a word whose last character's code point (below U+3000) is 3 modulo 5, about each fifth word; and where none comes for
32 words, after these. From every sentence starts one run: three sentences, and as many more as it takes to reach 120 characters. Runs are hashed to 96
bits and joined globally. The first occurrence is that of the smallest doc_id and, inside it, the smallest position; sentences
covered by any other are removed. Of a repeated passage the parts before its first cut and after its last may stay.

Inside a document repeats are found locally, so each document sends each of its runs once. Runs are written once. Counts are summed
before the shuffle; only runs that pass a bitmap of bounded size over the repeated ones are joined back with them, so a run that
many documents share meets no single task as a group (the join's large side may be split). Removed positions, not texts, are
gathered, at most one for each run of a document.

Null and empty text have no sentences and are left alone; a very long text is cut like any other. Rows of equal id are one
document for the global order (each is cleaned alike); rows with a null id are never first and are left alone. An empty
table gives an empty result. Columns of docs may have any name but `__removed`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, ship, store

RUN = 3
MIN_CHARS = 120
#: Bits of the bitmap that tells which runs may be repeated (4 MB).
FILTER_BITS = 1 << 25
# What ends a sentence.
WHITE, WIDE_STOPS, STOPS, CLOSING = r" \t-\r", "。！？", ".!?…", "\"')\\]”’»」』"
#: Sentences of more words are cut by their content.
LONG_WORDS = 16
MOST_WORDS, CUT_AT, CUT_MODULO = 32, 3, 5
_END = re.compile(rf"\A[{WHITE}]+|[{WIDE_STOPS}]+[{CLOSING}]*[{WHITE}]*|[{STOPS}][{CLOSING}]*(?:[{WHITE}]+|\Z)|[{WHITE}]*\n[{WHITE}]*")
_CUTS = "".join(re.escape(chr(c)) for c in range(CUT_AT, 0x3000, CUT_MODULO) if c != 0x0D)
_CUT = re.compile(rf"[{_CUTS}](?:[{WHITE}]+|\Z)")
_WORD = re.compile(rf"[^{WHITE}]+")
_MANY = re.compile(rf"(?:[^{WHITE}]+[{WHITE}]*){{1,{MOST_WORDS}}}")
_ENDS = " \t\n\x0b\x0c\r" + STOPS + WIDE_STOPS


def sentences(text: str | None) -> list[str]:
    """The sentences of text, long ones in parts, in order and with all that stands between them; white space before the first word is one."""
    if not text:
        return []
    parts, at = [], 0
    for end in [m.end() for m in _END.finditer(text)] + [len(text)]:
        if end > at:
            # Of n characters at most (n + 1) / 2 are words.
            if end - at > 2 * LONG_WORDS and len(_WORD.findall(text, at, end)) > LONG_WORDS:
                parts.extend(_clauses(text, at, end))
            else:
                parts.append(text[at:end])
            at = end
    return parts


def _clauses(text: str, at: int, end: int) -> list[str]:
    """The parts of a long sentence."""
    parts = []
    for cut in [m.end() for m in _CUT.finditer(text, at, end)] + [end]:
        if cut - at <= 2 * MOST_WORDS:
            parts.extend([text[at:cut]] if cut > at else [])
        else:
            parts.extend(_MANY.findall(text, at, cut))
        at = cut
    return parts


def _runs(parts: list[str], run: int, min_chars: int) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, end, digest) of every run; none starts at a sentence without words."""
    keys = [p.rstrip(_ENDS) for p in parts]
    at = [0, *accumulate(len(k) + 1 for k in keys)]
    for i in range(len(keys) - run + 1):
        if not keys[i]:
            continue
        j = max(i + run, bisect_left(at, at[i] + min_chars + 1, i))
        if j <= len(keys):
            yield i, j, xxhash.xxh3_128_digest("\x1f".join(keys[i:j]).encode("utf-8", "surrogatepass"))


def spans(docs: DataFrame, run: int = RUN, min_chars: int = MIN_CHARS) -> DataFrame:
    """Of docs (id, text): each document's distinct runs as (h, g, id, pos), pos being the first position."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, digests, counts = batch.column(0), [], [], []
            for text in batch.column(1):
                seen: dict[bytes, int] = {}
                for i, _, d in _runs(sentences(text.as_py()), run, min_chars):
                    seen.setdefault(d, i)
                digests.extend(seen)
                pos.extend(seen.values())
                counts.append(len(seen))
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            own = np.repeat(np.asarray(ids.to_numpy(zero_copy_only=False), np.int64), counts)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1].astype(np.int32)), pa.array(own), pa.array(pos, pa.int32())], names=["h", "g", "id", "pos"])

    ship(docs.sparkSession)
    return docs.where("id is not null").mapInArrow(work, "h long, g int, id long, pos int")


def repeated(docs: DataFrame, run: int = RUN, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document with any: id, the positions of its runs that an earlier document has, and those documents."""
    found = store(spans(docs, run, min_chars), "runs")
    many = store(found.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("h", "g", "first"), "repeated")
    bit = F.pmod("h", F.lit(FILTER_BITS)) + 1
    kept = many.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in kept.collect():
        own = np.frombuffer(r.bits, np.uint8)
        bits[(r.bucket - 1) * len(own) : r.bucket * len(own)] = own
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy() & (FILTER_BITS - 1)
            yield batch.filter(pa.array((shared.value[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)))

    later = found.mapInArrow(work, found.schema).join(many, ["h", "g"]).where("id > first")
    at = store(later.groupBy("id").agg(F.collect_set("pos").alias("pos"), F.collect_set("first").alias("firsts")), "later")
    discard(found, many)
    return at


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of docs with text_col cleaned, and a column `__removed`: a struct of n_sentences, n_removed, first_doc_ids (ascending)."""
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    at = repeated(plain, run, min_chars)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    joined = docs.toDF(*names).withColumn("__id", F.col(names[docs.columns.index(id_col)]).cast("long"))
    joined = joined.join(at, joined["__id"] == at["id"], "left").drop("id", "__id")
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)
    fields = list(joined.schema.fields)
    width = len(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, removed = [], [], []
            for owner, text, pos in zip(batch.column(id_at), batch.column(text_at), batch.column(width), strict=True):
                text, first = text.as_py(), set(pos.as_py() or ())
                parts = sentences(text)
                gone, seen = set(), set()
                for i, j, d in _runs(parts, run, min_chars) if owner.is_valid else ():
                    if d in seen or i in first:
                        gone.update(range(i, j))
                    seen.add(d)
                texts.append("".join(p for i, p in enumerate(parts) if i not in gone) if gone else text)
                sizes.append(len(parts) - bool(parts and not parts[0].rstrip(_ENDS)))
                removed.append(len(gone))
            columns = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns[:width])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), batch.column(width + 1)], names=[*names, "n_sentences", "n_removed", "firsts"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    out = [StructField(f.name, StringType()) if i == text_at else f for i, f in enumerate(fields[:width])]
    schema = StructType([*out, StructField("n_sentences", LongType()), StructField("n_removed", LongType()), fields[width + 1]])
    done = joined.mapInArrow(work, schema)
    extra = F.struct("n_sentences", "n_removed", F.sort_array(F.coalesce("firsts", F.array().cast("array<long>"))).alias("first_doc_ids")).alias("__removed")
    return done.select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)], extra)


def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that loses sentences to an earlier document or to itself."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = remove_repeats(docs).where("__removed.n_removed > 0")
    return done.select("doc_id", "__removed.n_sentences", "__removed.n_removed", "__removed.first_doc_ids", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op5_span_dedup": op5_span_dedup}
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_QUOTES = CLOSING.replace("'", "''")
_PIECE = rf"^[{WHITE}]+|[^{WHITE}{WIDE_STOPS}]*[{WIDE_STOPS}]+[{_QUOTES}]*[{WHITE}]*|[^{WHITE}{WIDE_STOPS}]+[{WHITE}]*"
_CLOSES = rf"[{WIDE_STOPS}\n]|[{STOPS}][{_QUOTES}]*[{WHITE}]*$|^[{WHITE}]+$"
ORACLES = {
    "op5_span_dedup": rf"""
WITH p AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '{_PIECE}') AS l FROM documents)),
q AS (SELECT *, unicode(right(rtrim(piece, {_BLANK}), 1)) AS u FROM p),
v AS (SELECT *, regexp_matches(piece, '{_CLOSES}') AS ends FROM q),
x AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM v),
z AS (SELECT *, ends OR u % {CUT_MODULO} = {CUT_AT} AND u < 12288 AND count(*) OVER (PARTITION BY doc_id, sentence) > {LONG_WORDS} AS closes FROM x),
o AS (SELECT *, coalesce(sum(CAST(closes AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM z),
y AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, seg ORDER BY i) - 1) // {MOST_WORDS} AS cut FROM o),
k AS (SELECT *, rtrim(part, {_BLANK} || '{STOPS}{WIDE_STOPS}') AS key FROM
      (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS i, string_agg(piece, '' ORDER BY i) AS part FROM y GROUP BY doc_id, seg, cut)),
a AS (SELECT doc_id, i, key, sum(length(key) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM k),
e AS (SELECT x.doc_id, x.i, min(y.i) AS j FROM a x JOIN a y ON x.doc_id = y.doc_id AND y.i BETWEEN x.i + {RUN - 1} AND x.i + {RUN + MIN_CHARS} AND y.c - x.c + length(x.key) + 1 >= {MIN_CHARS + 1}
      WHERE x.key <> '' GROUP BY x.doc_id, x.i),
l AS (SELECT doc_id, list(key ORDER BY i) AS keys FROM k GROUP BY doc_id),
w AS (SELECT doc_id, i, j, array_to_string(keys[i : j], chr(31)) AS run FROM e JOIN l USING (doc_id)),
r AS (SELECT doc_id, i, j, run, min(doc_id) OVER (PARTITION BY run) AS first, min(i) OVER (PARTITION BY doc_id, run) AS own FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM r WHERE doc_id > first OR i > own),
f AS (SELECT doc_id, list(DISTINCT first ORDER BY first) AS ids FROM r WHERE doc_id > first GROUP BY doc_id),
c AS (SELECT k.doc_id, count(*) FILTER (k.key <> '' OR k.i > 1) AS n_sentences, count(g.i) AS n_removed,
             coalesce(string_agg(k.part, '' ORDER BY k.i) FILTER (g.i IS NULL), '') AS clean
      FROM k LEFT JOIN g USING (doc_id, i) GROUP BY k.doc_id)
SELECT c.doc_id, n_sentences, n_removed, coalesce(f.ids, CAST([] AS BIGINT[])) AS first_doc_ids, length(clean) AS n_chars, sha256(clean) AS text_sha256
FROM c LEFT JOIN f USING (doc_id) WHERE n_removed > 0"""
}
