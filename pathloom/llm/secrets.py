"""Operator 8: secret scans by one combined automaton.

All rules' regexes, whole, are compiled by subset construction and minimisation into one transition array, which reads each
byte of every text once and tells the segments (between bytes that no rule contains) in which matches end. In those
the automaton of the reversed rules, reading backwards, tells where matches start, and a rule's own automaton how far the
longest one goes: leftmost-longest matches that do not overlap, per rule. No regex engine takes part. For rules in which
two ways to go on never begin with the same byte, as in all below, these are the matches of a greedy regex too.

Null and empty text have no spans (counts 0, empty strings). A very long text is read like any other: what is longer than
a lane without a break is walked alone. Spans of equal start are in the order of the rules. Every row gives a row,
repeated ones and null ids included; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import row_blocks, ship, text_buffers
from .automaton import Matcher, longest_from, compile_rules


@dataclass(frozen=True)
class Rule:
    """Matches are those of head, then value; one whose value has fewer than `least` characters is dropped, after it was matched."""

    kind: str
    value: str
    least: int = 0
    head: str = ""

    @property
    def pattern(self) -> str:
        return f"{self.head}({self.value})"


# The base kinds, in their order of listing. A run of hex digits matches whole or not at all, so that its
# least length may stand in the rule, where it keeps short runs from being hits.
BASE_RULES = [
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 8, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
]
# Public formats of tokens and keys.
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_.-]+", 36),
]
RULES = BASE_RULES + MORE_RULES


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """Per row: doc_id, a count n_<kind> of each of the first `base` rules, base_sha256 and spans.

    spans: kind:start:end of all rules by start, then rule, comma-joined (code points, end exclusive); base_sha256 is
    the digest of that string over the base rules alone.
    """
    ship(docs.sparkSession)
    matcher = Matcher([r.pattern for r in rules])
    heads = [compile_rules([r.head], anchored=True) if r.head else None for r in rules]
    schema = ", ".join(["doc_id long", *(f"n_{r.kind} long" for r in rules[:base]), "base_sha256 string", "spans string"])
    names = [f.split()[0] for f in schema.split(", ")]

    def spans_of(raw: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, start, end in matcher.matches(raw, offsets):
            value = start
            if heads[k]:
                value += longest_from(heads[k], memoryview(raw[start:end].tobytes().translate(heads[k].kinds)), 0)
            if np.count_nonzero((raw[value : min(end, value + 4 * rules[k].least)] & 0xC0) != 0x80) >= rules[k].least:
                found.setdefault(int(np.searchsorted(offsets, start, "right")) - 1, []).append((start, k, end))
        for row, spans in found.items():
            first = int(offsets[row])
            points = np.cumsum((raw[first : int(offsets[row + 1])] & 0xC0) != 0x80)
            at = lambda b: int(points[b - first - 1]) if b > first else 0  # noqa: B023, E731
            found[row] = sorted((at(a), k, at(b)) for a, k, b in spans)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            rows = []
            for first, last in row_blocks(offsets):
                at = offsets[first : last + 1]
                found = spans_of(raw[at[0] : at[-1]], at - at[0])
                for i in range(last - first):
                    spans = found.get(i, [])
                    text = [f"{rules[k].kind}:{a}:{b}" for a, k, b in spans]
                    own = ",".join(t for t, (_, k, _) in zip(text, spans, strict=True) if k < base)
                    rows.append((*(sum(k == j for _, k, _ in spans) for j in range(base)), hashlib.sha256(own.encode()).hexdigest(), ",".join(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names=names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_secrets": op8_secrets}
ORACLES: dict[str, str] = {}
