"""Column functions over text: hashes, ids, extractors and guards."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def repo_id(remote: Column, root: Column, path: Column) -> Column:
    """The first 16 hex digits of the digest of the first that is known: remote, root, path."""
    return F.substring(F.sha2(F.coalesce(remote, root, path), 256), 1, 16)


def stable_node_id(repo: Column, file: Column, kind: Column, name: Column, line: Column, ordinal: Column) -> Column:
    return F.sha2(F.concat_ws(":", repo, file, kind, name, line.cast("string"), ordinal.cast("string")), 256)


def ticket_ids(text: Column) -> Column:
    """All ids such as ABC-12, in order."""
    return F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9]+-[0-9]+)\b"), 1)


def fenced(text: Column, kind: str) -> Column:
    """The first block fenced as `kind`, without outer white space; '' if none."""
    return F.regexp_replace(F.regexp_extract(text, rf"(?s)```{kind}\n(.+?)```", 1), r"^\s+|\s+$", "")


def place_of(text: Column) -> Column:
    """(file_path, line_start, line_end) named in a text; '' and 0 where absent."""
    number = lambda label: F.coalesce(F.regexp_extract(text, rf"{label} Line: ([0-9]+)", 1).try_cast("int"), F.lit(0))
    return F.struct(F.trim(F.regexp_extract(text, "File: (.+)", 1)).alias("file_path"), number("Start").alias("line_start"), number("End").alias("line_end"))


def mostly_unprintable(data: Column, sample: int = 512, share: float = 0.2) -> Column:
    """Whether more than `share` of the first bytes are control bytes other than tab and line ends."""
    head = F.hex(F.substring(data, 1, sample))
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    bad = F.regexp_count(pairs, F.lit("(0[0-8BCEF]|1[0-9A-F]) "))
    n = F.length(head) / 2
    return (n > 0) & (bad > share * n)


def may_have_surface(text: Column, most_bytes: int = 16_384) -> Column:
    """Guards before a file's API surface is asked for: size, printable bytes, and a sign of C++."""
    includes = F.regexp_count(text, F.lit("#include"))
    return (F.octet_length(text) <= most_bytes) & ~mostly_unprintable(text.cast("binary")) & ((includes >= 2) | F.contains(text, F.lit("::")))


def signature_of(secret: str, body: bytes) -> str:
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
