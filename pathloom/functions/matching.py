"""Which of many words a text contains, in one pass over the text whatever their number."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ship

#: Characters of words in one automaton (some forty bytes each in memory); more words are dealt over several.
MOST_CHARS = 2_000_000
#: Groups that the texts are dealt to beside each block of words, where there are several blocks.
SALTS = 64


class Words:
    """An automaton of (id, word); words of no character are in every text."""

    def __init__(self, words: list[tuple[int, str]]) -> None:
        self.tree, self.anywhere, own = ahocorasick.Automaton(), [], {}
        for i, word in words:
            if word:
                own.setdefault(word, []).append(i)
            elif word is not None:
                self.anywhere.append(i)
        for word, ids in own.items():
            self.tree.add_word(word, (len(word), ids))
        if own:
            self.tree.make_automaton()
        self.some = bool(own)

    def first(self, text: str) -> dict[int, int]:
        """Where each word that text holds begins for the first time (from 0)."""
        found = dict.fromkeys(self.anywhere, 0)
        if self.some:
            for end, (n, ids) in self.tree.iter(text):
                if ids[0] not in found:
                    found.update(dict.fromkeys(ids, end - n + 1))
        return found


def _matched(keys: pa.Array, texts: pa.Array, words: Words) -> dict[str, pa.Array]:
    out: tuple[list, list, list, list] = ([], [], [], [])
    for key, text in zip(keys.to_pylist(), texts.to_pylist(), strict=True):
        if text is not None:
            for i, at in words.first(text).items():
                for column, value in zip(out, (key, i, at, text.count("\n", 0, at) + 1), strict=True):
                    column.append(value)
    return dict(zip(("key", "word_id", "at", "line"), (pa.array(out[0], keys.type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())), strict=True))


def match_words(texts: DataFrame, words: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """texts (key, text) and words (word_id, word): (key, word_id, at, line) of every word that a text contains, with the
    character (from 0) and the line (from 1) where it first begins.

    Words of most_chars characters at most are sent to all tasks as one list; more are dealt by hash to blocks, and each
    block meets all texts in SALTS groups. A null text or word is not matched; equal words of several ids each are.
    """
    ship(texts.sparkSession)
    texts, words = texts.select("key", "text"), words.where("word is not null").select(F.col("word_id").cast("long").alias("word_id"), "word")
    key = texts.schema["key"].dataType.simpleString()
    shape = f"key {key}, word_id long, at long, line long"
    size = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    if size <= most_chars:
        listed = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in words.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Words(listed.value)
            for batch in batches:
                yield pa.RecordBatch.from_pydict(_matched(batch.column(0), batch.column(1), own))

        return texts.mapInArrow(run, shape)
    blocks = -(-size // most_chars)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = texts.select("key", "text", F.pmod(F.xxhash64("key", "text"), F.lit(SALTS)).alias("salt"), each(blocks).alias("block"))
    own = words.select("word_id", "word", F.pmod(F.xxhash64("word"), F.lit(blocks)).alias("block"), each(SALTS).alias("salt"))

    def together(some: pa.Table, listed: pa.Table) -> pa.Table:
        tree = Words(list(zip(listed["word_id"].to_pylist(), listed["word"].to_pylist(), strict=True)))
        return pa.Table.from_pydict(_matched(some["key"].combine_chunks(), some["text"], tree))

    return dealt.groupBy("block", "salt").cogroup(own.groupBy("block", "salt")).applyInArrow(together, shape)

