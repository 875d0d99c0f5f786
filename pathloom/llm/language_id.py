"""Operator 11: language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of 2, 3 and 4 characters inside its lower-cased words (runs of letters and marks), a word's edge counting as a
character. Each is hashed to one of 65,536 buckets; the mean of the buckets' vectors over the whole text goes through a linear layer and a
softmax. Vectors and layer are trained by stochastic gradient descent in numpy; each step sees some of a text's subwords, from few to many, so
that short texts are learned as well as long ones.

The sample to learn from has at most SAMPLE_ROWS different labelled texts, equally many of each language where there are as many, chosen by
their hash; of each, at most DRAWN subwords, drawn evenly from the whole text. Every fifth one is held back for calibration: a temperature,
which makes scores probabilities of being right; and two limits for rejection, the score above which at most MOST_WRONG are wrong, and a least share of
subwords that training has seen. A rejected text keeps its best language and has accepted = false.

Null text and text without a letter are `und`, score 0, not accepted; so is every text if nothing could be learned (an empty table gives an
empty result). Texts of any length are read whole; a stretch of a megabyte without a blank is cut there. Of equal scores the language that sorts
first wins. Every row gives a row, repeated ones and null ids included; rows of a null id may be learned from. Languages beyond SAMPLE_ROWS
in number, the rarest, are not learned. Only the id, text and language columns are read, the last for learning alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import mix, row_blocks, ship, text_buffers

UNKNOWN = "und"
BITS, DIM, GRAMS = 16, 16, (2, 3, 4)
SAMPLE_ROWS, DRAWN = 2000, 2048
EPOCHS, BATCH, RATE = 12, 16, 4.0
#: Subwords of a text that one step sees, from - to.
SEEN = (4, 512)
MOST_WRONG, KNOWN_EDGE = 0.01, 0.005
_PIECE = 1 << 18
_STEP = np.uint64(0xD6E8FEB86659FD93)
_kinds: list[np.ndarray] = []


def _kind() -> np.ndarray:
    """Per code point: 2 of a letter, 1 of a mark, else 0."""
    if not _kinds:
        _kinds.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8))
    return _kinds[0]


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of parts of bounded size; a long row is cut after a blank, or else between characters."""
    for first, last in row_blocks(offsets, _PIECE):
        at, stop = int(offsets[first]), int(offsets[last])
        if last - first > 1 or stop - at <= 4 * _PIECE:
            yield first, raw[at:stop], offsets[first : last + 1] - at
            continue
        while at < stop:
            end = min(stop, at + 4 * _PIECE)
            if end < stop:
                cuts = np.flatnonzero(raw[at:end] <= 0x20)
                if len(cuts):
                    end = at + int(cuts[-1]) + 1
                else:
                    while raw[end] & 0xC0 == 0x80:
                        end -= 1
            yield first, raw[at:end], np.array([0, end - at])
            at = end


def subwords(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a column of texts: (first row, number of rows, row of each subword from the first, its bucket, letters per row)."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()))
    raw, offsets = text_buffers(lower)
    for first, part, at in _pieces(raw, offsets):
        rows = len(at) - 1
        codes = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[at]
        kind = _kind()[codes]
        letters = np.concatenate([[0], np.cumsum(kind == 2)])
        # One edge before each row, and after the last; then each run of edges is one.
        row = np.concatenate([np.insert(np.repeat(np.arange(rows), np.diff(starts)), starts[:-1], np.arange(rows)), [rows - 1]])
        chars = np.append(np.insert(np.where(kind > 0, codes, 0), starts[:-1], 0), 0)
        keep = np.ones(len(chars), bool)
        keep[1:] = (chars[1:] > 0) | (chars[:-1] > 0)
        chars, row = chars[keep].astype(np.uint64), row[keep]
        # An edge belongs to the word that follows it.
        row[:-1] = np.where(chars[:-1] > 0, row[:-1], row[1:])
        owners, buckets = [], []
        h, inside = chars, np.ones(len(chars), bool)
        for n in range(2, GRAMS[-1] + 1):
            h = h[:-1] * _STEP + chars[n - 1 :]
            inside = inside[: len(h)] & (chars[n - 2 : n - 2 + len(h)] > 0 if n > 2 else True)
            if n in GRAMS:
                at_ = np.flatnonzero(inside)
                owners.append(row[at_])
                buckets.append((mix(h[at_] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
        yield first, rows, np.concatenate(owners), np.concatenate(buckets), letters[starts[1:]] - letters[starts[:-1]]


@dataclass(frozen=True)
class Model:
    """langs ascending; vectors (DIM x buckets), weights (langs x DIM), bias; known: buckets that training has seen."""

    langs: list[str]
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    known: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        """Of mean vectors (rows x DIM)."""
        return _softmax((means @ self.weights.T + self.bias) / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def sample(docs: DataFrame, learn: Column, lang_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, h, text): at most `rows` different texts of docs where learn holds, alike many of each language, those of the smallest hashes."""
    spark = docs.sparkSession
    own = docs.where(learn).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where("lang is not null and text is not null")
    own = own.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    sizes = own.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not sizes:
        return own.select("lang", "h", "text").limit(0)
    each = max(1, rows // len(sizes))
    # Hashes are even over their range, so a share of it holds about that share of the texts; some more are let through than needed.
    upto = [(r.lang, min((1 << 63) - 1, int((1 << 63) * (1.5 * each + 50) / max(1, r.n)))) for r in sizes]
    near = own.join(F.broadcast(spark.createDataFrame(upto, "lang string, upto long")), "lang").where("h <= upto")
    texts = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    return texts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each).drop("k")


def drawn(texts: DataFrame) -> DataFrame:
    """(lang, h, buckets): of each text at most DRAWN subwords, in an order drawn by its hash, as 16-bit numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for first, rows, row, bucket, _ in subwords(batch.column(2)):
                by_row = bucket[np.argsort(row, kind="stable")].astype(np.uint16)
                ends = np.cumsum(np.bincount(row, minlength=rows))
                for i in range(rows):
                    own[first + i].append(by_row[ends[i - 1] if i else 0 : ends[i]])
            found = []
            for h, parts in zip(batch.column(1).to_pylist(), own, strict=True):
                whole = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
                found.append(np.random.default_rng(h).permutation(whole)[:DRAWN].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["lang", "h", "buckets"])

    return texts.mapInArrow(work, "lang string, h long, buckets binary")


def fit(langs: list[str], texts: list[tuple[str, np.ndarray]], seed: int = 11) -> Model:
    """Train on (language, drawn buckets) and calibrate on every fifth text of each language."""
    label = {g: i for i, g in enumerate(langs)}
    seen_of = dict.fromkeys(langs, 0)
    train, held = [], []
    for lang, buckets in texts:
        if len(buckets):
            seen_of[lang] += 1
            (held if seen_of[lang] % 5 == 0 else train).append((label[lang], buckets.astype(np.int64)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights, bias = np.zeros((len(langs), DIM), np.float32), np.zeros(len(langs), np.float32)
    known = np.zeros(1 << BITS, bool)
    for _, b in train:
        known[b] = True
    some = lambda b, m: b[rng.integers(0, len(b), m)] if m < len(b) else b
    low, high = np.log(SEEN)
    steps = EPOCHS * -(-len(train) // BATCH)
    done = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(train))
        for k in range(0, len(order), BATCH):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            own = [(train[i][0], some(train[i][1], int(np.exp(rng.uniform(low, high))))) for i in order[k : k + BATCH]]
            sizes = np.array([len(b) for _, b in own])
            at, row = np.concatenate([b for _, b in own]), np.repeat(np.arange(len(own)), sizes)
            means = np.add.reduceat(vectors[at], np.cumsum(sizes) - sizes) / sizes[:, None].astype(np.float32)
            error = _softmax(means @ weights.T + bias)
            error[np.arange(len(own)), [g for g, _ in own]] -= 1
            back = (error @ weights) / sizes[:, None]
            weights -= rate / BATCH * (error.T @ means)
            bias -= rate / BATCH * error.sum(0)
            np.subtract.at(vectors, at, (rate * back[row]).astype(np.float32))
    model = Model(langs, np.ascontiguousarray(vectors.T), weights, bias, known)
    return _calibrated(model, [(g, some(b, m)) for g, b in held for m in (8, 32, 128, DRAWN)])


def _calibrated(model: Model, held: list[tuple[int, np.ndarray]]) -> Model:
    if not held:
        return model
    truth = np.array([g for g, _ in held])
    logits = np.array([model.vectors[:, b].mean(1) @ model.weights.T + model.bias for _, b in held])
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 121).tolist(), key=loss)
    p = _softmax(logits / temperature)
    score, right = p.max(1), p.argmax(1) == truth
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(wrong <= MOST_WRONG)
    least = float(score[order[good[-1]]]) if len(good) else 1.0
    share = np.array([model.known[b].mean() for _, b in held if len(b) >= 32] or [0.0])
    return Model(model.langs, model.vectors, model.weights, model.bias, model.known, temperature, least, float(np.quantile(share, KNOWN_EDGE)) / 2)


def train(docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of a bounded sample of the rows of docs where learn holds; None if there are none."""
    ship(docs.sparkSession)
    found = drawn(sample(docs, learn, lang_col, text_col, rows)).collect()
    texts = sorted(((r.lang, r.h, np.frombuffer(bytes(r.buckets), np.uint16)) for r in found), key=lambda r: r[:2])
    langs = sorted({g for g, _, b in texts if len(b)})
    return fit(langs, [(g, b) for g, _, b in texts]) if langs else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, accepted, known_share (of its subwords)."""
    ship(docs.sparkSession)
    # The smaller of two equal forms: a number per language and bucket, or the vectors (DIM numbers a bucket).
    direct = model is not None and len(model.langs) <= DIM
    table = None if model is None else (model.weights @ model.vectors if direct else model.vectors)
    shared = docs.sparkSession.sparkContext.broadcast((model, table))

    def scored(texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        model, table = shared.value
        n = len(texts)
        sums, many, seen, letters = np.zeros((n, len(table))), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        for first, rows, row, bucket, own in subwords(texts):
            at = slice(first, first + rows)
            many[at] += np.bincount(row, minlength=rows)
            seen[at] += np.bincount(row, model.known[bucket], rows)
            letters[at] += own
            for k, values in enumerate(table):
                sums[at, k] += np.bincount(row, values[bucket], rows)
        means = sums / np.maximum(many, 1)[:, None]
        p = _softmax((means + model.bias) / model.temperature) if direct else model.probabilities(means)
        some = letters > 0
        best, share = p.argmax(1), seen / np.maximum(many, 1)
        score = np.where(some, p[np.arange(n), best], 0.0)
        langs = [model.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        return langs, score, some & (score >= model.least_score) & (share >= model.least_known), share

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            langs, score, accepted, share = scored(batch.column(1)) if n and shared.value[0] else ([UNKNOWN] * n, np.zeros(n), np.zeros(n, bool), np.zeros(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(accepted), pa.array(share)], names=["doc_id", "lang_pred", "score", "accepted", "known_share"])

    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return plain.mapInArrow(work, "doc_id long, lang_pred string, score double, accepted boolean, known_share double")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = lambda c: F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))
    model = train(docs, ~held_out(docs["doc_id"]))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted", "known_share")


QUERIES = {"op11_language": op11_language}
ORACLES: dict[str, str] = {}
