import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pathloom.llm._bpe import Encoder, vocabulary
from pathloom.llm.packing import CapacityTree, best_fit_decreasing, op7_packing, pack
from pathloom.llm.token_store import digest, op2_token_store, read_tokens, write_tokens
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, n_words int, __x string"
ROWS = [(3, None, 1, "a"), (1, "", 2, "b"), (2, "one two  three\n\n'quoted' 12½", 3, "c"), (5, "the same", 4, None), (4, "the same", 5, "d"), (9, "long words " * 4000, 6, "e"), (7, "日本 <|endoftext|> x", 7, "f")]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def ids(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


SMALL = Encoder(vocabulary("byte_bpe_50k.json"), remember=50)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), max_size=40))
def test_encoder_equals_library(plain_text):
    assert np.frombuffer(SMALL.encode(plain_text), "<u4").tolist() == SMALL.library.encode(plain_text, add_special_tokens=False).ids


def test_special_tokens_are_the_librarys(plain):
    names = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert names
    for name in names:
        for text in (name, f"a {name} b", f"{name}{name}", name[:-1]):
            assert np.frombuffer(SMALL.encode(text), "<u4").tolist() == ids(plain, text)


def test_encoder_every_common_character(plain):
    enc = Encoder(vocabulary("byte_bpe_50k.json"))
    for c in map(chr, range(0x260)):
        for text in (c, f"a{c}b", f" {c} 1", f"{c}{c}x", f"x {c}\n{c}{c} "):
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids(plain, text), hex(ord(c))


def test_store_round_trip(spark, plain, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS)
    write_tokens(docs, f"file://{tmp_path}/t")
    stored = read_tokens(spark, f"file://{tmp_path}/t")
    assert {r.doc_id: list(r.ids) for r in stored.collect()} == {r[0]: [*ids(plain, r[1]), 2] for r in ROWS}
    at, want = 0, []
    for doc_id, text, *_ in sorted(ROWS):
        all_ids = [*ids(plain, text), 2]
        want.append((doc_id, at, len(all_ids), crc(all_ids)))
        at += len(all_ids)
    assert sorted(map(tuple, digest(stored).collect())) == want
    assert [r.doc_id for r in read_tokens(spark, f"file://{tmp_path}/t", [5]).collect()] == [5]
    write_tokens(docs.limit(0), f"file://{tmp_path}/none")
    assert digest(read_tokens(spark, f"file://{tmp_path}/none")).collect() == []


def test_capacity_tree_takes_tightest():
    rng = np.random.default_rng(1)
    tree, plain_list = CapacityTree(64), []
    for i in range(2000):
        if rng.random() < 0.55:
            c = int(rng.integers(1, 65))
            tree.put(i, c)
            plain_list.append(c)
        else:
            need = int(rng.integers(1, 65))
            fits = [c for c in plain_list if c >= need]
            got = tree.take(need)
            assert (got[1] if got else None) == (min(fits) if fits else None)
            if got:
                plain_list.remove(got[1])


def test_best_fit_fills_windows():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1024, 5000).tolist()
    where, offset, windows = best_fit_decreasing(lengths)
    used = np.zeros(windows, int)
    for n, w, o in sorted(zip(lengths, where, offset), key=lambda x: x[1:]):
        assert used[w] == o
        used[w] += n
    assert used.max() <= 1024 and sum(lengths) / (1024 * windows) > 0.985


def test_pack_pieces(spark, plain):
    docs = spark.createDataFrame(ROWS, DOCS)
    rows = pack(docs, block_tokens=3000).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    for doc_id, text, *_ in ROWS:
        all_ids, at = [*ids(plain, text), 0], 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(all_ids), crc(all_ids[at : at + r.length]))
            at += r.length
        assert at == len(all_ids)
    assert pack(docs.limit(0)).collect() == []


def test_packing_of_documents(spark, plain, sf):
    """The registered query over a whole table in many small files: every id in one piece, little padding."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: [*ids(plain, r.text), 0] for r in docs.collect()}
    for got in (op7_packing(spark, sf), pack(docs.repartition(40))):
        rows = got.collect()
        pieces, used = {}, {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append((r.start, r.length))
            used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
            assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])
        assert {d: sum(n for _, n in p) for d, p in pieces.items()} == {d: len(x) for d, x in want.items()}
        assert max(used.values()) <= 1024 and sum(used.values()) / (1024 * len(used)) > 0.97


def test_store_of_documents(spark, plain, sf):
    at, want = 0, []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect()):
        all_ids = [*ids(plain, r.text), 2]
        want.append((r.doc_id, at, len(all_ids), crc(all_ids)))
        at += len(all_ids)
    assert sorted(map(tuple, op2_token_store(spark, sf).collect())) == want


def test_stored_files_prune(spark, tmp_path):
    """Files hold stripes with row indexes and Bloom filters, and a lookup passes over the rows that they rule out."""
    docs = spark.range(0, 40_000, 2, 4).selectExpr("id as doc_id", "concat('some words of document number ', id, ' and ', hash(id)) as text")
    at = f"file://{tmp_path}/t"
    write_tokens(docs, at)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    streams = set()
    for f in read_tokens(spark, at).inputFiles():
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getStripes().size() >= 1 and reader.getRowIndexStride() == 1000
        rows = reader.rows()
        for stripe in reader.getStripes():
            streams |= {x.getKind().toString() for x in rows.readStripeFooter(stripe).getStreamsList()}
        rows.close()
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= streams

    def rows_read(ids):
        df = read_tokens(spark, at, ids)
        found = sorted(r.doc_id for r in df.collect())
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return found, leaf.metrics().apply("numOutputRows").value()

    assert rows_read([12_346]) == ([12_346], 1000)  # one stride
    found, read = rows_read([20_001, 7_771])  # inside the strides' bounds; Bloom filters know better
    assert found == [] and read <= 1000
