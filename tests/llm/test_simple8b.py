"""Simple-8b words and the token store."""

import zlib

import numpy as np
import pytest

from framelake.llm import bpe_ids, simple8b, simple8b_store


@pytest.mark.parametrize("values", [
    [], [0], [0] * 1000, [1, 2, 3], list(range(70000)), [2**60 - 2, 2**60 - 1, 2**64 - 1, 0, 5], [2**64 - 1] * 600,
    [50256] * 257, [0] * 239 + [1] * 300])
def test_round_trip(values):
    got = np.array(values, np.uint64)
    words, first = simple8b.encode(got)
    assert np.array_equal(simple8b.decode(words, first, len(got)), got)


def test_round_trip_random():
    rng = np.random.default_rng(3)
    for bits in (0, 1, 4, 9, 16, 30, 59, 63):
        got = (rng.integers(0, 2**63, 5000, dtype=np.uint64) >> np.uint64(63 - bits)) * (rng.random(5000) < .8)
        got = got.astype(np.uint64)
        words, first = simple8b.encode(got)
        assert np.array_equal(simple8b.decode(words, first, len(got)), got)
        for run in range(len(first)):  # any run by itself
            upto = first[run + 1] if run + 1 < len(first) else len(words)
            size = min(256, len(got) - run * 256)
            assert np.array_equal(simple8b.decode(words[first[run]:upto], np.zeros(1, int), size), got[run * 256:run * 256 + size])


def test_pieces_equal_whole_texts():
    import random

    import pyarrow as pa

    from framelake.llm.text_blocks import as_strings
    random.seed(5)
    parts = ["a", "s", "t", " ", "  ", "\n", "'", "1", "!", "é", "×", "ll", "re", "d", "\t", "ß", "“", "日", "\x1c"]
    texts = ["", "<|endoftext|> a", "it's we're"] + ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000)]
    encoder = bpe_ids.encoder(bpe_ids.default_path())
    for text, got in zip(texts, encoder.batch(as_strings(pa.array(texts))), strict=True):
        assert got.tolist() == encoder.whole.encode(text, add_special_tokens=False).ids, text


def test_store_edges(spark, tmp_path):
    long_text = "word " * 60000
    rows = [(5, "b b", "x"), (None, "none", "y"), (5, "a", None), (2, None, ""), (1, "", "q"), (9, long_text, "z"), (5, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    whole = bpe_ids.encoder(bpe_ids.default_path()).whole
    path = str(tmp_path / "ids")
    simple8b_store.write_tokens(docs.repartition(3), path, block_ids=50)
    want, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, simple8b_store.token_digest(spark, path).collect()), key=lambda r: r[1]) == want
    assert sum(len(r.ids) for r in simple8b_store.read_tokens(spark, path).collect()) == start
    empty = str(tmp_path / "none")
    simple8b_store.write_tokens(docs.limit(0), empty)
    assert simple8b_store.token_digest(spark, empty).count() == 0


def test_query(spark, small):
    whole = bpe_ids.encoder(bpe_ids.default_path()).whole
    docs = sorted(map(tuple, spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()))
    start, want = 0, []
    for doc_id, text in docs:
        ids = np.array(whole.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, simple8b_store.op8_simple8b_tokens(spark, small).collect())) == want
