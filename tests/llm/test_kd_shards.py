"""Shards by a k-d tree: balance, numbering, edge cases."""

import math
import zlib
from collections import Counter

from framelake.llm import kd_shards


def check(rows, docs, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    return [sum(r["size"] for r in rows if r["shard"] == k) for k in range(shards)]


def test_query_balance(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = kd_shards.op10_kd_shards(spark, folder).collect()
    sizes = check(rows, docs, 24)
    assert max(sizes) - min(sizes) <= 2 * max(len(t.encode()) for _, t in docs)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def test_hot_values_are_cut(spark):
    rows = [(i, "x" * (100 + i % 3), "one", "en", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int")
    sizes = check(kd_shards.kd_shards(docs, 7).collect(), [r[:2] for r in rows], 7)
    assert max(sizes) - min(sizes) < 3 * 111
    assert len({r["text_crc32"] for r in kd_shards.kd_shards(docs, 7).collect()}) == 3
    copies = docs.withColumn("doc_id", docs.doc_id * 0 + 5)
    assert len(kd_shards.kd_shards(copies, 3).collect()) == 4000


def test_edges(spark):
    rows = [(None, None, None, None), (1, "", "", ""), (1, "", "", ""), (2, "é" * 40000, "s", "en"), (-5, "a", None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    check(kd_shards.kd_shards(docs, 24).collect(), [r[:2] for r in rows], 24)
    assert kd_shards.kd_shards(docs.limit(0), 24).count() == 0
    assert {r.shard for r in kd_shards.kd_shards(docs, target_bytes=10**9).collect()} == {0}


def test_equal_texts_stay_together(spark):
    """Groups of copies over all sources, languages and ids lie in one shard each; a group too large for that is dealt."""
    rows = [(i, f"text {i % 400:04d} " + "x" * (i % 400), f"common_crawl_{i % 7}", "en" if i % 3 else None) for i in range(4000)]
    rows += [(10_000 + i, "boilerplate", f"common_crawl_{i % 7}", "en") for i in range(60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = kd_shards.kd_shards(docs, 6).collect()
    sizes = check(out, [r[:2] for r in rows], 6)
    of_text = {}
    for r in out:
        of_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    hot = zlib.crc32(b"boilerplate")
    assert all(len(s) == 1 for t, s in of_text.items() if t != hot) and len(of_text[hot]) > 1
    assert max(sizes) - min(sizes) < 0.1 * sum(sizes) / 6


def test_values_with_one_beginning_are_parted(spark):
    """Sources that differ only at their end are values of their own: the first cut lies between them."""
    rows = [(5, f"{i:04d}", f"common_crawl_{'abcd'[i % 4]}", "en") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = kd_shards.kd_shards(docs, 4).collect()
    source = {zlib.crc32(t.encode()): s for _, t, s, _ in rows}
    assert {(r["shard"], source[r["text_crc32"]]) for r in out} == {(k, f"common_crawl_{'abcd'[k]}") for k in range(4)}


def brute(rows, shards):
    """The tree on one machine: rows of (key, size, tie, places), cut with exact medians of bin and tie."""
    done, waiting = {}, [(0, shards, rows)]
    while waiting:
        first, k, held = waiting.pop()
        if k == 1 or not held:
            done.update({r[0]: first for r in held})
            continue
        ends = [(min(r[3][d] for r in held), max(r[3][d] for r in held)) for d in range(4)]
        d = max(range(4), key=lambda i: ends[i][1] - ends[i][0])
        lo, wide = ends[d][0], ends[d][1] - ends[d][0]
        spot = lambda r: (min(math.floor((r[3][d] - lo) / wide * 1024), 1023) if wide > 0 else 0, r[2])
        goal, upto, border = sum(r[1] for r in held) * (k // 2) / k, 0, None
        for place, size in sorted(summed((spot(r), r[1]) for r in held).items()):
            if upto + size >= goal:
                border = (place[0], place[1] + (upto + size - goal <= goal - upto))
                break
            upto += size
        waiting += [(first, k // 2, [r for r in held if spot(r) < border]), (first + k // 2, k - k // 2, [r for r in held if spot(r) >= border])]
    return done


def summed(pairs):
    out = Counter()
    for place, size in pairs:
        out[place] += size
    return out


def test_against_a_tree_on_one_machine(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = kd_shards._scaled(kd_shards._grouped(kd_shards.metadata(docs), 10)).collect()
    want = brute([(r["doc_id"], r["size"], r["tie"], [r[d] for d in kd_shards.DIMENSIONS]) for r in rows], 10)
    assert {r["doc_id"]: r["shard"] for r in kd_shards.kd_shards(docs, 10).collect()} == want
