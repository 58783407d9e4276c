"""Block-at-a-time search against brute force."""

import math

import numpy as np
import pytest

from framelake.llm import topk_blocks


def brute(rows, top=20, every=20):
    ok = [(i, n, [math.floor(64 * x) for x in v]) for i, (n, v) in enumerate(rows)
          if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, v in ok:
        if n % every == 0:
            got = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), m) for j, m, w in ok if j != i and len(w) == len(v))
            out += [(n, r + 1, m, -s) for r, (s, m) in enumerate(got[:top])]
    return sorted(out)


def run(frame, **options):
    return sorted(map(tuple, topk_blocks.top_k(frame, **options).collect()))


def test_query(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(map(tuple, topk_blocks.op7_block_top_k(spark, small).collect())) == brute(rows)


@pytest.mark.parametrize("options", [dict(shard_rows=64, chunk=3, block=8), dict(shard_rows=1000, block=1), dict(top=3, every=7)])
def test_shapes(spark, options):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 12))
    rows = [(i, (centre[i % 6] + .2 * rng.normal(size=12)).tolist()) for i in range(300)]
    rows += [(300 + i, centre[0].tolist()) for i in range(100)]  # one vector that a fourth of the rows share
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert run(frame, **options) == brute(rows, options.get("top", 20), options.get("every", 20))


def test_pruning_skips_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    rows = np.floor(64 * np.repeat(np.eye(8) * 5, 40, axis=0) + rng.normal(size=(320, 8)))
    blocks = [topk_blocks._Block({"keys": np.arange(k, k + 40, dtype="<i8").tobytes(), "ids": np.arange(k, k + 40, dtype="<i8").tobytes(),
                                  "rows": rows[k:k + 40].tobytes(), "dims": 8, "high": rows[k:k + 40].max(0).tobytes(),
                                  "low": rows[k:k + 40].min(0).tobytes()}) for k in range(0, 320, 40)]
    seen = []
    real = topk_blocks._products
    monkeypatch.setattr(topk_blocks, "_products", lambda q, r: seen.append(len(q)) or real(q, r))
    got = topk_blocks.search(blocks, rows[:5], np.arange(5), np.full(5, -np.inf), 10)
    assert sum(seen) == 5 and all(len(g) == 10 for g in got)


def test_edges(spark):
    rows = [(0, [1.0, -0.5]), (20, [0.3, 0.2]), (20, [0.3, 0.2]), (None, [1.0, 1.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]),
            (4, [float("inf"), 1.0]), (40, [1.0, 2.0, 3.0]), (41, []), (60, []), (5, [0.3, 0.2]), (-20, [-1.0, 0.0]), (6, [1e12, 1e12]), (80, [3e9, 3e9])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    assert run(frame) == [tuple(min(x, 2 ** 63 - 1) for x in r) for r in brute(rows)]
    assert run(frame.limit(0)) == []
