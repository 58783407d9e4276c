"""Collision counting against all pairs."""

import math

import numpy as np
import pytest

from framelake.llm import vector_copies


def brute(rows, cosine=0.93):
    ok = [i for i, (n, v, g) in enumerate(rows) if n is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {}
    for i in ok:
        m = np.array(rows[i][1], float)
        m = m / np.abs(m).max()
        unit[i] = m / np.sqrt((m * m).sum())
    links = {i: [] for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i].append(j)
    least, out = {}, []
    for i in range(len(rows)):
        if i not in least:
            seen, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j), todo.append(j)
            smallest = min(rows[j][0] for j in seen) if rows[i][0] is not None else None
            least.update({j: smallest for j in seen})
        out.append((rows[i][0], len(links[i]), least[i], rows[i][0] == least[i]))
    return sorted(out, key=repr)


def run(frame, **options):
    return sorted(map(tuple, vector_copies.near_copies(frame, **options).collect()), key=repr)


def clouds(rng, n, dims, spread):
    centre = rng.normal(size=(n // 10, dims))
    return [(i, (centre[i % len(centre)] + spread * rng.normal(size=dims)).tolist(), i % len(centre) % 2) for i in range(n)]


@pytest.mark.parametrize("options", [dict(), dict(cell=16, tile=16), dict(cell=64, tile=7)])
def test_same_links_as_all_pairs(spark, options):
    rng = np.random.default_rng(3)
    rows = clouds(rng, 400, 24, .1)
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(60)]  # exact copies
    near = np.array(rows[9][1])
    rows += [(2000 + i, (near + .02 * rng.normal(size=24)).tolist(), rows[9][2]) for i in range(60)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, links int").repartition(4)
    assert run(frame, **options) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Pairs barely above the least cosine, in a label that is cut into many cells."""
    rng = np.random.default_rng(4)
    rows, pairs = [], 1500
    for i in range(pairs):
        x, y = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.9302
        rows += [(2 * i, x.tolist(), 1), (2 * i + 1, (c * x + math.sqrt(1 - c * c) * y).tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    found = sum(r[1] for r in run(frame, cell=64)) / 2
    assert found / pairs > 0.99


def test_counts_and_windows():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 50, 5)).round(1)
    want = (np.abs(a[:, None] - b[None]) <= .5 + 1e-12).sum(2)
    assert (vector_copies.collisions(a, b, .5 + 1e-12) == want).all()
    assert 0 < vector_copies.needed() < vector_copies.LINES
    assert vector_copies.tables(0) == 1 < vector_copies.tables(4) < vector_copies.tables(8)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, nan], 1),
            (8, [inf, 0.0], 1), (9, [1.0, None], 1), (10, [], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e300, 1e299], 1),
            (13, [1e-300, 1e-301], 1), (14, [-1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, component_id string")
    assert run(frame) == brute(rows)
    assert run(frame.limit(0)) == []


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, vector_copies.op12_vector_copies(spark, small).collect()), key=repr) == brute(rows)
