"""Operator 12, near-duplicate vectors by collision counting over one-dimensional projections.

*Windows.* All vectors are projected on ``LINES`` random lines. On each line the vectors are sorted, and every vector opens a window of
fixed width around its own place; two vectors collide on a line if one lies in the other's window. A pair goes on to verification if
it collides on at least ``needed`` lines: the largest count that a pair exactly at the least cosine still reaches with probability
``1 - MISS`` (the differences of a unit pair on a random line are normal, so the count is binomial). Verification is the cosine in
doubles, so no pair below the least cosine is ever linked.

*Cells.* Sorting a whole label against itself would count a window of a third of the label per line. So counting takes place in
cells: a label of n vectors is cut by the signs of k further projections into cells of about ``CELL`` vectors, in as many different ways
("tables") as it takes for a pair at the least cosine to share a cell of one of them with probability ``1 - MISS``. A pair is
counted in the first table whose cell both share, which a task knows from the two lists of cells, so no pair is ever written out,
counted twice, or gathered. A cell of more than ``TILE`` vectors becomes pairs of blocks of that size.

*Copies.* Equal vectors of a label are one class with a weight before anything is compared; classes and their links carry the result.
A task returns one row per class and tile: linked weight, and the smallest class that its links reach inside the tile.

Vectors that are null, zero, empty or hold null or non-finite components link with nothing, nor do rows without a label or id;
they come back as their own component (``kept`` is true). Vectors of different length do not meet. Rows that repeat an id are
vectors of their own: each counts in the others' links, and all of the smallest id are kept. Lengths are taken after division by the largest
component, so neither overflows nor vanishes. Only ``vec_id``, ``embedding`` and ``label`` are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.components import components
from framelake.llm.shared import cut, read, small_side

COSINE = 0.93
LINES = 32
#: half the window, in deviations of the difference of a pair at the least cosine
WINDOW = 1.5
MISS = 5e-4
CELL = 512
TILE = 1024
#: so many hot cells (four numbers each) are broadcast; more are joined by a shuffle
HOT_CELLS = 100_000
SEED = 20_259

_KEYED = "label long, dims int, bits int, class long, weight long, vector binary, cells array<bigint>"
_FOUND = "class long, links long, reached long"


def needed(cosine: float = COSINE, lines: int = LINES, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count of collisions that a pair at ``cosine`` reaches with probability ``1 - miss`` or more."""
    p = math.erf(window / math.sqrt(2))
    below = 0.0
    for count in range(lines + 1):
        below += math.comb(lines, count) * p ** count * (1 - p) ** (lines - count)
        if below > miss:
            return count
    return lines


def tables(bits: int, cosine: float = COSINE, miss: float = MISS) -> int:
    """Ways to cut a label into ``2 ** bits`` cells, so that a pair at ``cosine`` shares a cell once with probability ``1 - miss``."""
    if not bits:
        return 1
    share = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-share))


def _lines(dims: int, count: int, kind: int) -> np.ndarray:
    return np.random.default_rng([SEED, kind, dims]).normal(size=(count, dims)).T


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    m = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dims)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _keyed(classes: DataFrame, cosine: float, miss: float) -> DataFrame:
    """Classes with the cell that they fall into in each table of their label."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, bits = batch.column("dims").to_numpy(), batch.column("bits").to_numpy()
            for d, k in sorted(set(zip(dims.tolist(), bits.tolist(), strict=True))):
                part = batch.filter(pa.array((dims == d) & (bits == k)))
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                vectors = pa.array([v.astype("<f8").tobytes() for v in flat], pa.binary())
                ways = tables(k, cosine, miss)
                above = _unit(vectors, d) @ _lines(d, ways * k, 1) > 0 if k else np.zeros((len(part), 0), bool)
                cells = above.reshape(len(part), ways, k) @ (1 << np.arange(k, dtype=np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * ways, pa.int32()), pa.array(cells.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "dims", "bits", "class", "weight")), vectors, lists],
                                                 ["label", "dims", "bits", "class", "weight", "vector", "cells"])

    return classes.select("label", "dims", "bits", "class", "weight", "embedding").mapInArrow(rows, _KEYED)


def collisions(left: np.ndarray, right: np.ndarray, half: float) -> np.ndarray:
    """On how many lines (columns) each right row lies in each left row's window of ``half`` to either side."""
    counts = np.zeros((len(left), len(right)), np.uint8)
    for x, y in zip(left.T, right.T, strict=True):
        order = np.argsort(y, kind="stable")
        first, last = np.searchsorted(y[order], x - half), np.searchsorted(y[order], x + half, "right")
        place = np.empty(len(y), np.uint16)
        place[order] = np.arange(len(y))
        # places before the window wrap around to large numbers
        counts += place[None, :] - first.astype(np.uint16)[:, None] < (last - first).astype(np.uint16)[:, None]
    return counts


def _reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each row's links lead to."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def linked(vectors: np.ndarray, cells: np.ndarray, table: int, side: np.ndarray | None, cosine: float, lines: int, window: float,
           miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of a tile that meet first in this table, collide often enough and are close enough.

    ``side`` is None for a block with itself, else true for the rows of the first block.
    """
    left = np.arange(len(vectors)) if side is None else np.flatnonzero(side)
    right = left if side is None else np.flatnonzero(~side)
    fresh = np.ones((len(left), len(right)), bool) if side is not None else np.triu(np.ones((len(left),) * 2, bool), 1)
    for before in range(table):
        fresh &= cells[left, before][:, None] != cells[right, before][None, :]
    if not fresh.any():
        return left[:0], right[:0]
    places = vectors @ _lines(vectors.shape[1], lines, 0)
    half = window * math.sqrt(2 * (1 - cosine))
    least = needed(cosine, lines, window, miss)
    if fresh.mean() > 0.05:
        a, b = np.nonzero(fresh & (collisions(places[left], places[right], half) >= least))
    else:
        a, b = np.nonzero(fresh)
        often = (np.abs(places[left[a]] - places[right[b]]) <= half).sum(axis=1) >= least
        a, b = a[often], b[often]
    a, b = left[a], right[b]
    close = np.concatenate([(vectors[a[k:k + 65_536]] * vectors[b[k:k + 65_536]]).sum(axis=1) for k in range(0, max(1, len(a)), 65_536)]) >= cosine
    return a[close], b[close]


def near_copies(frame: DataFrame, cosine: float = COSINE, lines: int = LINES, window: float = WINDOW, miss: float = MISS, cell: int = CELL,
                tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    every = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                         F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND "
                   "abs(x) <= 1.7976931348623157E308D) AND exists(embedding, x -> x <> 0)")
    usable = F.coalesce(sound, F.lit(False))
    classes = (every.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("weight"))
               .withColumns({"dims": F.size("embedding"), "class": F.monotonically_increasing_id()}))
    classes = cut(classes)
    sizes = classes.groupBy("label", "dims").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / cell))).cast("int").alias("bits"))
    keyed = cut(_keyed(classes.join(small_side(sizes, HOT_CELLS), ["label", "dims"]), cosine, miss))

    place = ["label", "dims", "table", "cell"]
    dealt = keyed.select("label", "dims", "class", "weight", "vector", "cells", F.posexplode("cells").alias("table", "cell"))
    hot = (dealt.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > tile)
           .select(*place, F.ceil(F.col("_n") / tile).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("class"), F.coalesce("blocks", F.lit(1))).cast("int")
    tiles = (dealt.join(small_side(cut(hot), HOT_CELLS), place, "left").withColumn("block", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
             .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}))

    def count(group: pa.Table) -> pa.Table:
        dims, table = group.column("dims")[0].as_py(), group.column("table")[0].as_py()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        vectors = _unit(group.column("vector"), dims)
        cells = group.column("cells").combine_chunks().flatten().to_numpy().reshape(len(vectors), -1)
        side = None if low == high else group.column("block").to_numpy() == low
        a, b = linked(vectors, cells, table, side, cosine, lines, window, miss)
        names, weight = group.column("class").to_numpy(), group.column("weight").to_numpy()
        links = np.zeros(len(names), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        met = np.flatnonzero(links)
        return pa.table({"class": names[met], "links": links[met], "reached": names[_reached(len(names), a, b)[met]]})

    found = cut(tiles.select(*place, "low", "high", "block", "class", "weight", "vector", "cells")
                .groupBy(*place, "low", "high").applyInArrow(count, _FOUND))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("class").alias("a"), F.col("reached").alias("b"))).withColumnRenamed("node", "class")
    named = classes.join(links, "class", "left").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    settled = named.join(least, "component").select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "component_id",
                                                     (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    grouped = every.filter(usable).join(settled, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")))
    alone = every.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (grouped.select("vec_id", "n_links", "component_id").unionByName(alone)
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def op12_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all embeddings."""
    return near_copies(read(spark, sf_dir, "embeddings"))


QUERIES = {"op12_vector_copies": op12_vector_copies}
ORACLES = {"op12_vector_copies": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                       AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                       WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id, coalesce(l.b >= e.vec_id, true) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id"""}
