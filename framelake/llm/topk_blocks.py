"""Operator 7, exact top-k search by inner product with block-at-a-time pruning.

*Blocks.* Vectors are renumbered so that those with the same strongest dimensions are neighbours, dealt into shards by
ranges of this order, and packed into blocks of ``BLOCK`` rows. A block keeps its forward index (the rows' components) and
for each dimension (the "term") the largest and smallest component.

*Pruning.* The bound of a block for a query is the sum over dimensions of the component times the block's maximum, or its
minimum where the query is negative. A query takes blocks in the order of their bounds and stops when the next bound is
below its kth score so far; equal bounds go on, since ties go to the smaller id.

*Two rounds.* Every query first searches its own shard, where its neighbours tend to be; its kth score there is the
threshold that it takes to all other shards. Queries and shards meet in a grid of (shard, chunk of queries) of bounded size
on either side, so no side is ever broadcast or gathered. A last ranking merges at most k rows per query and shard.

Components become floor(64 * x); scores are exact (whole numbers in doubles, or Python integers where 2**53 would be
passed, kept in the range of a long). Vectors null, with null or non-finite components, or without an id take no part.
Only vectors of the same length meet. A query's own row is left out; other rows of its id are not. A repeated query
row is answered once per row. Only ``vec_id`` and ``embedding`` are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.shared import cut, read

TOP = 20
EVERY = 20
SCALE = 64.0
BLOCK = 256
SHARD_ROWS = 4_096
CHUNK_QUERIES = 4_096

_BLOCKS = "shard int, dims int, keys binary, ids binary, rows binary, high binary, low binary"
_FOUND = "key long, query_id long, shard int, dims int, vector binary, least double, vec_ids array<bigint>, scores array<bigint>"
_VECTOR_KEY = "dims int, place long, vec_id long, vector binary"


def _vectors(frame: DataFrame) -> DataFrame:
    """dims, place (what brings similar vectors together), vec_id and whole components of all vectors that take part."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, place, ids, packed = [], [], [], []
            for name, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if name is None or not values.is_valid or values.values.null_count:
                    continue
                v = np.floor(SCALE * values.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if not np.isfinite(v).all():
                    continue
                strong = np.argsort(-np.abs(v), kind="stable")[:3]
                code = 0
                for j in strong.tolist():
                    code = code * 2 * (len(v) + 1) + 2 * j + (v[j] > 0)
                dims.append(len(v)), place.append(code % (1 << 62)), ids.append(name), packed.append(v.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(place, pa.int64()), pa.array(ids, pa.int64()),
                                              pa.array(packed, pa.binary())], ["dims", "place", "vec_id", "vector"])

    return (frame.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
            .mapInArrow(rows, _VECTOR_KEY))


def _pack(vectors: DataFrame, block: int) -> DataFrame:
    """Blocks of neighbouring vectors, inside shards."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        key = shard << 40
        ids: list[int] = []
        held: list[bytes] = []
        dims = -1

        def send() -> pa.RecordBatch:
            nonlocal key
            m = np.frombuffer(b"".join(held), "<f8").reshape(len(held), dims)
            row = [[shard], [dims], [np.arange(key, key + len(ids), dtype="<i8").tobytes()], [np.array(ids, "<i8").tobytes()],
                   [m.tobytes()], [m.max(axis=0).tobytes() if dims else b""], [m.min(axis=0).tobytes() if dims else b""]]
            key += len(ids)
            ids.clear(), held.clear()
            types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)],
                                              ["shard", "dims", "keys", "ids", "rows", "high", "low"])

        for batch in batches:
            for d, name, vector in zip(batch.column("dims").to_pylist(), batch.column("vec_id").to_pylist(),
                                       batch.column("vector").to_pylist(), strict=True):
                if ids and (d != dims or len(ids) >= block):
                    yield send()
                dims = d
                ids.append(name), held.append(vector)
        if ids:
            yield send()

    return vectors.mapInArrow(rows, _BLOCKS)


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole components."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(rows)))
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1] < 2 ** 53:
        return queries @ rows.T
    whole = np.vectorize(int, otypes=[object])
    return whole(queries) @ whole(rows).T


class _Block:
    def __init__(self, row: dict):
        self.keys, self.ids = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["ids"], "<i8")
        self.rows = np.frombuffer(row["rows"], "<f8").reshape(len(self.ids), row["dims"])
        self.high, self.low = np.frombuffer(row["high"], "<f8"), np.frombuffer(row["low"], "<f8")


def search(blocks: list[_Block], queries: np.ndarray, keys: np.ndarray, least: np.ndarray, top: int) -> list[list[tuple[int, int]]]:
    """Per query the (score, vec_id) of at most ``top`` best rows of the blocks that score ``least`` or more.

    Blocks are taken by falling bound; all queries at their nth block go together where they meet the same block.
    """
    pools: list[list[tuple[int, int]]] = [[] for _ in keys]
    kth = least.astype(float).copy()
    if not blocks:
        return pools
    high, low = np.stack([b.high for b in blocks]), np.stack([b.low for b in blocks])
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    bound += np.abs(bound) * 1e-12  # doubles may round a bound down only where scores are not exact in doubles either
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(len(keys))
    for turn in range(len(blocks)):
        at = order[active, turn]
        going = bound[active, at] >= kth[active]
        active, at = active[going], at[going]
        if not len(active):
            break
        for b in np.unique(at).tolist():
            mine, block = active[at == b], blocks[b]
            scores = _products(queries[mine], block.rows)
            for q, row in zip(mine.tolist(), scores, strict=True):
                good = np.flatnonzero((row >= kth[q]) & (block.keys != keys[q]))
                if len(good):
                    pool = pools[q] + [(int(s), i) for s, i in zip(row[good].tolist(), block.ids[good].tolist(), strict=True)]
                    pool.sort(key=lambda p: (-p[0], p[1]))
                    pools[q] = pool = pool[:top]
                    if len(pool) == top:
                        kth[q] = max(kth[q], float(pool[-1][0]))
    return pools


def _result(found: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in _FOUND.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=names)


def _columns(pool: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    return [i for _, i in pool], [min(max(s, -(2 ** 63)), 2 ** 63 - 1) for s, _ in pool]


def top_k(frame: DataFrame, top: int = TOP, every: int = EVERY, shard_rows: int = SHARD_ROWS, chunk: int = CHUNK_QUERIES,
          block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the best ``top`` rows for every row whose id is divisible by ``every``."""
    vectors = cut(_vectors(frame))
    total = vectors.count()
    shards = max(1, -(-total // shard_rows))
    packed = cut(_pack(vectors.repartitionByRange(shards, "dims", "place", "vec_id").sortWithinPartitions("dims", "place", "vec_id"),
                       block))

    def at_home(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        for dims in sorted({r["dims"] for r in rows}):
            blocks = [_Block(r) for r in rows if r["dims"] == dims]
            picked = [(b.keys[i], b.ids[i], b.rows[i]) for b in blocks for i in np.flatnonzero(b.ids % every == 0).tolist()]
            if picked:
                queries = np.stack([p[2] for p in picked])
                keys = np.array([p[0] for p in picked])
                pools = search(blocks, queries, keys, np.full(len(keys), -np.inf), top)
                for (key, name, vector), pool in zip(picked, pools, strict=True):
                    least = float(pool[-1][0]) if len(pool) == top else -np.inf
                    out.append((int(key), int(name), rows[0]["shard"], dims, vector.astype("<f8").tobytes(), least, *_columns(pool)))
        return _result(out)

    home = cut(packed.groupBy("shard").applyInArrow(at_home, _FOUND))
    chunks = max(1, -(-home.count() // chunk))

    def elsewhere(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, asked = left.to_pylist(), right.to_pylist()
        out = []
        for dims in sorted({r["dims"] for r in asked}):
            blocks = [_Block(r) for r in rows if r["dims"] == dims]
            mine = [q for q in asked if q["dims"] == dims]
            queries = np.stack([np.frombuffer(q["vector"], "<f8") for q in mine])
            pools = search(blocks, queries, np.array([q["key"] for q in mine]), np.array([q["least"] for q in mine]), top)
            out += [(q["key"], q["query_id"], 0, dims, b"", 0.0, *_columns(pool)) for q, pool in zip(mine, pools, strict=True) if pool]
        return _result(out)

    last = packed.agg(F.max("shard")).first()[0] or 0
    asked = (home.select("key", "query_id", "shard", "dims", "vector", "least")
             .withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(last)))).filter(F.col("to") != F.col("shard"))
             .select(F.col("to").alias("shard"), F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int").alias("part"),
                     "key", "query_id", "dims", "vector", "least"))
    dealt = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    away = (dealt.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(elsewhere, _FOUND))
    pairs = (home.select("key", "query_id", "vec_ids", "scores").union(away.select("key", "query_id", "vec_ids", "scores"))
             .select("key", "query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("_p"))
             .select("key", "query_id", F.col("_p.vec_ids").alias("vec_id"), F.col("_p.scores").alias("score")))
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))


def op7_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of ``embeddings`` for every twentieth row."""
    return top_k(read(spark, sf_dir, "embeddings"))


QUERIES = {"op7_block_top_k": op7_block_top_k}
ORACLES = {"op7_block_top_k": f"""
WITH parts AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM parts q JOIN parts c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}"""}
