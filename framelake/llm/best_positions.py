"""Operator 13, ranked lexical search by the Best Position Algorithm.

*Postings.* One pass over the texts keeps, per slice of documents, the terms that some item asks for, with their counts and the number of
all terms of each document; it also yields N, L and each term's df. Nothing else of the corpus is written.

*Impact lists.* Documents are dealt into shards of about ``SHARD_ROWS``. In a shard every term has a list of (document, impact), sorted by
falling impact, and the same list by document for direct access.

*Search.* For each item all its lists are read from the top in step. Every document met is looked up in the item's other lists at once
(direct access), which scores it whole and marks its place in each list as seen. The best position of a list is the end
of its unbroken run of seen places, which may be far beyond the place read last. No document without a score can have more than the sum
of the impacts that follow the best positions, so a search ends as soon as that sum is strictly below its kth score: equal
scores go to the smaller id and must all be seen. Steps double, which reads a little more than row by row and changes nothing.

*Merge.* Each shard returns at most ``TOP`` documents an item; a window over items ranks them.

Items are taken in blocks of at most ``BLOCK_TERMS`` terms (one larger item is a block of its own); a block's terms are a table of that
proven size in every task, and each block is one pass. Null and empty texts have no terms: such items find nothing, such documents
are not counted in N. Documents without an id count in the statistics and are not returned. Repeated rows of ``documents`` are documents
of their own and may rank side by side; repeated items are answered once per row (a null item id stays null). Texts of any
length are read whole; further columns are not looked at; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm import packed_sums
from framelake.llm.shared import cut, read
from framelake.llm.text_blocks import Words, mix64, slices, text_hash

TOP = 50
SHARD_ROWS = 16_384
BLOCK_TERMS = 1 << 18
FIRST_STEP = 32
#: share of the document length in the impact, in percent
LENGTH_SHARE = 50
SCALE = 1_000_000_000

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_APART = np.zeros(256, bool)
_APART[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_SLICE = "shard int, docs long, terms_all long, ids binary, lengths binary, rows binary, terms binary, counts binary"
_HIT = "item int, doc_id long, score long"


def terms_of(text: str | None) -> list[str]:
    """Distinct terms of a query."""
    return list(dict.fromkeys(t.translate(_LOWER) for t in _TERM.findall(text or "")))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """w * ((10**9 tf) div (1000 tf + 20 m)), in 64-bit integers."""
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * n // total
    return w * (SCALE * tf // (1000 * tf + 20 * m))


def _postings(docs: DataFrame, hashes: np.ndarray, shards: int) -> DataFrame:
    """Per slice of documents: their numbers of terms, and (row, term, count) of the terms in ``hashes`` (sorted)."""
    asked = docs.sparkSession.sparkContext.broadcast(hashes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = asked.value
        made = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part, texts in slices(batch, "text"):
                made += 1
                shard = int(mix64(np.array([made], np.uint64))[0] % np.uint64(shards))
                words = Words(texts, _APART)
                sizes = words.counts()
                at = np.minimum(np.searchsorted(wanted, words.hash), max(0, len(wanted) - 1))
                hit = np.flatnonzero(wanted[at] == words.hash)
                codes, counts = np.unique(words.owner()[hit] * len(wanted) + at[hit], return_counts=True)
                ids = part.column("doc_id")
                owner, term = np.divmod(codes, len(wanted))
                # documents without an id have counted; no list needs them
                named = ~ids.is_null().to_numpy(zero_copy_only=False)[owner]
                df = np.bincount(term, minlength=0)
                yield _slice_row(ids, sizes, owner[named], term[named], counts[named], int((sizes > 0).sum()), shard, None if named.all() else df)

    return docs.mapInArrow(rows, _SLICE + ", nameless binary")


def _slice_row(ids: pa.Array, sizes: np.ndarray, owner: np.ndarray, term: np.ndarray, counts: np.ndarray, docs: int, shard: int,
               all_df: np.ndarray | None) -> pa.RecordBatch:
    names = ids.fill_null(0).to_numpy()
    used, place = np.unique(owner, return_inverse=True)
    nameless = b"" if all_df is None else (all_df - np.bincount(term, minlength=len(all_df))).astype("<i8").tobytes()
    cells = [shard, docs, int(sizes.sum()), names[used].astype("<i8").tobytes(), sizes[used].astype("<i8").tobytes(), place.astype("<i4").tobytes(),
             term.astype("<i4").tobytes(), counts.astype("<i8").tobytes(), nameless]
    fields = [f.split() for f in (_SLICE + ", nameless binary").split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(cells, fields, strict=True)], [n for n, _ in fields])


def _document_counts(postings: DataFrame, terms: int) -> np.ndarray:
    """df of each term, summed over the slices."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            for held, nameless in zip(batch.column("terms").to_pylist(), batch.column("nameless").to_pylist(), strict=True):
                df += np.bincount(np.frombuffer(held, "<i4"), minlength=terms)
                more = np.frombuffer(nameless, "<i8")
                df[:len(more)] += more
        yield from packed_sums.packed(df, "<i8", 1 << 16)

    return packed_sums.total(postings.select("terms", "nameless").mapInArrow(rows, packed_sums.SCHEMA), terms, "<i8", 1 << 16)


class ImpactList:
    """One term's list in a shard: ``docs`` rising with their ``impact`` and ``place``, and ``falling`` impacts with ``by_place`` documents."""

    def __init__(self, docs: np.ndarray, impact: np.ndarray):
        order = np.argsort(-impact, kind="stable")
        self.docs, self.impact = docs, impact
        self.by_place, self.falling = docs[order], np.append(impact[order], 0)
        self.place = np.empty(len(docs), np.int64)
        self.place[order] = np.arange(len(docs))

    def direct(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Impacts of the documents (0 where absent), and the places at which the present ones stand."""
        at = np.minimum(np.searchsorted(self.docs, wanted), len(self.docs) - 1)
        there = self.docs[at] == wanted
        return np.where(there, self.impact[at], 0), self.place[at[there]]


def best_positions(lists: list[ImpactList], names: np.ndarray, top: int, step: int = FIRST_STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents (numbers into ``names``) and scores of the ``top`` best with a score above 0, and how many documents were scored."""
    seen = [np.zeros(len(x.docs) + 1, bool) for x in lists]
    best = [0] * len(lists)
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, met, scored = 0, np.zeros(0, np.int64), 0
    while lists:
        fresh = np.setdiff1d(np.concatenate([x.by_place[depth:depth + step] for x in lists]), met, assume_unique=False)
        depth, step = depth + step, step * 2
        if len(fresh):
            met = np.union1d(met, fresh)
            scored += len(fresh)
            sums = np.zeros(len(fresh), np.int64)
            for x, marks in zip(lists, seen, strict=True):
                got, places = x.direct(fresh)
                sums += got
                marks[places] = True
            docs, scores = np.append(docs, fresh[sums > 0]), np.append(scores, sums[sums > 0])
            keep = np.lexsort((names[docs], -scores))[:top]
            docs, scores = docs[keep], scores[keep]
        bound = 0
        for k, (x, marks) in enumerate(zip(lists, seen, strict=True)):
            best[k] += int(np.argmin(marks[best[k]:]))  # the last mark is never set
            bound += int(x.falling[best[k]])
        if bound == 0 or len(docs) == top and bound < scores[-1]:
            break
    return docs, scores, scored


def _shard_hits(rows: list[dict], queries: list[tuple[int, np.ndarray]], weights: np.ndarray, n: int, total: int, top: int) -> pa.Table:
    of = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
    ids, place = of("ids", "<i8"), of("rows", "<i4")
    shift = np.cumsum([0] + [len(x) for x in ids])
    names, lengths = np.concatenate(ids), np.concatenate(of("lengths", "<i8"))
    doc = np.concatenate([p + s for p, s in zip(place, shift[:-1], strict=True)]).astype(np.int64)
    term, tf = np.concatenate(of("terms", "<i4")), np.concatenate(of("counts", "<i8"))
    order = np.lexsort((doc, term))
    doc, term, tf = doc[order], term[order], tf[order]
    impact = impacts(weights[term], tf, lengths[doc], n, total)
    first = np.searchsorted(term, np.arange(len(weights) + 1))
    made: dict[int, ImpactList] = {}
    out: tuple[list, list, list] = ([], [], [])
    for item, wanted in queries:
        for t in wanted.tolist():
            if t not in made and first[t] < first[t + 1]:
                made[t] = ImpactList(doc[first[t]:first[t + 1]], impact[first[t]:first[t + 1]])
        docs, scores, _ = best_positions([made[t] for t in wanted.tolist() if t in made], names, top)
        out[0].append(np.full(len(docs), item, np.int32)), out[1].append(names[docs]), out[2].append(scores)
    return pa.table({name: np.concatenate(part).astype(kind) for name, part, kind in zip(("item", "doc_id", "score"), out, ("i4", "i8", "i8"), strict=True)})


def _answers(known: Broadcast, n: int, total: int, top: int) -> Callable[[pa.Table], pa.Table]:
    def hits(group: pa.Table) -> pa.Table:
        return _shard_hits(group.to_pylist(), *known.value, n, total, top)

    return hits


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Items with their terms, in blocks of at most ``limit`` terms."""
    block, held = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        terms = terms_of(row["text"])
        if not terms:
            continue
        if block and held + len(terms) > limit:
            yield block
            block, held = [], 0
        block.append((row["item_id"], terms))
        held += len(terms)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard_rows: int = SHARD_ROWS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of every item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shards = max(1, -(-docs.count() // shard_rows))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items, block_terms):
        names = sorted({text_hash(t) for _, terms in block for t in terms})
        hashes = np.array(names, np.uint64)
        queries = [(k, np.searchsorted(hashes, np.array([text_hash(t) for t in terms], np.uint64))) for k, (_, terms) in enumerate(block)]
        postings = cut(_postings(docs, hashes, shards))
        n, total = postings.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms_all"), F.lit(0))).first()
        df = _document_counts(postings, len(hashes))
        weights = np.array([weight(n, int(d)) for d in df.tolist()], np.int64)
        answer = _answers(spark.sparkContext.broadcast((queries, weights)), n, total, top)
        found = postings.select("shard", "ids", "lengths", "rows", "terms", "counts").groupBy("shard").applyInArrow(answer, _HIT)
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        item_ids = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(block)], "item int, item_id long")
        out = out.union(ranked.join(F.broadcast(item_ids), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_UPPER = "".join(map(chr, range(65, 91)))
_TERMS = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
QUERIES = {"op13_best_positions": op13_best_positions}
ORACLES = {"op13_best_positions": f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
sizes AS (SELECT row, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
counts AS MATERIALIZED (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (SELECT a.item_id, s.row, s.doc_id,
                  sum(w.w * (({SCALE} * c.tf) // (1000 * c.tf + 20 * (100 - {LENGTH_SHARE} + (({LENGTH_SHARE} * s.n * t.n_docs) // t.n_terms)))))::BIGINT AS score
           FROM asked a JOIN counts c USING (term) JOIN weights w USING (term) JOIN sizes s USING (row), totals t GROUP BY a.item_id, s.row, s.doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
           FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""}
