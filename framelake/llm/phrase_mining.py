"""Operator 11, phrase collocation mining by prefix-free parsing.

*Parse.* Texts become pieces, pieces become words. A run of ``WINDOW`` words whose hash is divisible by ``PERIOD`` is a trigger; a
chunk goes from one trigger (or the piece's start) to the end of the next trigger window (or the piece's end), so neighbours
overlap by ``WINDOW`` words. Chunks without a trigger end after ``LONGEST`` words, counted from their start. Chunks depend on
content alone: equal passages give equal chunks, which are stored once in a dictionary with their frequency in the parse.

*Count.* A chunk owns the runs of words that begin before its closing trigger window; with ``WINDOW`` words of overlap it holds
all of each, so every occurrence is counted in one chunk exactly, weighted by the chunk's frequency. Runs of k words are counted only
where both runs of k-1 words in them occur often enough; a bit table of ``FILTER_BITS`` bits (one size whatever the corpus) tells
where. It may let rare runs pass, which the count itself then drops, and never hides a frequent one.

*Rank.* Every count that matters is one of a frequent run. Scores use whole decimals; rows of one language are ranked in hash parts
first, so that a language of any size is no single task.

Null texts and texts without words add nothing; a null language is ``und`` (and joins rows that say so). Every row counts, repeated
rows as often as they stand; only ``text`` and ``lang`` are read; an empty table gives no rows. Text of any length is parsed
whole. Words are compared by 64-bit hashes inside a slice of text and by their bytes between slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.shared import cut, read, scratch
from framelake.llm.text_blocks import Words, as_strings, byte_hash, mix64, raw, slices

LEAST = 30
LONGEST_PHRASE = 4
TOP = 2_000
#: a longer candidate absorbs a shorter one that it accounts for to this percentage
ABSORBED = 80
WINDOW = LONGEST_PHRASE - 1
PERIOD = 16
LONGEST = 64
FILTER_BITS = 25
COUNT_BYTES = 1 << 23
RANK_PARTS = 32

_CHUNK = "lang string, chunk string, owned int"
_GRAM = "lang string, phrase string, f long"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _marks(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_PIECE_ENDS = _marks(*b".,;:!?", *range(0x0A, 0x0E))
_APART = _PIECE_ENDS | _marks(0x20, 0x09)
_BLANK = _marks(0x20)


def _ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    size = end - start
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    picked = data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(picked))


def _spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of a slice with one blank after each: bytes, start and end of each word."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    source = np.arange(int(end[-1]) + 1 if len(end) else 0) + np.repeat(words.start - start, size + 1)
    data = words.data[np.minimum(source, max(0, len(words.data) - 1))] if len(end) else np.zeros(0, np.uint8)
    data[end] = 0x20
    return data, start, end


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words that begin at each word (rubbish at the last ones)."""
    out = mix64(hashes + _STEP)
    for k in range(1, width):
        out[:len(out) - k] = mix64(out[:len(out) - k] * _STEP + hashes[k:])
    return out


def cuts(hashes: np.ndarray, piece: np.ndarray, period: int = PERIOD, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, one past the last owned word, and one past the last word of each chunk; ``piece`` numbers each word's piece."""
    n = len(hashes)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    place = np.arange(n)
    opens = np.ones(n, bool)
    opens[1:] = piece[1:] != piece[:-1]
    whole = np.zeros(n, bool)
    whole[:n - WINDOW + 1] = piece[WINDOW - 1:] == piece[:n - WINDOW + 1]
    opens |= whole & (_runs(hashes, WINDOW) % np.uint64(period) == 0)
    since = place - np.maximum.accumulate(np.where(opens, place, 0))
    first = np.flatnonzero(since % longest == 0)
    owned = np.append(first[1:], n)
    stop = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, n)
    last = np.minimum(owned + WINDOW, stop[np.searchsorted(stop, first, "right")])
    return first, owned, last


def parse(docs: DataFrame, period: int = PERIOD, longest: int = LONGEST) -> DataFrame:
    """lang, chunk (its words, parted by one blank), owned (words at which its own runs begin) and frequency: the dictionary."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = Words(texts, _APART)
                ends = np.zeros(len(words.data) + 1, np.int64)
                np.cumsum(_PIECE_ENDS[words.data], out=ends[1:])
                owner = words.owner()
                piece = ends[words.start] + owner  # grows at a separator and at a new text
                first, owned, last = cuts(words.hash, piece, period, longest)
                data, start, end = _spaced(words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(pa.array(owner[first])),
                     _ranges(data, start[first], end[last - 1]).cast(pa.string()), pa.array(owned - first, pa.int32())],
                    ["lang", "chunk", "owned"])

    named = docs.select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return (named.filter("text IS NOT NULL").mapInArrow(rows, _CHUNK)
            .groupBy("lang", "chunk", "owned").agg(F.count(F.lit(1)).alias("frequency")))


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about ``limit`` bytes, so that more equal runs meet."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Grams:
    """Runs of words of a slice of chunks or phrases: their hashes, apart by language."""

    def __init__(self, words: Words, langs: pa.Array, width: int):
        data, at = raw(as_strings(langs))
        tongue = byte_hash(data, at[:-1], at[1:])
        self.hashes = _runs(words.hash + mix64(tongue + _STEP)[words.owner()], width)

    def bits(self) -> np.ndarray:
        return (self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _counted(dictionary: DataFrame, width: int, likely: object) -> DataFrame:
    """lang, phrase and exact count of the runs of ``width`` words, for all whose shorter runs pass the filter."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if likely is None else np.frombuffer(likely.value, np.uint8)
        for batch in _gathered(batches, COUNT_BYTES):
            for part, texts in slices(batch, "chunk", COUNT_BYTES):
                words, langs = Words(texts, _BLANK), part.column("lang")
                owner = words.owner()
                place = np.arange(len(owner))
                good = place - words.first[:-1][owner] < part.column("owned").to_numpy()[owner]
                good &= place + width <= words.first[1:][owner]
                if table is not None:
                    bit = _Grams(words, langs, width - 1).bits()
                    seen = (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                    good &= seen
                    good[:-1] &= seen[1:]
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                hashes = _Grams(words, langs, width).hashes[at]
                order = np.argsort(hashes, kind="stable")
                hashes, at = hashes[order], at[order]
                begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                sums = np.add.reduceat(part.column("frequency").to_numpy()[owner[at]], begin)
                at = at[begin]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(pa.array(owner[at])),
                     _ranges(words.data, words.start[at], words.end[at + width - 1]).cast(pa.string()), pa.array(sums, pa.int64())],
                    ["lang", "phrase", "f"])

    return dictionary.mapInArrow(rows, _GRAM).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _filter(grams: DataFrame, width: int) -> object:
    """The bit table of the runs, as a broadcast of a fixed size."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "phrase"):
                words, langs = Words(texts, _BLANK), part.column("lang")
                bits = _Grams(words, langs, width).bits()[words.first[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], ["bit"])

    table = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    # a bucket has 32 768 bits; its number and positions count from 1 and 0
    for row in (grams.select("lang", "phrase").mapInArrow(rows, "bit long")
                .groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")).toLocalIterator()):
        first = (row["bucket"] - 1) * 4096
        table[first:first + 4096] = np.frombuffer(row["bits"], np.uint8)
    return grams.sparkSession.sparkContext.broadcast(table.tobytes())


def frequent(dictionary: DataFrame, least: int = LEAST, longest: int = LONGEST_PHRASE) -> DataFrame:
    """lang, phrase, words and f of every run of 1 to ``longest`` words that occurs ``least`` times or more."""
    out, likely = None, None
    for width in range(1, longest + 1):
        level = cut(_counted(dictionary, width, likely).filter(F.col("f") >= least).withColumn("words", F.lit(width)))
        out = level if out is None else out.unionByName(level)
        if width < longest:
            likely = _filter(level, width)
    return out


def _whole(name: str) -> str:
    return f"CAST({name} AS DECIMAL(20, 0))"


def _part(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("parts", first, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r and score of every phrase of two words or more, at its lowest-scoring cut."""
    phrases = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("parts"))
    ways = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", "a", "k", _part(1, F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    valued = ways.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn(
        "score", F.expr(f"CAST(2000000 AS DECIMAL(7, 0)) * {_whole('a')} div ({_whole('l')} + {_whole('r')})"))
    return (valued.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
            .select("lang", "phrase", "words", "a", "low.l", "low.r", "low.score"))


def standing(scores: DataFrame, percent: int = ABSORBED) -> DataFrame:
    """Phrases that no longer candidate accounts for."""
    inner = (scores.filter("words > 2").withColumn("parts", F.split("phrase", " "))
             .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
             .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
             .select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "a")
             .groupBy("lang", "phrase").agg(F.max("a").alias("_longer")))
    return (scores.join(inner, ["lang", "phrase"], "left")
            .filter(F.expr(f"_longer IS NULL OR {_whole('_longer')} * 100 < {_whole('a')} * {percent}")).drop("_longer"))


def ranked(phrases: DataFrame, top: int = TOP, parts: int = RANK_PARTS) -> DataFrame:
    """The first ``top`` of each language: first of its hash parts, then of what is left."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = phrases.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = (dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
            .filter(F.col("rank") <= top))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .filter(F.col("rank") <= top).drop("_part"))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, period: int = PERIOD, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    path = scratch(docs.sparkSession, "phrase-dictionary")
    parse(docs, period, longest).write.parquet(path)
    dictionary = docs.sparkSession.read.parquet(path)
    sizes = dictionary.groupBy("lang").agg(F.sum(F.col("owned") * F.col("frequency")).alias("n"))
    best = ranked(standing(cut(scored(frequent(dictionary, least)))), top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents."""
    return mine(read(spark, sf_dir, "documents"))


_UPPER = "".join(map(chr, range(65, 91)))
QUERIES = {"op11_phrase_mining": op11_phrase_mining}
ORACLES = {"op11_phrase_mining": f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                                                                    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, {LONGEST_PHRASE + 1}) AS sizes(k))),
sizes AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
ways AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM counts WHERE k > 1),
valued AS (SELECT y.lang, y.k, y.phrase, y.f AS a, y.c, p.f AS l, q.f AS r, (2000000::HUGEINT * y.f) // (p.f + q.f) AS score
           FROM ways y JOIN counts p ON p.lang = y.lang AND p.phrase = array_to_string(y.w[1:y.c], ' ')
                       JOIN counts q ON q.lang = y.lang AND q.phrase = array_to_string(y.w[y.c + 1:], ' ')),
scored AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(f) AS longer
           FROM (SELECT lang, w, f, k, size, unnest(range(1, k - size + 2)) AS i
                 FROM (SELECT lang, string_split(phrase, ' ') AS w, f, k, unnest(range(2, k)) AS size FROM counts WHERE k > 2))
           GROUP BY ALL),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
           FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
           WHERE i.longer IS NULL OR 100 * i.longer::HUGEINT < {ABSORBED} * s.a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= {TOP}"""}
