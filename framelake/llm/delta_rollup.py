"""Operator 4, token counts as rollups kept up to date by signed deltas.

A change says what happened to a document: ``insert``, ``delete`` or ``revise`` (with the old and the new key and count).
It becomes signed rows - a revision takes back the old count and adds the new one - and these add up per (source, lang,
tokenizer), first inside tasks, so that one source with most of the rows is as cheap as any other. The sums of a
batch are written as one Parquet folder named by the batch. Totals are the sums over the folders, so applying a batch costs
its own changes and never the documents that are already counted.

*Idempotent commits.* A folder counts once Spark's writer has put its success mark; a batch whose folder has the mark
is not applied again, whatever the changes say, and one that was cut off is written over. ``compact`` adds up committed
batches into one snapshot that remembers their names, so late repeats stay without effect.

Null sources, languages and tokenizers are keys like others. A change with a null count adds no tokens, an unknown kind of
change is an error. Repeated changes inside a batch count as often as they stand there. Totals of an empty store have
no rows; a key whose documents and tokens are both zero is left out. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bpe_ids
from framelake.llm.shared import cut, read, scratch
from framelake.llm.text_blocks import Words, slices

KEY = ("source", "lang", "tokenizer")
CHANGES = ("change string, source string, lang string, tokenizer string, tokens long, "
           "old_source string, old_lang string, old_tokenizer string, old_tokens long")
_TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"
_STORED = _TOTALS + ", batches array<string>"
_MARK = "_SUCCESS"
SNAPSHOT = "snapshot-"


def signed(changes: DataFrame) -> DataFrame:
    """source, lang, tokenizer, docs and tokens: what each change adds and takes back."""
    def side(sign: int, prefix: str = "") -> Column:
        return F.struct(*[F.col(prefix + c).cast("string").alias(c) for c in KEY], F.lit(sign).cast("long").alias("docs"),
                        (F.coalesce(F.col(prefix + "tokens"), F.lit(0)) * sign).cast("long").alias("tokens"))

    rows = (F.when(F.col("change") == "insert", F.array(side(1))).when(F.col("change") == "delete", F.array(side(-1)))
            .when(F.col("change") == "revise", F.array(side(-1, "old_"), side(1)))
            .otherwise(F.raise_error(F.concat(F.lit("unknown change "), F.coalesce("change", F.lit("null"))))))
    return changes.select(F.explode(rows).alias("r")).select("r.*")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class RollupStore:
    """A folder of committed batches; any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch) or batch.startswith(("_", ".", SNAPSHOT)):
            raise ValueError(f"not a batch name: {batch!r}")
        return f"{self.path}/{batch}"

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Folders with a success mark."""
        path, files = self._files()
        if not files.exists(path):
            return []
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(f.getPath().getName() for f in files.listStatus(path)
                      if f.isDirectory() and files.exists(Path(f.getPath(), _MARK)))

    def _stored(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(*[f"{self.path}/{f}" for f in folders])

    def _live(self) -> tuple[list[str], set[str]]:
        """(folders that totals are made of, batches they hold): the widest snapshot and the batches it does not name."""
        folders = self.committed()
        snapshots = [f for f in folders if f.startswith(SNAPSHOT)]
        batches = set(folders) - set(snapshots)
        named = [set(r["batches"]) for r in self._stored(snapshots).filter("batches IS NOT NULL").select("batches").collect()]
        base = max(named, key=len, default=set())
        return sorted(batches - base) + ([_snapshot(base)] if base else []), batches | base

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits the changes of a batch; False if it was committed before."""
        folder = self._folder(batch)
        if batch in self._live()[1]:
            return False
        sums = _summed(signed(changes)).withColumn("batches", F.array(F.lit(batch)))
        sums.write.mode("overwrite").parquet(folder)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        return _summed(self._stored(self._live()[0])).filter("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Adds up all committed batches into a snapshot; their folders may then go."""
        live, names = self._live()
        if len(live) < 2:
            return
        note = self.spark.createDataFrame([(None, None, None, 0, 0, sorted(names))], _STORED)
        sums = _summed(self._stored(live)).withColumn("batches", F.lit(None).cast("array<string>"))
        sums.unionByName(note).write.mode("overwrite").parquet(f"{self.path}/{_snapshot(names)}")


def _snapshot(names: set[str]) -> str:
    return SNAPSHOT + hashlib.blake2b("\n".join(sorted(names)).encode(), digest_size=8).hexdigest()


def counted(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, lang, words and tokens (by the tokenizers library) of every row."""
    vocabulary = vocabulary or bpe_ids.default_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe_ids.encoder(vocabulary)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array(Words(texts).counts().astype("int64")),
                     pa.array([len(i) for i in encoder.batch(texts)], pa.int64())], ["doc_id", "source", "lang", "words", "tokens"])

    return (docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("source", "lang", "text")])
            .mapInArrow(rows, "doc_id long, source string, lang string, words long, tokens long"))


def changes_of(rows: DataFrame, change: str, **columns: Column) -> DataFrame:
    """Changes of one kind; columns that are not given are null."""
    given = {"change": F.lit(change), **columns}
    return rows.select(*[given.get(name, F.lit(None)).cast(kind).alias(name)
                         for name, kind in (c.split() for c in CHANGES.split(", "))])


def op4_delta_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after three batches over all documents.

    ``load`` inserts every document with its words (tokenizer ``words-1``), ``recount`` revises every document to its
    byte-level tokens (``bytes-1``), ``takedown`` deletes the documents that the labels call toxic. ``recount`` is sent again
    after a compaction, which must change nothing.
    """
    counts = cut(counted(read(spark, sf_dir, "documents")))
    toxic = read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    key = {"source": F.col("source"), "lang": F.col("lang")}
    words, tokens = F.lit("words-1"), F.lit("bytes-1")
    recount = changes_of(counts, "revise", **key, tokenizer=tokens, tokens=F.col("tokens"), old_source=F.col("source"),
                         old_lang=F.col("lang"), old_tokenizer=words, old_tokens=F.col("words"))
    store = RollupStore(spark, scratch(spark, "rollup"))
    store.apply("load", changes_of(counts, "insert", **key, tokenizer=words, tokens=F.col("words")))
    store.apply("recount", recount)
    store.compact()
    store.apply("recount", recount)
    store.apply("takedown", changes_of(counts.join(toxic, "doc_id"), "delete", **key, tokenizer=tokens, tokens=F.col("tokens")))
    return store.totals()


QUERIES = {"op4_delta_rollup": op4_delta_rollup}
ORACLES: dict[str, str] = {}
