"""Order-dependent folds over keys of any length.

Some state machines (box tracks, undo stacks) cannot be written as a window. A key is cut into
segments; each segment is folded on its own from an assumed start state, and only segments whose
assumed start differs from their predecessor's end are folded again, until nothing changes. The
result is exactly the sequential one; state machines that forget settle after a round or two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.ordered import SEG, SEGMENT_ROWS, segment_of
from framelake.session import ensure_checkpoints

# fold(rows in order, start state or None) -> (output rows, end state); states are short strings.
Fold = Callable[[pd.DataFrame, str | None], tuple[pd.DataFrame, str | None]]
START, FIRST = "_start", "_first"


def _stored(df: DataFrame) -> DataFrame:
    """Checkpoints, and gives the columns an identity of their own so they can meet their source."""
    return df.checkpoint().toDF(*df.columns)


def groups(parts: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a sorted partition; a group may span several Arrow batches."""
    waiting: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        keys, before = part[group], part[group].shift()
        new = ((keys != before) & ~(keys.isna() & before.isna())).any(axis=1).to_numpy()
        new[0] = True
        if waiting:
            old, first = waiting[-1][group].iloc[-1], keys.iloc[0]
            new[0] = not ((old == first) | (old.isna() & first.isna())).all()  # else the first rows continue the waiting group
        starts = np.flatnonzero(new).tolist()
        bounds = [*([] if new[0] else [0]), *starts, len(part)]
        for low, high in zip(bounds[:-1], bounds[1:]):
            if new[low] and waiting:
                yield pd.concat(waiting) if len(waiting) > 1 else waiting[0]
                waiting = []
            waiting.append(part.iloc[low:high])
    if waiting:
        yield pd.concat(waiting) if len(waiting) > 1 else waiting[0]


def _fold_segments(rows: DataFrame, starts: DataFrame, group: list[str], order: list[str], fold, schema: str) -> DataFrame:
    """Folds each (key, segment) once, beginning with the state its row in ``starts`` names.

    The start state travels as one extra row in front of its segment.
    """
    marked = (rows.withColumn(START, F.lit(None).cast("string")).withColumn(FIRST, F.lit(1))
              .unionByName(starts.withColumn(FIRST, F.lit(0)), allowMissingColumns=True))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in groups(parts, group):
            lead = whole[FIRST].to_numpy() == 0
            state = whole[START].iloc[0] if lead[0] else None
            body = whole[~lead] if lead[0] else whole
            if len(body):
                yield fold(body, state)

    return (marked.repartition(*group).sortWithinPartitions(*group, FIRST, *order).mapInPandas(run, schema))


def chained_fold(df: DataFrame, keys: Sequence[str], position: str, order: Sequence[str], fold: Fold,
                 out_schema: str, rows: int = SEGMENT_ROWS, resets: DataFrame | None = None) -> DataFrame:
    """Folds every key in order and returns the fold's output rows.

    ``resets`` names, per key and segment (``_seg``), the last position ``_from`` at which the state forgets all before it: the end of
    such a segment is found from there on.

    The rounds run as jobs while the plan is built, but only when some key spans several segments.
    Column types must survive a null in one row: use bigint, double, string or arrays.
    """
    keys, order = list(keys), list(order)
    group = keys + [SEG]
    cut = df.withColumn(SEG, segment_of(position, rows))
    ensure_checkpoints(df.sparkSession)
    segments = _stored(cut.select(*group).distinct())
    linked = segments.withColumn("_next", F.lead(SEG).over(Window.partitionBy(*keys).orderBy(SEG))).where("_next is not null")
    kinds = dict(cut.dtypes)
    if linked.isEmpty():
        starts = linked.select(*group, F.lit(None).cast("string").alias(START))
    else:
        needed = cut
        if resets is not None:
            needed = cut.join(resets, group, "left").where(F.col("_from").isNull() | (F.col(position) >= F.col("_from"))).drop("_from")
            needed = _stored(needed.select(*cut.columns))
        states = _settled(needed, keys, order, fold, linked.select(*group), kinds)
        starts = linked.join(states, group).select(*keys, F.col("_next").alias(SEG), F.col("_end").alias(START))
    return _fold_segments(cut, starts, group, order, lambda pdf, state: fold(_typed(pdf, kinds), state)[0], out_schema)


def _typed(pdf: pd.DataFrame, kinds: dict[str, str]) -> pd.DataFrame:
    """Integers again after the null of the start row made them floats."""
    wrong = [c for c, kind in kinds.items() if kind in ("int", "bigint") and c in pdf and pdf[c].dtype.kind == "f"]
    return pdf.astype({c: "int64" for c in wrong}) if wrong else pdf


def _settled(cut: DataFrame, keys: list[str], order: list[str], fold: Fold, inner: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """End state of every segment that has a successor."""
    group = keys + [SEG]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in group) + ", `_start` string, `_end` string"

    def end_of(pdf: pd.DataFrame, state: str | None) -> pd.DataFrame:
        out = pdf[group].iloc[:1].copy()
        out[START], out["_end"] = state, fold(_typed(pdf, kinds), state)[1]
        return out

    def fold_from(starts: DataFrame) -> DataFrame:
        return _fold_segments(cut.join(starts.select(*group), group, "left_semi"), starts, group, order, end_of, schema)

    states = _stored(fold_from(inner.withColumn(START, F.lit(None).cast("string"))))
    before = Window.partitionBy(*keys).orderBy(SEG)
    while True:
        moved = _stored(states.withColumn("_want", F.lag("_end").over(before))
                        .where(~F.col("_want").eqNullSafe(F.col(START))).select(*group, F.col("_want").alias(START)))
        if moved.isEmpty():
            return states
        kept = states.join(moved.select(*group), group, "left_anti")
        states = _stored(kept.unionByName(fold_from(moved)))
