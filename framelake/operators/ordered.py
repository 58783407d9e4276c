"""Ordered computation that stays parallel when one key holds most of the rows.

A plain ``Window.partitionBy(clip_id)`` puts a whole clip into one task. Here a clip is cut into
segments of consecutive positions and every window is partitioned by (key, segment):

* bounded look-back or look-ahead copies the few rows next to a border into the neighbouring
  segment (``with_halo``), found from the ends of the segments that have rows;
* running values are the local running value combined with the fold of all earlier segments
  (``running``); the fold runs over one pre-aggregated row per segment.

Positions are whole numbers that grow along a key; they may have holes. ``number_rows`` makes dense ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.session import ensure_checkpoints

SEG = "_seg"
HOME = "_home"
SEGMENT_ROWS = 16_384


def stored(df: DataFrame) -> DataFrame:
    """Checkpoints, and gives the columns an identity of their own so they can meet their source."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint().toDF(*df.columns)


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)


def _whole(keys: Sequence[str]):
    return (Window.partitionBy(*keys).orderBy(SEG)
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column,
                name: str = "frame_no") -> DataFrame:
    """Dense 0-based ordinal per key.

    ``bucket`` must not decrease along ``order``; rows are sorted inside (key, bucket) only and
    the counts of earlier buckets are added.
    """
    keys = list(keys)
    cut = df.withColumn("_bucket", bucket)
    counts = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (Window.partitionBy(*keys).orderBy("_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_bucket",
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (cut.join(offsets, keys + ["_bucket"])
            .withColumn(name, F.col("_offset") + F.row_number().over(local) - 1)
            .drop("_bucket", "_offset"))


def segment_of(position: str, rows: int = SEGMENT_ROWS) -> Column:
    return F.expr(f"`{position}` div {int(rows)}L")


def _lookers(df: DataFrame, keys: list[str], position: str, back: int, ahead: int) -> DataFrame:
    """Per (key, segment) the segments that look into it: ``_seen`` as (segment, from position, up to position).

    One row per segment that has rows: its number of positions and its outermost ones. Ordinals of whole segments then
    tell how many rows of the end of a segment another one sees, so numbers may have holes of any size.
    """
    order = Window.partitionBy(*keys).orderBy(SEG)
    if back <= 1 and ahead <= 1:  # the outermost rows, seen by the neighbours
        ends = df.groupBy(*keys, SEG).agg(F.min(position).alias("_low"), F.max(position).alias("_high"))
        nothing = F.lit(None).cast("bigint")
        sides = [F.struct(F.lead(SEG).over(order).alias("to"), F.col("_high").alias("low"), nothing.alias("high"))] if back else []
        sides += [F.struct(F.lag(SEG).over(order).alias("to"), nothing.alias("low"), F.col("_low").alias("high"))] if ahead else []
        return ends.select(*keys, SEG, F.filter(F.array(*sides), lambda t: t["to"].isNotNull()).alias("_seen"))
    positions = F.collect_set(position)
    ends = df.groupBy(*keys, SEG).agg(F.size(positions).alias("_n"), F.slice(F.sort_array(positions), 1, max(1, ahead)).alias("_first"),
                                      F.slice(F.sort_array(positions, asc=False), 1, max(1, back)).alias("_last"))
    ends = ends.withColumn("_start", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = ends.withColumn("_end", F.col("_start") + F.col("_n"))
    seen = []
    if back:
        later = F.collect_list(F.struct(F.col(SEG).alias("to"), F.col("_start").alias("start"))).over(order.rowsBetween(1, back))
        used = F.filter(later, lambda t: t["start"] < F.col("_end") + back)
        seen.append(F.transform(used, lambda t: F.struct(t["to"].alias("to"), F.element_at("_last", F.least(
            F.col("_n"), F.col("_end") + back - t["start"]).cast("int")).alias("low"), F.lit(None).cast("bigint").alias("high"))))
    if ahead:
        earlier = F.collect_list(F.struct(F.col(SEG).alias("to"), F.col("_end").alias("end"))).over(order.rowsBetween(-ahead, -1))
        used = F.filter(earlier, lambda t: F.col("_start") - t["end"] < ahead)
        seen.append(F.transform(used, lambda t: F.struct(t["to"].alias("to"), F.lit(None).cast("bigint").alias("low"), F.element_at(
            "_first", F.least(F.col("_n"), F.lit(ahead) - (F.col("_start") - t["end"])).cast("int")).alias("high"))))
    return ends.select(*keys, SEG, F.concat(*seen).alias("_seen"))


def with_halo(df: DataFrame, keys: Sequence[str], position: str = "frame_no", back: int = 0, ahead: int = 0,
              rows: int = SEGMENT_ROWS) -> DataFrame:
    """Puts each row in its own segment and in every segment whose rows look at it.

    ``back``/``ahead`` say how many rows a row looks at before/after itself, whatever their numbers are. Keep only
    rows with ``_home`` true after the window.
    """
    keys = list(keys)
    cut = df.withColumn(SEG, segment_of(position, rows))
    if not back and not ahead:
        return cut.withColumn(HOME, F.lit(True))
    lookers = _lookers(cut.select(*keys, SEG, F.col(position).cast("bigint").alias(position)), keys, position, back, ahead)
    inside = lambda t: F.coalesce(F.col(position) >= t["low"], F.col(position) <= t["high"])
    return (cut.join(lookers, keys + [SEG], "left").withColumn("_own", F.col(SEG))
            .withColumn(SEG, F.explode(F.concat(F.array("_own"), F.transform(F.filter(F.coalesce("_seen", F.array().cast(
                "array<struct<to:bigint,low:bigint,high:bigint>>")), inside), lambda t: t["to"]))))
            .withColumn(HOME, F.col(SEG) == F.col("_own")).drop("_own", "_seen"))


def keep_home(df: DataFrame) -> DataFrame:
    return df.where(HOME).drop(SEG, HOME)


def local_window(keys: Sequence[str], position: str = "frame_no"):
    return Window.partitionBy(*keys, SEG).orderBy(position)


def neighbours(df: DataFrame, keys: Sequence[str], position: str = "frame_no",
               lag: dict[str, str] | None = None, lead: dict[str, str] | None = None,
               rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds the previous (``lag``: new name -> column) and next (``lead``) row's values."""
    w = local_window(keys, position)
    out = with_halo(df, keys, position, back=1 if lag else 0, ahead=1 if lead else 0, rows=rows)
    for name, source in (lag or {}).items():
        out = out.withColumn(name, F.lag(source).over(w))
    for name, source in (lead or {}).items():
        out = out.withColumn(name, F.lead(source).over(w))
    return keep_home(out)


def attach(df: DataFrame, keys: Sequence[str], partials: Sequence[Column],
           derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Joins values derived from one pre-aggregated row per (key, segment) back to the rows.

    ``df`` already carries ``_seg``. ``derive`` gets the summary and returns keys, ``_seg`` and
    the new columns; windows over the summary see one row per segment.
    """
    keys = list(keys)
    summary = df.groupBy(*keys, SEG).agg(*partials)
    return df.join(derive(summary), keys + [SEG], "left")


def running(df: DataFrame, keys: Sequence[str], specs: dict[str, tuple],
            position: str = "frame_no", rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds running values over all rows of a key in position order.

    ``specs``: name -> (kind, column, inclusive). Kinds: ``max``, ``sum``, ``last`` (last
    non-null), ``first`` (first non-null). Exclusive values leave the current row out.
    """
    keys = list(keys)
    df = df.withColumn(SEG, segment_of(position, rows))
    partials, carried = [], []
    earlier = _before(keys)
    for name, (kind, column, _) in specs.items():
        part, carry = f"_p_{name}", f"_c_{name}"
        if kind == "max":
            partials.append(F.max(column).alias(part))
            carried.append(F.max(part).over(earlier).alias(carry))
        elif kind == "sum":
            partials.append(F.sum(column).alias(part))
            carried.append(F.sum(part).over(earlier).alias(carry))
        elif kind == "last":
            partials.append(F.max_by(column, F.when(column.isNotNull(), F.col(position))).alias(part))
            carried.append(F.last(part, ignorenulls=True).over(earlier).alias(carry))
        elif kind == "first":
            partials.append(F.min_by(column, F.when(column.isNotNull(), F.col(position))).alias(part))
            carried.append(F.first(part, ignorenulls=True).over(earlier).alias(carry))
        else:
            raise ValueError(f"unknown running kind {kind}")
    out = attach(df, keys, partials, lambda s: s.select(*keys, SEG, *carried))
    base = Window.partitionBy(*keys, SEG).orderBy(position)
    for name, (kind, column, inclusive) in specs.items():
        w = base.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        carry = F.col(f"_c_{name}")
        if kind == "max":
            value = F.greatest(F.max(column).over(w), carry)
        elif kind == "sum":
            value = F.coalesce(F.sum(column).over(w), F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif kind == "last":
            value = F.coalesce(F.last(column, ignorenulls=True).over(w), carry)
        else:
            value = F.coalesce(carry, F.first(column, ignorenulls=True).over(w))
        out = out.withColumn(name, value)
    return out.drop(SEG, *[f"_c_{name}" for name in specs])


def key_totals(df: DataFrame, keys: Sequence[str], totals: dict[str, tuple],
               position: str = "frame_no", rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds whole-key totals to every row without gathering the key: (kind, column) per name."""
    keys = list(keys)
    df = df.withColumn(SEG, segment_of(position, rows))
    w = _whole(keys)
    partials, derived = [], []
    for name, (kind, column) in totals.items():
        part = f"_p_{name}"
        if kind == "first":
            partials.append(F.min_by(column, F.when(column.isNotNull(), F.col(position))).alias(part))
            derived.append(F.first(part, ignorenulls=True).over(w).alias(name))
        else:
            fn = {"max": F.max, "min": F.min, "sum": F.sum}[kind]
            partials.append(fn(column).alias(part))
            derived.append(fn(part).over(w).alias(name))
    return attach(df, keys, partials, lambda s: s.select(*keys, SEG, *derived)).drop(SEG)


def explode_range(df: DataFrame, low: Column, high: Column, name: str,
                  chunk: int = 4096) -> DataFrame:
    """One row per integer in [low, high]; built in two levels so no array is longer than ``chunk``
    plus the number of chunks."""
    block = df.withColumn("_lo", low.cast("bigint")).withColumn("_hi", high.cast("bigint"))
    block = block.where("_hi >= _lo")
    block = block.withColumn("_start", F.explode(F.expr(f"sequence(_lo, _hi, {chunk}L)")))
    return (block.withColumn(name, F.explode(F.sequence(
        F.col("_start"), F.least(F.col("_hi"), F.col("_start") + (chunk - 1)))))
        .drop("_lo", "_hi", "_start"))


#: keys of up to so many rows are sorted as they are
SMALL_KEY = 4096
#: half the width, in ranks per row, of the bracket that a sketch puts around the median of a large key
BRACKET, SKETCH = 0.002, 10_000


def upper_median(df: DataFrame, keys: Sequence[str], columns: Sequence[str], small: int = SMALL_KEY) -> DataFrame:
    """Per key and column the element sorted[n div 2]; null and NaN count as 0.

    Keys are counted first. The values of a key of at most ``small`` rows are one small array per column. For larger keys one sketch per
    column brackets the median, one aggregate counts the rows below the bracket and keeps none of them, and only the few distinct values
    inside the bracket become rows. A bracket that misses its rank (a sketch promises its error only for most merges) is widened to
    everything, so the result is exact at every size. No group is gathered.
    """
    keys, columns = list(keys), list(columns)
    clean = df.select(*keys, *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns])
    sizes = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > small)
    upper = lambda c: F.sort_array(F.collect_list(c))[F.expr("CAST(count(1) div 2 AS INT)")].alias(c)
    if large.isEmpty():
        return clean.groupBy(*keys).agg(*[upper(c) for c in columns])
    few = clean.join(large.select(*keys), keys, "left_anti").groupBy(*keys).agg(*[upper(c) for c in columns])
    return few.unionByName(_large_medians(clean, keys, columns, stored(large)))


def _large_medians(clean: DataFrame, keys: list[str], columns: list[str], large: DataFrame) -> DataFrame:
    rows = clean.join(large, keys)
    ends = lambda c: F.percentile_approx(c, [0.5 - BRACKET, 0.5 + BRACKET], SKETCH).alias(f"_e_{c}")
    brackets = stored(rows.groupBy(*keys).agg(*[ends(c) for c in columns]))
    met = rows.join(brackets, keys)
    below = stored(met.groupBy(*keys).agg(*[F.count_if(F.col(c) < F.col(f"_e_{c}")[0]).alias(f"_b_{c}") for c in columns]))
    pair = lambda c: F.struct(F.lit(c).alias("_name"), F.col(c).alias("_value"), F.col(f"_e_{c}").alias("_ends"))
    inside = lambda p: (p["_value"] >= p["_ends"][0]) & (p["_value"] <= p["_ends"][1])
    group = [*keys, "_name"]
    held = (met.select(*keys, F.inline(F.filter(F.array(*[pair(c) for c in columns]), inside)))
            .groupBy(*group, "_value").agg(F.count(F.lit(1)).alias("_k")))
    offsets = below.join(large, keys).select(*keys, F.expr("_n div 2").alias("_rank"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("_name"), F.col(f"_b_{c}").alias("_below")) for c in columns])))
    picked = stored(_at_rank(held.join(offsets, group), group))
    missed = offsets.join(picked, group, "left_anti")
    if not missed.isEmpty():  # all distinct values of these columns, each counted before it is moved
        every = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).alias("_value")) for c in columns])))
        counted = every.join(missed.select(*group, "_rank"), group).groupBy(*group, "_rank", "_value").agg(F.count(F.lit(1)).alias("_k"))
        picked = picked.unionByName(_at_rank(counted.withColumn("_below", F.lit(0).cast("bigint")), group))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col("_value"))).alias(c) for c in columns])


def _at_rank(counted: DataFrame, group: list[str]) -> DataFrame:
    """The value at ``_rank`` of each group of distinct values with their counts ``_k``, of which ``_below`` rows come first."""
    upto = F.col("_below") + F.sum("_k").over(Window.partitionBy(*group).orderBy("_value"))
    return counted.withColumn("_upto", upto).where("_upto > _rank and _upto - _k <= _rank").select(*group, "_value")
