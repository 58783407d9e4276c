"""Sessions, stage caches, lineage and resume."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.text import node_key
from framelake.operators import scans, stacks
from framelake.operators.ordered import SEG, SEGMENT_ROWS, key_totals, number_rows, running, segment_of

DAY_US = 86_400_000_000
MIB = 1024 * 1024

# Cache budget defaults in bytes (fixed values).
MIN_BUDGET = 256 * MIB
MIN_CAP = 512 * MIB


# ---- sessions -----------------------------------------------------------------------------

TERMINAL = ("completed", "aborted")


def session_state(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Latest record per session from patches (seq, action, stage, progress, frames_written,
    bytes_written, ts_us): last non-null fields, largest counters, first terminal action wins.

    Patches after the terminal action are ignored. Two combinable aggregates, no per-session sort.
    """
    ends = events.where(F.col("action").isin("finalize", "abort")).groupBy(key).agg(
        F.min_by("action", "seq").alias("_end_action"), F.min("seq").alias("_end_seq"))
    live = events.join(ends, key, "left").where(F.col("_end_seq").isNull() | (F.col("seq") <= F.col("_end_seq")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    out = live.groupBy(key).agg(
        last("stage").alias("_stage"), F.max(F.least(F.lit(1.0), F.col("progress"))).alias("_progress"),
        F.max("frames_written").alias("frames_written"), F.max("bytes_written").alias("bytes_written"),
        F.min("ts_us").alias("started_us"), F.max("ts_us").alias("updated_us"), F.first("_end_action").alias("_end"))
    done = F.coalesce(F.col("_end") == "finalize", F.lit(False))
    return out.select(
        key, F.when(done, "completed").when(F.col("_end") == "abort", "aborted").otherwise("in_progress").alias("status"),
        F.when(done, "completed").otherwise(F.coalesce("_stage", F.lit("initializing"))).alias("stage"),
        F.when(done, 1.0).otherwise(F.coalesce("_progress", F.lit(0.0))).alias("progress"),
        F.coalesce("frames_written", F.lit(0)).alias("frames_written"),
        F.coalesce("bytes_written", F.lit(0)).alias("bytes_written"), "started_us", "updated_us")


def latest_resumable(sessions: DataFrame, owner: str = "owner") -> DataFrame:
    """Newest in-progress session per owner; none when its file is smaller than the claimed bytes."""
    rest = [c for c in sessions.columns if c != owner]
    newest = (sessions.where(F.col("status") == "in_progress").groupBy(owner)
              .agg(F.max_by(F.struct(*rest), F.struct("updated_at_us", "session_id")).alias("_s")))
    return newest.select(owner, "_s.*").where(F.col("file_bytes") >= F.col("bytes_written"))


def prunable(sessions: DataFrame, keep_completed: int = 0, owner: str = "owner") -> DataFrame:
    """Aborted sessions and completed ones beyond the newest ``keep_completed`` per owner.

    The kept rows are a top-k (pruned before the shuffle); the rest is an anti join on the id.
    """
    terminal = sessions.where(F.col("status").isin(*TERMINAL))
    if keep_completed <= 0:
        return terminal
    newest = Window.partitionBy(owner).orderBy(F.col("updated_at_us").desc(), F.col("session_id").desc())
    kept = (terminal.where(F.col("status") == "completed").select(owner, "session_id", "updated_at_us")
            .withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= keep_completed).select("session_id"))
    return terminal.join(kept, "session_id", "left_anti")


def list_sessions(sessions: DataFrame, statuses=None) -> DataFrame:
    """Sessions of the given statuses, newest first."""
    out = sessions if statuses is None else sessions.where(F.col("status").isin(*statuses))
    return out.orderBy(F.col("updated_at_us").desc(), F.col("session_id").desc())


def resume_remaining(frames: DataFrame, sessions: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Frames still to do: those from the latest resumable session's frame count on, all frames of
    clips without one, minus a ledger of finished frames."""
    at = latest_resumable(sessions).select(F.col("owner").alias("clip_id"), F.col("frames_written").alias("_from"))
    out = frames.join(at, "clip_id", "left").where(F.col("frame_no") >= F.coalesce("_from", F.lit(0))).drop("_from")
    if done is not None:
        out = out.join(done.select("clip_id", "frame_no"), ["clip_id", "frame_no"], "left_anti")
    return out


# ---- stage cache --------------------------------------------------------------------------

def cache_usage(cache: DataFrame, owner: str = "owner") -> DataFrame:
    return cache.groupBy(owner).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def cache_budget(quota: Column, max_bytes: Column | None = None, default_cap: int = 4096 * MIB) -> Column:
    """Budget from a quota: 38 % of it within [512 MiB, default], at least 256 MiB; an explicit
    maximum replaces the quota rule."""
    cap = F.when(quota > 0, F.greatest(F.lit(MIN_CAP), F.least(F.lit(default_cap), F.floor(quota * 0.38)))).otherwise(F.lit(default_cap))
    wanted = cap if max_bytes is None else F.when(F.coalesce(max_bytes, F.lit(0)) > 0, max_bytes).otherwise(cap)
    return F.greatest(F.lit(MIN_BUDGET), wanted).cast("bigint")


def cache_reserve(quota: Column, minimum: int = 512 * MIB) -> Column:
    """Free space to keep: 8 % of the quota, at least the minimum."""
    return F.when(quota > 0, F.greatest(F.lit(minimum), F.floor(quota * 0.08))).otherwise(F.lit(minimum)).cast("bigint")


def retention_plan(cache: DataFrame, budget, free=None, reserve=0, owner: str = "owner", protected: DataFrame | None = None,
                   rows: int = SEGMENT_ROWS) -> DataFrame:
    """Least-recently-used eviction per owner: unpinned and unprotected entries, oldest access first,
    until the total fits the budget and the free space reaches the reserve.

    Evicting in order only lowers both pressures, so an entry goes exactly when the bytes of the
    candidates before it did not suffice. ``free`` null means unlimited. Adds evict, before_bytes.
    """
    number = lambda v: F.lit(None).cast("bigint") if v is None else v if isinstance(v, Column) else F.lit(v)
    out = cache.withColumn("_access", F.coalesce(F.when(F.col("last_access_us") != 0, F.col("last_access_us")),
                                                 F.col("created_at_us") if "created_at_us" in cache.columns else F.lit(0)))
    out = out.withColumn("_free", number(free)).withColumn("_candidate", ~F.coalesce(F.col("pinned"), F.lit(False)))
    if protected is not None:
        marks = protected.select("name").distinct().withColumn("_keep", F.lit(True))
        out = out.join(marks, "name", "left").withColumn("_candidate", F.col("_candidate") & F.col("_keep").isNull()).drop("_keep")
    out = number_rows(out, [owner], ["_access", "name"], F.floor(F.col("_access") / DAY_US), "_pos")
    out = running(out, [owner], {"before_bytes": ("sum", F.when(F.col("_candidate"), F.col("bytes")).otherwise(0), False)}, "_pos", rows)
    out = key_totals(out, [owner], {"total_bytes": ("sum", F.col("bytes"))}, "_pos", rows)
    tight = F.col("total_bytes") - F.col("before_bytes") > number(budget)
    low = F.coalesce(F.col("_free") + F.col("before_bytes") < number(reserve), F.lit(False))
    return out.withColumn("evict", F.col("_candidate") & (tight | low)).drop("_access", "_free", "_candidate", "_pos")


def pin_diff(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries whose pin flag must change: wanted and unpinned ones, pinned and unwanted ones."""
    names = wanted.select("name").where(F.col("name").isNotNull()).distinct()
    pinned = F.coalesce(F.col("pinned"), F.lit(False))
    to_pin = cache.where(~pinned).join(names, "name", "left_semi").withColumn("action", F.lit("pin"))
    to_unpin = cache.where(pinned).join(names, "name", "left_anti").withColumn("action", F.lit("unpin"))
    return to_pin.unionByName(to_unpin)


def cache_hit(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``hit``: the same node key is materialised and not empty."""
    stored = nodes.where(F.col("bytes") > 0).groupBy("node_key").agg(F.max("bytes").alias("cached_bytes"))
    return (requests.join(stored, "node_key", "left").withColumn("hit", F.col("cached_bytes").isNotNull()))


def work_items(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requests that still need computing."""
    return requests.join(nodes.where(F.col("bytes") > 0).select("node_key"), "node_key", "left_anti")


def verify_artifacts(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Size and hash of each file against its manifest row, with class, verdict and reason.

    ``files`` has artifact_id with ``content`` (hashed here) or actual_sha256 and size_bytes.
    """
    out = files
    if "content" in files.columns:
        out = (out.withColumn("actual_sha256", F.sha2("content", 256))
               .withColumn("size_bytes", F.octet_length("content").cast("bigint")).drop("content"))
    if manifest is not None:
        out = out.join(manifest, "artifact_id", "left")
    expected = F.lower(F.coalesce(F.col("expected_sha256"), F.lit("")))
    pinned = F.col("pinned_size")
    near = F.abs(F.col("size_bytes") - pinned) <= F.greatest(F.lit(1024.0), pinned * 0.02)
    unpinned = F.coalesce(pinned, F.lit(0)) == 0
    out = (out.withColumn("valid_hash", (expected == "") | (F.col("actual_sha256") == expected))
           .withColumn("valid_size", F.coalesce(F.col("size_bytes") == F.col("registered_size"), F.lit(False)) & (unpinned | near)))
    return (out.withColumn("verified", F.col("valid_hash") & F.col("valid_size"))
            .withColumn("verification_class", F.when(expected != "", "catalog-hash").otherwise("custom-runtime-required"))
            .withColumn("failure", F.when(~F.col("valid_size"), "size-mismatch").when(~F.col("valid_hash"), "hash-mismatch")))


# ---- lineage ------------------------------------------------------------------------------

LINEAGE_ROWS = 4096


def lineage_entries(events: DataFrame, rows: int = LINEAGE_ROWS, fan: int = scans.FAN) -> DataFrame:
    """Entries of each session's stack of applied stages: ``level`` from 0, ``stage_id``.

    Events are apply, adopt, rewind (cuts the stack at the first entry of its stage), undo and clear; others change nothing. A segment is
    summed up as its effect on any stack, effects are composed over the segments before (see ``stacks``, ``scans``), and each segment then
    gives those of its own entries that no later segment reaches down to. So a stack of any height comes from many tasks.
    """
    steps = events.select("session_id", "seq", "action", "stage_id").withColumn(SEG, segment_of("seq", rows))
    group = ["session_id", SEG]

    def rows_of(batches):
        for batch in batches:
            yield list(zip(batch.column("action").to_pylist(), batch.column("stage_id").to_pylist()))

    def summarise(batches, prefix):
        whole = None
        for part in rows_of(batches):
            one = stacks.effect(part)
            whole = one if whole is None else stacks.then(whole, one)
        return stacks.packed(whole)

    maps = scans.summaries(steps, group, ["seq"], summarise)
    before = scans.prefixes(maps, ["session_id"], stacks.compose, fan)

    def landed(batches):
        for batch in batches:
            kept, start = [], []
            for prefix, own in zip(batch.column(scans.PREFIX).to_pylist(), batch.column(scans.MAP).to_pylist()):
                _, height, first = stacks.land(stacks.read(prefix), 0, {}) if prefix else (0, 0, {})
                kept.append(stacks.land(stacks.read(own), height, first)[0])
                start.append(json.dumps([height, list(first.items())]))
            yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column(SEG), pa.array(kept, pa.int64()), pa.array(start)],
                                             ["session_id", SEG, "_kept", "_start"])

    key = dict(steps.dtypes)["session_id"]
    met = maps.join(before, group, "left").select(*group, scans.PREFIX, scans.MAP).mapInArrow(
        landed, f"session_id {key}, {SEG} bigint, _kept bigint, _start string")
    later = Window.partitionBy("session_id").orderBy(F.col(SEG).desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = met.select(*group, F.concat_ws("|", F.coalesce(F.min("_kept").over(later), F.lit(stacks.ALL)), "_start").cast("binary").alias(scans.PREFIX))

    def walk(batches, prefix):
        limit, _, start = prefix.decode().partition("|")
        below, first = json.loads(start)
        first = {s: i for s, i in first}
        tail, session = stacks.Tail(), None
        for batch in batches:
            session = batch.column("session_id").slice(0, 1)
            for action, stage in zip(batch.column("action").to_pylist(), batch.column("stage_id").to_pylist()):
                if action in ("apply", "adopt"):
                    tail.push(stage)
                elif action == "undo" and tail.entries:
                    tail.cut(len(tail.entries) - 1)
                elif action == "undo":
                    below = max(0, below - 1)
                elif action == "clear":
                    tail, below = stacks.Tail(), 0
                elif action == "rewind" and first.get(stage, below) < below:
                    tail, below = stacks.Tail(), first[stage]
                elif action == "rewind" and tail.find(stage) is not None:
                    tail.cut(tail.find(stage))
        stays = tail.entries[:max(0, int(limit) - below)]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([session] * len(stays)) if stays else session.slice(1),
                                          pa.array(range(below, below + len(stays)), pa.int64()), pa.array(stays, pa.string())],
                                         ["session_id", "level", "stage_id"])

    return scans.fold_segments(steps, starts, group, ["seq"], walk, f"session_id {key}, level bigint, stage_id string")


def lineage_stack(events: DataFrame, rows: int = LINEAGE_ROWS, fan: int = scans.FAN) -> DataFrame:
    """Current stack of applied stages per session as one array, with its depth and the session's last event; see ``lineage_entries``."""
    last = events.groupBy("session_id").agg(F.max("seq").alias("last_seq"))
    whole = lineage_entries(events, rows, fan).groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", "stage_id"))), lambda e: e["stage_id"]).alias("stack"))
    return (last.join(whole, "session_id", "left").withColumn("stack", F.coalesce("stack", F.array().cast("array<string>")))
            .withColumn("depth", F.size("stack")))


def apply_stage(df: DataFrame, parent_key: str, stage_id: str, settings: dict[str, str], fn, nodes: DataFrame,
                read_cached, model_sha256: str | None = None, metadata: dict[str, str] | None = None):
    """Runs a named stage unless its node is already materialised.

    Returns (result, node_key, hit). ``fn`` maps a DataFrame; ``read_cached(node_key)`` reads a
    stored result. Looking the key up is one small query on the node table.
    """
    spark = df.sparkSession
    as_map = lambda d: (F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.lit(None).cast("map<string,string>"))
    key = spark.range(1).select(node_key(F.lit(parent_key), F.lit(stage_id), as_map(settings), F.lit(model_sha256),
                                         as_map(metadata)).alias("k")).first()["k"]
    hit = not nodes.where((F.col("node_key") == key) & (F.col("bytes") > 0)).isEmpty()
    return (read_cached(key) if hit else df.transform(fn)), key, hit
