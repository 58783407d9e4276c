"""Registered session, cache, lineage and key queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import text as tx
from framelake.operators import storage as st
from framelake.plans import bindings as b
from framelake.plans.registry import query

STATES_SQL = """ss AS (SELECT session_id, owner, status, frames_written, bytes AS bytes_written,
    CASE WHEN session_id % 5 = 0 THEN bytes - 1 ELSE bytes END AS file_bytes, last_access_us AS updated_at_us FROM S)"""


def _sessions(spark, sf_dir):
    return b.sessions(spark, sf_dir).select(
        "session_id", "owner", "status", "frames_written", F.col("bytes").alias("bytes_written"),
        F.when(F.col("session_id") % 5 == 0, F.col("bytes") - 1).otherwise(F.col("bytes")).alias("file_bytes"),
        F.col("last_access_us").alias("updated_at_us"))


RESUMABLE_SQL = STATES_SQL + """,
  rk AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY updated_at_us DESC, session_id DESC) AS k FROM ss WHERE status = 'in_progress'),
  res AS (SELECT * EXCLUDE (k) FROM rk WHERE k = 1 AND file_bytes >= bytes_written)"""


@query("latest_resumable", b.sql("S", RESUMABLE_SQL + " SELECT * FROM res"))
def latest_resumable(spark, sf_dir):
    return st.latest_resumable(_sessions(spark, sf_dir))


@query("prunable_sessions", b.sql("S", STATES_SQL + """,
  c AS (SELECT session_id, row_number() OVER (PARTITION BY owner ORDER BY updated_at_us DESC, session_id DESC) AS k FROM ss WHERE status = 'completed')
SELECT ss.* FROM ss LEFT JOIN c ON ss.session_id = c.session_id WHERE status = 'aborted' OR (status = 'completed' AND k > 2)"""))
def prunable_sessions(spark, sf_dir):
    return st.prunable(_sessions(spark, sf_dir), 2)


@query("list_sessions", b.sql("S", STATES_SQL + """
SELECT session_id, status, updated_at_us FROM ss WHERE status IN ('completed', 'aborted') ORDER BY updated_at_us DESC, session_id DESC"""))
def list_sessions(spark, sf_dir):
    return st.list_sessions(_sessions(spark, sf_dir), ["completed", "aborted"]).select("session_id", "status", "updated_at_us")


@query("resume_remaining", b.sql("TS", RESUMABLE_SQL + """
SELECT T.clip_id, T.frame_no FROM T LEFT JOIN res ON T.clip_id = res.owner
WHERE T.frame_no >= coalesce(frames_written % 60, 0) AND NOT (T.event_id % 10 = 0)"""))
def resume_remaining(spark, sf_dir):
    frames = b.timelines(spark, sf_dir)
    done = frames.where("event_id % 10 = 0")
    sessions = _sessions(spark, sf_dir).withColumn("frames_written", F.col("frames_written") % 60)
    return st.resume_remaining(frames, sessions, done).select("clip_id", "frame_no")


CACHE_SQL = """ca AS (SELECT CAST(session_id AS VARCHAR) AS name, owner, bytes, last_access_us, last_access_us - 1000 AS created_at_us, pinned FROM S)"""


def _cache(spark, sf_dir):
    return b.sessions(spark, sf_dir).select(
        F.col("session_id").cast("string").alias("name"), "owner", "bytes", "last_access_us",
        (F.col("last_access_us") - 1000).alias("created_at_us"), "pinned")


@query("cache_usage", b.sql("S", "SELECT owner, count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes FROM S GROUP BY owner"))
def cache_usage(spark, sf_dir):
    return st.cache_usage(_cache(spark, sf_dir))


@query("retention_plan", b.sql("S", CACHE_SQL + f""",
  w AS (SELECT *, CAST(coalesce(sum(CASE WHEN pinned THEN 0 ELSE bytes END) OVER (PARTITION BY owner ORDER BY last_access_us, name
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_bytes, CAST(sum(bytes) OVER (PARTITION BY owner) AS BIGINT) AS total_bytes FROM ca)
SELECT name, owner, before_bytes, total_bytes, NOT pinned AND (total_bytes - before_bytes > {b.CACHE_BUDGET} OR 5000000 + before_bytes < 30000000) AS evict FROM w"""))
def retention_plan(spark, sf_dir):
    out = st.retention_plan(_cache(spark, sf_dir), b.CACHE_BUDGET, free=5_000_000, reserve=30_000_000)
    return out.select("name", "owner", "before_bytes", "total_bytes", "evict")


@query("cache_budget", b.sql("S", """q AS (SELECT session_id, CASE WHEN session_id % 3 = 0 THEN NULL ELSE bytes * 400 END AS quota, CASE WHEN session_id % 7 = 0 THEN bytes * 20 END AS mx FROM S)
SELECT session_id, CAST(greatest(268435456, CASE WHEN mx > 0 THEN mx WHEN quota > 0 THEN greatest(536870912, least(4294967296, CAST(floor(quota * 0.38::DOUBLE) AS BIGINT))) ELSE 4294967296 END) AS BIGINT) AS budget_bytes,
  CAST(CASE WHEN quota > 0 THEN greatest(536870912, CAST(floor(quota * 0.08::DOUBLE) AS BIGINT)) ELSE 536870912 END AS BIGINT) AS reserve_bytes FROM q"""))
def cache_budget(spark, sf_dir):
    rows = b.sessions(spark, sf_dir).select(
        "session_id", F.when(F.col("session_id") % 3 != 0, F.col("bytes") * 400).alias("quota"),
        F.when(F.col("session_id") % 7 == 0, F.col("bytes") * 20).alias("mx"))
    return rows.select("session_id", st.cache_budget(F.col("quota"), F.col("mx")).alias("budget_bytes"),
                       st.cache_reserve(F.col("quota")).alias("reserve_bytes"))


@query("pin_diff", b.sql("S", CACHE_SQL + """, wa AS (SELECT name FROM ca WHERE CAST(name AS BIGINT) % 10 = 0)
SELECT name, CASE WHEN pinned THEN 'unpin' ELSE 'pin' END AS action FROM ca WHERE pinned <> (name IN (SELECT name FROM wa))"""))
def pin_diff(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    wanted = cache.where(F.col("name").cast("bigint") % 10 == 0)
    return st.pin_diff(cache, wanted).select("name", "action")


@query("session_state", b.sql("S", """ev AS (SELECT session_id, k AS seq, CASE WHEN k = 0 THEN 'begin' WHEN k = 3 AND status = 'completed' THEN 'finalize' WHEN k = 4 AND status = 'aborted' THEN 'abort' ELSE 'append' END AS action,
    CASE WHEN (session_id + k) % 3 = 0 THEN 'stage' || k END AS stage, (session_id * (k + 1) % 150) / 100 AS progress, frames_written * k AS fw, CASE WHEN k % 2 = 0 THEN bytes + k END AS bw, last_access_us + k AS ts
    FROM S, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k)),
  en AS (SELECT session_id, min(seq) AS es, arg_min(action, seq) AS ea FROM ev WHERE action IN ('finalize', 'abort') GROUP BY session_id),
  lv AS (SELECT ev.*, ea FROM ev LEFT JOIN en ON ev.session_id = en.session_id WHERE es IS NULL OR seq <= es),
  ag AS (SELECT session_id, arg_max(stage, seq) FILTER (stage IS NOT NULL) AS sg, max(least(1.0, progress)) AS pr, max(fw) AS frames_written, max(bw) AS bytes_written, min(ts) AS started_us, max(ts) AS updated_us, any_value(ea) AS ea FROM lv GROUP BY session_id)
SELECT session_id, CASE ea WHEN 'finalize' THEN 'completed' WHEN 'abort' THEN 'aborted' ELSE 'in_progress' END AS status, CASE WHEN ea = 'finalize' THEN 'completed' ELSE coalesce(sg, 'initializing') END AS stage,
  CAST(CASE WHEN ea = 'finalize' THEN 1.0 ELSE pr END AS DOUBLE) AS progress, frames_written, bytes_written, started_us, updated_us FROM ag"""))
def session_state(spark, sf_dir):
    rows = b.sessions(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    k, i = F.col("k"), F.col("session_id")
    action = (F.when(k == 0, "begin").when((k == 3) & (F.col("status") == "completed"), "finalize")
              .when((k == 4) & (F.col("status") == "aborted"), "abort").otherwise("append"))
    events = rows.select(
        "session_id", k.alias("seq"), action.alias("action"), F.when((i + k) % 3 == 0, F.concat(F.lit("stage"), k)).alias("stage"),
        (i * (k + 1) % 150 / F.lit(100.0)).alias("progress"), (F.col("frames_written") * k).alias("frames_written"),
        F.when(k % 2 == 0, F.col("bytes") + k).alias("bytes_written"), (F.col("last_access_us") + k).alias("ts_us"))
    return st.session_state(events)


# ---- artifacts and keys -------------------------------------------------------------------

@query("verify_artifacts", b.sql("D", """v AS (SELECT *, CASE WHEN artifact_id % 17 = 0 THEN size_bytes + 1 ELSE size_bytes END AS reg, CASE WHEN artifact_id % 5 = 0 THEN size_bytes + artifact_id * 3 ELSE 0 END AS pin FROM D),
  w AS (SELECT artifact_id, coalesce(expected_sha256 = actual_sha256, true) AS valid_hash, size_bytes = reg AND (pin = 0 OR abs(size_bytes - pin) <= greatest(1024, pin * 0.02)) AS valid_size, expected_sha256 FROM v)
SELECT artifact_id, valid_hash, valid_size, valid_hash AND valid_size AS verified, CASE WHEN expected_sha256 IS NULL THEN 'custom-runtime-required' ELSE 'catalog-hash' END AS verification_class,
  CASE WHEN NOT valid_size THEN 'size-mismatch' WHEN NOT valid_hash THEN 'hash-mismatch' END AS failure FROM w"""))
def verify_artifacts(spark, sf_dir):
    files = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), F.encode("text", "utf-8").alias("content"))
    known = b.artifacts(spark, sf_dir)
    i, size = F.col("artifact_id"), F.col("size_bytes")
    manifest = known.select("artifact_id", F.when(i % 17 == 0, size + 1).otherwise(size).alias("registered_size"),
                            F.when(i % 5 == 0, size + i * 3).otherwise(F.lit(0)).alias("pinned_size"), "expected_sha256")
    return st.verify_artifacts(files, manifest).select(
        "artifact_id", "valid_hash", "valid_size", "verified", "verification_class", "failure")


def _node_keys(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents")
    settings = F.create_map(F.lit("text"), F.col("text"), F.lit("lang"), F.col("lang"), F.lit("a b"), F.lit('q"\\'))
    return docs.select("doc_id", tx.stable_json(settings).alias("settings"), tx.node_key(
        F.concat(F.lit("parent-"), F.col("doc_id") % 7), "source", settings,
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.create_map(F.lit("fps"), F.lit("30"))).alias("node_key"))


NODE_SQL = """js AS (SELECT *, '{"a b":' || CAST(to_json('q"\\') AS VARCHAR) || ',"lang":' || CAST(to_json(lang) AS VARCHAR) || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}' AS settings FROM documents),
  nk AS (SELECT doc_id, settings, sha256('["node",1,"parent-' || (doc_id % 7) || '",' || CAST(to_json(source) AS VARCHAR) || ','
    || CASE WHEN doc_id % 2 = 0 THEN CAST(to_json(lang) AS VARCHAR) ELSE 'null' END || ',' || settings || ',{"fps":"30"}]') AS node_key FROM js)"""


@query("node_key", b.sql("D", NODE_SQL + " SELECT doc_id, sha256(settings) AS settings_sha256, node_key FROM nk"))
def node_key(spark, sf_dir):
    return _node_keys(spark, sf_dir).select("doc_id", F.sha2("settings", 256).alias("settings_sha256"), "node_key")


@query("cache_hit", b.sql("D", NODE_SQL + """, no AS (SELECT node_key, max(octets) AS o FROM (SELECT node_key, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 10 + doc_id END AS octets FROM nk WHERE doc_id % 3 <> 0) GROUP BY node_key)
SELECT doc_id, o IS NOT NULL AS hit, o AS cached_bytes FROM nk LEFT JOIN (SELECT * FROM no WHERE o > 0) s ON nk.node_key = s.node_key"""))
def cache_hit(spark, sf_dir):
    keys = _node_keys(spark, sf_dir).select("doc_id", "node_key")
    nodes = keys.where("doc_id % 3 <> 0").select("node_key", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("doc_id") + 10).alias("bytes"))
    return st.cache_hit(keys, nodes).select("doc_id", "hit", "cached_bytes")


@query("work_items", b.sql("D", NODE_SQL + """
SELECT doc_id FROM nk WHERE node_key NOT IN (SELECT node_key FROM nk WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0)"""))
def work_items(spark, sf_dir):
    keys = _node_keys(spark, sf_dir).select("doc_id", "node_key")
    nodes = keys.where("doc_id % 3 <> 0").select("node_key", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("doc_id") + 10).alias("bytes"))
    return st.work_items(keys, nodes).select("doc_id")


@query("apply_stage", b.sql("D", """x AS (SELECT 1) SELECT doc_id, CAST(n_chars * 2 AS BIGINT) AS value, false AS hit FROM documents
UNION ALL SELECT doc_id, CAST(n_chars AS BIGINT), true FROM documents"""))
def apply_stage(spark, sf_dir):
    """A stage that runs, and again with its node materialised: the stored result is read."""
    docs = b.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("bigint").alias("value"))
    run = lambda nodes: st.apply_stage(docs, "root", "double", {"factor": "2"}, lambda d: d.withColumn("value", F.col("value") * 2), nodes,
                                       lambda key: docs)
    none = spark.createDataFrame([], "node_key string, bytes bigint")
    fresh, key, missed = run(none)
    stored, _, hit = run(spark.createDataFrame([(key, 10)], "node_key string, bytes bigint"))
    return fresh.withColumn("hit", F.lit(missed)).unionByName(stored.withColumn("hit", F.lit(hit)))


@query("source_key", b.sql("D", """x AS (SELECT doc_id, encode(text) AS c, lang, n_chars FROM documents)
SELECT doc_id, sha256('["source",1,"' || sha256(c) || '",' || octet_length(c) || ',' || CAST(to_json(lang) AS VARCHAR) || ',"text",' || n_chars || ']') AS source_key FROM x"""))
def source_key(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents").withColumn("content", F.encode("text", "utf-8"))
    return docs.select("doc_id", tx.source_key("content", "lang", "n_chars", F.lit("text")).alias("source_key"))


@query("sanitize_name", b.sql("D", r"""x AS (SELECT 1) SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}._-]+', '_', 'g') AS safe FROM documents"""))
def sanitize_name(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", tx.sanitize_name("text").alias("safe"))


@query("stage_file_name", b.sql("D", r"""x AS (SELECT doc_id, lang, regexp_replace(coalesce(c_name, ''), '[^\p{L}\p{N}._-]+', '_', 'g') AS stem
    FROM documents LEFT JOIN customer ON doc_id = c_custkey)
SELECT doc_id, CASE WHEN stem = '' THEN 'video' ELSE stem END || '_' || lang || '.mp4' AS name FROM x"""))
def stage_file_name(spark, sf_dir):
    """Documents without a customer of their number have no source name."""
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "lang")
    names = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    rows = docs.join(names, "doc_id", "left")
    return rows.select("doc_id", tx.stage_file_name("lang", F.concat("c_name", F.lit("."), "lang")).alias("name"))


@query("readable_sizes", b.sql("S", """x AS (SELECT session_id, CASE WHEN session_id % 2 = 0 THEN bytes // 100 ELSE bytes * 3 END AS v, CAST(floor(bytes / 10000 + 0.5) AS BIGINT) AS d FROM S)
SELECT session_id, CASE WHEN v < 1048576 THEN printf('%.1f', floor(v / 1024 * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(v / 1048576 * 10 + 0.5) / 10) || ' MB' END AS size_text,
  CASE WHEN d >= 3600 THEN (d // 3600) || ' h ' || (d % 3600 // 60) || ' min' WHEN d >= 60 THEN (d // 60) || ' min ' || (d % 60) || ' s' ELSE d || ' s' END AS duration_text FROM x"""))
def readable_sizes(spark, sf_dir):
    size = F.when(F.col("session_id") % 2 == 0, F.expr("bytes div 100")).otherwise(F.col("bytes") * 3)
    return b.sessions(spark, sf_dir).select("session_id", tx.format_bytes(size).alias("size_text"),
                                            tx.format_duration(F.col("bytes") / 10000).alias("duration_text"))


STACK_SQL = """ev AS (SELECT clip_id AS session_id, frame_no, CASE kind WHEN 'view' THEN 'restore' WHEN 'click' THEN 'detail' WHEN 'purchase' THEN 'color' WHEN 'error' THEN '<undo>' ELSE '<rewind>' END AS op FROM T),
  ls AS (SELECT session_id, max(frame_no) AS last_seq, list(op ORDER BY frame_no) AS ops FROM ev GROUP BY session_id),
  rd AS (SELECT session_id, last_seq, list_reduce(ops, lambda a, x: CASE WHEN x = '<undo>' THEN a[1:len(a) - 1] WHEN x = '<rewind>' THEN CASE WHEN list_contains(a, 'detail') THEN a[1:list_position(a, 'detail') - 1] ELSE a END
     ELSE list_append(a, x) END, []::VARCHAR[]) AS stack FROM ls)"""


def _lineage_events(spark, sf_dir):
    kind = F.col("kind")
    action = F.when(kind == "error", "undo").when(kind == "signup", "rewind").otherwise("apply")
    stage = F.when(kind == "view", "restore").when(kind == "purchase", "color").otherwise("detail")
    return b.timelines(spark, sf_dir).select(F.col("clip_id").alias("session_id"), F.col("frame_no").alias("seq"),
                                             action.alias("action"), stage.alias("stage_id"))


@query("lineage_entries", b.sql("T", STACK_SQL + """
SELECT session_id, unnest(range(len(stack))) AS level, unnest(stack) AS stage_id FROM rd"""))
def lineage_entries(spark, sf_dir):
    return st.lineage_entries(_lineage_events(spark, sf_dir))


@query("lineage_stack", b.sql("T", STACK_SQL + " SELECT session_id, last_seq, array_to_string(stack, ',') AS stack, CAST(len(stack) AS INT) AS depth FROM rd"))
def lineage_stack(spark, sf_dir):
    return st.lineage_stack(_lineage_events(spark, sf_dir)).withColumn("stack", F.concat_ws(",", "stack"))
