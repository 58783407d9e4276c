"""Registered re-timing and tile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import retime as rt
from framelake.operators import tiles as ti
from framelake.plans import bindings as b
from framelake.plans.registry import query

GRID_US = 21_600_000_000  # six hours
OUT_US = 86_400_000_000   # one day per shutter tick
IN_US = b.NOMINAL_STEP_US

RESAMPLE_SQL = f"""n AS (SELECT clip_id, frame_no, pts_us, dur_us,
    lead(pts_us) OVER (PARTITION BY clip_id ORDER BY frame_no) AS nx,
    first_value(pts_us) OVER (PARTITION BY clip_id ORDER BY frame_no) AS f FROM T),
  span AS (SELECT clip_id, min(pts_us) AS f, max(pts_us + dur_us) AS e FROM T GROUP BY clip_id),
  grid AS (SELECT clip_id, unnest(range(0, CAST((e - f) // {GRID_US} + 2 AS BIGINT))) AS k FROM span),
  g AS (SELECT grid.clip_id, k, span.f + k * CAST({GRID_US} AS DOUBLE) AS tau FROM grid JOIN span USING (clip_id)),
  hit AS (SELECT g.clip_id, k, tau, n.frame_no, n.pts_us, n.nx, n.dur_us FROM g ASOF JOIN n
    ON g.clip_id = n.clip_id AND g.tau + 0.5 >= n.pts_us),
  inner_ticks AS (SELECT *, greatest(0.0, least(1.0, (tau - pts_us) / greatest(1, nx - pts_us))) AS t FROM hit WHERE nx IS NOT NULL),
  last_ticks AS (SELECT clip_id, min(k) AS k, min(tau) AS tau, any_value(frame_no) AS frame_no, any_value(pts_us) AS pts_us,
    any_value(dur_us) AS dur_us FROM hit WHERE nx IS NULL GROUP BY clip_id)"""


@query("resample_cfr", b.sql("T", RESAMPLE_SQL + f"""
SELECT clip_id, k AS tick_no, CAST(floor(tau + 0.5) AS BIGINT) AS pts_us,
  CASE WHEN t < 0.5 THEN frame_no ELSE frame_no + 1 END AS source_no, round(t, 6) AS t, false AS generated,
  CAST({GRID_US} AS BIGINT) AS dur_us FROM inner_ticks
UNION ALL
SELECT clip_id, k, CAST(floor(greatest(tau, pts_us) + 0.5) AS BIGINT), frame_no, 0.0, false, CAST({GRID_US} AS BIGINT)
FROM last_ticks WHERE tau <= pts_us + dur_us"""))
def resample_cfr(spark, sf_dir):
    return rt.resample_cfr(b.timelines(spark, sf_dir), step_us=GRID_US).withColumn("t", F.round("t", 6))


@query("interpolation_plan", b.sql("T", """g AS (SELECT clip_id, frame_no, unnest([0, 1, 2, 3]) AS slot,
    lead(frame_no) OVER (PARTITION BY clip_id ORDER BY frame_no) AS nx FROM T)
SELECT clip_id, frame_no * 4 + slot AS out_no, CASE WHEN slot = 0 THEN 'source' ELSE 'generated' END AS type,
  frame_no AS source_no, slot / 4 AS t FROM g WHERE slot = 0 OR nx IS NOT NULL"""))
def interpolation_plan(spark, sf_dir):
    return rt.interpolation_plan(b.timelines(spark, sf_dir), 4)


@query("union_outputs", b.sql("T", """n AS (SELECT clip_id, frame_no, pts_us, event_id,
    lead(pts_us) OVER (PARTITION BY clip_id ORDER BY frame_no) AS nx FROM T)
SELECT clip_id, pts_us, event_id, false AS generated FROM n
UNION ALL SELECT clip_id, (pts_us + nx) // 2, NULL, true FROM n WHERE nx IS NOT NULL"""))
def union_outputs(spark, sf_dir):
    from framelake.operators.ordered import neighbours
    frames = b.timelines(spark, sf_dir)
    middle = (neighbours(frames.select("clip_id", "frame_no", "pts_us"), ["clip_id"], lead={"nx": "pts_us"})
              .where("nx is not null").select("clip_id", F.expr("(pts_us + nx) div 2").alias("pts_us")))
    return rt.union_outputs(frames.select("clip_id", "pts_us", "event_id"), middle)


# A scene is the run between two 'signup' rows; every third row counts as a duplicate.
SHUTTER_SQL = f"""s AS (SELECT clip_id, frame_no, pts_us, CAST(dur_us * 8 AS DOUBLE) AS dur, event_id % 3 = 0 AS dup,
    sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_no) AS scene_id FROM T),
  p AS (SELECT *, pts_us + dur AS e, max(pts_us + dur) OVER (PARTITION BY clip_id, scene_id ORDER BY frame_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM s),
  sc AS (SELECT clip_id, scene_id, min(pts_us) AS o, max(e) AS le FROM p GROUP BY ALL),
  lim AS (SELECT clip_id, scene_id, o, coalesce(lead(o) OVER (PARTITION BY clip_id ORDER BY scene_id), le) AS l FROM sc),
  ticks AS (SELECT clip_id, scene_id, o, l, unnest(range(0, CAST(greatest(0, ceil((l - 0.5 - o) / {OUT_US})) AS BIGINT))) AS tick_no FROM lim),
  cand AS (SELECT t.clip_id, t.scene_id, t.tick_no, o + tick_no * CAST({OUT_US} AS BIGINT) AS tick_us, p.frame_no, p.pts_us, p.dup,
      row_number() OVER (PARTITION BY t.clip_id, t.scene_id, t.tick_no ORDER BY p.frame_no DESC) AS rk
    FROM ticks t JOIN p ON t.clip_id = p.clip_id AND t.scene_id = p.scene_id
     AND p.pts_us < o + (tick_no + 1) * {OUT_US} + 0.5
     AND p.e > o + (tick_no + 1) * {OUT_US} - 2 * {IN_US} - 0.5
     AND (p.prev_end IS NULL OR p.prev_end < o + (tick_no + 1) * {OUT_US} - 0.5)),
  top AS (SELECT *, sum(CASE WHEN dup THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id, scene_id, tick_no) AS u FROM cand WHERE rk <= 2),
  w AS (SELECT clip_id, CAST(scene_id AS BIGINT) AS scene_id, tick_no, tick_us, frame_no,
     CAST(row_number() OVER (PARTITION BY clip_id, scene_id, tick_no ORDER BY frame_no) - 1 AS INT) AS pos,
     CAST(count(*) OVER (PARTITION BY clip_id, scene_id, tick_no) AS INT) AS n
     FROM top WHERE NOT dup OR (u = 0 AND rk = 1))"""


def _shutter(spark, sf_dir):
    from framelake.operators.ordered import running
    frames = b.timelines(spark, sf_dir)
    frames = running(frames, ["clip_id"], {
        "scene_id": ("sum", F.when(F.col("kind") == "signup", 1).otherwise(0), True)})
    frames = frames.withColumn("dur_us", F.col("dur_us") * 8).withColumn("dup", F.col("event_id") % 3 == 0)
    return rt.shutter_window(frames, IN_US, OUT_US, amount=1.0, scene="scene_id", duplicate="dup",
                             duplicate_method="nearest")


@query("shutter_window", b.sql("T", SHUTTER_SQL + " SELECT * FROM w"))
def shutter_window(spark, sf_dir):
    return _shutter(spark, sf_dir)


WEIGHTS_SQL = """k AS (SELECT clip_id, frame_no // 7 AS tick_no, frame_no % 7 AS pos, count(*) OVER (PARTITION BY clip_id, frame_no // 7) AS n FROM T)"""


def _weight_windows(spark, sf_dir):
    frames = b.timelines(spark, sf_dir).select(
        "clip_id", F.expr("frame_no div 7").alias("tick_no"), (F.col("frame_no") % 7).alias("pos"))
    size = frames.groupBy("clip_id", "tick_no").agg(F.count(F.lit(1)).alias("n"))
    return frames.join(size, ["clip_id", "tick_no"])


def _weights(spark, sf_dir, method, **options):
    out = rt.window_weights(_weight_windows(spark, sf_dir), method, keys=("clip_id", "tick_no"), **options)
    return out.select("clip_id", "tick_no", "pos", F.round("weight", 6).alias("weight"))


def _weight_sql(raw: str) -> str:
    return b.sql("T", WEIGHTS_SQL + f""", raw AS (SELECT clip_id, tick_no, pos, n, {raw} AS v FROM k),
  s AS (SELECT *, min(v) OVER (PARTITION BY clip_id, tick_no) AS lo FROM raw),
  z AS (SELECT *, greatest(0, CASE WHEN lo < 0 THEN v - lo + 1 ELSE v END) AS p FROM s)
SELECT clip_id, tick_no, pos, round(p / sum(p) OVER (PARTITION BY clip_id, tick_no), 6) AS weight FROM z""")


GAUSS = "exp(-pow(({x}) - {m}, 2) / 2.0)"
SPREAD = "CASE WHEN n = 1 THEN {s} ELSE {s} + {at} * ({e} - ({s})) / (n - 1) END"
WEIGHT_RAW = {
    "equal": "1.0",
    "ascending": "CAST(pos + 1 AS DOUBLE)",
    "descending": "CAST(n - pos AS DOUBLE)",
    "pyramid": "(n - 1) / 2 - abs(pos - (n - 1) / 2) + 1",
    "vegas": "CASE WHEN n % 2 = 1 OR pos = 0 OR pos = n - 1 THEN 1.0 ELSE 2.0 END",
    "gaussian": GAUSS.format(x=SPREAD.format(s="-2.0", e="2.0", at="pos"), m="0.5"),
    "gaussian_sym": GAUSS.format(x=SPREAD.format(s="-2.0", e="2.0", at="pos"), m="0.0"),
    "gaussian_reverse": GAUSS.format(x=SPREAD.format(s="-1.0", e="2.0", at="(n - 1 - pos)"), m="0.0"),
    "custom": """(SELECT c[CAST(l AS INT) + 1] + (c[CAST(least(2, l + 1) AS INT) + 1] - c[CAST(l AS INT) + 1]) * (a - l)
      FROM (SELECT a, floor(a) AS l, [1.0, -2.0, 1.5] AS c FROM (SELECT CASE WHEN n = 1 THEN 0 ELSE pos * 2 / (n - 1) END AS a)))""",
}
WEIGHT_OPTIONS = {"gaussian": {"mean": 0.5}, "gaussian_reverse": {"bound": (-1.0, 2.0)},
                  "custom": {"custom": [1.0, -2.0, 1.5]}}

for _method, _raw in WEIGHT_RAW.items():
    query(f"window_weights_{_method}", _weight_sql(_raw))(
        lambda spark, sf_dir, m=_method: _weights(spark, sf_dir, m, **WEIGHT_OPTIONS.get(m, {})))


@query("weighted_window_blend", b.sql("V", """f AS (SELECT clip_id, frame_no, frame_no // 5 AS tick_no, frame_no % 5 AS pos,
    count(*) OVER (PARTITION BY clip_id, frame_no // 5) AS n, luma FROM V),
  w AS (SELECT *, (pos + 1) / sum(pos + 1) OVER (PARTITION BY clip_id, tick_no) AS weight FROM f),
  x AS (SELECT clip_id, tick_no, i, sum(pow(luma[i + 1] / 255.0, 2.2) * weight) AS s
        FROM w, (SELECT unnest(range(64)) AS i) GROUP BY ALL)
SELECT clip_id, tick_no, string_agg(CAST(greatest(0, least(255, floor(pow(greatest(0, least(1, s)), 1 / 2.2) * 255 + 0.5))) AS INT), ',' ORDER BY i) AS luma
FROM x GROUP BY clip_id, tick_no"""))
def weighted_window_blend(spark, sf_dir):
    planes = b.planes(spark, sf_dir)
    windows = planes.select("clip_id", "frame_no", F.expr("frame_no div 5").alias("tick_no"),
                            (F.col("frame_no") % 5).alias("pos"), F.col("frame_no").alias("tick_us"))
    size = windows.groupBy("clip_id", "tick_no").agg(F.count(F.lit(1)).alias("n"))
    keys = ("clip_id", "tick_no")
    windows = rt.window_weights(windows.join(size, list(keys)), "ascending", keys=keys)
    out = rt.weighted_window_blend(windows, planes, gamma=2.2, keys=keys)
    return out.select("clip_id", "tick_no", F.concat_ws(",", F.col("luma").cast("array<string>")).alias("luma"))


LAYOUT_SQL = """g AS (SELECT clip_id, width, height,
    unnest(range(0, CAST(greatest(0, ceil((height - 1280) / 1216.0)) AS BIGINT) + 1)) * 1216 AS tile_y FROM C),
  h AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((width - 1280) / 1216.0)) AS BIGINT) + 1)) * 1216 AS tile_x FROM g)"""


@query("tile_layout", b.sql("C", LAYOUT_SQL + """
SELECT clip_id, CAST(tile_x AS INT) AS tile_x, CAST(tile_y AS INT) AS tile_y,
  CAST(least(1280, width - tile_x) AS INT) AS tile_w, CAST(least(1280, height - tile_y) AS INT) AS tile_h FROM h"""))
def tile_layout(spark, sf_dir):
    return (ti.tile_layout(b.clips(spark, sf_dir).select("clip_id", "width", "height"), 1280, 64)
            .select("clip_id", "tile_x", "tile_y", "tile_w", "tile_h"))


@query("tile_merge", b.sql("V", """SELECT clip_id, frame_no, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y,
  CAST(1.0 AS DOUBLE) AS weight, CAST(luma[i + 1] AS DOUBLE) AS value FROM V, (SELECT unnest(range(64)) AS i)"""))
def tile_merge(spark, sf_dir):
    """Cut, leave unchanged, merge: every cell comes back with total weight one."""
    tiles = ti.cut_tiles(b.planes(spark, sf_dir), 6, 2)
    out = ti.tile_merge(tiles, 2, width="pw", height="ph")
    return out.select("clip_id", "frame_no", "x", "y", F.round("weight", 6).alias("weight"),
                      F.round("value", 6).alias("value"))


@query("map_tiles", b.sql("V", """SELECT clip_id, frame_no, CAST(i % 16 AS INT) AS x, CAST(i // 16 AS INT) AS y,
  CAST(255 - luma[((i // 16) // 2) * 8 + (i % 16) // 2 + 1] AS DOUBLE) AS value FROM V, (SELECT unnest(range(256)) AS i)"""))
def map_tiles(spark, sf_dir):
    """A two-fold pixel-doubling negative run tile by tile, then merged."""
    import numpy as np

    def model(tile):
        return 255 - np.kron(tile, np.ones((2, 2)))

    tiles = ti.map_tiles(ti.cut_tiles(b.planes(spark, sf_dir).drop("vec_id"), 6, 2), model, scale=2)
    out = ti.tile_merge(tiles, 2, scale=2, width="pw", height="ph")
    return out.select("clip_id", "frame_no", "x", "y", F.round("value", 6).alias("value"))


@query("peak_bytes", b.sql("C", """SELECT clip_id, CAST(CAST(width AS DOUBLE) * height * s * s * 4
   + (256.0 * 256 * 4 + 256.0 * 256 * 4 * s * s) * 2 AS BIGINT) AS peak_bytes
FROM (SELECT *, 1 + clip_id % 4 AS s FROM C)"""))
def peak_bytes(spark, sf_dir):
    jobs = b.clips(spark, sf_dir).withColumn("scale", F.lit(1) + F.col("clip_id") % 4)
    return ti.peak_bytes(jobs, tile=256, batch=2).select("clip_id", "peak_bytes")
