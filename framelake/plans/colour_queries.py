"""Registered colour and box queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import colour as co
from framelake.functions import geometry as ge
from framelake.functions import mathx as mx
from framelake.operators import boxes as bx
from framelake.operators import colour_ops as cop
from framelake.plans import bindings as b
from framelake.plans.plane_queries import rounded
from framelake.plans.registry import query
from framelake.sources.media_files import parse_cube

TONE = {"temperature": 0.4, "tint": 0.3, "lift": 0.02, "exposure": 0.5, "shadows": 0.4, "highlights": -0.3, "blacks": 0.2,
        "whites": -0.2, "dehaze": 0.3, "gamma": 1.2, "gain": 1.05, "contrast": 1.1, "brightness": 0.03, "saturation": 1.2,
        "vibrance": 0.4}


def c01(e):
    return f"greatest(0.0, least(1.0, {e}))"


def sst(lo, hi, v):
    t = c01(f"(({v}) - {lo}) / ({hi} - {lo})::DOUBLE")
    return f"({t} * {t} * (3 - 2 * {t}))"


def each(fmt):
    """One SQL projection per channel; {c} is the channel."""
    return ", ".join(fmt.format(c=c) + f" AS {c}" for c in "rgb")


LUMA = "(r * 0.2126 + g * 0.7152 + b * 0.0722)"
BYTE = "CAST(greatest(0, least(255, floor(({e}) * 255 + 0.5))) AS INT)"


@query("tone_map", b.sql("P", f"""t0 AS (SELECT sample_id, (r / 255 + 0.4 * 0.08 + 0.3 * 0.025 + 0.02) * pow(2, 0.5) AS r, (g / 255 - 0.3 * 0.05 + 0.02) * pow(2, 0.5) AS g, (b / 255 - 0.4 * 0.08 + 0.3 * 0.025 + 0.02) * pow(2, 0.5) AS b FROM P),
  t1 AS (SELECT *, {LUMA} AS l FROM t0),
  t2 AS (SELECT *, 0.4 * pow(1 - {c01('l')}, 2) * 0.28 - 0.3 * pow({c01('l')}, 2) * 0.24 + 0.2 * (1 - {sst(0.08, 0.38, 'l')}) * 0.16 - 0.2 * {sst(0.62, 0.94, 'l')} * 0.14 AS z FROM t1),
  t3 AS (SELECT sample_id, {each('({c} + z - 0.5) * (1 + 0.3 * 0.34) + 0.5')} FROM t2),
  t4 AS (SELECT *, {LUMA} AS l FROM t3), t5 AS (SELECT sample_id, {each('l + ({c} - l) * (1 + 0.3 * 0.18)')} FROM t4),
  t6 AS (SELECT sample_id, {each('(pow(' + c01('{c}') + ', 1 / 1.2) * 1.05 - 0.5) * 1.1 + 0.5 + 0.03')} FROM t5),
  t7 AS (SELECT *, {LUMA} AS l FROM t6), t8 AS (SELECT sample_id, l, {each('l + ({c} - l) * 1.2')} FROM t7),
  t9 AS (SELECT *, 1 + 0.4 * (1 - {c01('greatest(r, g, b) - least(r, g, b)')}) AS v FROM t8)
SELECT sample_id, {each(BYTE.format(e='l + ({c} - l) * v'))} FROM t9"""))
def tone_map(spark, sf_dir):
    return cop.tone_map(b.colour_samples(spark, sf_dir), TONE)


GRADE = {"tint": 0.5, "lift": 0.03, "gamma": 1.1, "gain": 1.05, "offset": -0.01, "hue_rotate": 30, "shadow_sat": 1.3, "mid_sat": 0.9,
         "highlight_sat": 1.1, "red_sat": 1.2, "green_sat": 0.8, "blue_sat": 1.4, "mixer": [1.1, -0.05, 0, 0, 0.9, 0.05, 0.1, 0, 1.0],
         "curves": {"luma": "0:0,0.5:0.45,1:1", "red": "0:0,0.25:0.3,1:1"}}


def curve_sql(v, points):
    x = c01(v)
    parts = " ".join(f"WHEN {x} < {x1} THEN {y0} + ({y1} - {y0})::DOUBLE * ({x} - {x0}) / ({x1} - {x0})::DOUBLE" for (x0, y0), (x1, y1) in zip(points, points[1:]))
    return f"(CASE {parts} ELSE {points[-1][1]} END)"


def band(v, left, centre, right):
    rise = "1.0" if centre == left else c01(f"({v} - {left}) / ({centre} - {left})::DOUBLE")
    fall = "1.0" if centre == right else c01(f"({right} - {v}) / ({right} - {centre})::DOUBLE")
    return f"(CASE WHEN {v} {'<=' if centre == left else '<'} {centre} THEN {rise} ELSE {fall} END)"


def hw(centre):
    return f"greatest(0.0, 1 - least(abs(h - {centre}), 1 - abs(h - {centre})) / 0.34)"


SECTORS = {"r": ["mx", "q", "p", "p", "t", "mx"], "g": ["t", "mx", "mx", "q", "p", "p"], "b": ["p", "p", "t", "mx", "mx", "q"]}


@query("color_grade", b.sql("P", f"""g0 AS (SELECT sample_id, {each(c01('pow(' + c01('{c} / 255 + s{c}') + ', 1 / 1.1) * 1.05 - 0.01'))} FROM
     (SELECT *, 0.03 + 0.5 * 0.055 * 0.45 AS sr, 0.03 - 0.5 * 0.055 AS sg, 0.03 + 0.5 * 0.055 * 0.45 AS sb FROM P)),
  g1 AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS d, {LUMA} AS y FROM g0),
  g2 AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN mx = r THEN ((g - b) / d) / 6 WHEN mx = g THEN ((b - r) / d + 2) / 6 ELSE ((r - g) / d + 4) / 6 END AS h0, CASE WHEN mx = 0 THEN 0 ELSE d / mx END AS s0 FROM g1),
  g3 AS (SELECT *, (CASE WHEN h0 < 0 THEN h0 + 1 ELSE h0 END + 30 / 360 + 1) % 1 AS h, {band('y', 0.0, 0.0, 0.45)} AS w1, {band('y', 0.15, 0.5, 0.85)} AS w2, {band('y', 0.55, 1.0, 1.0)} AS w3 FROM g2),
  g4 AS (SELECT *, {c01(f'''s0 * (1.3 * w1 + 0.9 * w2 + 1.1 * w3) / greatest(1e-6, w1 + w2 + w3)
     * (1.2 * {hw('0')} + 0.8 * {hw('(1 / 3)')} + 1.4 * {hw('(2 / 3)')}) / greatest(1e-6, {hw('0')} + {hw('(1 / 3)')} + {hw('(2 / 3)')})''')} AS s FROM g3),
  g5 AS (SELECT *, floor(h * 6) AS i, h * 6 - floor(h * 6) AS f FROM g4),
  g6 AS (SELECT *, mx * (1 - s) AS p, mx * (1 - f * s) AS q, mx * (1 - (1 - f) * s) AS t FROM g5),
  g7 AS (SELECT sample_id, {", ".join("CASE i % 6 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(vs)) + f" END AS {c}" for c, vs in SECTORS.items())} FROM g6),
  g8 AS (SELECT sample_id, r * 1.1 - g * 0.05 AS r, g * 0.9 + b * 0.05 AS g, r * 0.1 + b AS b FROM g7),
  g9 AS (SELECT *, {curve_sql(LUMA, [(0, 0), (0.5, 0.45), (1, 1)])} - {LUMA} AS dl FROM g8)
SELECT sample_id, {BYTE.format(e=curve_sql('r + dl', [(0, 0), (0.25, 0.3), (1, 1)]))} AS r, {BYTE.format(e=c01('g + dl'))} AS g, {BYTE.format(e=c01('b + dl'))} AS b FROM g9"""))
def color_grade(spark, sf_dir):
    return cop.color_grade(b.colour_samples(spark, sf_dir), GRADE)


@query("curve_apply", b.sql("P", f"SELECT sample_id, round({curve_sql('r / 255', [(0, 0.1), (0.2, 0.15), (0.7, 0.9), (1, 0.95)])}, 6) AS mapped FROM P"))
def curve_apply(spark, sf_dir):
    rows = b.colour_samples(spark, sf_dir).select("sample_id", (F.col("r") / 255).alias("value"))
    return rounded(cop.curve_apply(rows, "0:0.1,0.2:0.15,0.7:0.9,1:0.95").select("sample_id", "mapped"))


# Two tables derived from the nation keys: entry i of the 3d one and of the 1d one.
LUT_SQL = """n AS (SELECT n_nationkey AS k FROM nation),
  cube AS (SELECT k AS i, (k * 37 % 100) / 100 AS r, (k * 53 % 100) / 100 AS g, (k * 71 % 100) / 100 AS b FROM n WHERE k < 8),
  line AS (SELECT k AS i, k / 24 AS r, k * k / 576 AS g, (24 - k) / 24 AS b FROM n)"""


def _cube_texts(spark, sf_dir):
    """Both tables as .cube text, so that the reader is part of the path."""
    k = F.col("n_nationkey")
    number = lambda v: F.format_string("%.15f", v.cast("double"))
    nation = b.table(spark, sf_dir, "nation")
    line = lambda r, g, c: F.concat_ws(" ", number(r), number(g), number(c))
    cube = nation.where(k < 8).select(F.lit(0).alias("lut_id"), k.alias("i"), line(
        k * 37 % 100 / F.lit(100.0), k * 53 % 100 / F.lit(100.0), k * 71 % 100 / F.lit(100.0)).alias("t"))
    ramp = nation.select(F.lit(1).alias("lut_id"), k.alias("i"), line(k / F.lit(24.0), k * k / F.lit(576.0), (F.lit(24) - k) / F.lit(24.0)).alias("t"))
    body = cube.union(ramp).groupBy("lut_id").agg(F.concat_ws("\n", F.transform(
        F.array_sort(F.collect_list(F.struct("i", "t"))), lambda e: e["t"])).alias("body"))
    head = F.when(F.col("lut_id") == 0, 'TITLE "cube"\nLUT_3D_SIZE 2\n').otherwise("LUT_1D_SIZE 25\nDOMAIN_MAX 2 2 2 # wide\n")
    return body.select("lut_id", F.concat(head, F.col("body")).alias("text"))


def _luts(spark, sf_dir):
    return cop.lattice_rows_to_luts(*parse_cube(_cube_texts(spark, sf_dir)))


CORNER = "cube[CAST(((lb + bz) * 2 + lg + gy) * 2 + lr + rx + 1 AS INT)]"


@query("lut_apply", b.sql("P", LUT_SQL + f""",
  cl AS (SELECT list(struct_pack(r := r, g := g, b := b) ORDER BY i) AS cube FROM cube), ll AS (SELECT list(struct_pack(r := r, g := g, b := b) ORDER BY i) AS ln FROM line),
  sp AS (SELECT sample_id, row_number() OVER () AS rid, sample_id % 2 AS lut, {each('{c} / 255')} FROM P),
  c3 AS (SELECT any_value(sample_id) AS sample_id, any_value(sp.r) AS r0, any_value(sp.g) AS g0, any_value(sp.b) AS b0, {", ".join(
      f"sum((CASE WHEN rx = 1 THEN sp.r ELSE 1 - sp.r END) * (CASE WHEN gy = 1 THEN sp.g ELSE 1 - sp.g END) * (CASE WHEN bz = 1 THEN sp.b ELSE 1 - sp.b END) * cube[(bz * 2 + gy) * 2 + rx + 1].{c}) AS {c}" for c in "rgb")}
     FROM sp, cl, (SELECT unnest([0, 1]) AS rx), (SELECT unnest([0, 1]) AS gy), (SELECT unnest([0, 1]) AS bz) WHERE lut = 0 GROUP BY rid),
  c1 AS (SELECT sample_id, sp.r AS r0, sp.g AS g0, sp.b AS b0, {", ".join(
      f"ln[CAST(floor(sp.{c} / 2 * 24) AS INT) + 1].{c} + (ln[CAST(least(24, floor(sp.{c} / 2 * 24) + 1) AS INT) + 1].{c} - ln[CAST(floor(sp.{c} / 2 * 24) AS INT) + 1].{c}) * (sp.{c} / 2 * 24 - floor(sp.{c} / 2 * 24)) AS {c}" for c in "rgb")}
     FROM sp, ll WHERE lut = 1),
  al AS (SELECT * FROM c3 UNION ALL SELECT * FROM c1)
SELECT sample_id, {each('round({c}0 + (' + c01('{c}') + ' - {c}0) * 0.75, 9)')} FROM al"""))
def lut_apply(spark, sf_dir):
    rows = b.colour_samples(spark, sf_dir).select("sample_id", (F.col("sample_id") % 2).cast("int").alias("lut_id"),
                                                  *[(F.col(c) / 255).alias(c) for c in "rgb"])
    return rounded(cop.lut_apply(rows, _luts(spark, sf_dir), 0.75).select("sample_id", "r", "g", "b"), 9)


@query("colour_functions", b.sql("P", """h AS (SELECT *, CAST(r * 54 + g * 183 + b * 19 AS INT) >> 8 AS il, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b AS cb, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b AS cr,
   greatest(r, g, b) - least(r, g, b) AS d, greatest(r, g, b) AS mx FROM P)
SELECT sample_id, round(CAST(r * 0.2126 + g * 0.7152 + b * 0.0722 AS DOUBLE), 6) AS luma709, round(CAST(r * 0.299 + g * 0.587 + b * 0.114 AS DOUBLE), 6) AS luma601, il AS integer_luma,
  r > 95 AND g > 40 AND b > 20 AND d > 15 AND abs(r - g) > 15 AND r > g AND r > b AS skin_strict, r > 80 AND g > 30 AND b > 15 AND d > 12 AND r > g * 0.92 AND r > b AS skin_loose,
  r + g + b > 90 AND cb BETWEEN 72 AND 138 AND cr BETWEEN 126 AND 184 AS skin_chroma,
  round(CASE WHEN d = 0 THEN 0 ELSE ((CASE WHEN mx = r THEN (g - b) / d WHEN mx = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END) / 6 + 1) % 1 END, 6) AS hue,
  round(CAST((cb - 128) * 1.772 + r * 0.299 + g * 0.587 + b * 0.114 AS DOUBLE), 4) AS blue_back FROM h"""))
def colour_functions(spark, sf_dir):
    rgb = ("r", "g", "b")
    back = co.ycbcr_to_rgb(co.luma601(*rgb) / 255, co.chroma_blue(*rgb, centre=0.0) / 255 + 0.5, co.chroma_red(*rgb, centre=0.0) / 255 + 0.5)
    return b.colour_samples(spark, sf_dir).select(
        "sample_id", F.round(co.luma709(*rgb), 6).alias("luma709"), F.round(co.luma601(*rgb), 6).alias("luma601"),
        co.integer_luma(*rgb).alias("integer_luma"), co.skin_strict(*rgb).alias("skin_strict"), co.skin_loose(*rgb).alias("skin_loose"),
        co.skin_chroma(*rgb).alias("skin_chroma"), F.round(co.hue(*rgb), 6).alias("hue"), F.round(back["b"] * 255, 4).alias("blue_back"))


@query("math_functions", b.sql("P", """x AS (SELECT sample_id, r / 10 - 12.75 AS v, g / 255 AS u, r, g, b FROM P)
SELECT sample_id, floor(v + 0.5) AS js_round, greatest(-5.0::DOUBLE, least(5.0, v)) AS clamped, round(pow(10, v / 20), 6) AS gain, greatest(2.0::DOUBLE, floor(r / 2 + 0.5) * 2) AS even,
  round((greatest(0, least(1, (u - 0.2) / 0.5))) * (greatest(0, least(1, (u - 0.2) / 0.5))) * (3 - 2 * (greatest(0, least(1, (u - 0.2) / 0.5)))), 6) AS smooth, round(v + (g - v) * u, 6) AS mixed,
  round(sin(r * 12.9898::DOUBLE + g * 78.233::DOUBLE) * 43758.5453::DOUBLE - floor(sin(r * 12.9898::DOUBLE + g * 78.233::DOUBLE) * 43758.5453::DOUBLE), 4) AS noise FROM x"""))
def math_functions(spark, sf_dir):
    v, u = F.col("r") / 10 - 12.75, F.col("g") / 255
    return b.colour_samples(spark, sf_dir).select(
        "sample_id", mx.js_round(v).alias("js_round"), mx.clamp(v, -5, 5).alias("clamped"), F.round(mx.db_to_gain(v), 6).alias("gain"),
        mx.even_size("r").alias("even"), F.round(mx.smoothstep(0.2, 0.7, u), 6).alias("smooth"), F.round(mx.lerp(v, "g", u), 6).alias("mixed"),
        F.round(mx.hash_noise("r", "g"), 4).alias("noise"))


# ---- boxes --------------------------------------------------------------------------------

IOU = "(greatest(0, least({a}.x + {a}.width, {c}.x + {c}.width) - greatest({a}.x, {c}.x)) * greatest(0, least({a}.y + {a}.height, {c}.y + {c}.height) - greatest({a}.y, {c}.y)))"
RATIO = IOU + " / greatest({f}, {a}.width * {a}.height + {c}.width * {c}.height - " + IOU + ")"
NMS_SQL = f"""fr AS (SELECT clip_id, frame_no, list(struct_pack(x := x, y := y, width := width, height := height, score := score, box_no := box_no) ORDER BY score DESC, box_no) AS bs FROM B GROUP BY ALL),
  kp AS (SELECT clip_id, frame_no, list_reduce(bs, lambda a, x: CASE WHEN len(list_filter(a, lambda q: {RATIO.format(a='q', c='x', f='1e-6')} >= 0.3)) > 0 THEN a ELSE list_append(a, x) END,
    CAST([] AS STRUCT(x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, score DOUBLE, box_no BIGINT)[])) AS kept FROM fr)"""


@query("nms", b.sql("B", NMS_SQL + """, ex AS (SELECT clip_id, frame_no, unnest(kept[1:4]) AS k, unnest(range(len(kept[1:4]))) AS i FROM kp)
SELECT clip_id, frame_no, k.box_no AS box_no, CAST(i AS INT) AS rank, round(k.score, 6) AS score FROM ex"""))
def nms(spark, sf_dir):
    return rounded(bx.nms(b.boxes(spark, sf_dir), max_boxes=4).select("clip_id", "frame_no", "box_no", "rank", "score"))


@query("nms_unlimited", b.sql("B", NMS_SQL + """, ex AS (SELECT clip_id, frame_no, unnest(kept) AS k, unnest(range(len(kept))) AS i FROM kp)
SELECT clip_id, frame_no, k.box_no AS box_no, CAST(i AS INT) AS rank, round(k.score, 6) AS score FROM ex"""))
def nms_unlimited(spark, sf_dir):
    return rounded(bx.nms(b.boxes(spark, sf_dir), max_boxes=None).select("clip_id", "frame_no", "box_no", "rank", "score"))


@query("nms_crowded", b.sql("B", "B1 AS (SELECT * REPLACE (0::BIGINT AS frame_no) FROM B), " + NMS_SQL.replace(
    "score DESC, box_no)", "score DESC, box_no, x, y, width, height)").replace("FROM B GROUP", "FROM B1 GROUP") + """, ex AS (SELECT clip_id, frame_no, unnest(kept) AS k, unnest(range(len(kept))) AS i FROM kp)
SELECT clip_id, frame_no, k.box_no AS box_no, CAST(i AS INT) AS rank, round(k.score, 6) AS score FROM ex"""))
def nms_crowded(spark, sf_dir):
    """All boxes of a clip as one frame: frames of any size, dealt to a grid."""
    crowd = b.boxes(spark, sf_dir).withColumn("frame_no", F.lit(0).cast("bigint"))
    return rounded(bx.nms(crowd, max_boxes=None, crowded=64).select("clip_id", "frame_no", "box_no", "rank", "score"))


@query("top_boxes", b.sql("B", """r AS (SELECT clip_id, frame_no, box_no, row_number() OVER (PARTITION BY clip_id, frame_no ORDER BY width * height DESC, box_no) AS k FROM B)
SELECT clip_id, frame_no, box_no, CAST(k AS INT) AS rank FROM r WHERE k <= 2"""))
def top_boxes(spark, sf_dir):
    return bx.top_boxes(b.boxes(spark, sf_dir), 2).select("clip_id", "frame_no", "box_no", "rank")


@query("box_geometry", b.sql("B", f"""q AS (SELECT *, struct_pack(x := x, y := y, width := width, height := height) AS m, struct_pack(x := 60, y := 40, width := 120, height := 90) AS o FROM B)
SELECT clip_id, frame_no, box_no, round({RATIO.format(a='m', c='o', f='1')}, 6) AS overlap, greatest(0.0::DOUBLE, floor(x - width * 0.35 / 2)) AS ex, greatest(0.0::DOUBLE, floor(y - height * 0.35 / 2)) AS ey,
  least(320.0::DOUBLE, ceil(x + width + width * 0.35 / 2)) - greatest(0, floor(x - width * 0.35 / 2)) AS ew, least(240.0::DOUBLE, ceil(y + height + height * 0.35 / 2)) - greatest(0, floor(y - height * 0.35 / 2)) AS eh,
  round(CASE WHEN sqrt((width - 100) * (width - 100) + (height - 100) * (height - 100)) < 2 THEN 0 ELSE greatest(-35 * pi() / 180, least(35 * pi() / 180, atan2(height - 100, width - 100))) END, 6) AS roll FROM q"""))
def box_geometry(spark, sf_dir):
    box = F.struct("x", "y", "width", "height")
    other = F.struct(F.lit(60.0).alias("x"), F.lit(40.0).alias("y"), F.lit(120.0).alias("width"), F.lit(90.0).alias("height"))
    rows = b.boxes(spark, sf_dir).withColumn("e", ge.expand_box(box, 320, 240, 0.35))
    return rounded(rows.select("clip_id", "frame_no", "box_no", ge.iou(box, other, 1.0).alias("overlap"), F.col("e.x").alias("ex"), F.col("e.y").alias("ey"),
                               F.col("e.width").alias("ew"), F.col("e.height").alias("eh"),
                               ge.roll_radians(F.lit(100), F.lit(100), "width", "height").alias("roll")))


# Frame by frame: each old track in turn takes the best box that still waits (w) and goes on (o); the boxes that are left start tracks.
TRACK_SCORES = "list_transform(a.w, lambda q: " + RATIO.format(a="t", c="q", f="1") + ")"
TRACK_MIX = ", ".join(f"{c} := floor(t.{c} * 0.62::DOUBLE + a.w[i].{c} * (1 - 0.62::DOUBLE) + 0.5::DOUBLE)" for c in ("x", "y", "width", "height"))
TRACKS_SQL = b.sql("B", f"""fr AS MATERIALIZED (SELECT clip_id, frame_no, row_number() OVER (PARTITION BY clip_id ORDER BY frame_no) AS k, list(struct_pack(x := x::DOUBLE, y := y::DOUBLE,
    width := width::DOUBLE, height := height::DOUBLE, score := score::DOUBLE, track_id := frame_no || ':' || box_no) ORDER BY box_no) AS bs FROM B GROUP BY clip_id, frame_no),
  tr(clip_id, frame_no, k, tracks) AS (SELECT clip_id, frame_no, k, bs[1:4] FROM fr WHERE k = 1
    UNION ALL SELECT n.clip_id, n.frame_no, n.k, list_transform([list_reduce(CASE WHEN n.frame_no = p.frame_no + 1 THEN p.tracks ELSE p.tracks[1:0] END,
      lambda a, t: list_transform([list_transform([{TRACK_SCORES}], lambda s: CASE WHEN list_max(s) > 0 AND list_max(s) >= 0.08::DOUBLE THEN list_position(s, list_max(s)) END)[1]],
        lambda i: CASE WHEN i IS NULL THEN a ELSE struct_pack(w := list_concat(a.w[1:i - 1], a.w[i + 1:]),
          o := list_append(a.o, struct_pack({TRACK_MIX}, score := a.w[i].score, track_id := t.track_id))) END)[1],
      struct_pack(w := n.bs, o := n.bs[1:0]))], lambda e: list_concat(e.o, e.w)[1:4])[1]
    FROM tr p JOIN fr n ON n.clip_id = p.clip_id AND n.k = p.k + 1),
  ex AS (SELECT clip_id, frame_no, unnest(tracks) AS t, unnest(range(len(tracks))) AS i FROM tr)
SELECT clip_id, frame_no, CAST(i AS INT) AS track_no, t.track_id AS track_id, round(t.x, 6) AS x, round(t.y, 6) AS y, round(t.width, 6) AS width, round(t.height, 6) AS height,
  round(t.score, 6) AS score FROM ex""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("track_boxes", TRACKS_SQL)
def track_boxes(spark, sf_dir):
    out = bx.track_boxes(b.boxes(spark, sf_dir), max_tracks=4)
    return rounded(out.select("clip_id", "frame_no", "track_no", "track_id", "x", "y", "width", "height", "score"))


DECODE_SQL = """te AS (SELECT CAST(label AS BIGINT) AS clip_id, vec_id AS frame_no, [greatest(0.0, least(1.0, (CAST(x AS DOUBLE) + 0.6) / 1.2)) FOR x IN embedding] AS p FROM embeddings),
  ce AS (SELECT *, unnest(range(64)) AS i FROM te), sc AS (SELECT *, sqrt(p[i + 1] * p[64 - i]) AS score FROM ce),
  bo AS (SELECT clip_id, frame_no, i, score, (i % 8 + p[(i * 4) % 64 + 1]) * 8 AS cx, (i // 8 + p[(i * 4 + 1) % 64 + 1]) * 8 AS cy, exp(p[(i * 4 + 2) % 64 + 1]) * 8 AS w, exp(p[(i * 4 + 3) % 64 + 1]) * 8 AS h,
     (p[(i * 10) % 64 + 1] + i % 8) * 8 AS l0x, (p[(i * 10 + 9) % 64 + 1] + i // 8) * 8 AS l4y FROM sc WHERE score >= 0.6)"""


def _detector_outputs(spark, sf_dir):
    p = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x.cast("double") + 0.6) / 1.2)))
    rows = b.table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("clip_id"), F.col("vec_id").alias("frame_no"), p.alias("p"))
    cycle = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("p", i % 64))
    return rows.select("clip_id", "frame_no", F.lit(8).alias("stride"), F.col("p").alias("cls"), F.reverse("p").alias("obj"),
                       cycle(256).alias("bbox"), cycle(640).alias("kps"))


@query("decode_detections", b.sql("V", DECODE_SQL + """
SELECT clip_id, frame_no, CAST(8000000 + i AS BIGINT) AS box_no, round(cx - w / 2, 6) AS x, round(cy - h / 2, 6) AS y, round(w, 6) AS width, round(h, 6) AS height, round(score, 6) AS score,
  round(l0x, 6) AS first_x, round(l4y, 6) AS last_y FROM bo"""))
def decode_detections(spark, sf_dir):
    out = bx.decode_detections(_detector_outputs(spark, sf_dir), 0.6, 64, 64)
    return rounded(out.select("clip_id", "frame_no", "box_no", "x", "y", "width", "height", "score",
                              F.col("landmarks")[0]["x"].alias("first_x"), F.col("landmarks")[4]["y"].alias("last_y")))


@query("undo_letterbox", b.sql("V", DECODE_SQL + """,
  sz AS (SELECT *, 100 + clip_id * 20 AS sw, 90 AS sh FROM bo), k AS (SELECT *, least(64.0 / sw, 64.0 / sh)::DOUBLE AS s FROM sz), o AS (SELECT *, (64 - sw * s) / 2 AS ox, (64 - sh * s) / 2 AS oy FROM k),
  m AS (SELECT clip_id, frame_no, i, sw, sh, greatest(0, least(sw - 1, (cx - w / 2 - ox) / s)) AS x, greatest(0, least(sh - 1, (cy - h / 2 - oy) / s)) AS y, greatest(1, least(sw, w / s)) AS w, greatest(1, least(sh, h / s)) AS h FROM o)
SELECT clip_id, frame_no, CAST(8000000 + i AS BIGINT) AS box_no, round(x, 6) AS x, round(y, 6) AS y, round(least(w, sw - x), 6) AS width, round(least(h, sh - y), 6) AS height FROM m WHERE x + w > 0 AND y + h > 0"""))
def undo_letterbox(spark, sf_dir):
    found = bx.decode_detections(_detector_outputs(spark, sf_dir), 0.6, 64, 64)
    out = bx.undo_letterbox(found, F.lit(100) + F.col("clip_id") * 20, F.lit(90), 64, 64)
    return rounded(out.select("clip_id", "frame_no", "box_no", "x", "y", "width", "height"))


# Cells reach their neighbours step by step; a region is named by its first cell.
PROPOSALS_SQL = b.sql("V", """px AS (SELECT clip_id, frame_no, unnest(luma) AS v, unnest(range(64)) AS i FROM V),
  c AS (SELECT *, CASE WHEN v > 120 THEN least(255, v + 60) ELSE 10 END AS r, v AS g, greatest(0, v - 20) AS bl FROM px),
  cell AS MATERIALIZED (SELECT clip_id, frame_no, i, i % 8 AS x, i // 8 AS y FROM c WHERE r + g + bl > 90
    AND -0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * bl + 128 BETWEEN 72 AND 138
    AND 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * bl + 128 BETWEEN 126 AND 184),
  reach(clip_id, frame_no, i, x, y, root) AS (SELECT clip_id, frame_no, i, x, y, i FROM cell
    UNION SELECT n.clip_id, n.frame_no, n.i, n.x, n.y, r.root FROM reach r JOIN cell n
      ON n.clip_id = r.clip_id AND n.frame_no = r.frame_no AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1 AND n.i > r.root),
  named AS (SELECT clip_id, frame_no, i, x, y, min(root) AS root FROM reach GROUP BY ALL),
  reg AS (SELECT clip_id, frame_no, root + 1 AS box_no, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, CAST(count(*) AS INT) AS cells FROM named GROUP BY clip_id, frame_no, root),
  sc AS (SELECT *, (x1 - x0 + 1) * 80.0::DOUBLE AS w, (y1 - y0 + 1) * 80.0::DOUBLE AS h FROM reg WHERE cells >= 3 AND x1 > x0 AND y1 > y0),
  sd AS (SELECT *, greatest(w, h * 0.82::DOUBLE) * 1.65::DOUBLE AS s FROM sc),
  bx AS (SELECT *, x0 * 80 + w / 2 - s / 2 AS bx0, y0 * 80 + h / 2 - s * 0.48::DOUBLE AS by0 FROM sd),
  cl AS (SELECT clip_id, frame_no, box_no, cells, greatest(0.0, floor(bx0)) AS x, greatest(0.0, floor(by0)) AS y,
    least(640.0, ceil(bx0 + s)) - greatest(0.0, floor(bx0)) AS width, least(640.0, ceil(by0 + s)) - greatest(0.0, floor(by0)) AS height FROM bx),
  rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY clip_id, frame_no ORDER BY width * height DESC, box_no) AS INT) AS rank FROM cl WHERE width >= 51.2 AND height >= 51.2)
SELECT clip_id, frame_no, rank, cells, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height FROM rk WHERE rank <= 4""").replace(
    "WITH ", "WITH RECURSIVE ", 1)


@query("region_proposals", PROPOSALS_SQL)
def region_proposals(spark, sf_dir):
    planes = b.planes(spark, sf_dir).withColumns({
        "r": F.transform("luma", lambda v: F.least(F.lit(255), v + 60)), "g": F.col("luma"),
        "b": F.transform("luma", lambda v: F.greatest(F.lit(0), v - 20)), "width": F.lit(640), "height": F.lit(640)})
    planes = planes.withColumn("r", F.transform("luma", lambda v: F.when(v > 120, F.least(F.lit(255), v + 60)).otherwise(F.lit(10))))
    out = bx.region_proposals(planes, max_boxes=4, cell=1)
    return rounded(out.select("clip_id", "frame_no", "rank", "cells", "x", "y", "width", "height"))
