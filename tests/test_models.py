"""Operators without a SQL check against plain sequential models on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import audio, boxes, motion, retime, storage
from framelake.plans import bindings as b


def test_filter_chain_per_sample(spark, small):
    blocks = b.audio_blocks(spark, small)
    got = {(r.clip_id, r.block_no): r.samples for r in audio.audio_filter_chain(blocks, gate_db=-20, rows=16).collect()}
    rate, hp, lp = 64.0, 70.0, 16000.0
    a = 1 / (1 + 2 * math.pi * hp / rate)
    k = 1 - math.exp(-2 * math.pi * min(lp, rate * .48) / rate)
    attack, release = 1 - math.exp(-1 / (rate * .006)), 1 - math.exp(-1 / (rate * .09))
    state = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.clip_id, r.block_no)):
        last, high, low, gate = state.get(r.clip_id, (0.0, 0.0, 0.0, 1.0))
        want = []
        for x in r.samples:
            high = a * (high + x - last)
            last = x
            low += k * (high - low)
            target = 1 if abs(low) >= 10 ** (-20 / 20) else 1 - .18
            gate += (target - gate) * (attack if target > gate else release)
            want.append(low * gate)
        state[r.clip_id] = (last, high, low, gate)
        assert got[r.clip_id, r.block_no] == pytest.approx(want, abs=1e-9)


def test_noise_gate_per_sample(spark, small):
    blocks = b.audio_blocks(spark, small)
    got = {(r.clip_id, r.block_no): r.samples for r in audio.noise_gate(blocks, -20, attack_ms=40, rows=16).collect()}
    envelope = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.clip_id, r.block_no)):
        e, want = envelope.get(r.clip_id, 1.0), []
        for x in r.samples:
            target = 1 if abs(x) >= 0.1 else 0
            e += (target - e) / (3 if target else 5)
            want.append(x * e)
        envelope[r.clip_id] = e
        assert got[r.clip_id, r.block_no] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("run", [
    lambda blocks, n: audio.noise_gate(blocks, -40, release_ms=100, rows=n),
    lambda blocks, n: audio.audio_filter_chain(blocks, gate_db=-30, noise_reduction=1, rows=n)])
def test_state_is_carried_over_any_number_of_short_blocks(spark, run):
    """A loud start, then silence: the tail is all state, and must not depend on where a segment begins."""
    rng = random.Random(3)
    data = [(1, i, 1000, 1, [rng.uniform(-1, 1) if i < 3 else rng.uniform(-1e-3, 1e-3) for _ in range(16 if i % 7 else 3)] if i % 50 else [])
            for i in range(1200)]
    blocks = spark.createDataFrame(data, "clip_id bigint, block_no bigint, rate int, channels int, samples array<double>")
    whole = {r.block_no: r.samples for r in run(blocks, 10**6).collect()}
    parts = {r.block_no: r.samples for r in run(blocks, 250).collect()}
    assert set(whole) == set(parts) == set(range(1200))
    for k, samples in whole.items():
        assert parts[k] == pytest.approx(samples, rel=1e-9, abs=1e-18)


def test_noise_gate_with_instant_attack(spark, small):
    out = audio.noise_gate(b.audio_blocks(spark, small), -20).where("clip_id = 0 and block_no = 0").first()
    assert len(out.samples) == 64 and all(math.isfinite(v) for v in out.samples)


def test_channels_split_and_join(spark):
    df = spark.createDataFrame([(1, 0, 8, 2, [1.0, 10.0, 2.0, 20.0, 3.0, 30.0])],
                               "clip_id bigint, block_no bigint, rate int, channels int, samples array<double>")
    parts = audio.split_channels(df)
    assert {r.channel: r.samples for r in parts.collect()} == {0: [1.0, 2.0, 3.0], 1: [10.0, 20.0, 30.0]}
    assert audio.join_channels(parts).first().samples == [1.0, 10.0, 2.0, 20.0, 3.0, 30.0]


@pytest.mark.parametrize("align", [False, True])
def test_history_blend_sequential(spark, small, align):
    fields = motion.motion_field(b.planes(spark, small), block=1, radius=1, vectors=False)
    fields = fields.withColumn("cut", F.col("frame_no") % 13 == 12)
    got = {(r.clip_id, r.frame_no): r.blended for r in motion.history_blend(fields, 1.0, align=align, cut="cut", rows=8).collect()}
    history = {}
    for r in sorted(fields.collect(), key=lambda r: (r.clip_id, r.frame_no)):
        kept = [] if r.cut else history.get(r.clip_id, [])
        plane = np.array(r.luma, float).reshape(8, 8)
        gate = max(0, 1 - r.motion / max(.5, 4 * .75))
        base = min(.32, 1.0 * .28 * gate * r.confidence)
        if r.ready and not r.cut and kept and r.confidence > .12 and base > .002:
            for i, old in enumerate(kept):
                age, out = len(kept) - i, plane.copy()
                dx = math.floor(r.global_dx * age + .5) if align else 0
                dy = math.floor(r.global_dy * age + .5) if align else 0
                for y in range(8):
                    for x in range(8):
                        if 0 <= y - dy < 8 and 0 <= x - dx < 8:
                            out[y, x] = plane[y, x] * (1 - base / age) + old[y - dy, x - dx] * base / age
                plane = out
        history[r.clip_id] = (kept + [plane])[-3:]
        assert got[r.clip_id, r.frame_no] == pytest.approx(plane.ravel().tolist(), abs=1e-9)


def overlap(a, c, floor):
    w = min(a[0] + a[2], c[0] + c[2]) - max(a[0], c[0])
    h = min(a[1] + a[3], c[1] + c[3]) - max(a[1], c[1])
    common = max(0, w) * max(0, h)
    return common / max(floor, a[2] * a[3] + c[2] * c[3] - common)


@pytest.mark.parametrize("every", [1, 2])
def test_track_boxes_sequential(spark, every):
    rng = random.Random(3)
    data, centre = [], {i: [rng.uniform(0, 300), rng.uniform(0, 200)] for i in range(3)}
    for frame in [f for f in range(60) if f not in (20, 21)]:
        for i in centre:
            centre[i] = [v + rng.uniform(-6, 6) for v in centre[i]]
            if rng.random() < .9:
                data.append((1, frame, i, *centre[i], 50.0 + i, 40.0, rng.random()))
    df = spark.createDataFrame(data, "clip_id bigint, frame_no bigint, box_no bigint, x double, y double, width double, height double, score double")
    got = {}
    for r in boxes.track_boxes(df, every=every, rows=9).collect():
        got.setdefault(r.frame_no, {})[r.track_no] = (r.x, r.y, r.width, r.height)
    tracks, last = [], None
    for frame in sorted({d[1] for d in data}):
        found = [d[3:7] for d in data if d[1] == frame]
        if last is not None and frame != last + 1:
            tracks = []
        if not (tracks and every == 2 and frame % 2):
            out, waiting = [], list(found)
            for old in tracks:
                best, score = -1, 0
                for i, new in enumerate(waiting):
                    s = overlap(old, new, 1)
                    if s > score:
                        best, score = i, s
                if best < 0 or score < .08:
                    continue
                new = waiting.pop(best)
                out.append(tuple(math.floor(o * .62 + n * (1 - .62) + .5) for o, n in zip(old, new)))
            tracks = (out + waiting)[:4]
        last = frame
        assert got.get(frame, {}) == {i: pytest.approx(t) for i, t in enumerate(tracks)}


@pytest.mark.parametrize("maximum", [4, 2, None])
def test_nms_sequential(spark, maximum):
    rng = random.Random(8)
    data = [(1, frame, i, rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(20, 60), rng.uniform(20, 60), rng.choice([.1, .5, .5, .9]))
            for frame in range(12) for i in range(rng.randint(1, 14))]
    df = spark.createDataFrame(data, "clip_id bigint, frame_no bigint, box_no bigint, x double, y double, width double, height double, score double")
    got = {}
    for r in boxes.nms(df, .3, maximum).collect():
        got.setdefault(r.frame_no, {})[r.rank] = r.box_no
    for frame in range(12):
        rest = sorted((d for d in data if d[1] == frame), key=lambda d: (-d[7], d[2]))
        kept = []
        while rest and (maximum is None or len(kept) < maximum):
            kept.append(rest.pop(0))
            rest = [d for d in rest if overlap(kept[-1][3:7], d[3:7], 1e-6) < .3]
        assert got[frame] == {i: d[2] for i, d in enumerate(kept)}


def test_tracks_are_handed_on_from_the_last_gap(spark, monkeypatch):
    """The rows before a segment's last missing frame are folded once, not in every round."""
    from framelake.operators import chained
    data = [(1, f, b, 9. * b, 5., 10., 10., .5) for f in range(100) if f % 17 for b in range(3)]
    df = spark.createDataFrame(data, "clip_id bigint, frame_no bigint, box_no bigint, x double, y double, width double, height double, score double")
    seen = []
    real = chained._settled
    monkeypatch.setattr(chained, "_settled", lambda cut, *a: seen.append(cut.count()) or real(cut, *a))
    cut = sorted(map(str, boxes.track_boxes(df, rows=25).collect()))
    assert cut == sorted(map(str, boxes.track_boxes(df).collect()))
    assert len(seen) == 1 and seen[0] < len(data) / 2


@pytest.mark.parametrize("threshold,maximum,front", [(.3, None, 3), (.55, 40, 64)])
def test_nms_of_a_crowded_frame(spark, threshold, maximum, front):
    """Boxes of all sizes, equal rows, flat ones and a long chain: dealt to a grid they give the rows of the fold, and of a plain loop."""
    rng = random.Random(11)
    size = lambda: rng.choice([.5, 3, 20, 64, 300]) * rng.uniform(.8, 1.3)
    data = [(1, 0, i, rng.uniform(-200, 600), rng.uniform(-200, 600), size(), size(), rng.choice([.2, .5, .5, .9])) for i in range(700)]
    data += [(1, 0, 5000 + i, 1000. + 8 * i, 0., 16., 16., 1 - i / 100) for i in range(60)]
    data += [(1, 0, 9, 5., 5., 0., 10., .7), (1, 0, 9, 5., 5., -4., 10., .7), *[(1, 0, 9000, 7., 7., 30., 30., .95)] * 3]
    data += [(2, 0, i, float(i), 0., 9., 9., .5) for i in range(5)] + [(3, 0, i, None if i else 1., 0., 9., 9., .5) for i in range(200)]
    df = spark.createDataFrame(data, "clip_id bigint, frame_no bigint, box_no bigint, x double, y double, width double, height double, score double")
    dealt = boxes.nms(df, threshold, maximum, crowded=100, front=front)
    got = sorted(map(tuple, dealt.collect()), key=str)
    assert got == sorted(map(tuple, boxes.nms(df, threshold, maximum).select(*dealt.columns).collect()), key=str)
    kept = []
    for d in sorted((d for d in data if d[0] == 1), key=lambda d: (-d[7], d[2:])):
        if (maximum is None or len(kept) < maximum) and all(overlap(k[3:7], d[3:7], 1e-6) < threshold for k in kept):
            kept.append(d)
    assert [r[3:] for r in sorted((r for r in got if r[0] == 1), key=lambda r: r[2])] == [d[2:] for d in kept]


def test_nms_of_a_frame_of_copies_takes_few_rounds(spark, monkeypatch):
    """Thousands of boxes on one spot, many of them equal, are settled by their best ones: no box reaches the grid."""
    rng = random.Random(3)
    spots = [(rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(30, 90), rng.uniform(30, 90)) for _ in range(900)]
    data = [(1, 0, i, *rng.choice(spots), rng.choice([.2, .5, .9])) for i in range(3000)]
    df = spark.createDataFrame(data, "clip_id bigint, frame_no bigint, box_no bigint, x double, y double, width double, height double, score double")
    dealt = []
    real = boxes._heads
    monkeypatch.setattr(boxes, "_heads", lambda *a: (lambda kept, rest: dealt.append((len(kept), rest.count())) or (kept, rest))(*real(*a)))
    got = boxes.nms(df, crowded=100, head=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, boxes.nms(df).select(*got.columns).collect()))
    assert dealt[0][1] == 0 and dealt[0][0] < 12


def test_one_snake_of_a_large_plane(monkeypatch):
    """A region that winds through a 4K mask: a few rounds, not one per cell."""
    import numpy as np
    mask = np.zeros((540, 960), bool)
    mask[::4] = True
    for k, y in enumerate(range(1, 538, 4)):
        mask[y:y + 3, 0 if k % 2 else -1] = True
    rounds = []
    real = np.array_equal
    monkeypatch.setattr(boxes.np, "array_equal", lambda *a: rounds.append(1) or real(*a))
    assert boxes._components(mask) == [(0, 0, 959, 539, int(mask.sum()), 1)]
    assert len(rounds) < 60
    rng = np.random.default_rng(1)
    for share in (.2, .45, .7):
        mask = rng.random((40, 33)) < share
        labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
        while True:
            padded = np.pad(np.where(labels > 0, labels, 10 ** 6), 1, constant_values=10 ** 6)
            low = np.where(mask, np.min([padded[dy:dy + 40, dx:dx + 33] for dy in range(3) for dx in range(3)], axis=0), 0)
            if (low == labels).all():
                break
            labels = low
        want = [(xs.min(), ys.min(), xs.max(), ys.max(), len(xs), k) for k in np.unique(labels[labels > 0]) for ys, xs in [np.nonzero(labels == k)]]
        assert boxes._components(mask) == [tuple(map(int, w)) for w in want]
    assert boxes._components(np.zeros((3, 3), bool)) == []


def test_region_proposals_flood_fill(spark):
    rng = random.Random(2)
    data = []
    for frame in range(8):
        skin = [[rng.random() < .55 for _ in range(20)] for _ in range(15)]
        flat = [v for row in skin for v in row]
        data.append((1, frame, 20, 15, 400, 300, [200 if s else 10 for s in flat], [140 if s else 10 for s in flat], [110 if s else 200 for s in flat], skin))
    schema = "clip_id bigint, frame_no bigint, pw int, ph int, width int, height int, r array<int>, g array<int>, b array<int>"
    out = boxes.region_proposals(spark.createDataFrame([d[:9] for d in data], schema), max_boxes=3, cell=1).collect()
    for d in data:
        skin, seen, found = d[9], set(), []
        for y in range(15):
            for x in range(20):
                if not skin[y][x] or (x, y) in seen:
                    continue
                stack, cells = [(x, y)], []
                seen.add((x, y))
                while stack:
                    cx, cy = stack.pop()
                    cells.append((cx, cy))
                    for nx in range(max(0, cx - 1), min(20, cx + 2)):
                        for ny in range(max(0, cy - 1), min(15, cy + 2)):
                            if skin[ny][nx] and (nx, ny) not in seen:
                                seen.add((nx, ny))
                                stack.append((nx, ny))
                xs, ys = [c[0] for c in cells], [c[1] for c in cells]
                if len(cells) < 3 or max(xs) == min(xs) or max(ys) == min(ys):
                    continue
                w, h = (max(xs) - min(xs) + 1) * 20.0, (max(ys) - min(ys) + 1) * 20.0
                side = max(w, h * .82) * 1.65
                left, top = min(xs) * 20 + w / 2 - side / 2, min(ys) * 20 + h / 2 - side * .48
                x0, y0 = max(0, math.floor(left)), max(0, math.floor(top))
                box = (x0, y0, min(400, math.ceil(left + side)) - x0, min(300, math.ceil(top + side)) - y0)
                if box[2] >= 32 and box[3] >= 24:
                    found.append((box[2] * box[3], len(cells), box))
        found.sort(key=lambda f: -f[0])
        mine = sorted((r for r in out if r.frame_no == d[1]), key=lambda r: r.rank)
        assert [(r.x, r.y, r.width, r.height) for r in mine] == [f[2] for f in found[:3]]


def test_lineage_stack_over_segments(spark):
    rng = random.Random(4)
    stages = ["restore", "detail", "color", "blur"]
    data = [(s, i, rng.choice(["apply", "apply", "apply", "undo", "rewind", "clear" if rng.random() < .1 else "adopt"]), rng.choice(stages))
            for s in range(4) for i in range(5 + 30 * s)]
    df = spark.createDataFrame(data, "session_id bigint, seq bigint, action string, stage_id string")
    got = {r.session_id: r.stack for r in storage.lineage_stack(df, rows=7).collect()}
    for s in range(4):
        stack = []
        for _, _, action, stage in [d for d in data if d[0] == s]:
            if action in ("apply", "adopt"):
                stack.append(stage)
            elif action == "undo" and stack:
                stack.pop()
            elif action == "clear":
                stack = []
            elif action == "rewind" and stage in stack:
                del stack[stack.index(stage):]
        assert got[s] == stack


@pytest.mark.parametrize("jitter", [0, 150, 400])
def test_shutter_window_push_and_drain(spark, jitter):
    """The closed form against a buffer that is filled and drained frame by frame."""
    rng = random.Random(jitter)
    at, data = 0, []
    for i in range(80):
        data.append((1, i, at + rng.randint(0, jitter), 1000))
        at += 1000
    data.sort(key=lambda d: d[2])
    data = [(1, i, d[2], d[3]) for i, d in enumerate(data)]
    df = spark.createDataFrame(data, "clip_id bigint, frame_no bigint, pts_us bigint, dur_us bigint")
    got = {}
    for r in retime.shutter_window(df, 1000, 2500, 1.0, rows=16).collect():
        got.setdefault(r.tick_no, []).append(r.frame_no)
    n, width = 3, 3000.0
    want, buffer, tick, start = {}, [], 0, data[0][2]

    def drain(until, flush):
        nonlocal tick
        while True:
            begin = start + tick * 2500.0
            end = begin + 2500
            if (not flush and until < end - .5) or (flush and begin >= until - .5):
                return
            chosen = [d for d in buffer if d[2] < end + .5 and d[2] + d[3] > end - width - .5][-n:]
            if not chosen:
                return
            want[tick] = [d[1] for d in chosen]
            tick += 1

    for d in data:
        buffer.append(d)
        drain(d[2] + d[3], False)
    drain(max(d[2] + d[3] for d in data), True)
    assert {k: sorted(v) for k, v in got.items()} == want
