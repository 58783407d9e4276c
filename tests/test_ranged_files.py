"""Containers scanned in place against the scan of whole contents."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from framelake.sources import media_files, ranged_files


def archive(packets, count=0, tail=b""):
    head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"VP90", 64, 64, 30000, 1000, count, 0)
    return head + b"".join(struct.pack("<IQ", len(p), 2 * i) + p for i, p in enumerate(packets)) + tail


def some_archives():
    rng = random.Random(1)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    plain = [noise(rng.randrange(1, 400)) for _ in range(200)]
    inner = archive([noise(30) for _ in range(40)])[32:]
    return {
        "plain": archive(plain), "counted": archive(plain, count=33), "cut": archive(plain)[:-5], "ends": archive(plain, tail=struct.pack("<IQ", 0, 1)) + noise(500),
        "nested": archive([noise(100), inner, inner, noise(3), inner + noise(17)]), "large": archive([noise(9), noise(20_000), noise(9)]),
        "zeros": archive([bytes(500)] * 20), "empty": archive([])}


@pytest.mark.parametrize("range_bytes", [50, 1000, 1 << 20])
def test_packets_as_in_whole_contents(spark, tmp_path, range_bytes):
    for name, data in some_archives().items():
        (tmp_path / f"{name}.ivf").write_bytes(data)
    name = F.element_at(F.split("path", "/"), -1).alias("path")
    pick = lambda df: sorted(map(tuple, df.select(name, "packet_no", "offset", "length", "ts", F.round("pts_ms", 6)).collect()))
    got = pick(ranged_files.scan_ivf_files(ranged_files.list_files(spark, str(tmp_path)), range_bytes))
    assert got == pick(media_files.scan_ivf_packets(media_files.read_files(spark, str(tmp_path))))
    assert len({r[0] for r in got}) == 7


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.ivf").write_bytes(b"RIFF" + bytes(60))
    with pytest.raises(Exception, match="not an IVF stream"):
        ranged_files.scan_ivf_files(ranged_files.list_files(spark, str(tmp_path))).collect()


def test_boxes_as_in_whole_contents(spark, tmp_path):
    box = lambda kind, payload: struct.pack(">I4s", len(payload) + 8, kind) + payload
    files = {"good": box(b"ftyp", b"isom0000") + box(b"moov", b"xy") + struct.pack(">I4sQ", 1, b"mdat", 30) + b"12345678901234",
             "open": box(b"ftyp", b"isom0000") + struct.pack(">I4s", 0, b"mdat") + bytes(40), "short": b"abc", "huge": box(b"ftyp", bytes(8)) + struct.pack(">I4sQ", 1, b"mdat", 1 << 60),
             "bad": box(b"ftyp", bytes(8)) + struct.pack(">I4s", 3, b"free"), "cut": box(b"ftyp", bytes(8)) + struct.pack(">I4s", 999, b"mdat") + bytes(9)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    pick = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = ranged_files.scan_mp4_files(ranged_files.list_files(spark, str(tmp_path)))
    assert pick(got) == pick(media_files.scan_mp4_boxes(media_files.read_files(spark, str(tmp_path))))


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """3 GB each, nearly all holes: only headers are read."""
    big = 3 << 30
    with open(tmp_path / "a.mp4", "wb") as f:
        f.write(struct.pack(">I4s", 16, b"ftyp") + b"isom0000" + struct.pack(">I4sQ", 1, b"mdat", big))
        f.seek(16 + big)
        f.write(struct.pack(">I4s", 12, b"moov") + b"abcd")
    verdict = media_files.audit_mp4(ranged_files.scan_mp4_files(ranged_files.list_files(spark, str(tmp_path), "*.mp4"))).first()
    assert verdict.valid and not verdict.fast_start and verdict.boxes == 3
    size = 8 << 20
    with open(tmp_path / "a.ivf", "wb") as f:
        f.write(archive([]))
        for i in range(big // size):
            f.write(struct.pack("<IQ", size, 2 * i))
            f.seek(size, 1)
        f.truncate()
    files = ranged_files.list_files(spark, str(tmp_path), "*.ivf")
    packets = ranged_files.scan_ivf_files(files)
    assert packets.agg(F.count("*"), F.max("offset")).first() == (big // size, 32 + (big // size - 1) * (size + 12) + 12)
    assert "content" not in packets._jdf.queryExecution().toString() and ranged_files.settled_ranges(files).count() > 40
