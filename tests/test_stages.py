"""Stage outputs under several writers."""

import pytest
from pyspark.sql import functions as F

from framelake.sources import stages


def rows_of(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_a_stage_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path)
    assert stages.latest_version(spark, path) == 0 and stages.read_index(spark, path).count() == 0
    out = stages.write_stage_output(spark.range(5), path, "s", "a", 7)
    assert rows_of(out) == [0, 1, 2, 3, 4]
    old = stages.read_stage_output(spark, path, "s", "a")
    assert rows_of(stages.write_stage_output(spark.range(2), path, "s", "a", 9)) == [0, 1]
    assert rows_of(old) == [0, 1, 2, 3, 4]  # a reader of the version before keeps it
    stages.write_stage_output(spark.range(3), path, "s", "b", 9)
    index = {r.stage_key: r for r in stages.read_index(spark, path).collect()}
    assert (index["a"].row_count, index["a"].created_at_us, index["a"].last_access_us) == (2, 7, 9) and index["a"].bytes > 0
    assert index["b"].row_count == 3 and len(stages.unnamed_folders(spark, path)) == 1
    with pytest.raises(LookupError):
        stages.read_stage_output(spark, path, "s", "c")


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path)
    stages.write_stage_output(spark.range(1), path, "s", "a", 1)
    began = stages.latest_version(spark, path)
    stages.write_stage_output(spark.range(10), path, "s", "a", 2, since=began)
    with pytest.raises(stages.StageConflict):
        stages.write_stage_output(spark.range(20), path, "s", "a", 2, since=began)
    assert rows_of(stages.read_stage_output(spark, path, "s", "a")) == list(range(10))
    assert stages.read_index(spark, path).first().row_count == 10  # the same last_access, still decided
    stages.write_stage_output(spark.range(4), path, "s", "b", 3, since=began)  # another stage only moves on
    assert stages.latest_version(spark, path) == 3


def test_a_taken_version_is_not_overwritten(spark, tmp_path, monkeypatch):
    """Another writer takes the version between the look and the commit."""
    path = str(tmp_path)
    real, done = stages._create, []

    def late(session, where, version, row):
        if not done:
            done.append(version)
            folder = f"{path}/data/session_id=s/stage_key=other/x"
            session.range(6).write.parquet(folder)
            real(session, where, version, {**row, "stage_key": "other", "folder": folder, "row_count": 6})
        return real(session, where, version, row)

    monkeypatch.setattr(stages, "_create", late)
    stages.write_stage_output(spark.range(3), path, "s", "a", 5)
    assert {r.version: r.stage_key for r in stages.read_log(spark, path).collect()} == {1: "other", 2: "a"}

    done.clear()

    def same(session, where, version, row):
        if not done:
            done.append(version)
            real(session, where, version, {**row, "row_count": 77})
        return real(session, where, version, row)

    monkeypatch.setattr(stages, "_create", same)
    with pytest.raises(stages.StageConflict):
        stages.write_stage_output(spark.range(9), path, "s", "a", 6)
    assert stages.read_index(spark, path).where(F.col("stage_key") == "a").first().row_count == 77


def test_a_writer_that_dies_leaves_no_trace_in_the_index(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    stages.write_stage_output(spark.range(2), path, "s", "a", 1)
    monkeypatch.setattr(stages, "commit_stage", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        stages.write_stage_output(spark.range(8), path, "s", "a", 2)
    assert rows_of(stages.read_stage_output(spark, path, "s", "a")) == [0, 1] and len(stages.unnamed_folders(spark, path)) == 1
