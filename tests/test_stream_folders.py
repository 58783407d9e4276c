"""Registered streaming queries over folders of many part files in no order of time."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

CHECKS = entry.oracle_sql()
QUERIES = entry.queries()
STREAMS = ["stream_telemetry", "stream_resample", "stream_pacing", "stream_integrity", "stream_seeded_pacing", "stream_hysteresis", "stream_scenes",
           "stream_duplicates"]


@pytest.fixture(scope="module")
def shuffled(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("shuffled")
    for name in ("events", "embeddings"):
        spark.read.parquet(f"{small}/{name}.parquet").repartition(70).write.parquet(f"{folder}/{name}.parquet")
        assert len(list((folder / f"{name}.parquet").glob("part-*"))) > 64
    return str(folder)


@pytest.mark.parametrize("name", STREAMS)
def test_many_shuffled_files_match_sql(spark, small, shuffled, name):
    assert compare(connect(small), QUERIES[name](spark, shuffled), CHECKS[name]) == ""


def test_many_shuffled_files_of_audio(spark, small, shuffled):
    rows = [sorted(map(tuple, QUERIES["stream_audio"](spark, f).drop("batch").collect()), key=repr) for f in (shuffled, small)]
    assert rows[0] == rows[1]
