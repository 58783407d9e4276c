"""Plans keep the shapes the operators promise."""

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
NAMES = ["resample_cfr", "shutter_window", "scene_segments", "duplicate_flags", "hysteresis_transitions", "retention_plan",
         "encode_ladder", "lut_apply", "curve_apply", "assign_first_ready", "av_drift", "tile_merge", "color_grade"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_nested_loops_or_row_udfs(spark, small, name):
    text = plan_of(QUERIES[name](spark, small))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "SinglePartition"):
        assert node not in text


@pytest.mark.parametrize("name", ["tile_udtf", "boxes_udtf"])
def test_table_functions_are_one_generator(spark, small, name):
    text = plan_of(QUERIES[name](spark, small))
    assert "Python" not in text and "ArrowEval" not in text and "Join" not in text.split("Generate")[0]


def test_tiles_must_advance(spark, small):
    from framelake.operators import usercode
    usercode.register_table_functions(spark)
    assert spark.sql("SELECT count(*) FROM tile_layout(100, 50, 30, 10)").first()[0] == 5 * 2
    with pytest.raises(Exception, match="overlap must be smaller than the tile"):
        spark.sql("SELECT * FROM VALUES (100) AS v(w), LATERAL tile_layout(w, 50, 30, 40) t").collect()


def test_rules_are_one_narrow_scan(spark, small):
    text = plan_of(QUERIES["output_geometry"](spark, small))
    assert "Exchange" not in text and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int>" in text


def test_filters_reach_the_scan(spark, small):
    text = plan_of(QUERIES["capacity_check"](spark, small).where("session_id = 5"))
    assert "EqualTo(o_orderkey,5)" in text


@pytest.mark.parametrize("name", ["placement", "resolve_settings", "split_settings"])
def test_no_method_is_too_long_to_be_compiled(spark, small, name):
    """With Spark's default limit of generated code, too: the JVM runs methods over 8000 bytes slowly, for ever."""
    settings = {"spark.sql.codegen.hugeMethodLimit": "65535", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan()
        parts = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
        assert parts.size() and all(parts.apply(i)._3().maxMethodCodeSize() <= 8000 for i in range(parts.size()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_observers_part_many_keys_in_their_tasks(spark):
    """No hand-over per key; a null key is one key, and groups go on over Arrow batches."""
    from framelake.operators import usercode
    rows = [(k if k else None, i, float(k + i)) for k in range(300) for i in range(7)]
    df = spark.createDataFrame(rows, "clip_id bigint, frame_no bigint, v double")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "10")
    try:
        out = usercode.observe(df, lambda pdf: {"n": len(pdf), "first": pdf["v"].iloc[0]},
                               lambda a, c: {"n": a["n"] + c["n"], "first": a["first"]}, "n bigint, first double", rows=3)
        assert "FlatMapGroupsInPandas" not in plan_of(out)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(((k if k else None, 7, float(k)) for k in range(300)), key=str)
    finally:
        spark.conf.set(batch, before)
