"""Groups without a bound are not gathered into one row."""

from meridia.plans import QUERIES


def test_first_group_of_a_feature_gathers_no_lists(spark, tmp_path):
    rows = [(p, 7) for p in range(2000)] + [(5, 3), (6, 9), (None, 2), (None, 1)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["d31_feature_group_first"](spark, str(tmp_path))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in p and "Generate" not in p
    assert {r.feature_id: r.district for r in df.collect()} == {p: 7 for p in range(2000)} | {5: 3, None: 1}
