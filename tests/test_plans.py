"""The physical plans that matter: what reaches the scan, and that spatial joins are equi-joins."""

from pyspark.sql import functions as F

from meridia.operators import spatial as G
from meridia.plans import QUERIES
from meridia.sources import files as R


def plan(df):
    for k, v in (("spark.sql.maxMetadataStringLength", "5000"), ("spark.sql.debug.maxToStringFields", "200")):
        df.sparkSession.conf.set(k, v)
    return df._jdf.queryExecution().executedPlan().toString()


def test_nested_box_tests_reach_the_parquet_scan(spark, tmp_path, sf):
    box = F.struct(*[F.lit(1.0).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])
    spark.range(10).select(F.col("id").alias("segment_id"), F.lit("a").alias("class"), F.lit("road").alias("subtype"), box.alias("bbox"), F.lit("x" * 50).alias("unused")).write.parquet(f"{tmp_path}/s")
    p = plan(R.read_segments(spark, f"{tmp_path}/s", "road", ["a", "b"], (-20, 30, 40, 60)).select("segment_id"))
    for test in ("GreaterThanOrEqual(bbox.xmax,-20.0)", "LessThan(bbox.xmin,40.0)", "EqualTo(subtype,road)", "In(class, [a,b])"):
        assert test in p, test
    assert "unused" not in p


def test_spatial_joins_have_keys(spark, sf):
    for name in ("c1_within", "c2_nearest", "c3_within_else_nearest", "c4_max_overlap", "c5_adjacency", "c13_pairwise_overlap", "d22_inverse_distance_vote"):
        p = plan(QUERIES[name](spark, sf))
        assert "NestedLoop" not in p and "Cartesian" not in p, name


def test_only_needed_columns_are_read(spark, sf):
    p = plan(QUERIES["d2_owner_controller_counts"](spark, sf))
    assert "p_retailprice" not in p and "p_name" not in p


def test_hot_cell_is_split_by_adaptive_execution(spark):
    # A third of all points in one cell: the join's two sides are shuffles that Spark may split.
    pts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") % 180).alias("lon"), F.lit(0.5).alias("lat"))
    polys = spark.range(180).select(F.col("id").alias("pid"), F.col("id").cast("double").alias("xmin"), F.lit(0.0).alias("ymin"), (F.col("id") + 1).cast("double").alias("xmax"), F.lit(1.0).alias("ymax"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = G.within(pts, polys.select("pid", G.box_rings("xmin", "ymin", "xmax", "ymax").alias("rings")), "rings", key="pid")
        text = plan(df)
        assert text.count("hashpartitioning(_lv") >= 2 and df.count() == 3000
        # Cells carry boxes and keys: the polygons meet the points behind them, by key.
        for side in text.split("hashpartitioning(_lv")[1:]:
            assert "rings" not in side.split("\n")[1].split("AS ")[0] and "rings" not in side.split("Generate")[0]
        assert "SortMergeJoin [_key" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
