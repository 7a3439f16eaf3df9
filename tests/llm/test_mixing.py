from pyspark.sql import functions as F

from meridia.llm.mixing import mix


def test_shares_and_draws(spark):
    df = spark.range(30000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.when(F.col("id") % 3 == 0, 10).otherwise(40)).alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit(0).alias("rate"))
    out = mix(df, {"a": 6.0, "b": 1.0}, epochs=2.0)
    size = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = 10000 * 90 * 2  # a source that the weights don't name gets nothing
    assert set(size) == {"a", "b"} and abs(size["a"] / total - 6 / 7) < 0.02 and abs(size["b"] / total - 1 / 7) < 0.02
    again = mix(df.repartition(7), {"a": 6.0, "b": 1.0}, epochs=2.0)
    assert out.exceptAll(again).count() == 0 and again.exceptAll(out).count() == 0
    n = {r.doc_id: r.n for r in out.where("source = 'a'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("c")).where("n = c + 1").collect()}
    mean = sum(n.values()) / 10000  # rate 15.4 in one part; 16 and more are drawn in parts
    var = sum((n.get(3 * i, 0) - mean) ** 2 for i in range(10000)) / 10000
    assert abs(var / mean - 1) < 0.06
    order = [r.doc_id for r in out.where("source = 'b'").collect()]
    assert abs(sum(a < b for a, b in zip(order, order[1:])) / len(order) - 0.5) < 0.05


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "t", "s"), (2, "", "e"), (3, "long" * 100000, "s")], "doc_id long, text string, source string")
    assert set(mix(df).columns) == {"doc_id", "text", "source", "copy"}
    assert mix(df, {"none": 1.0}).count() == 0 and mix(df.limit(0)).count() == 0
    big = mix(df.where("doc_id = 3"), {"s": 1.0}, epochs=500.0)
    assert 350 < big.count() < 650
