"""Input columns named as those that operators make or use within."""

from pyspark.sql import functions as F

from corpus_pipeline import STAGES
from meridia.llm.decontaminate import find_contamination
from meridia.llm.html_text import extract_text
from meridia.llm.mixing import mix
from meridia.llm.quality import fit, score

NAMES = "quality_score score n_words hit_spans items leak_words mix_copy copy rate id text_key bands shard slot own_size offset place digest node comp class_id kept order_0 cdf".split()


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = docs.select("*", *[F.lit(n).alias(n) for n in NAMES])
    for name, stage in STAGES:
        out = stage(spark, odd, sf)
        made = {"shard", "slot"} if name == "sharding" else set()
        assert set(out.columns) == set(odd.columns), name
        rows = out.collect()
        assert all(r[n] == n for r in rows for n in NAMES if n not in made) and rows, name
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_stages_take_nulls_in_every_column(spark, sf):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 2, spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in STAGES:
        assert stage(spark, docs, sf).count() <= 40


def test_results_replace_columns_of_their_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    odd = docs.select("*", *[F.lit("x").alias(n) for n in ("Score", "copy", "n_words", "Items", "html")])
    model = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert dict(score(odd, model).dtypes)["score"] == "double"
    assert dict(mix(odd).dtypes)["copy"] == "int"
    found = find_contamination(odd, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert dict(found.dtypes)["n_words"] == "bigint" and "Items" not in found.columns and found.count() == 20
    assert extract_text(odd).select("text").distinct().count() == 1
