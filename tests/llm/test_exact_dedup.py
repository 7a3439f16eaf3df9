from collections import defaultdict

from pyspark.sql import functions as F

from meridia.llm.exact_dedup import exact_dedup, sha256

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(1, None), (2, ""), (3, "Abc"), (4, "aBC"), (5, "abcÉ"), (6, "abcé"), (7, "x" * 300000), (8, "X" * 300000), (None, "abc"), (9, "solo"), (9, "solo"), (None, "lone"), (11, "abd"), (12, "abd")]


def want(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOW)].append(i)
    out = []
    for i, t in rows:
        g = groups[(t or "").translate(LOW)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_rules_over_several_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, digest string, bytes int")
    df.repartition(5).write.parquet(f"{tmp_path}/docs")
    assert got(exact_dedup(spark, f"{tmp_path}/docs", bytes_per_trigger=1)) == want(ROWS)  # a file a batch
    assert got(exact_dedup(spark, f"{tmp_path}/docs")) == want(ROWS)


def test_texts_with_one_digest_are_told_apart_by_their_bytes(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    weak = lambda text: F.substring(sha256(text), 1, 0)  # noqa: E731 - all texts collide
    assert got(exact_dedup(spark, f"{tmp_path}/docs", digest=weak)) == want(ROWS)
    half = lambda text: F.when(F.length(text) > 3, sha256(text)).otherwise(F.lit(b"z"))
    assert got(exact_dedup(spark, f"{tmp_path}/docs", digest=half)) == want(ROWS)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    assert exact_dedup(spark, f"{tmp_path}/docs").count() == 0


def test_state_that_outlives_the_call(spark, tmp_path):
    path, state = f"{tmp_path}/docs", f"file://{tmp_path}/state"
    for k in range(0, len(ROWS), 5):
        spark.createDataFrame(ROWS[k : k + 5], "doc_id long, text string").repartition(2).write.mode("append").parquet(path)
        assert got(exact_dedup(spark, path, state=state)) == want(ROWS[: k + 5])
    digests = spark.read.parquet(f"{state}/digests")
    assert digests.count() == len(ROWS) and digests.select("file", "row").distinct().count() == len(ROWS)  # each was hashed once
