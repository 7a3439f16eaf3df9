from pyspark.sql import functions as F

from meridia.llm.sharding import shard_by_bytes, stage_sharding, text_size


def test_contiguous_balanced_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = shard_by_bytes(docs, text_size(F.col("text")), 7, [F.col("doc_id")]).select("doc_id", "shard", "slot", text_size(F.col("text")).alias("n")).orderBy("doc_id").collect()
    assert len(out) == docs.count() and [r.shard for r in out] == sorted(r.shard for r in out)
    size = [sum(r.n for r in out if r.shard == s) for s in range(7)]
    assert max(size) - min(size) <= 2 * max(r.n for r in out)
    for s in range(7):
        assert [r.slot for r in out if r.shard == s] == list(range(sum(r.shard == s for r in out)))


def test_odd_rows(spark):
    rows = [(1, "a" * 1000000, "s"), (None, None, "s"), (2, "", None), (2, "", None), (3, "b", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_size string")
    out = stage_sharding(spark, df, "").collect()
    assert len(out) == 5 and sorted(out[0].asDict()) == ["doc_id", "own_size", "shard", "slot", "text"]
    assert all(0 <= r.shard < 40 for r in out)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert stage_sharding(spark, df.limit(0), "").count() == 0
    assert {r.shard for r in shard_by_bytes(df, F.lit(0), 4, [F.col("doc_id")]).collect()} == {0}
    again = shard_by_bytes(df.withColumn("Slot", F.lit("x")).withColumn("base_rows", F.lit(1)).withColumn("first_place", F.lit(2)), F.lit(1), 5, [F.col("doc_id")])
    assert again.columns[-2:] == ["shard", "slot"] and "Slot" not in again.columns and {(r.shard, r.slot, r.base_rows, r.first_place) for r in again.collect()} == {(k, 0, 1, 2) for k in range(5)}


def test_op7_against_brute_force(spark):
    import zlib

    import xxhash

    from meridia.llm.sharding import op7_sharding

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    signed = lambda b: (h := xxhash.xxh64_intdigest(b, seed=42)) - (1 << 64) * (h >> 63)
    at, want, seen = 0, {}, {}
    total = sum(len(b) + 16 for _, b in docs)
    for i, b in sorted(docs, key=lambda d: (signed(d[1]), d[0])):
        shard = min(39, at * 40 // total)
        want[i] = (len(b) + 16, zlib.crc32(b), "bytes", shard, seen.setdefault(shard, 0), None)
        seen[shard] += 1
        at += len(b) + 16
    assert {r.doc_id: tuple(r)[1:] for r in op7_sharding(spark, sf).collect()} == want
