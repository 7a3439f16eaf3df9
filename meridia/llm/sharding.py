"""Contiguous shards of near-equal bytes by global prefix sums.

The rows are put in one global order by a range shuffle; each partition adds up its own sizes; the driver adds up the
partitions' totals (a row for each partition, never for each document) and every row's global offset then follows from
its partition's base. Cutting the byte line at equal targets gives the shards, each a contiguous run of the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, partitions, table, written


def _running(batches: Iterator[pa.RecordBatch], size: str, sums: str, rows: str) -> Iterator[pa.RecordBatch]:
    """Adds to each row the bytes and rows that come before it in its partition."""
    at, n = 0, 0
    for b in batches:
        v = b.column(b.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = at + np.cumsum(v)
        yield b.append_column(sums, pa.array(ends - v)).append_column(rows, pa.array(np.arange(n, n + len(v), dtype=np.int64)))
        if len(v):
            at, n = int(ends[-1]), n + len(v)


def shard_by_bytes(df: DataFrame, size: Column, shards: int, order: list[Column], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df with the columns shard (0 to shards - 1) and slot (place in the shard, without gaps from 0).

    The shards are contiguous in the given order, and a row belongs to the shard on whose part of the byte line its
    first byte lies, so shards differ from the target by less than the rows at their two ends. A null size counts as 0;
    nulls in order come first; ties in it are cut anywhere, as each row has its own place. Rows without any size at
    all (total 0) all go to shard 0. Repeated rows have a place each; a very long row fills its shard, and shards that its
    bytes pass over stay empty. An empty table gives an empty one. Columns of df named as the new ones are replaced, no
    other name clashes.
    """
    spark = df.sparkSession
    names = {k: free_name(df, k) for k in ("own_size", "own_part", "bytes_before", "rows_before", "base_bytes", "base_rows", "first_place", *(f"order_{i}" for i in range(len(order))))}
    sized = df.select("*", F.coalesce(size.cast("long"), F.lit(0)).alias(names["own_size"]), *(c.alias(names[f"order_{i}"]) for i, c in enumerate(order)))
    keys = [names[f"order_{i}"] for i in range(len(order))]
    sized = sized.drop(shard, slot)
    dealt = sized.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop(*keys)
    schema = T.StructType([*dealt.schema.fields, T.StructField(names["bytes_before"], T.LongType()), T.StructField(names["rows_before"], T.LongType())])
    own, before, rank = names["own_size"], names["bytes_before"], names["rows_before"]
    # Written, as the bounds of a range shuffle may differ if it runs again.
    placed = written(dealt.mapInArrow(lambda it: _running(it, own, before, rank), schema).withColumn(names["own_part"], F.spark_partition_id()), "placed")

    totals = placed.groupBy(names["own_part"]).agg(F.sum(own).alias("b"), F.count(F.lit(1)).alias("n")).orderBy(names["own_part"]).collect()  # one row for each partition
    bases, b, n = [], 0, 0
    for r in totals:
        bases.append((r[0], b, n))
        b, n = b + r.b, n + r.n
    base = spark.createDataFrame(bases, f"`{names['own_part']}` int, `{names['base_bytes']}` long, `{names['base_rows']}` long")
    offset, place = free_name(df, "offset"), free_name(df, "place")
    based = (
        placed.join(F.broadcast(base), names["own_part"])
        .withColumn(offset, F.col(before) + F.col(names["base_bytes"]))
        .withColumn(place, F.col(rank) + F.col(names["base_rows"]))
        # Integer arithmetic on decimals, as offset * shards may pass 2^63.
        .withColumn(shard, F.least(F.lit(shards - 1), F.floor(F.col(offset).cast("decimal(38,0)") * F.lit(shards) / F.lit(max(b, 1)).cast("decimal(20,0)")).cast("int")))
    )
    first = based.groupBy(shard).agg(F.min(place).alias(names["first_place"]))  # at most shards rows
    kept = [c for c in df.columns if c.lower() not in (shard.lower(), slot.lower())]
    return based.join(F.broadcast(first), shard).select(*kept, shard, (F.col(place) - F.col(names["first_place"])).alias(slot))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text and 16 for the record's frame; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def op7_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in 40 shards of near-equal bytes. Equal texts are neighbours in the order (a digest of the text, then
    doc_id), so that groups of copies are cut only where a shard ends."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("digest"))
    out = shard_by_bytes(rows, F.col("size"), shards, [F.col("digest"), F.col("doc_id")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str, shards: int = 40) -> DataFrame:
    """Pipeline stage: every row of docs, repeated ones too, with shard and slot. Nulls, very long texts, ties and empty tables as in
    shard_by_bytes; columns named shard or slot are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard_by_bytes(docs, text_size(F.col("text")), shards, [F.xxhash64(text, F.lit(7)), F.col("doc_id")])
