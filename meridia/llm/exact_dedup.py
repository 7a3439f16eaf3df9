"""Exact dedup as two streams, in DataFrame and SQL operations only.

The first stream gives each document's digest, identifier and content locator (file and row). The second, stateful,
keeps for every digest ever seen the identifier and the locator of the document that stays and the number of documents,
in RocksDB state on the executors' disks that never expires and is part of the stream's checkpoint. The full bytes of
every document whose digest was hit more than once are then read by its locator, and texts that share a digest are told
apart.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, lower_ascii, written

#: Many small stores: no disk is set aside ahead for each.
STATE_CONF = {
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Broadcast of the digests that were hit, or of their rows: so many of about 200 bytes (100 MB) at most, else a shuffle.
BROADCAST_ROWS = 500_000


def normal(text: Column) -> Column:
    """What is compared: the text with A-Z lower-cased; null counts as empty."""
    return F.coalesce(lower_ascii(text), F.lit(""))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    was = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digest_stream(stream: DataFrame, id_col: str, text_col: str, checkpoint: str, sink: str, digest=sha256) -> None:
    """Appends (digest, id, file, row) of all that is there now and was not read before to sink: each text is hashed once."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = stream.select(digest(normal(F.col(text_col))).alias("digest"), F.col(id_col).alias("id"), *where)
    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink).awaitTermination()


def index_stream(seen: DataFrame, checkpoint: str, sink: str) -> None:
    """Runs the stateful stream over the rows (digest, id, file, row) that are there now and appends each batch's changed digests to sink.

    Started again with the same checkpoint, it goes on where it ended and reads new files only. A batch that runs
    twice overwrites its own folder. Rows of sink: digest, group_size, keeper (id, file, row) as of that batch; the
    keeper is the largest id so far, a null id the least of all.
    """
    state = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "file", "row")).alias("keeper"))
    with _conf(seen.sparkSession, STATE_CONF):
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")).start()
        )
        query.awaitTermination()


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", bytes_per_trigger: int = 1 << 30, digest=sha256, state: str | None = None) -> DataFrame:
    """One row for each row at path: id_col, keep_id, group_size, kept, digest.

    Rows are equal if their texts, of any length, are identical after lower-casing A-Z; null counts as empty. Of equal
    rows the one with the largest id stays; ids are meant to be unique, and rows that repeat the keeper's id (ties) are
    kept with it. A null id is less than any other. An empty table gives no rows; further columns are not read, whatever
    their names.

    state: a shared folder where digests and the index stay. A later call with it and the same path hashes and indexes the files that have
    come since only; files that were read must stay as they are.
    """
    docs = spark.read.parquet(path)
    # A stream reads folders; of a path that is one file it takes the folder and that name.
    folder, _, file = path.rpartition("/")
    single = docs.select("_metadata.file_path").limit(1).collect()
    if not single:
        return docs.limit(0).select(F.col(id_col), F.col(id_col).alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(False).alias("kept"), F.lit(b"").alias("digest"))
    places = {k: f"{state}/{k}" if state else fresh_path(spark, f"dedup-{k}") for k in ("digests", "digest-state", "index", "index-state")}
    reader = spark.readStream.schema(docs.schema).option("maxBytesPerTrigger", str(bytes_per_trigger))
    stream = reader.option("pathGlobFilter", file).parquet(folder) if single[0][0].endswith(f"/{file}") else reader.parquet(path)
    digest_stream(stream, id_col, text_col, places["digest-state"], places["digests"], digest)
    rows = spark.read.parquet(places["digests"])
    index_stream(spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(places["digests"]), places["index-state"], places["index"])
    index = spark.read.schema(f"digest binary, group_size long, keeper struct<id:{rows.schema['id'].dataType.simpleString()},file:string,row:long>").parquet(places["index"])
    # A digest's size only grows from batch to batch, so its largest row is its last.
    last = written(index.groupBy("digest").agg(F.max(F.struct("group_size", "keeper")).alias("s")).select("digest", "s.group_size", F.col("s.keeper.id").alias("keep_id")), "dedup-last")

    hit = last.where("group_size > 1").select("digest")
    located = written(rows.join(F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit, "digest").select("digest", "id", F.col("file").alias("hit_file"), F.col("row").alias("hit_row")), "dedup-hits")
    # Full bytes of all hits by their locators: copies fold into one row in each task before the shuffle, so a hot text is no hot task.
    texts = docs.select(normal(F.col(text_col)).alias("bytes"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    read = texts.join(F.broadcast(located) if located.count() <= BROADCAST_ROWS else located, (F.col("file") == F.col("hit_file")) & (F.col("row") == F.col("hit_row")))
    classes = read.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id"))
    clash = written(classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "dedup-clash")
    out = rows.select("id", "digest").join(last, "digest")
    if not clash.isEmpty():  # different texts under one digest: these are told apart by their bytes
        mixed = read.join(clash, "digest")
        own = written(mixed.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id")), "dedup-own")
        out = rows.select("id", "digest").join(clash, "digest", "left_anti").join(last, "digest").unionByName(mixed.join(own, ["digest", "bytes"]).select("id", "digest", "group_size", "keep_id"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
"""
