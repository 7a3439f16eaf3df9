"""Line dedup over levelled sorted runs of line hashes, in DataFrame and SQL operations only.

A run is a table of (h, n, owner): line hash, documents that hold the line, largest of them; it is bucketed by h and
sorted within each bucket. Batches come in descending order of doc_id. Each merge-anti-joins its own line hashes
against the runs - a line that a run already knows to be in enough documents and whose owner is no less than any of the
batch is settled - and adds the rest as a new run of level 0. Two runs of one level are compacted into one run of
the next, so that there are never more runs than the logarithm of the batches. At the end the runs together say which lines go, and from where.
Runs may stay in a folder, and later calls go on from them, with documents of any ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, fresh_path, lower_ascii, partitions, table, written

#: Bytes of the table of dropped positions up to which it is broadcast to the texts; beyond, both are shuffled.
BROADCAST_BYTES = 64 << 20


def lines_of(text: Column) -> Column:
    """The text split at newlines; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


class LineRuns:
    """The levelled runs. Tables lie in the shared folder, or in one that outlives the call; the driver holds their names only.

    folder: where runs stay. Its table of versions, which only grows, tells each level's run; a call that dies leaves the last version whole.
    """

    def __init__(self, spark: SparkSession, min_docs: int, folder: str | None = None):
        self.spark, self.min_docs, self.folder = spark, min_docs, folder
        self.levels: list[str | None] = []
        self.paths: dict[str, str] = {}
        self.buckets, self.version = partitions(spark), 0
        if folder and (rows := self._versions()):
            self.version = max(r.version for r in rows)
            last = sorted((r for r in rows if r.version == self.version), key=lambda r: r.level)
            self.buckets = last[0].buckets
            for r in last:
                self.levels += [None] * (r.level - len(self.levels)) + [self._opened(r.path)]

    def _versions(self) -> list:
        """Some rows for each call so far."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        if not where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
            return []
        return self.spark.read.schema("version int, level int, path string, buckets int").json(f"{self.folder}/versions").collect()

    def _opened(self, path: str) -> str:
        name, kind = f"line_run_{uuid.uuid4().hex}", self.spark.read.parquet(path).schema["owner"].dataType.simpleString()
        self.spark.sql(f"CREATE TABLE {name} (h BINARY, n BIGINT, owner {kind}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        self.paths[name] = path
        return name

    def _write(self, run: DataFrame) -> str:
        """run is dealt by h already, by the shuffle of its aggregate or by its inputs' buckets: a task has whole buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = f"{self.folder}/{name}" if self.folder else fresh_path(self.spark, "line-run")
        run.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).saveAsTable(name)
        return name

    def save(self) -> None:
        """The runs as they are become the folder's newest version."""
        if self.folder:
            rows = [(self.version + 1, k, self.paths[x], self.buckets) for k, x in enumerate(self.levels) if x]
            self.spark.createDataFrame(rows, "version int, level int, path string, buckets int").coalesce(1).write.mode("append").json(f"{self.folder}/versions")
            self.version += 1

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Both runs as one: a merge join, bucket by bucket, without a shuffle."""
        b = b.select("h", F.col("n").alias("n2"), F.col("owner").alias("owner2"))
        n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
        return a.hint("merge").join(b, "h", "full_outer").select("h", n.alias("n"), F.greatest("owner", "owner2").alias("owner"))

    def add(self, batch: DataFrame, bound) -> None:
        """batch: rows (h, doc), each line of a document once; bound is no less than any of its documents."""
        new = batch.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("owner"))
        for name in filter(None, self.levels):
            settled = self.spark.table(name).where((F.col("n") >= self.min_docs) & (F.col("owner") >= F.lit(bound))).select("h")
            new = new.hint("merge").join(settled, "h", "left_anti")
        run, level = self._write(new), 0
        while level < len(self.levels) and (other := self.levels[level]):
            self.levels[level] = None
            merged = self._write(self._merged(self.spark.table(other), self.spark.table(run)))
            for name in (other, run):
                self.spark.sql(f"DROP TABLE {name}")
            run, level = merged, level + 1
        self.levels[level : level + 1] = [run]

    def repeated(self) -> DataFrame:
        """(h, owner) of the lines in at least min_docs documents."""
        first, *rest = [self.spark.table(x) for x in self.levels if x]
        for run in rest:
            first = self._merged(first, run)
        return first.where(F.col("n") >= self.min_docs).select("h", "owner")

    def close(self) -> None:
        for name in filter(None, self.levels):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def batch_cuts(ids: DataFrame, least: int, batch_rows: int) -> tuple[list, object]:
    """(the least ids of all batches but the last, in descending order; the largest id): at least so many batches, none of many more rows than batch_rows
    but where one id has more. Ids may be of any type that has an order; the driver gets one row for each shuffle partition."""
    dealt = ids.repartitionByRange(max(partitions(ids.sparkSession), 4 * least), F.col("doc").desc_nulls_last())
    parts = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    rows = sum(r.n for r in parts)
    batches, cuts, seen = max(least, -(-rows // batch_rows)), [], 0
    for r in parts:
        seen += r.n
        if r.lo is not None and seen < rows and seen * batches >= (len(cuts) + 1) * rows:
            cuts.append(r.lo)
    return cuts, max((r.hi for r in parts if r.hi is not None), default=None)


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, batch_rows: int = 1 << 28, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """For each row of docs: id_col, n_lines, n_dropped, kept_text.

    Lines whose key (stripped of ASCII white space, A-Z lower-cased) has at least min_chars code points and is in at
    least min_docs rows go everywhere but from the largest id that holds them; the rest is joined by newlines. Each row
    counts as one document; ids may be of any ordered type and are meant to be unique, and rows that share the largest
    id all keep the line. A null id is less than any other. Null and empty texts are one empty line. Texts of any length
    are taken whole; a text's lines must fit a task. At least batches of them, of about batch_rows rows at most. No rows
    give no rows; further columns are not read, whatever their names.

    folder: a shared folder where runs stay. docs are then judged by all documents that calls with it were given, these included, and must not
    have been given before; cut_lines judges documents anew without adding them.
    """
    cuts, top = batch_cuts(docs.select(F.col(id_col).alias("doc")), batches, batch_rows)
    place = sum((F.coalesce(F.col("doc") < F.lit(c), F.lit(True)).cast("int") for c in cuts), F.lit(0))
    rows, hashed = _hashed(docs, place, min_chars, id_col, text_col)
    runs = LineRuns(docs.sparkSession, min_docs, folder)
    try:
        for k in range(len(cuts) + 1):
            own = hashed.where(F.col("batch") == k)
            runs.add(own.select("doc", F.explode(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull()))).alias("h")), cuts[k - 1] if k else top)
        runs.save()
        repeated = written(runs.repeated(), "lines-repeated")
    finally:
        runs.close()
    return _without(rows, hashed, repeated, id_col)


def cut_lines(docs: DataFrame, folder: str, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As line_dedup, for documents that calls with this folder were given already: what they are by all that were given since."""
    rows, hashed = _hashed(docs, F.lit(0), min_chars, id_col, text_col)
    runs = LineRuns(docs.sparkSession, min_docs, folder)
    try:
        repeated = written(runs.repeated(), "lines-repeated")
    finally:
        runs.close()
    return _without(rows, hashed, repeated, id_col)


def _hashed(docs: DataFrame, place: Column, min_chars: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows of doc, text, text_key; the hashes of their lines, written by batch)."""
    spark = docs.sparkSession
    keys = F.transform(lines_of(F.col("text")), lambda x: F.when(F.length(line_key(x)) >= min_chars, F.unhex(F.md5(line_key(x)))))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    path = fresh_path(spark, "line-hashes")
    hashed = rows.select("doc", "text_key", keys.alias("hashes"), place.alias("batch"))
    hashed.write.partitionBy("batch").parquet(path)
    return rows, spark.read.schema(hashed.schema).parquet(path)


def _without(rows: DataFrame, hashed: DataFrame, repeated: DataFrame, id_col: str) -> DataFrame:
    """rows without the repeated lines, but where a row is their owner."""
    # Rows with the same id and text lose the same lines, so the pair identifies what to cut.
    held = hashed.select("doc", "text_key", F.posexplode("hashes").alias("pos", "h")).where("h IS NOT NULL")
    gone = held.join(repeated, "h").where(~F.col("doc").eqNullSafe(F.col("owner")))
    gone = written(gone.groupBy("doc", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "lines-gone")
    size = gone.agg(F.sum(F.size("gone") * 4 + 100)).first()[0] or 0
    gone = gone.select(F.col("doc").alias("d"), F.col("text_key").alias("k"), "gone")
    joined = rows.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    # The kept lines are the slices between dropped ones: linear in the length of the text.
    split = joined.select("doc", lines_of(F.col("text")).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    split = split.withColumn("ends", F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("lines"))))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.slice("lines", F.get("ends", i - 1) + 2, F.get("ends", i) - F.get("ends", i - 1) - 1)))
    return split.select(F.col("doc").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.owner AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
