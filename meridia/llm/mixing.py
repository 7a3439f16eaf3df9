"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate from its target weight and its bytes. Each document's number of copies is a
Poisson variate of that mean, by inverting the distribution at a number in [0, 1) hashed from a seed and the document's
id; the same seed gives the same copies on any cluster, and no document's copies depend on another's. The copies are
then shuffled globally: dealt to partitions, and sorted in each, by a hash of seed, id and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, partitions, table, written

#: A larger mean is split into equal parts of at most this mean, whose variates are added: keeps the table of a source short.
PART = 16.0
#: Sources up to which their rates are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 50_000
HEX13 = float(16**13)


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(HEX13)


def rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, epochs: float, source: str, text: str) -> DataFrame:
    """(source, rate, part, cdf): mean copies of a document, number of parts of the mean, distribution function of a part.

    weights: target share by source, normalised over the sources there are; a source not in it has weight 0, and if all have, nothing is drawn. None: the
    source's bytes to the power alpha. A source without bytes has rate 1 (0 if its weight is 0), as no rate changes its share.
    """
    size = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0))).cast("double").alias("bytes"))
    if weights is None:
        weight = F.pow("bytes", F.lit(alpha))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "given string, weight double")
        size = size.join(given, F.col("source").eqNullSafe(F.col("given")), "left")
        weight = F.coalesce("weight", F.lit(0.0))
    size = written(size.select("source", "bytes", weight.alias("w")), "mix-sizes")
    both = size.agg(F.sum("w").alias("all_w"), F.sum("bytes").alias("all_bytes"))  # one row
    rate = F.when(F.col("bytes") > 0, F.coalesce(F.try_divide("w", "all_w"), F.lit(0.0)) * F.col("all_bytes") * F.lit(epochs) / F.col("bytes")).when(F.col("w") > 0, 1.0).otherwise(1.0 if weights is None else 0.0)
    out = size.crossJoin(F.broadcast(both)).select("source", rate.alias("rate")).withColumn("part", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    mean = F.col("rate") / F.col("part")
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int"))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("cdf"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.concat(a["cdf"], F.array(a["sum"] + p)).alias("cdf"))

    return written(out.withColumn("cdf", F.aggregate(steps, start, step)["cdf"]), "mix-rates")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy: str = "copy") -> DataFrame:
    """docs, each row as often as drawn (often not at all), with its copy's number from 0, in global random order.

    Expected bytes: epochs times those of docs, shared among the sources as weights say (see rates). Null is a source
    like any other. Rows with the same id get the same draw and the order among them (ties) is free; null ids count as one id.
    A null or empty text counts as no bytes and is copied as its source is; a very long one is copied whole. An empty
    table gives no rows. A column of docs named as copy is replaced; other names never clash.
    """
    docs = docs.drop(copy)
    found = rates(docs, weights, alpha, epochs, source_col, text_col)
    src, rate, part, cdf, key = (free_name(docs, f"mix_{x}") for x in ("source", "rate", "part", "cdf", "key"))
    found = found.toDF(src, rate, part, cdf)
    found = F.broadcast(found) if found.count() <= BROADCAST_SOURCES else found
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    # The variate: how many values of the distribution function the number has reached. One hash for each part of the mean.
    drawn = F.transform(F.sequence(F.lit(1), F.col(part)), lambda j: uniform(F.lit(str(seed)), ident, j.cast("string")))
    n = F.aggregate(drawn, F.lit(0), lambda a, u: a + F.size(F.filter(cdf, lambda c: c <= u)))
    copies = docs.join(found, F.col(source_col).eqNullSafe(F.col(src))).withColumn(copy, n).where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copy) - 1)))
    # Rows without an id are dealt by their text too, so that many of them are no hot key.
    mixed = copies.select(*docs.columns, copy).withColumn(key, F.xxhash64(F.lit(seed), ident, F.col(copy), F.when(F.col(id_col).isNull(), F.xxhash64(text_col))))
    return mixed.repartition(partitions(docs.sparkSession), key).sortWithinPartitions(key).drop(key)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the copies as rows of their own, without the copy's number. Nulls, ties, repeated rows, empty tables and
    names as in mix."""
    copy = free_name(docs, "mix_copy")
    return mix(docs, copy=copy).drop(copy)


OP2_SQL = """
WITH s AS (SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS DOUBLE) AS b FROM documents GROUP BY source),
t AS (SELECT sum(sqrt(b)) AS w, sum(b) AS b FROM s),
r AS (SELECT source, CASE WHEN s.b > 0 THEN sqrt(s.b) / t.w * t.b / s.b ELSE 1.0 END AS rate FROM s, t),
p AS (SELECT source, rate, greatest(1, CAST(ceil(rate / 16.0) AS INTEGER)) AS part FROM r),
k AS (SELECT source, part, rate / part AS mean, unnest(range(0, CAST(ceil(rate / part + 12 * sqrt(rate / part) + 20) AS INTEGER) + 1)) AS k FROM p),
c AS (SELECT source, part, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT doc_id, source, CAST(CAST('0x' || substr(md5('17|' || doc_id || '|' || j), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM (SELECT doc_id, d.source, unnest(range(1, part + 1)) AS j FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source)),
n AS (SELECT u.doc_id, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY u.doc_id)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(0, n)) AS INTEGER) AS copy FROM documents JOIN n USING (doc_id)
"""
