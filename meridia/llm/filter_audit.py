"""How filters interact: what each of them removes, alone and after others, in every order.

One pass over a text's UTF-8 bytes finds all that the filters ask. It is a transducer with a table: a byte has a class, the
state tells whether a word is open, and the table gives for state and class what there is to count and whether a word
begins or ends. The next state depends on the class alone, so the states of a whole buffer are its classes, shifted by
one, and the table is looked up for millions of bytes at once. The spans of words go into a hash table whose hits are
compared byte by byte, so that words that only share a hash count as different.

Then a document is a mask of the filters that it fails. The orders are worked out on counts of (part, mask), of which
there are 32 at most for each part, and not on documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .words import U64, Text, byte_values, chunks, mix, segment_sums

FILTERS = "ABCDE"
#: Rows of texts that occur more than once up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes that are looked at together.
SPAN = 1 << 22

#: Classes of bytes: inside a code point, other, white space, A-Z, symbol.
INSIDE, OTHER, WHITE, CAPITAL, SYMBOL = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = INSIDE
CLASS[[0x20, *range(0x09, 0x0E)]] = WHITE
CLASS[0x41:0x5B] = CAPITAL
CLASS[list(b"#$%&*|")] = SYMBOL

#: What the transducer puts out, as bits of a byte.
BEGINS, ENDS, IS_POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16


def _emitted() -> np.ndarray:
    """Output for each state (0: between words, 1: in a word) and class."""
    t = np.zeros((2, 5), np.uint8)
    for state in (0, 1):
        for c in range(5):
            t[state, c] = (BEGINS * (not state) if c != WHITE else ENDS * state) | IS_POINT * (c != INSIDE) | IS_CAPITAL * (c == CAPITAL) | IS_SYMBOL * (c == SYMBOL)
    return t


EMITTED = _emitted()


def run(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(byte places where words begin, where they end, and for each document its code points, capitals and symbols)."""
    raw, bounds = text.bytes, text.bounds
    n, docs = len(raw), len(bounds) - 1
    begins, ends, sums = [], [], np.zeros((3, docs), np.int64)
    open_word = 0
    for k in range(0, n, SPAN):
        c = CLASS[raw[k : k + SPAN]]
        state = np.empty(len(c), np.uint8)
        state[0], state[1:] = open_word, c[:-1] != WHITE
        open_word = int(c[-1] != WHITE)
        edge = bounds[np.searchsorted(bounds, k) : np.searchsorted(bounds, k + len(c))] - k
        closed = edge[state[edge] == 1]  # a document's end ends its last word
        state[edge] = 0
        out = EMITTED[state, c]
        begins.append(np.flatnonzero(out & BEGINS) + k)
        ends.append(np.union1d(np.flatnonzero(out & ENDS), closed) + k)
        cut = np.clip(bounds, k, k + len(c)) - k
        for row, bit in enumerate((IS_POINT, IS_CAPITAL, IS_SYMBOL)):
            sums[row] += segment_sums((out & bit > 0).astype(np.int64), cut)
    if open_word:
        ends.append(np.array([n]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *begins]), np.concatenate([none, *ends]), *sums


def distinct_words(text: Text, start: np.ndarray, end: np.ndarray, hashes=None) -> np.ndarray:
    """Different words of each document, case and all. Words of a document with one hash are compared with the first of them byte by byte; those
    that differ are put in place by their bytes."""
    docs = len(text.bounds) - 1
    doc = np.searchsorted(text.bounds, start, "right") - 1
    h = (hashes or word_hashes)(text.bytes, start, end)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else order  # the slot's first word
    found = np.bincount(doc[order[new]], minlength=docs)
    again = np.flatnonzero(~new)
    a, b = order[again], first[again]
    size = end - start
    other = size[a] != size[b]
    same = np.flatnonzero(~other)
    for k in _pieces(size[a[same]]):  # equal lengths: their bytes
        s = same[k]
        n = size[a[s]]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        unlike = text.bytes[np.repeat(start[a[s]], n) + at] != text.bytes[np.repeat(start[b[s]], n) + at]
        other[s] = np.logical_or.reduceat(unlike, np.cumsum(n) - n)
    clash: dict[tuple[int, int], set[bytes]] = {}
    for w in a[other].tolist():
        clash.setdefault((int(doc[w]), int(h[w])), set()).add(text.bytes[start[w] : end[w]].tobytes())
    for (d, _), held in clash.items():
        found[d] += len(held)
    return found


def _pieces(size: np.ndarray) -> Iterator[np.ndarray]:
    """Places in runs of about SPAN bytes."""
    if len(size):
        yield from np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // SPAN)) + 1)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    h = np.zeros(len(start), U64)
    for k in _pieces(size):
        n = size[k]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        h[k] = np.add.reduceat(byte_values(raw[np.repeat(start[k], n) + at], at), first)
    return mix(h + size.astype(U64))


def _failed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            start, end, points, capitals, symbols = run(part)
            words = np.diff(np.searchsorted(start, part.bounds))
            distinct = distinct_words(part, start, end)
            mask = (words < 200) * 1 | (100 * distinct < 50 * words) * 2 | (100 * capitals > 3 * points) * 4 | (symbols > 0) * 8
            cols = [part.rows.column(k) for k in range(3)]
            yield pa.record_batch([*cols, *(pa.array(x, pa.int64()) for x in (words, distinct, capitals, points, symbols)), pa.array(mask, pa.int32())], names=["id", "part", "digest", "words", "distinct", "capitals", "points", "symbols", "failed"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each row of docs: id, part, words, distinct, capitals, points (code points), symbols, failed.

    failed is a mask: 1 (A) under 200 words, 2 (B) less than half of the words different, 4 (C) over 3 % of the code points A-Z, 8 (D)
    any of #$%&*|, 16 (E) a row with a smaller id has the same text, by SHA-256. Null texts are empty and equal to each other; an empty text fails A, and E as others
    do. Very long texts are taken whole and alone. A null id is more than any other, null ids (as equal ids) do not fail E by
    each other. A null part is the empty string. No rows give no rows; further columns are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    seen = written(rows.mapInArrow(_failed, f"id {kind}, part string, digest binary, words long, distinct long, capitals long, points long, symbols long, failed int"), "audit-rows")
    copies = seen.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 AND least IS NOT NULL").select("digest", "least")
    copies = written(copies, "audit-copies")
    both = seen.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "digest", "left")
    copy = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    return both.withColumn("failed", F.col("failed") + F.when(copy, 16).otherwise(0)).select("id", "part", "words", "distinct", "capitals", "points", "symbols", "failed")


def interaction(counts: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic) to a row for each part, order of the filters and step: see audit. Rows of counts are few: 32 masks a part."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        for k, own in enumerate(order):
            steps.append(F.struct(F.lit("".join(FILTERS[f] for f in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << own).alias("own"), F.lit(sum(1 << f for f in order[:k])).alias("before")))
    each = counts.withColumn("s", F.explode(F.array(*steps))).select("part", "failed", "n", "good", "toxic", "s.*")
    hit = lambda c: F.col("failed").bitwiseAND(F.col(c)) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    removed = hit("own") & ~hit("before")
    # Of the filters that a document fails each is the first in equally many orders.
    share = F.when(hit("own"), F.col("n") * F.floor(F.lit(len(steps) // len(FILTERS)) / F.bit_count("failed"))).otherwise(0)
    return each.groupBy("part", "filter_order", "step").agg(
        total(~hit("own") & ~hit("before")).alias("kept"), total(removed).alias("removed"), total(hit("own") & hit("before")).alias("redundant"), total(F.col("failed") == F.col("own")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each part, each order of the five filters of failures and each step of it: kept (documents left after it), removed (by it), redundant
    (they fail it, but were removed before), unique_fails (they fail it alone), good_lost and toxic_lost (removed, with quality or toxic 1 in labels), shapley (what
    the filter removes, summed over all orders).

    Rows of docs are as in failures. labels has id_col, quality and toxic; of rows that repeat an id (ties) the greatest values hold, null
    ids name no document. A part without rows has none; no documents give no rows.
    """
    found = failures(docs, id_col, text_col, part_col).select("id", "part", "failed")
    named = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    one = lambda c: F.count_if(F.col(c) == 1)
    counts = found.join(named, "id", "left").groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), one("quality").alias("good"), one("toxic").alias("toxic"))
    return interaction(counts)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(ws) < 50 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails,
  coalesce(l.quality = 1, FALSE) AS good, coalesce(l.toxic = 1, FALSE) AS toxic FROM w LEFT JOIN labels l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
g AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, n, good, toxic, fails, CASE WHEN step = 1 THEN FALSE ELSE regexp_matches(fails, '[' || substr(filter_order, 1, step - 1) || '_]') END AS before, contains(fails, substr(filter_order, step, 1)) AS fail FROM c, s),
r AS (SELECT part, filter_order, step, any_value(own) AS own, CAST(coalesce(sum(n) FILTER (WHERE NOT before AND NOT fail), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE NOT before AND fail), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE before AND fail), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE fails = own), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (WHERE NOT before AND fail), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE NOT before AND fail), 0) AS BIGINT) AS toxic_lost FROM g GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
