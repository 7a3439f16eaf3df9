"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has a bit for each bit that more than half of its shingle hashes have. Of two fingerprints that differ
in at most two of 64 bits, two of the four 16-bit quarters are equal, so fingerprints meet in six buckets of 32 bits each.
A bucket of many is dealt again by the two bytes out of the other four that must be equal too: what then lies together
agrees in 48 bits, so no group has more than 2**16 different fingerprints, whatever the data are.

In a group the fingerprints stand vertically, a plane for each bit with a place for each fingerprint. One is compared with
all by a xor for each plane; carry-save counters of two bits and an overflow add up the differences of 64 places at
a time, and a block is left as soon as all of its places are over the radius. Out of a group come links from
each fingerprint to the least that it is connected with there, which keeps every component and never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from meridia.operators.graph import linked

from .common import table, written
from .words import U64, Text, chunks

#: Shingles whose bits are counted together.
AT_ONCE = 1 << 16
#: Members up to which a bucket is one group; a larger one is dealt again. It changes no result.
GROUP = 4096
#: Fingerprints in a block of planes, a multiple of 64, and queries that go through it together.
BLOCK, QUERIES = 4096, 256

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
ALL = ~U64(0)


def shingle_hashes(text: Text, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, XXH64) of every run of k words, joined by one space; a document of fewer words, but not none, has one of all its words."""
    raw, n = LOWER[text.bytes], len(text.bytes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    inside = ~SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[text.bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # The words with one space behind each.
    length = end - start
    to = np.cumsum(length + 1) - length - 1
    packed = np.full(int((length + 1).sum()), 0x20, np.uint8)
    packed[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = raw[inside]
    first = np.searchsorted(start, text.bounds)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    left = first[1:][doc] - np.arange(len(start))  # words from here to the document's end
    at = np.flatnonzero((left >= k) | ((counts[doc] < k) & (left == counts[doc])))
    last = at + np.minimum(left[at], k) - 1
    view = memoryview(packed)
    spans = zip(to[at].tolist(), (to[last] + length[last]).tolist(), strict=True)
    return doc[at], np.fromiter((xxh64_intdigest(view[i:j], seed) for i, j in spans), U64, len(at))


def fingerprints(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """uint64 for each document: the bits that over half of its hashes have; 0 if it has none."""
    ones, n = np.zeros((docs, 64), np.int64), np.bincount(doc, minlength=docs)
    for k in range(0, len(h), AT_ONCE):
        d = doc[k : k + AT_ONCE]
        bits = np.unpackbits(h[k : k + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        ones[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").astype(U64).ravel()


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            f = fingerprints(*shingle_hashes(part, k, seed), len(part.rows))
            yield pa.record_batch([part.rows.column(0), pa.array(f.view(np.int64))], names=["id", "fp"])


def planes(fps: np.ndarray) -> np.ndarray:
    """uint64 (64, words): plane b has bit b of the fingerprints, 64 of them a word; places without one are zero."""
    padded = np.zeros(-(-len(fps) // 64) * 64, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(U64)


def within_radius(queries: np.ndarray, block: np.ndarray, radius: int = 2) -> np.ndarray:
    """bool (queries, places of the block's planes): the fingerprints differ in at most radius (0 to 2) bits."""
    one, two, over = (np.zeros((len(queries), block.shape[1]), U64) for _ in range(3))
    for b in range(64):
        # A query's bit, spread over a word, turns the plane into the differences.
        d = block[b][None, :] ^ (((queries >> U64(b)) & U64(1)) * ALL)[:, None]
        one, carry = one ^ d, one & d
        two, carry = two ^ carry, two & carry
        over |= carry
        if b % 8 == 7 and b < 63:
            dead = over | _beyond(one, two, radius)
            if (dead == ALL).all():
                return np.zeros((len(queries), block.shape[1] * 64), bool)
    near = ~(over | _beyond(one, two, radius))
    return np.unpackbits(near.astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(bool)


def _beyond(one: np.ndarray, two: np.ndarray, radius: int) -> np.ndarray:
    """Places whose two counter bits say more than radius."""
    return (one | two, two, one & two)[radius]


def group_links(fps: np.ndarray, radius: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, another): each that is near others in the group with the least place of its connected component there."""
    n, parent = len(fps), np.arange(len(fps))
    order = np.arange(n)
    for k in range(0, n, BLOCK):
        block = planes(fps[k : k + BLOCK])
        for q in range(k, n, QUERIES):  # a pair meets once, in the block of the lesser place
            i, j = np.nonzero(within_radius(fps[q : q + QUERIES], block, radius)[:, : min(BLOCK, n - k)])
            i, j = i + q, j + k
            _unite(parent, i[j < i], j[j < i])
    far = parent != order
    return fps[far], fps[parent[far]]


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j, all at once; parents are roots afterwards."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups = batch.column(0)
        for k in range(len(batch)):
            a, b = group_links(groups[k].values.to_numpy().view(U64), radius)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])


def bits(fp: Column, at: tuple[int, ...], width: int) -> Column:
    """The fingerprint's pieces of that width at those places, as one number."""
    return sum((F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1)) * F.lit(1 << (width * n)) for n, i in enumerate(at)), F.lit(0).cast("long"))


def near_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (src, dst) between different fingerprints (fp, each once) whose connected components are those of all pairs of at most radius (0 to 2)
    differing bits."""
    quarters, bytes_of = list(combinations(range(4), 2)), {}
    for pair in quarters:
        bytes_of[pair] = list(combinations([b for q in range(4) if q not in pair for b in (2 * q, 2 * q + 1)], 2))
    keys = F.array(*[F.struct(F.lit(t).alias("t"), bits(F.col("fp"), pair, 16).alias("key")) for t, pair in enumerate(quarters)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    size = written(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
    met = written(keyed.join(size, ["t", "key"]), "simhash-members")
    plain = met.where(F.col("n") <= GROUP).groupBy("t", "key").agg(F.collect_list("fp").alias("g")).select("g")
    # Large buckets once more, by two bytes of the rest.
    again = [F.array(*[F.struct(F.lit(u).alias("u"), bits(F.col("fp"), two, 8).alias("key2")) for u, two in enumerate(bytes_of[p])]) for p in quarters]
    which = F.when(F.col("t") == 0, again[0])
    for t in range(1, len(quarters)):
        which = which.when(F.col("t") == t, again[t])
    split = met.where(F.col("n") > GROUP).withColumn("k2", F.explode(which)).groupBy("t", "key", "k2").agg(F.collect_list("fp").alias("g")).where(F.size("g") > 1).select("g")
    return plain.unionByName(split).mapInArrow(lambda it: _links(it, radius), "src long, dst long")


def simhash_classes(docs: DataFrame, radius: int = 2, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, fingerprint (16 hexadecimal digits), component_id.

    A word is a run of what is no ASCII white space, with A-Z lower-cased; a shingle is words of them, and a text of fewer is one
    shingle. A fingerprint's bit is one if over half of the shingles' XXH64 have it, repeats counted. Documents are linked if their
    fingerprints differ in at most radius bits (2 at most); component_id is the least id that is reached over links. Texts without words, null
    and empty ones too, have fingerprint zero and are linked like any other. Very long texts are taken whole and alone. Rows that repeat an
    id are documents of their own, and equal fingerprints (ties) one node; a null id is never the least, and null where a
    component has no other. No rows give no rows; further columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    marked = written(rows.mapInArrow(lambda it: _fingerprints(it, words, seed), f"id {kind}, fp long"), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-nodes")
    of = written(linked(written(near_fingerprints(nodes.select("fp"), radius), "fingerprint-links")).select(F.col("id").alias("fp"), "component"), "fingerprint-components")
    # Only fingerprints with links have a component besides themselves.
    least = of.join(nodes, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    reached = written(of.join(least, "component").select("fp", F.col("component_id").alias("reached")), "fingerprint-least")
    named = written(nodes.join(reached, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id")), "fingerprint-names")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))
