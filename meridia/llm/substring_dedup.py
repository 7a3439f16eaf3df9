"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where it falls below a threshold. Where chunks end depends on
the bytes just before alone, so text inserted elsewhere shifts no later chunk. Chunks are deduplicated by a 128-bit
BLAKE2 digest: of equal chunks those of the least id stay. A passage's first and last chunk reach into what surrounds it;
so both ends of a run of repeated chunks are compared byte by byte with the text that the chunks come from, and the
run ends where the texts do. Runs are cut if they have enough words, so that phrases which happen to recur are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .words import GOLDEN, U64, Text, chunks, mix, words

#: Bytes of context of the gear hash; bytes between candidates on average; fewest bytes between an end and the candidate before; most bytes of a chunk.
WINDOW, MEAN_GAP, LEAST_GAP, MOST = 16, 24, 8, 2048
#: Bytes of the tables of repeated chunks' places up to which they are broadcast to the texts; beyond, both are shuffled. So low that all
#: but small tables go one way, and grow in proportion.
BROADCAST_BYTES = 1 << 20
#: Bytes on either side of a chunk up to which a run is extended; in text that is not all alike one chunk in 150 is longer.
REACH = 128
_GEAR = (mix(np.arange(1, 257, dtype=U64) * GOLDEN) >> U64(32)).astype(np.uint32)


@dataclass
class Cuts:
    """start, end: byte places of the chunks; first: number of the first chunk of each document, with one more bound; a, b:
    digest; same: number of the first equal chunk in the same document, the chunk's own if there is none before."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    a: np.ndarray
    b: np.ndarray
    same: np.ndarray


def cuts(text: Text) -> Cuts:
    raw, bounds = text.bytes, text.bounds
    n = len(raw)
    none = np.zeros(0, np.int64)
    if not n:
        return Cuts(none, none, np.zeros(len(bounds), np.int64), none, none, none)
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):  # sums of 2, 4, 8 and 16 shifted entries
        h[k:] += h[:-k] << np.uint32(k)
    follows = np.zeros(n + 1, bool)
    follows[:n] = (raw & 0xC0) == 0x80  # a byte inside a code point
    doc_of = lambda at: np.searchsorted(bounds, at, "right") - 1
    ends = np.flatnonzero((h >> np.uint32(16)) < 65536 // MEAN_GAP) + 1
    ends = ends[(ends < n) & ~follows[ends]]
    ends = ends[ends - bounds[doc_of(ends - 1)] >= WINDOW]  # nothing of the document before has a say
    same = np.append(False, doc_of(ends[1:] - 1) == doc_of(ends[:-1] - 1)) if len(ends) else np.zeros(0, bool)
    ends = ends[~same | (np.diff(ends, prepend=-MOST) >= LEAST_GAP)]
    edges = np.unique(np.concatenate((ends, bounds)))
    gaps = np.diff(edges)
    long = np.flatnonzero(gaps > MOST)
    if len(long):
        extra = np.concatenate([np.arange(edges[i] + MOST, edges[i + 1], MOST) for i in long.tolist()])
        for _ in range(3):
            extra = extra - follows[extra]
        edges = np.unique(np.concatenate((edges, extra)))
    start, end = edges[:-1], edges[1:]
    whole = memoryview(np.ascontiguousarray(raw))
    digest = b"".join(blake2b(whole[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), end.tolist(), strict=True))
    a, b = np.frombuffer(digest, U64).reshape(-1, 2).T.copy()
    doc = doc_of(start)
    order = np.lexsort((a, doc))
    new = np.ones(len(start), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    same = np.empty(len(start), np.int64)
    same[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return Cuts(start, end, np.searchsorted(start, bounds), a, b, same)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            c = cuts(part)
            first = pa.array(c.first, pa.int32())
            lists = [pa.ListArray.from_arrays(first, x) for x in (pa.array(c.a.view(np.int64)), pa.array(c.b.view(np.int64)), pa.array(c.same != np.arange(len(c.same))))]
            yield pa.record_batch([part.rows.column(0), part.rows.column(1), *lists], names=["id", "text_key", "a", "b", "again"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes before and behind each wanted chunk (its first place) in texts that have it."""
    for batch in batches:
        for part in chunks(batch, "text"):
            c = cuts(part)
            wanted = part.rows.column(part.rows.schema.get_field_index("wanted"))
            out: list[tuple[int, int, bytes, bytes]] = []
            for d in range(len(part.rows)):
                lo, hi = int(part.bounds[d]), int(part.bounds[d + 1])
                own = slice(int(c.first[d]), int(c.first[d + 1]))
                place = {}
                for k, (a, b) in enumerate(zip(c.a[own].view(np.int64).tolist(), c.b[own].view(np.int64).tolist(), strict=True), own.start):
                    place.setdefault((a, b), k)
                for x in wanted[d].as_py():
                    k = place.get((x["a"], x["b"]))
                    if k is not None:
                        i, j = int(c.start[k]), int(c.end[k])
                        out.append((x["a"], x["b"], part.bytes[max(lo, i - REACH) : i].tobytes(), part.bytes[j : min(hi, j + REACH)].tobytes()))
            a, b, left, right = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b", "left", "right"])


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that both have at the end."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8)[::-1][:n], np.frombuffer(b, np.uint8)[::-1][:n]
    unlike = np.flatnonzero(x != y)
    return int(unlike[0]) if len(unlike) else n


def _extended(part: Text, c: Cuts, d: int, edges: list[dict], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's runs, extended as far as the texts agree that their edge chunks come from."""
    lo, hi = int(part.bounds[d]), int(part.bounds[d + 1])
    start, end = start.copy(), end.copy()
    for x in edges:
        k = int(c.first[d]) + x["pos"]
        i, j = int(c.start[k]), int(c.end[k])
        run = int(np.searchsorted(start, i, "right")) - 1
        if x["left"] is not None:
            start[run] = min(start[run], i - _shared(part.bytes[max(lo, i - REACH) : i].tobytes(), x["left"]))
        if x["right"] is not None:
            end[run] = max(end[run], j + _shared(part.bytes[j : min(hi, j + REACH)].tobytes()[::-1], x["right"][::-1]))
    # Runs that have grown into each other are one.
    apart = np.append(True, start[1:] > np.maximum.accumulate(end)[:-1])
    return start[apart], np.maximum.reduceat(end, np.flatnonzero(apart))


def _cut(batches: Iterator[pa.RecordBatch], min_words: int, within: bool, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            c, w = cuts(part), words(part)
            gone = part.rows.column(part.rows.schema.get_field_index("gone"))
            size = np.array([len(g) if g is not None else 0 for g in gone.to_pylist()], np.int64) if gone.null_count < len(gone) else np.zeros(len(gone), np.int64)
            flag = np.zeros(len(c.start), bool)
            flag[np.repeat(c.first[:-1], size) + gone.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = True
            flag = flag[c.same]  # repeats of a chunk in its document share its fate
            if within:
                flag |= c.same != np.arange(len(flag))
            # Runs of flagged chunks, parted where documents are.
            begins, ends = flag.copy(), flag.copy()
            inner = np.ones(len(flag), bool)
            inner[c.first[:-1][c.first[:-1] < len(flag)]] = False
            begins[1:] &= ~(flag[:-1] & inner[1:])
            ends[:-1] &= ~(flag[1:] & inner[1:])
            start, end = c.start[begins], c.end[ends]
            doc = np.searchsorted(part.bounds, start, "right") - 1
            edges = part.rows.column(part.rows.schema.get_field_index("edges"))
            if edges.null_count < len(edges):
                pieces = []
                for d in np.unique(doc).tolist():
                    own = slice(*np.searchsorted(doc, [d, d + 1]))
                    e = edges[d].as_py()
                    pieces.append((start[own], end[own]) if e is None else _extended(part, c, d, e, start[own], end[own]))
                start, end = (np.concatenate(x) for x in zip(*pieces, strict=True)) if pieces else (start, end)
                doc = np.searchsorted(part.bounds, start, "right") - 1
            # From the first whole word on and up to the next one behind the run, but to the text's ends.
            first, last = np.searchsorted(w.start, start), np.searchsorted(w.end, end, "right")
            word_start, nothing = np.append(w.start, len(part.bytes)), len(w.start) == 0
            start = np.where((start == part.bounds[doc]) | nothing, start, np.minimum(word_start[first], part.bounds[doc + 1]))
            end = np.where((end == part.bounds[doc + 1]) | nothing, end, np.minimum(end, word_start[last]))
            keep = (np.searchsorted(w.start, end) - np.searchsorted(w.start, start) >= min_words) & (end > start)
            start, end, doc = start[keep], end[keep], doc[keep]
            spans: list[list] = [[] for _ in range(len(part.bounds) - 1)]
            for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
                spans[d].append({"start": s - int(part.bounds[d]), "end": e - int(part.bounds[d])})
            texts = []
            for d, cut in enumerate(spans):
                raw = part.bytes[part.bounds[d] : part.bounds[d + 1]].tobytes()
                at = [0, *(x for s in cut for x in (s["start"], s["end"])), len(raw)]
                texts.append(b"".join(raw[at[i] : at[i + 1]] for i in range(0, len(at), 2)).decode())
            counts = np.diff(c.first)
            cols = [part.rows.column(0), pa.array(counts, pa.int64()), pa.array(spans, out.field(2).type), pa.array(texts, pa.string())]
            yield pa.record_batch([x.cast(f.type) for x, f in zip(cols, out, strict=True)], schema=out)


def substring_dedup(docs: DataFrame, min_words: int = 25, within: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, n_chunks, removed (byte spans of the UTF-8 text that go), kept_text.

    A run of successive chunks, each of which also stands in a row of a lesser id (or, with within, earlier in the same
    text), is extended to both sides as far as the text agrees with those that its two first and two last chunks come from (REACH bytes
    at most), and goes if at least min_words whole words are in it; words at its ends that are not whole stay. Chunks of no more than one in
    a row are not extended. Null and empty texts have no chunks and are kept
    as empty; very long texts are cut whole and alone. Ids are meant to be unique; rows that repeat the least id (ties)
    are all kept. A null id is more than any other; among null ids nothing goes. An empty table gives no rows; further
    columns are not read, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    chunked = written(rows.mapInArrow(_digests, f"id {kind}, text_key long, a array<long>, b array<long>, again array<boolean>"), "chunks")
    each = chunked.select("id", "text_key", F.posexplode(F.arrays_zip("a", "b", "again")).alias("pos", "c")).where("NOT c.again").select("id", "text_key", "pos", "c.a", "c.b")
    owners = written(each.groupBy("a", "b").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "chunk-owners")
    hits = written(each.join(owners, ["a", "b"]).where("NOT id <=> owner"), "chunk-hits")
    gone = hits.groupBy("id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = written(gone.select(F.col("id").alias("i"), F.col("text_key").alias("k"), "gone"), "chunks-gone")
    edges = _edges(gone, hits, rows)
    both = gone.join(edges.select(F.col("i").alias("i2"), F.col("k").alias("k2"), "edges"), F.col("i").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2")), "left").select("i", "k", "gone", "edges")
    both = written(both, "cuts")
    heavy = F.size("gone") * 4 + 100 + F.coalesce(F.aggregate("edges", F.lit(0), lambda n, e: n + 20 + F.coalesce(F.length(e["left"]), F.lit(0)) + F.coalesce(F.length(e["right"]), F.lit(0))), F.lit(0))
    size = both.agg(F.sum(heavy)).first()[0] or 0
    joined = rows.join(F.broadcast(both) if size <= BROADCAST_BYTES else both, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left").select("id", "text", "gone", "edges")
    schema = docs.sparkSession.createDataFrame([], f"id {kind}, n_chunks long, removed array<struct<start:int,end:int>>, kept_text string").schema
    arrow = to_arrow_schema(schema)
    return joined.mapInArrow(lambda it: _cut(it, min_words, within, arrow), schema).withColumnRenamed("id", id_col)


def _edges(gone: DataFrame, hits: DataFrame, rows: DataFrame) -> DataFrame:
    """(i, k, edges): for each row with hits the two first and two last chunks of its runs, with the bytes that stand before the former and behind the latter in
    the text of their owner."""
    near = lambda i, d: F.coalesce(F.get("gone", i + d) == F.get("gone", i) + d, F.lit(False))
    # In a run of two chunks and more: nothing before, or nothing before the one before.
    left = lambda i: near(i, 1) & ~near(i, -1) | near(i, -1) & ~near(i, -2)
    right = lambda i: near(i, -1) & ~near(i, 1) | near(i, 1) & ~near(i, 2)
    marks = F.transform("gone", lambda p, i: F.struct(p.alias("pos"), left(i).alias("l"), right(i).alias("r")))
    ends = gone.select("i", "k", F.explode(F.filter(marks, lambda m: m["l"] | m["r"])).alias("m")).select("i", "k", "m.pos", "m.l", "m.r")
    told = hits.select(F.col("id").alias("i2"), F.col("text_key").alias("k"), "pos", "a", "b", "owner")
    ends = ends.join(told, [F.col("i").eqNullSafe(F.col("i2")), ends["k"] == told["k"], ends["pos"] == told["pos"]]).select("i", ends["k"], ends["pos"], "l", "r", "a", "b", "owner")
    ends = written(ends.distinct(), "run-ends")
    wanted = written(ends.select("owner", "a", "b").distinct().groupBy("owner").agg(F.collect_list(F.struct("a", "b")).alias("wanted")), "wanted-chunks")
    size = wanted.agg(F.sum(F.size("wanted") * 32 + 60)).first()[0] or 0
    wanted = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
    found = rows.join(wanted, F.col("id") == F.col("owner")).select("id", "text", "wanted").mapInArrow(_contexts, "a long, b long, left binary, right binary")
    found = written(found.groupBy("a", "b").agg(F.min(F.struct("left", "right")).alias("c")), "contexts")
    edge = F.struct("pos", F.when(F.col("l"), F.col("c.left")).alias("left"), F.when(F.col("r"), F.col("c.right")).alias("right"))
    return ends.join(found, ["a", "b"]).groupBy("i", "k").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_chunks", (F.size("removed") > 0).alias("changed"), size.alias("removed_bytes"), "removed", "kept_text")
