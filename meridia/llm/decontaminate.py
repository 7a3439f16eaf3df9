"""Benchmark decontamination by suffix arrays over the training text.

Every task cuts its documents into shards of about a million bytes and builds each shard's word suffix array by prefix
doubling. Every window of every benchmark item is binary-searched in every shard, all of them at once, which gives the
interval of places that hold it; stretches of windows are followed to their whole length where locations are asked for.
Documents and items never leave their tasks; the benchmark lies in blocks of bounded size in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import free_name, fresh_path, table, written
from .words import U64, Text, chunks, words

#: Bytes of benchmark text in one block, which a task holds at a time.
BLOCK_BYTES = 16 << 20
#: Places of a suffix array, at most.
SHARD_WORDS = 1 << 20
#: Shards that are searched together, each block being read once for them.
SHARDS = 16
#: Pairs of windows and places that are spread out at a time.
AT_ONCE = 1 << 20
SPAN = "array<struct<start:int,end:int>>"


def suffix_array(words_: np.ndarray, depth: int) -> np.ndarray:
    """Places of words_ in the order of the word sequences that start there, compared up to depth words at least (ties by
    place). Words compare as numbers. Prefix doubling: each round sorts only places that are still tied."""
    n = len(words_)
    order = np.argsort(words_, kind="stable")
    head = np.empty(n, bool)
    head[:1] = True
    np.not_equal(words_[order][1:], words_[order][:-1], out=head[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]  # the place in order where its class begins
    k = 1
    while k < depth:
        last = np.append(head[1:], True)
        tied = np.flatnonzero(~(head & last))  # slots of classes with more than one member
        if not len(tied):
            break
        at = order[tied]
        after = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[at]))
        at, after = at[by], after[by]
        order[tied] = at
        own = rank[at]
        new = np.ones(len(tied), bool)
        new[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        head[tied] = new
        rank[at] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        k *= 2
    return order


def equal_runs(order: np.ndarray, flat: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For places in word order: the number of each one's class, equal if as many words as both need are equal."""
    if not len(order):
        return order
    i, j, n = order[:-1], order[1:], len(flat)
    same = need[:-1] == need[1:]
    for k in range(int(need.max())):
        same &= (k >= need[1:]) | (flat[np.minimum(i + k, n - 1)] == flat[np.minimum(j + k, n - 1)])
    return np.cumsum(np.append(False, ~same))


class Items:
    """A block of distinct item texts as word arrays. Windows that several texts have, or one has often, are one class: each class is searched
    once, and texts stands for the distinct texts of class c at places texts_of[c] to texts_of[c + 1]."""

    def __init__(self, texts: pa.Array, ids: pa.ListArray, window: int):
        rows = pa.record_batch([texts], names=["t"])
        parts = [words(t) for t in chunks(rows, "t")]
        counts = np.concatenate([p.counts() for p in parts]) if parts else np.zeros(0, np.int64)
        self.ids, self.values, self.bounds = ids, ids.flatten(), np.append(0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        self.flat, self.first = flat_words(np.concatenate([p.hash for p in parts]) if parts else np.zeros(0, U64), counts)
        self.item = np.repeat(np.arange(len(counts)), counts + 1)
        self.left = self.first[1:][self.item] - 1 - np.arange(len(self.flat))  # words from here to the item's end; 0 at its separator
        self.need = np.minimum(window, counts)[self.item]  # words of a window of its item
        order = suffix_array(self.flat, window)
        starts = order[(self.left[order] >= self.need[order]) & (self.need[order] > 0)]
        starts = starts[np.lexsort((np.arange(len(starts)), self.need[starts]))]  # by need, in word order within
        self.starts, kind = starts, equal_runs(starts, self.flat, self.need[starts])
        self.start_of = np.searchsorted(kind, np.arange((int(kind[-1]) if len(kind) else -1) + 2))  # first window of each class, with one more bound
        self.one = starts[self.start_of[:-1]]  # a window of each class
        pair = np.unique(kind * max(len(counts), 1) + self.item[starts])
        self.texts = pair % max(len(counts), 1)
        self.texts_of = np.searchsorted(pair // max(len(counts), 1), np.arange(len(self.one) + 1))


def flat_words(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a separator, 0, after each text, so that no match passes a text's end; first place of each text, with one more bound."""
    n = len(counts)
    flat = np.zeros(len(hashes) + n, U64)
    flat[np.arange(len(hashes)) + np.repeat(np.arange(n), counts)] = np.where(hashes == 0, U64(1), hashes)
    return flat, np.concatenate(([0], np.cumsum(counts + 1)))


class Shard:
    """Some documents as suffix arrays of up to SHARD_WORDS places each; most shards need one, a very long document several. An array
    sees window - 1 words beyond its places, so that no window is lost between two."""

    def __init__(self, text: Text, window: int):
        self.rows, self.counts = text.rows, (w := words(text)).counts()
        self.flat, self.first = flat_words(w.hash, self.counts)
        self.window = window

    def arrays(self) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(words, their first place in the shard, places in word order)."""
        for k in range(0, len(self.flat), SHARD_WORDS):
            own = self.flat[k : k + SHARD_WORDS + self.window - 1]
            yield own, k, suffix_array(own, self.window)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def search(text: np.ndarray, order: np.ndarray, items: Items, suffix: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """For each item suffix, cut to length words: the first slot of the array whose place is not less (upper: is greater)."""
    text, own = (np.concatenate((x, np.zeros(int(length.max(initial=0)), U64))) for x in (text, items.flat))
    lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(order), np.int64)
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        same, i, less = np.ones(len(live), bool), 0, np.full(len(live), upper)
        place = order[mid]
        while len(open_ := np.flatnonzero(same & (i < length[live]))):
            a, b = text[place[open_] + i], own[suffix[live[open_]] + i]
            differ = a != b
            less[open_[differ]] = a[differ] < b[differ]
            same[open_[differ]] = False
            i += 1
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
    return lo


def ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low[i] to low[i] + size[i] - 1 for each i, one after another."""
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def slices(size: np.ndarray, most: int = AT_ONCE) -> Iterator[slice]:
    """Slices of about most in sum of size; a larger element is alone."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


class Found:
    """The window classes found in one array: kind, and of each its places in the shard (place, from to the next of start)."""

    def __init__(self, array: tuple[np.ndarray, int, np.ndarray], items: Items):
        text, base, order = array
        length = items.need[items.one]
        low, high = (search(text, order, items, items.one, length, upper) for upper in (False, True))
        place, of = order[ranges(low, high - low)], np.repeat(np.arange(len(low)), high - low)
        own = place < SHARD_WORDS  # what begins beyond belongs to the next array
        self.place, of = place[own] + base, of[own]
        self.kind, self.start, self.size = np.unique(of, return_index=True, return_counts=True)
        self.of = of


def hits(shard: Shard, found: Found, items: Items, mask: np.ndarray) -> np.ndarray:
    """document * items + text, once for each item text with a window in the document. Adds the windows' words to mask, as steps up and down."""
    np.add.at(mask, found.place, 1)
    np.add.at(mask, found.place + items.need[items.one[found.of]], -1)
    kinds, n = max(len(items.one), 1), max(len(items.ids), 1)
    pair = np.unique(shard.doc(found.place) * kinds + found.of)  # a class counts once for a document
    doc, of = pair // kinds, pair % kinds
    many, out = items.texts_of[of + 1] - items.texts_of[of], np.zeros(0, np.int64)
    for s in slices(many):
        out = np.union1d(out, np.repeat(doc[s], many[s]) * n + items.texts[ranges(items.texts_of[of[s]], many[s])])
    return out


def stretches(shard: Shard, found: Found, items: Items) -> Iterator[tuple[np.ndarray, ...]]:
    """(item suffix, place, words) of the verbatim stretches of a window or more, as long as they get; a bounded number at a time."""
    many = items.start_of[found.kind + 1] - items.start_of[found.kind]
    for s in slices(many):
        suffixes, own, start = items.starts[ranges(items.start_of[found.kind[s]], many[s])], np.repeat(found.size[s], many[s]), np.repeat(found.start[s], many[s])
        for t in slices(own):
            place, suffix = found.place[ranges(start[t], own[t])], np.repeat(suffixes[t], own[t])
            # Of windows that continue one another only the first is told, with its whole length.
            before = (place > 0) & (suffix > items.first[items.item[suffix]])
            before[before] = shard.flat[place[before] - 1] == items.flat[suffix[before] - 1]
            place, suffix = place[~before], suffix[~before]
            yield suffix, place, common_prefix(shard, place, suffix, items)


def common_prefix(shard: Shard, at: np.ndarray, suffix: np.ndarray, items: Items) -> np.ndarray:
    """Words that the text at these places and these item suffixes have in common."""
    out, live = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(live):
        i = out[live]
        live = live[i < items.left[suffix[live]]]
        i = out[live]
        live = live[shard.flat[at[live] + i] == items.flat[suffix[live] + i]]
        out[live] += 1
    return out


class Blocks:
    """The benchmark's blocks, written in the shared folder; a task holds one at a time."""

    def __init__(self, path: str, files: list[str], window: int):
        self.path, self.files, self.window, self.kept = path, files, window, (None, None)

    def __iter__(self) -> Iterator[Items]:
        for f in self.files:
            if self.kept[0] != f:
                fs, _ = pafs.FileSystem.from_uri(self.path)
                rows = pq.read_table(f, filesystem=fs).combine_chunks()
                self.kept = f, Items(rows.column("text").combine_chunks(), rows.column("ids").combine_chunks(), self.window)
            yield self.kept[1]


def blocks_of(benchmark: DataFrame, window: int, item_id: str, item_text: str) -> Blocks:
    """Writes the items in blocks of about BLOCK_BYTES, equal texts as one with all their ids; the driver gets the files' names."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    folded = written(items.groupBy("text").agg(F.sort_array(F.collect_set("i")).alias("ids")).select("text", "ids"), "items")
    many = max(1, -(-(folded.agg(F.sum(F.octet_length("text") + 64 + 16 * F.size("ids"))).first()[0] or 0) // BLOCK_BYTES))
    path = fresh_path(benchmark.sparkSession, "item-blocks")
    folded.repartition(many).write.parquet(path)
    fs, root = pafs.FileSystem.from_uri(path)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet"))
    return Blocks(path, files, window)


def _found(batches: Iterator[pa.RecordBatch], blocks: Blocks, text: str, keep: list[str], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """keep, n_words, hit_spans and item ids. All blocks are searched in one array for each shard."""
    for parts in (p for batch in batches for p in batched(chunks(batch, text), SHARDS)):
        shards = [Shard(part, blocks.window) for part in parts]
        masks = [np.zeros(len(s.flat) + 1, np.int64) for s in shards]
        found: list[list] = [[] for _ in shards]
        arrays = [list(s.arrays()) for s in shards]
        for items in blocks:
            n = max(len(items.ids), 1)
            for shard, mask, own, some in zip(shards, masks, found, arrays, strict=True):
                pair = np.unique(np.concatenate([np.zeros(0, np.int64), *(hits(shard, Found(a, items), items, mask) for a in some)]))
                doc, t = pair // n, pair % n
                size = items.bounds[t + 1] - items.bounds[t]
                own.append((np.repeat(doc, size), items.values.take(pa.array(ranges(items.bounds[t], size)))))
        for shard, mask, own in zip(shards, masks, found, strict=True):
            n, rows = len(shard.counts), shard.rows
            edge = np.diff(np.concatenate(([False], np.cumsum(mask) > 0)).astype(np.int8))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            doc = shard.doc(start)
            base = shard.first[doc]
            span = pa.StructArray.from_arrays([pa.array(start - base, pa.int32()), pa.array(end - base, pa.int32())], names=["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), span)
            doc = np.concatenate([d for d, _ in own]) if own else np.zeros(0, np.int64)
            order = np.argsort(doc, kind="stable")
            ids = pa.concat_arrays([v for _, v in own]).take(pa.array(order)) if own else pa.array([], out.field(-1).type.value_type)
            ids = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(n + 1)), pa.int32()), ids)
            new = [*(rows.column(rows.schema.get_field_index(c)) for c in keep), pa.array(shard.counts, pa.int64()), spans, ids]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(new, out, strict=True)], schema=out)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("n_words", "hit_spans", "items")) -> DataFrame:
    """docs (or the columns keep of it) with names: n_words, hit_spans (word spans inside an occurrence of a window) and items (ids
    of the items with a window there, each once).

    A window is that many successive words of an item; an item of fewer, but not none, is one window; an item without
    words, or null, has none. Null and empty documents have no words; an empty table gives no rows, an empty benchmark no
    hits. Items of equal texts (ties) are all told; repeated rows of documents have the same result each. A very long
    document is a shard of its own, in several arrays. The benchmark lies in blocks of about BLOCK_BYTES in the shared folder, and a task
    holds one at a time. Columns of docs named as the new ones are replaced, no other name clashes.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    blocks = blocks_of(benchmark, window, item_id, item_text)
    new = T.StructType.fromDDL(f"`{names[0]}` long, `{names[1]}` {SPAN}, `{names[2]}` array<{benchmark.schema[item_id].dataType.simpleString()}>")
    schema = T.StructType([*docs.select(*keep).schema.fields, *new.fields])
    arrow = to_arrow_schema(schema)
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(lambda it: _found(it, blocks, text_col, keep, arrow), schema)


def _stretches(batches: Iterator[pa.RecordBatch], blocks: Blocks, text: str, id_col: str, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, text):
            shard = Shard(part, blocks.window)
            arrays = list(shard.arrays())
            for items in blocks:
                for suffix, place, n in (x for a in arrays for x in stretches(shard, Found(a, items), items)):
                    doc, item = shard.doc(place), items.item[suffix]
                    size = items.bounds[item + 1] - items.bounds[item]
                    for s in slices(size):  # an item's ids are rows of their own
                        ids = items.values.take(pa.array(ranges(items.bounds[item[s]], size[s])))
                        row = np.repeat(np.arange(len(item))[s], size[s])
                        own = part.rows.column(part.rows.schema.get_field_index(id_col)).take(pa.array(doc[row]))
                        places = [pa.array(x, pa.int32()) for x in ((suffix - items.first[item])[row], (place - shard.first[doc])[row], n[row])]
                        yield pa.record_batch([x.cast(f.type) for x, f in zip([own, ids, *places], out, strict=True)], schema=out)


def match_locations(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (id_col, item id as item, item_word, doc_word, n_words): every verbatim stretch of a window or more, as long as it gets in both
    texts, and its first word in each. Items and documents as in find_contamination; a lower window tells shorter matches.
    """
    blocks = blocks_of(benchmark, window, item_id, item_text)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item", benchmark.schema[item_id].dataType), *T.StructType.fromDDL("item_word int, doc_word int, n_words int").fields])
    arrow = to_arrow_schema(schema)
    return docs.select(id_col, text_col).mapInArrow(lambda it: _stretches(it, blocks, text_col, id_col, arrow), schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """For each item with a match: its longest verbatim stretch and where it is (of equal ones that of the greatest document id)."""
    return match_locations(docs, benchmark, **how).groupBy("item").agg(F.max(F.struct("n_words", how.get("id_col", "doc_id"), "doc_word", "item_word")).alias("m")).select("item", "m.*")


def count_hits(spans: str = "hit_spans"):
    """Words in the spans, which are apart."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.array_sort(F.array_distinct(F.transform("items", lambda i: i.cast("string"))))
    return found.select(
        "doc_id", "n_words", count_hits().alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated")
    )


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without any window of a benchmark item. Nulls, empty and very long texts, ties, repeated
    rows and empty tables as in find_contamination; all columns stay, whatever their names."""
    names = tuple(free_name(docs, f"leak_{x}") for x in ("words", "spans", "items"))
    return find_contamination(docs, table(spark, sf_dir, "benchmark"), names=names).where(F.size(names[1]) == 0).select(*docs.columns)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, len(w) AS n, least(len(w), 10) AS k, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT item_id, k, w, unnest(range(1, n - k + 2)) AS p FROM g)),
ks AS (SELECT DISTINCT k FROM g),
pos AS (SELECT doc_id, k, w, unnest(range(1, greatest(len(w) - k + 2, 1))) AS p FROM d, ks),
occ AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM pos),
m AS (SELECT o.doc_id, o.p, o.k, win.item_id FROM occ o JOIN win ON o.k = win.k AND o.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h USING (doc_id) LEFT JOIN its i USING (doc_id)
"""
