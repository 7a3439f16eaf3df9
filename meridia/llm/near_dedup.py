"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its word 5-grams. For each distinct 5-gram a Poisson process runs over (weight, time); the
weight axis is cut into the dyadic blocks [0, 1), [1, 2), [2, 4), [4, 8), ... each with a process of its own, which is
independent of the others and seeded by the 5-gram and the block alone. A document of weight w sees the points below w;
of the block that w cuts, the points whose mark lies below it. Each point falls on one of the registers and a register
keeps its earliest point, so two documents agree in a register with the probability of their weighted Jaccard
similarity. Points come in order of time, and a process stops as soon as it is past the latest register of its document.

Banding gives candidates, the real multisets decide, and classes are the connected components of the links found. A
band's bucket is never turned into all of its pairs: its members are first compared with one leader, the member with the
most company over all bands. Members that are not in their leader's component by then are compared with the rest of
their bucket in blocks of bounded size: a row is a pair of blocks, the overlaps in it are matrix products, and only
links come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators.graph import linked

from .common import free_name, table, written
from .words import GOLDEN, U64, Text, chunks, mix, sequence_digests, shingles, words

#: 25 bands of 5 registers: a pair of similarity 0.8 shares a band with probability 0.99995, one of 0.5 with 0.55, of 0.2 with 0.008.
BANDS, ROWS, REGISTERS = 25, 5, 128
#: Documents and 5-grams in a block on average, at most.
BLOCK_DOCS, BLOCK_GRAMS = 256, 1 << 17
#: Shingles whose processes run together.
AT_ONCE = 1 << 18
ID_BITS = U64((1 << 24) - 1)
NEVER = U64(0x7FF0000000000000)


def bags(text: Text, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 48-bit 5-gram hash, count) in order of document and hash."""
    doc, h = shingles(words(text), k)
    key = np.sort((doc.astype(U64) << U64(44)) | (h >> U64(20)))
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(begins, len(key)))
    key = key[begins]
    return (key >> U64(44)).astype(np.int64), key & U64((1 << 44) - 1), weight


def bag_min_hash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """uint64 (docs, registers): each register's earliest point, its time's leading bits before 24 bits of the point's identity. So many
    shingles at a time; those that come later stop the sooner."""
    regs = np.full(docs * registers, NEVER, U64)
    for k in range(0, len(doc), AT_ONCE):
        _run_processes(regs, doc[k : k + AT_ONCE], shingle[k : k + AT_ONCE], weight[k : k + AT_ONCE], docs, registers)
    return regs.reshape(docs, registers)


def _run_processes(regs: np.ndarray, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> None:
    # Blocks below or across the weight: number 0 is [0, 1), number b is [2^(b-1), 2^b).
    blocks = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    of = np.repeat(np.arange(len(weight)), blocks)
    b = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(b > 0, 1 << np.maximum(b - 1, 0), 0)
    width = np.maximum(low, 1).astype(np.float64)  # also the block's rate
    share = np.minimum((weight[of] - low) / width, 1.0)  # part of the block below the weight
    d = doc[of]
    seed = mix(shingle[of] * GOLDEN + b.astype(U64))
    time = np.zeros(len(of))
    n = 0
    while len(d):
        n += 1
        u = mix(seed + U64(n * int(GOLDEN) % (1 << 64)))
        time = time - np.log(((u >> U64(11)) + U64(1)).astype(np.float64) * 2.0**-53) / width
        point = mix(u + U64(0xA24BAED4963EE407))
        key = (time.view(U64) & ~ID_BITS) | (point & ID_BITS)
        seen = ((point >> U64(32)).astype(np.float64) * 2.0**-32) < share
        np.minimum.at(regs, d[seen] * registers + (u[seen] & U64(registers - 1)).astype(np.int64), key[seen])
        last = regs.reshape(docs, registers).max(1)
        live = np.flatnonzero(time.view(U64) < last[d])
        d, seed, time, width, share = d[live], seed[live], time[live], width[live], share[live]


def band_keys(regs: np.ndarray) -> np.ndarray:
    """int64 (docs, BANDS): hash of the identities of a band's points, and of the band's number."""
    ids = (regs & ID_BITS)[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * GOLDEN, (len(regs), BANDS)).copy()
    for i in range(ROWS):
        h = mix(h + ids[:, :, i] * GOLDEN)
    return h.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, text):
            w = words(part)
            a, b = sequence_digests(w)
            n = len(a)
            digest = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * 16), pa.py_buffer(np.column_stack((a, b)).tobytes())])
            keys = band_keys(bag_min_hash(*bags(part), n))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.record_batch([part.rows.column(0), part.rows.column(1), digest, pa.array(w.counts(), pa.int64()), bands], names=["id", "text_key", "digest", "n_words", "bands"])


def similarity(a: Text, b: Text) -> np.ndarray:
    """Weighted Jaccard similarity of the documents of a with those of b, one by one."""
    da, ha, wa = bags(a)
    db, hb, wb = bags(b)
    key = np.concatenate(((da.astype(U64) << U64(44)) | ha, (db.astype(U64) << U64(44)) | hb))
    weight = np.concatenate((wa, wb))
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    both = np.flatnonzero(key[1:] == key[:-1])
    n = len(a.bounds) - 1
    least = np.bincount((key[both] >> U64(44)).astype(np.int64), np.minimum(weight[both], weight[both + 1]), n)
    total = np.bincount(da, wa, n) + np.bincount(db, wb, n)
    return np.where(total > 0, least / np.maximum(total - least, 1), 1.0)


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text_a", 1 << 19):
            (other,) = chunks(part.rows, "text_b", 1 << 62)
            live = similarity(part, other) >= threshold
            yield part.rows.select(["a", "b"]).filter(pa.array(live))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts' multisets of 5-grams have at least this similarity."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _verified(it, threshold), pairs.select("a", "b").schema)


def _gram_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            doc, gram, weight = bags(part)
            # The k-th time that a gram occurs is an element of its own: multisets become sets.
            nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
            element = mix(np.repeat(gram, weight) * GOLDEN + nth.astype(U64))
            first = np.searchsorted(np.repeat(doc, weight), np.arange(len(part.bounds)))
            yield pa.record_batch([part.rows.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(element.view(np.int64)))], names=["node", "grams"])


def _block_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            sides = [batch.column(k)[row].values for k in (0, 1)]
            lists = [x.field("grams") for x in sides]
            sizes = [x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            of = [np.repeat(np.arange(len(n)), n) for n in sizes]
            shared = np.intersect1d(*flat)
            at = [np.minimum(np.searchsorted(shared, x), max(len(shared) - 1, 0)) for x in flat]
            both = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
            for k in range(0, len(shared), 8192):
                m = []
                for x, i, d, n in zip(flat, at, of, sizes, strict=True):
                    own = np.flatnonzero((i >= k) & (i < k + 8192) & (shared[i] == x))
                    dense = np.zeros((len(n), min(8192, len(shared) - k)), np.float32)
                    dense[d[own], i[own] - k] = 1
                    m.append(dense)
                both += m[0] @ m[1].T
            comps = [x.field("comp") for x in sides]
            names = pa.concat_arrays(comps).dictionary_encode().indices.to_numpy()
            apart = names[: len(comps[0]), None] != names[None, len(comps[0]) :]
            i, j = np.nonzero(apart & (both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both)))
            yield pa.record_batch([sides[0].field("node").take(pa.array(i)), sides[1].field("node").take(pa.array(j))], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, comp): for every end of a link (a, b) the least node of its connected component."""
    return linked(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("node"), F.col("component").alias("comp"))


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """For each row: id, text_key (a hash of the text; with the id it names the row), class_id, class_size, kept."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = rows.mapInArrow(lambda it: _signatures(it, "text"), f"id {kind}, text_key long, digest binary, n_words long, bands array<long>")
    signed = written(signed, "signatures")
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")  # its order puts the least id first, null ids last
    # Texts with the same words are one node. Copies fold into one row in each task before the shuffle.
    nodes = signed.groupBy("digest").agg(F.min(row).alias("row"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.where("n_words > 0").select("node", "n_words", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("grams")).where("n > 1")
    members = written(spread.select("node", "band").join(written(shared, "buckets"), "band"), "members")
    company = written(members.groupBy("node").agg(F.sum("n").alias("company")), "company")
    leads = members.join(company, "node").groupBy("band").agg(F.max(F.struct("company", "node"))["node"].alias("lead"))
    leads = written(leads, "leads")
    wanted = nodes.select("node", F.struct("row.id", "row.text_key").alias("row")).join(company.select("node"), "node", "left_semi")
    texts = rows.select(F.struct("id", "text_key").alias("row"), "text").join(wanted, "row").dropDuplicates(["row"]).select("node", "text")
    texts = written(texts, "texts")

    pairs = members.join(leads, "band").where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    links = written(verified(written(pairs, "pairs"), texts, threshold), "links")
    comp = written(components(links), "comp")
    # Members outside their leader's component, against all of their bucket.
    head = leads.select("band", F.col("lead").alias("node")).join(comp, "node", "left").select("band", F.coalesce("comp", "node").alias("head"))
    named = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(written(head, "heads"), "band")
    out_of = written(named.where("comp <> head").select("band", "node", "comp", "grams", "n"), "outside")
    mixed = written(out_of.groupBy("band").agg(F.count(F.lit(1)).alias("outside")), "mixed")
    lists = texts.join(named.join(mixed, "band").select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_gram_lists, "node long, grams array<long>")
    lists = written(lists, "gram-lists")
    blocks_of = lambda n: F.ceil(F.greatest(F.col(n) / BLOCK_DOCS, F.col("grams") * F.col(n) / F.col("n") / BLOCK_GRAMS))

    def blocks(side: DataFrame, n: str, name: str) -> DataFrame:
        """Rows of (band, block): the members whose hash falls on that block; others: the blocks of all members of the band."""
        dealt = side.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), blocks_of(n))).withColumn("others", blocks_of("n")).drop("grams")
        dealt = dealt.join(lists, "node").select("band", "block", "others", F.struct("node", "comp", "grams").alias("m"))
        return written(dealt.groupBy("band", "block", "others").agg(F.collect_list("m").alias(name)), name)

    left = blocks(out_of.join(mixed, "band"), "outside", "outsiders")
    right = blocks(named.join(mixed, "band"), "n", "everyone").select("band", "block", "everyone")
    # A key is a band and one block of its members, so a large bucket is many keys.
    met = left.select("band", "outsiders", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("block")).join(right, ["band", "block"])
    more = written(met.select("outsiders", "everyone").mapInArrow(lambda it: _block_links(it, threshold), "a long, b long").distinct(), "more-links")
    if not more.isEmpty():
        comp = written(components(links.unionByName(more)), "comp")
    found = signed.select("id", "text_key", "digest").join(nodes.select("digest", "node"), "digest").join(comp, "node", "left")
    found = written(found.select("id", "text_key", F.coalesce("comp", "node").alias("class")), "classes")
    classes = found.groupBy("class").agg(F.count(F.lit(1)).alias("class_size"), F.min(row).alias("first"))
    out = found.join(written(classes, "class-sizes"), "class")
    return out.select("id", "text_key", F.col("first.id").alias("class_id"), "class_size", (row == F.col("first")).alias("kept"))


def near_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, class_id (least id of its class), class_size, kept (the row has that id).

    Two documents are linked if the multisets of their word 5-grams overlap by threshold or more (sum of lesser counts by
    sum of greater counts); a class is a connected component of links. Texts with the same words in the same order are
    one node, and so are all texts without words, null and empty ones among them. A document of fewer than five words
    has one gram of all its words. Very long texts are taken whole and alone; a text's grams must fit a task. Ids are
    meant to be unique; rows that repeat id and text share their fate, rows that repeat an id alone are texts of their
    own, and of a class's rows with the least id one text is kept. A null id is in a class by its text like any other,
    and is kept only in a class without ids (class_id null), of whose texts one is kept. Ties between buckets' leaders
    change no class. An empty table gives no rows; further columns are not read, whatever their names.
    """
    found = _classes(docs, threshold, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one document, that with the least id, null ids last; very long texts, nulls and empty
    tables as in near_classes. Rows that repeat both id and text fold into one, any of them. All columns stay, whatever their names."""
    key = free_name(docs, "near_key")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")))
    found = written(_classes(docs, 0.8, "doc_id", "text").select(F.struct("id", "text_key").alias(key), "kept"), "near-rows")
    kept = keyed.join(found.where("NOT kept").select(key), key, "left_anti")
    again = written(found.where("kept").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "near-again")
    if not again.isEmpty():
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)
