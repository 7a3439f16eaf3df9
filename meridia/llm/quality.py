"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from how its characters follow one another and how its words
repeat; gated attention, learnt from document labels alone, weighs the passages, and the weighted representation is
scored. The model is fitted on a bounded sample of labelled documents; every passage of every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, table
from .words import GOLDEN, U64, Text, chunks, mix, words

#: Bytes of a passage.
PASSAGE = 512
#: Labelled documents that a model is fitted on, at most.
SAMPLE = 4000
#: Passages of each of them, at most.
SAMPLE_PASSAGES = 64
#: Passages that are encoded at a time.
SPAN = 2048
#: Score from which a document is predicted to be good.
CUT = 0.7


def _classes() -> np.ndarray:
    """Byte to kind of character: lower, upper, digit, space, newline, four kinds of marks, other ASCII, beyond ASCII, none."""
    kind = np.full(256, 9, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"'\"()-", b"!?", b"|/\\<>[]{}")):
        kind[list(chars)] = k
    kind[128:] = 10
    return kind


KIND, KINDS = _classes(), 11
LAGS = (1, 2, 3, 4, 6, 8)
WIDTH = KINDS * KINDS + len(LAGS) + 3


def passages(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the passages, and the number of the first passage of each document with one more bound. A document
    without text has one passage without bytes."""
    size = np.diff(text.bounds)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate(([0], np.cumsum(count)))
    nth = np.arange(int(first[-1])) - np.repeat(first[:-1], count)
    return np.append(np.repeat(text.bounds[:-1], count) + nth * PASSAGE, text.bounds[-1]), first


def encode(text: Text, bounds: np.ndarray) -> np.ndarray:
    """float32 (passages, WIDTH), each passage by its own bytes alone; one without bytes is all zeros."""
    total = len(bounds) - 1
    out = np.zeros((total, WIDTH), np.float32)
    raw = text.bytes[bounds[0] : bounds[-1]]
    if not len(raw):
        return out
    bounds = bounds - bounds[0]
    size = np.diff(bounds)
    of = np.repeat(np.arange(total), size)
    kind = KIND[raw]
    before = np.concatenate(([4], kind[:-1]))
    before[bounds[:-1][size > 0]] = 4
    pairs = np.bincount((of * KINDS + before) * KINDS + kind, minlength=total * KINDS * KINDS).reshape(total, KINDS * KINDS)
    length = np.maximum(size, 1)
    out[:, : KINDS * KINDS] = np.sqrt(pairs / length[:, None])
    w = words(Text(text.rows, raw, bounds))
    if len(w.hash):
        wp = of[w.start]
        count = np.maximum(np.bincount(wp, minlength=total), 1)
        for i, lag in enumerate(LAGS):
            same = np.zeros(len(wp), bool)
            same[lag:] = (w.hash[lag:] == w.hash[:-lag]) & (wp[lag:] == wp[:-lag])
            out[:, KINDS * KINDS + i] = np.bincount(wp[same], minlength=total) / count
        key = np.sort((wp.astype(U64) << U64(40)) | (mix(w.hash + GOLDEN) >> U64(24)))
        distinct = key[np.concatenate(([True], key[1:] != key[:-1]))] >> U64(40)
        out[:, -3] = np.bincount(distinct.astype(np.int64), minlength=total) / count
        out[:, -2] = np.bincount(wp, w.end - w.start, total) / count / 10
    out[size > 0, -1] = np.log1p(length[size > 0]) / 6
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def hidden(m: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """Passages to h, which encodes, t * s, which gates, and e, the attention before it is shared out."""
    h = np.tanh(x @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    return {"h": h, "t": t, "s": s, "e": (t * s) @ m["w"]}


def pooled(m: dict[str, np.ndarray], h: np.ndarray, e: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Passages to documents: a weighs within each document, z is the document, p its score."""
    at, n = first[:-1], np.diff(first)
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
    a /= np.repeat(np.add.reduceat(a, at), n)
    z = np.add.reduceat(a[:, None] * h, at)
    return {"a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["d"])}


def forward(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    f = hidden(m, x)
    return f | pooled(m, f["h"], f["e"], first)


def gradients(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(m, x, first)
    n = np.diff(first)
    h, t, s, a = f["h"], f["t"], f["s"], f["a"]
    dy = (f["p"] - y) / len(y)
    dz = np.repeat(dy[:, None] * m["c"], n, 0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), n))
    dts = de[:, None] * m["w"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    pre = (a[:, None] * dz + dt @ m["V"].T + ds @ m["U"].T) * (1 - h * h)
    return {"W": x.T @ pre, "b": pre.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ dy, "d": dy.sum()}


def train(bags: list[np.ndarray], labels: np.ndarray, width: int = 24, epochs: int = 30, batch: int = 128, seed: int = 3) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of documents; the same bags give the same model."""
    rng = np.random.default_rng(seed)
    shape = {"W": (WIDTH, width), "b": (width,), "V": (width, width), "U": (width, width), "w": (width,), "c": (width,), "d": ()}
    m = {k: np.asarray(rng.normal(0, 1 / np.sqrt(v[0] if v else 1), v) if k not in "bd" else np.zeros(v), np.float64) for k, v in shape.items()}
    one, two, step = {k: np.zeros(v) for k, v in shape.items()}, {k: np.zeros(v) for k, v in shape.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            x, first = np.concatenate([bags[i] for i in own]).astype(np.float64), np.concatenate(([0], np.cumsum([len(bags[i]) for i in own])))
            step += 1
            for name, g in gradients(m, x, first, labels[own]).items():
                one[name] = 0.9 * one[name] + 0.1 * g
                two[name] = 0.999 * two[name] + 0.001 * g * g
                m[name] = m[name] - 0.01 * (one[name] / (1 - 0.9**step)) / (np.sqrt(two[name] / (1 - 0.999**step)) + 1e-8) - 1e-5 * m[name]
    return m


def _bags(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in chunks(b, "text"):
            bounds, first = passages(part)
            bags = []
            for i, j in zip(first.tolist(), first[1:].tolist()):
                own = np.unique(np.linspace(i, j - 1, min(most, j - i)).round().astype(np.int64))
                bags.append(b"".join(encode(part, bounds[[k, k + 1]]).tobytes() for k in own.tolist()) if j - i > most else encode(part, bounds[i : j + 1]).tobytes())
            yield pa.record_batch([pa.array(bags, pa.binary()), part.rows.column(1)], names=["bag", "label"])


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, most: int = SAMPLE_PASSAGES, id_col: str = "doc_id", text_col: str = "text") -> dict[str, np.ndarray]:
    """A model from at most sample labelled documents that are not held out, chosen by a hash of their id, and at most so many
    passages of each, evenly spread; so the driver gets sample * most * WIDTH * 4 bytes at most (139 MB).

    A document with several labels has their majority, a tie counts as 1; null labels and ids are passed over. Null and
    empty texts are one empty passage, very long ones are sampled; of rows that repeat an id the greatest text is learnt from. Without any label, or with labels of one kind only, or of an empty table, the model is what such labels teach. Further columns are not read.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    picked = picked.groupBy("id").agg(F.max("text").alias("text"), F.first("label").alias("label")).select("text", "label")  # sample rows at most
    rows = picked.mapInArrow(lambda it: _bags(it, most), "bag binary, label double").toArrow().to_pydict()
    order = sorted(range(len(rows["bag"])), key=lambda i: rows["bag"][i])  # the same order whatever the partitions
    bags = [np.frombuffer(rows["bag"][i], np.float32).reshape(-1, WIDTH) for i in order]
    return train(bags, np.array([rows["label"][i] for i in order]))


def _scores(batches: Iterator[pa.RecordBatch], model, text: str, name: str) -> Iterator[pa.RecordBatch]:
    m = {k: v.astype(np.float32) for k, v in model.value.items()}
    for b in batches:
        for part in chunks(b, text):
            bounds, first = passages(part)
            # A long document's passages are encoded some at a time; only their hidden states are kept.
            some = [hidden(m, encode(part, bounds[k : k + SPAN + 1])) for k in range(0, len(bounds) - 1, SPAN)]
            h, e = (np.concatenate([x[k] for x in some]) for k in "he")
            yield part.rows.append_column(name, pa.array(pooled(m, h, e, first)["p"].astype(np.float64)))


def score(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 by the whole text alone. Null and empty texts are one empty passage and get that
    passage's score; equal texts (repeated rows, ties) get equal scores; very long texts are read whole, some passages at a time;
    an empty table stays empty. A column already named as the score is replaced, no other name clashes."""
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _scores(it, sent, text_col, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents predicted to be good. Nulls, empty and very long texts, repeated rows and empty tables as in
    score; all columns stay, whatever their names."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "quality_score")
    return score(docs, model, name=name).where(F.col(name) >= CUT).select(*docs.columns)
