"""Operator 8: document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. A passage is its hashed byte trigrams (square roots of
counts, length 1), encoded by one tanh layer. Gated attention, learned from the documents' labels alone, gives
each passage a weight; the weighted sum of the encodings is scored by a logistic unit.

Scoring is a running sum over passages: the share of each in its document's score needs two numbers (its
attention and its own logit), so a text of any length is read in slabs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import free_name, text_of

PASSAGE, BUCKETS, WIDTH, GATE = 512, 512, 24, 12
#: Passages that are encoded together.
SLAB = 1024
#: The classifier is fitted on at most so many labelled documents (those with the least hashes of their ids).
SAMPLE = 3000
#: ... of at most so many bytes each, and so many bytes together (in the order of the hashes).
TEACH_BYTES, ALL_BYTES = 1 << 20, 48 << 20
#: From this score on a document counts as good.
THRESHOLD = 0.3
_STEP = np.uint32(0x9E3779B1)


def bags(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Trigram counts of consecutive passages of ``data``."""
    lengths = ends - starts
    owner = np.repeat(np.arange(len(starts)), lengths)
    part = data[starts[0] : ends[-1]].astype(np.uint32)
    if len(part) < 3:
        return np.zeros((len(starts), BUCKETS), np.float32)
    h = ((part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]) * _STEP
    cell = owner[:-2] * BUCKETS + (h >> np.uint32(32 - 9)).astype(np.int64)
    inside = owner[:-2] == owner[2:]
    return np.bincount(cell[inside], minlength=len(starts) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)


def slabs(texts: list[bytes]):
    """Passages of the texts in order: (document numbers, bags), at most ``SLAB`` passages at a time."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    counts = -(-(ends - starts) // PASSAGE)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    a = starts[owner] + nth * PASSAGE
    b = np.minimum(a + PASSAGE, ends[owner])
    for i in range(0, len(owner), SLAB):
        yield owner[i : i + SLAB], bags(data, a[i : i + SLAB], b[i : i + SLAB])


def vectors(counts: np.ndarray) -> np.ndarray:
    """What the encoder reads of each passage: the counts' square roots at length 1, the share of trigrams that differ, how far few of them prevail, and the passage's size."""
    out = np.empty((len(counts), BUCKETS + 3), np.float32)
    total = counts.sum(1, dtype=np.float32) + 1e-6
    out[:, :BUCKETS] = np.sqrt(counts) / np.sqrt(total)[:, None]
    out[:, BUCKETS] = 2 * np.count_nonzero(counts, axis=1) / total
    out[:, BUCKETS + 1] = np.sqrt(np.einsum("ij,ij->i", counts, counts) / total) / 2
    out[:, BUCKETS + 2] = np.log1p(total) / 6
    return out


@dataclass
class Model:
    """The weights: ``enc``, ``enc0`` encode; ``tanh``, ``gate``, ``att`` attend; ``out``, ``out0`` score."""

    enc: np.ndarray
    enc0: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    att: np.ndarray
    out: np.ndarray
    out0: np.ndarray

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        h = np.tanh(x @ self.enc + self.enc0)
        t, g = np.tanh(h @ self.tanh), 1 / (1 + np.exp(-(h @ self.gate)))
        return h, t, g, (t * g) @ self.att

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 of each text; one without passages is scored by the bias alone."""
        n = len(texts)
        top, weight, total = np.full(n, -np.inf), np.zeros(n), np.zeros(n)
        for owner, counts in slabs(texts):
            h, _, _, e = self.passages(vectors(counts))
            own, first = np.unique(owner, return_index=True)
            new = np.maximum(top[own], np.maximum.reduceat(e, first))
            fade = np.exp(top[own] - new)
            top[own] = new
            w = np.exp(e - top[owner])
            weight[own] = weight[own] * fade + np.add.reduceat(w, first)
            total[own] = total[own] * fade + np.add.reduceat(w * (h @ self.out), first)
        logit = total / np.maximum(weight, 1e-12) + self.out0[0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(owner: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = 16, batch: int = 128, rate: float = 0.01, seed: int = 3) -> Model:
    """Adam on the logistic loss of the documents' labels; ``owner`` (ascending) says whose each passage is."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    model = Model(draw(BUCKETS + 3, WIDTH) * 8, np.zeros(WIDTH, np.float32), draw(WIDTH, GATE), draw(WIDTH, GATE), draw(GATE), draw(WIDTH), np.zeros(1, np.float32))
    names = list(model.__dataclass_fields__)
    first, second, step = {k: 0 for k in names}, {k: 0 for k in names}, 0
    begins, ends = np.searchsorted(owner, np.arange(len(labels))), np.searchsorted(owner, np.arange(len(labels)), "right")
    full = np.flatnonzero(ends > begins)
    read = vectors(counts.astype(np.float32)) if len(counts) else np.zeros((0, BUCKETS + 3), np.float32)
    for epoch in range(epochs):
        order = rng.permutation(full)
        for i in range(0, len(order), batch):
            docs = order[i : i + batch]
            rows = np.concatenate([np.arange(begins[d], ends[d]) for d in docs])
            sizes = ends[docs] - begins[docs]
            at, own = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(docs)), sizes)
            x = read[rows]
            h, t, g, e = model.passages(x)
            a = np.exp(e - np.maximum.reduceat(e, at)[own])
            a /= np.add.reduceat(a, at)[own]
            z = np.add.reduceat(a[:, None] * h, at)
            p = 1 / (1 + np.exp(-(z @ model.out + model.out0[0])))
            dl = ((p - labels[docs]) / len(docs)).astype(np.float32)
            dz = dl[:, None] * model.out
            da = (dz[own] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, at)[own])
            dt, dg = de[:, None] * model.att * g * (1 - t * t), de[:, None] * model.att * t * g * (1 - g)
            dh = a[:, None] * dz[own] + dt @ model.tanh.T + dg @ model.gate.T
            dp = dh * (1 - h * h)
            grads = {"enc": x.T @ dp + 1e-4 * model.enc, "enc0": dp.sum(0), "tanh": h.T @ dt, "gate": h.T @ dg, "att": (t * g).T @ de, "out": z.T @ dl + 1e-4 * model.out, "out0": dl.sum(keepdims=True)}
            step += 1
            for k, d in grads.items():
                first[k], second[k] = 0.9 * first[k] + 0.1 * d, 0.999 * second[k] + 0.001 * d * d
                change = rate * (1 - 0.9 * epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(model, k, (getattr(model, k) - change).astype(np.float32))
    return model


def held_out(key: str = "doc_id"):
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> Model:
    """Fits the model on at most ``sample`` labelled documents that aren't held out; their whole texts are read.

    Documents of more than ``TEACH_BYTES`` don't teach, nor those beyond ``ALL_BYTES`` in all, so what comes to the
    driver is bounded in bytes as well; every document is scored, whatever its size.

    The bags are made on the executors, what comes to the driver is theirs (a byte for each count). Labels that
    are null are ignored, a document labelled twice has its lesser label, texts that are null or empty teach
    nothing. Without labels of both kinds the model gives the labels' mean (0.5 without any).
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.min("quality").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col(key), F.lit("quality")), key).limit(sample).select(F.col(key).alias("_k"), "y")
    rows = docs.select(key, text_of().alias("text")).join(F.broadcast(chosen), F.col(key) == F.col("_k")).select("_k", "y", "text").where(F.octet_length("text") <= TEACH_BYTES)
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("_k", F.lit("quality")), "_k", "size").rowsBetween(Window.unboundedPreceding, 0))  # as many rows as the sample has
    within = rows.select("_k", F.octet_length("text").alias("size")).distinct().withColumn("upto", upto).where(F.col("upto") <= ALL_BYTES).select("_k", "size")
    rows = rows.withColumn("size", F.octet_length("text")).join(F.broadcast(within), ["_k", "size"], "left_semi").select("_k", "y", "text")

    def features(batches):
        for batch in batches:
            keys, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            for i, t in enumerate(texts):
                parts = [np.minimum(c, 255).astype(np.uint8) for _, c in slabs([t])]
                yield pa.RecordBatch.from_pydict({"k": [keys[i]], "y": pa.array([ys[i]], pa.int32()), "bags": [np.concatenate(parts).tobytes() if parts else b""]})

    got = sorted((r["k"], r["y"], bytes(r["bags"])) for r in rows.mapInArrow(features, "k long, y int, bags binary").collect())
    y = np.array([r[1] for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        model = fit(np.zeros(0, np.int64), np.zeros((0, BUCKETS), np.uint8), y[:0])
        mean = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        model.out, model.out0 = model.out * 0, np.array([np.log(mean / (1 - mean))], np.float32)
        return model
    counts = np.frombuffer(b"".join(r[2] for r in got), np.uint8).reshape(-1, BUCKETS)
    owner = np.repeat(np.arange(len(got)), [len(r[2]) // BUCKETS for r in got])
    return fit(owner, counts, y)


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Every whole text's score and whether it reaches ``THRESHOLD``; ``extra`` columns pass through.

    Null text counts as empty. Repeated rows each get their (equal) score. An empty table gives an empty result.
    """
    kept = docs.select(F.col(key).cast("long").alias(key), text_of().alias("_text"), *extra)
    names = [key, *extra]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                scores = model.scores([t.encode() for t in part.column("_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    return kept.mapInArrow(run, fields + ", score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """Key, held_out, score, predicted of every document, by a model fitted on those that aren't held out."""
    scored = score_documents(docs, train(docs, labels, sample, key), key)
    return scored.select(key, held_out(key).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """``docs`` without those that score below ``THRESHOLD``; all columns stay, whatever their names. A null text is scored as the empty one."""
    model = train(docs, labels, sample, key)
    columns, name = docs.columns, free_name(docs, "_text")
    flags = docs.withColumn(name, text_of())

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                good = model.scores([t.encode() for t in part.column(name).to_pylist()]) >= THRESHOLD
                yield part.select(columns).filter(pa.array(good))

    return flags.mapInArrow(run, docs.schema)
