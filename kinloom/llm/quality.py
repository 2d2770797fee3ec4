"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words (the last one shorter; a text without words is one empty passage).
Each passage is described by its shape, by its words and by its word pairs, both hashed into ``HASHED`` shares
(``features``); a learned layer encodes that. Gated attention, the
softmax over the passages of w . (tanh(h V) * sigmoid(h U)), weights the codes; the weighted sum is the text's
representation, which a logistic layer scores. Labels are of documents only: encoder, attention and scorer are learned
jointly from them, by the driver, in numpy, on a bounded sample (``SAMPLE`` labelled documents).

Null, empty: one empty passage, scored as such. Rows with the same id are scored one by one. Without any label all
scores are 0. Other columns are ignored, whatever their names; no rows, no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import common, sampling

PASSAGE = 64
SAMPLE = 4000
CODE, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4
THRESHOLD = 0.7
#: Words of a text beyond which it is described in pieces of that many (whole passages).
LONG = 256 * PASSAGE
#: Kinds of bytes that are counted: lower case, upper case, digits, each of some marks, other marks, beyond ASCII.
_KINDS = np.full(256, 17, np.int64)
_KINDS[0x61:0x7B], _KINDS[0x41:0x5B], _KINDS[0x30:0x3A], _KINDS[0x80:] = 0, 1, 2, 3
for _i, _c in enumerate("#$%&*|!<>.,:@"):
    _KINDS[ord(_c)] = 4 + _i
N_KINDS = 18
#: Buckets of words, and of word pairs.
HASHED = 48
N_SHAPE = N_KINDS + 8
#: What is added to the spread of a hashed share: they are many, and a small sample must not lean on one of them.
HASHED_SCALE = 0.5
N_FEATURES = N_SHAPE + 2 * HASHED


def features(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (one row each), and where each text's passages begin (one more at the end)."""
    n = len(starts) - 1
    begin, end, owner = common.word_spans(flat, starts, common.SPACED)
    n_words = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(n_words)])
    passages = np.maximum(-(-n_words // PASSAGE), 1)
    cuts = np.concatenate([[0], np.cumsum(passages)])
    total = int(cuts[-1])
    if n == 1 and len(begin) > LONG:  # a very long text: by whole passages, so that memory stays small
        pieces = (slice(i, i + LONG) for i in range(0, len(begin), LONG))
        return np.concatenate([features(flat[begin[p][0] : end[p][-1]], np.array([0, end[p][-1] - begin[p][0]]))[0] for p in pieces]), cuts
    out = np.zeros((total, N_FEATURES))
    if len(begin):
        of = cuts[owner] + (np.arange(len(begin)) - first[owner]) // PASSAGE  # passage of each word
        words = np.bincount(of, minlength=total)
        some = np.maximum(words, 1)
        sizes = end - begin
        place = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        kinds = np.bincount(np.repeat(of, sizes) * N_KINDS + _KINDS[flat[place]], minlength=total * N_KINDS).reshape(total, N_KINDS)
        chars = np.maximum(kinds.sum(axis=1), 1)
        out[:, :N_KINDS] = np.sqrt(kinds / chars[:, None])
        h = common.span_hashes(flat, begin, end)
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (of[1:] == of[:-1])])
        order = np.lexsort((h, of))
        again = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])])
        inside = np.flatnonzero(of[1:] == of[:-1])  # pairs of words in one passage
        pair, pair_of = common.gram_hashes(h, 2)[inside], of[inside]
        order2 = np.lexsort((pair, pair_of))
        again2 = np.concatenate([[False], (pair[order2][1:] == pair[order2][:-1]) & (pair_of[order2][1:] == pair_of[order2][:-1])])[: len(pair)]
        mean = np.bincount(of, weights=sizes, minlength=total) / some
        square = np.bincount(of, weights=sizes.astype(float) ** 2, minlength=total) / some
        capital = _KINDS[flat[begin]] == 1
        columns = (
            mean / 10, np.sqrt(np.maximum(square - mean**2, 0)) / 10, np.minimum(words / PASSAGE, 1),
            np.bincount(of, weights=same, minlength=total) / some, np.bincount(of[order], weights=again, minlength=total) / some,
            np.bincount(pair_of[order2], weights=again2, minlength=total) / some,
            np.bincount(of, weights=sizes == 1, minlength=total) / some, np.bincount(of, weights=capital, minlength=total) / some,
        )
        for i, c in enumerate(columns):
            out[:, N_KINDS + i] = c
        for i, (own, hashes) in enumerate(((of, h), (pair_of, pair))):
            times = np.bincount(own * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED)
            at = N_SHAPE + i * HASHED
            out[:, at : at + HASHED] = np.sqrt(times / np.maximum(times.sum(axis=1), 1)[:, None])
    return out, cuts


@dataclass
class Model:
    """Weights of encoder (W, b), attention (V, U, w) and scorer (c, d); ``center`` and ``scale`` of the features."""

    center: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, cuts: np.ndarray):
        p = self.weights
        h = np.tanh((x - self.center) / self.scale @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        a = (t * s) @ p["w"]
        own = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        e = np.exp(a - np.maximum.reduceat(a, cuts[:-1])[own])
        e /= np.add.reduceat(e, cuts[:-1])[own]
        z = np.add.reduceat(e[:, None] * h, cuts[:-1], axis=0)
        return h, t, s, e, own, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))

    def scores(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return self.forward(x, cuts)[-1]

    def gradients(self, x: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        h, t, s, e, own, z, score = self.forward(x, cuts)
        g = (score - y) / len(y)
        dz = g[:, None] * p["c"]
        da = (h * dz[own]).sum(axis=1)
        da = e * (da - np.add.reduceat(e * da, cuts[:-1])[own])
        dt, ds = da[:, None] * p["w"] * s * (1 - t * t), da[:, None] * p["w"] * t * s * (1 - s)
        dh = (e[:, None] * dz[own] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": ((x - self.center) / self.scale).T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ da, "c": z.T @ g, "d": g.sum(keepdims=True)}


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Model | None:
    """Train on one feature table for each text; None without labels."""
    if not len(y):
        return None
    random = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shape = {"W": (N_FEATURES, CODE), "b": (CODE,), "V": (CODE, GATE), "U": (CODE, GATE), "w": (GATE,), "c": (CODE,), "d": (1,)}
    model = Model(every.mean(axis=0), every.std(axis=0) + np.where(np.arange(N_FEATURES) < N_SHAPE, 0.05, HASHED_SCALE), {k: random.normal(0, s[0] ** -0.5, s) if k not in "bd" else np.zeros(s) for k, s in shape.items()})
    m, v, step = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}, 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(y))
        for some in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
            step += 1
            cuts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
            for k, g in model.gradients(np.concatenate([bags[i] for i in some]), cuts, y[some]).items():
                g = g + DECAY * model.weights[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                model.weights[k] -= rate * m[k] / (np.sqrt(v[k]) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> Model | None:
    texts, y = sampling.labelled(docs, labels, label, sample)
    return fit(bags_of(texts), np.minimum(y, 1))


def bags_of(texts: list[str]) -> list[np.ndarray]:
    x, cuts = features(*common.text_bytes(pa.array(texts, pa.string())))
    return [x[a:b] for a, b in zip(cuts, cuts[1:])]


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id") -> DataFrame:
    """One row for each document: ``id_col`` and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch):
            flat, starts = common.text_bytes(batch.column("text"))
            for i, j in common.chunks(starts, common.CHUNK // 4):
                found = np.zeros(j - i)
                if model:
                    found = model.scores(*features(flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i]))
                yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(i, j - i), pa.array(found)], names=["row_id", "score"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    return common.per_batch(rows, "row_id long, score double", make).withColumnRenamed("row_id", id_col)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
