"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of characters that are no letters become one space, and n-grams of ``1..N_MAX`` characters
(the space marks word borders) are hashed into ``BUCKETS``. A feature is the relative frequency of its bucket times
its inverse document frequency; document frequencies are counted over all texts that may be learned from, by the
executors. Weights are fitted by the driver on a bounded sample (``PER_CLASS`` documents of each language) with
follow-the-regularised-leader and elastic-net penalties, so most stay exactly zero. One part in ``CALIBRATION`` of the
sample is kept back to fit the temperature that divides the logits.

Prediction reads text alone. A text that is null or has no letter, and every text where nothing could be learned, is
``und`` with score 0. Equal scores go to the first language by name. Rows with the same id are predicted one by one.
Other columns are ignored, or kept as they are, whatever their names. No rows, no result and no model.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm import common, sampling

N_MAX = 3
BUCKETS = 1 << 15
PER_CLASS = 600
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-3, 1e-3
CALIBRATION = 5
UNKNOWN = "und"
MIN_SCORE = 0.4
#: Characters of a text beyond which it is scored in windows of that size.
LONG = 1 << 18
_OTHER = re.compile(r"[\W\d_]+")


def prepare(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip(" ")


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for m in re.finditer(r"[^\W\d_]+", text or "") for c in m[0])


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the prepared texts, and where each text's begin (one more at the end).

    Each text ends with so many spaces that no n-gram reaches into the next one.
    """
    codes, starts = sampling.code_points([t + " " * (N_MAX - 1) for t in texts])
    found = _grams(codes.astype(np.uint64))
    own = np.ones(len(codes), bool)
    for k in range(1, N_MAX):
        own[starts[1:] - k] = False
    return found[own].reshape(-1), (starts - (N_MAX - 1) * np.arange(len(starts))) * N_MAX


def _grams(codes: np.ndarray) -> np.ndarray:
    """For each position the buckets of the n-grams that begin there, shortest first."""
    out = np.empty((len(codes), N_MAX), np.uint16 if BUCKETS <= 1 << 16 else np.uint32)
    h = np.zeros(len(codes), np.uint64)
    after = np.concatenate([codes, np.full(N_MAX, 32, np.uint64)])
    for n in range(N_MAX):
        h = h * np.uint64(0x100000001B3) + after[n : n + len(codes)] + np.uint64(1)
        out[:, n] = common.mix(h + np.uint64(n << 40)) % np.uint64(BUCKETS)
    return out


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # bucket x class, the inverse document frequency multiplied in
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > LONG:
            return self._long(texts[0])
        found, starts = buckets(texts)
        total = sampling.sums(self.weights[found], starts)
        return total / np.maximum(np.diff(starts), 1)[:, None] + self.bias

    def _long(self, text: str) -> np.ndarray:
        """The same for one very long text, window by window, so that memory stays small."""
        padded, total = f" {text} ", np.zeros(len(self.classes))
        for at in range(0, len(padded), LONG):
            part = padded[at : at + LONG + N_MAX - 1] + " " * N_MAX
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            found = _grams(codes)[: min(LONG, len(padded) - at)].reshape(-1)
            total += self.weights[found].sum(axis=0, dtype=np.float64)
        return (total / (len(padded) * N_MAX))[None, :] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias. ``rows``: distinct features of each example and their values."""
    z, n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = weights(z, n)
    return w[:BUCKETS], w[BUCKETS]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes ``y`` likeliest, by golden-section search on its logarithm.

    One more example than there are counts as one of which nothing is known, so that a sample without a mistake does
    not make predictions certain.
    """

    def loss(t: float) -> float:
        log_p = np.log(softmax(logits / np.exp(t)) + 1e-30)
        return -log_p[np.arange(len(y)), y].sum() - log_p.mean(axis=1).mean()

    a, b, step = np.log(0.01), np.log(100.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - step * (b - a), a + step * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of each bucket over all of ``docs``, and their number. One row of a task per bucket meets another in a sum."""

    def count(batches):
        total, n, seen = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, bool)
        for batch in batches:
            texts = [prepare(t) for t in batch.column("text").to_pylist()]
            n += len(texts)
            for i, j in sampling.bounded(texts):
                long = j - i == 1 and len(texts[i]) > LONG
                parts = [texts[i][k : k + LONG + N_MAX] for k in range(0, len(texts[i]), LONG)] if long else [None]
                for part in parts:  # a very long text is marked window by window
                    found, starts = buckets([part] if long else texts[i:j])
                    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                        seen[found[a:b]] = True
                        if not long:
                            total += seen
                            seen[found[a:b]] = False
                if long:
                    total += seen
                    seen[:] = False
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(BUCKETS, np.int64), 0
    for r in rows:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, n


def train(docs: DataFrame, *, label: str = "lang", per_class: int = PER_CLASS) -> Model | None:
    """Learn from the documents that are not held out and have a label; None if there are none."""
    texts, langs = sampling.by_class(docs, label, per_class)
    use = [i for i, t in enumerate(texts) if has_letter(t)]
    if not use:
        return None
    texts, langs = [prepare(texts[i]) for i in use], [langs[i] for i in use]
    classes = sorted(set(langs))
    frequency, n = document_frequencies(docs.where(~common.held_out(F.col("doc_id")) & F.col(label).isNotNull()))
    idf = np.log((1 + n) / (1 + frequency)) + 1
    y = np.array([classes.index(x) for x in langs])
    rows = []
    for text in texts:
        found = buckets([text])[0]
        at, times = np.unique(found, return_counts=True)
        rows.append((np.append(at, BUCKETS), np.append(times / len(found) * idf[at] * SCALE, 1.0)))
    kept = np.arange(len(rows)) % CALIBRATION == 0 if len(rows) >= 10 * CALIBRATION else np.zeros(len(rows), bool)
    learn = np.flatnonzero(~kept)
    weights, bias = ftrl([rows[i] for i in learn], y[learn], len(classes))
    model = Model(classes, (weights * (idf * SCALE)[:, None]).astype(np.float32), bias)
    if kept.any():
        own = np.flatnonzero(kept)
        model.temperature = temperature(model.logits([texts[i] for i in own]), y[own])
    return model


#: Relative frequencies are small; this brings their steps to the size that ``ALPHA`` expects.
SCALE = 30.0


def predict(docs: DataFrame, model: Model | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` of each document with its language and the score, under ``names``, which must be none of ``keep``."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    text = common.fresh(keep, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch):
            texts = batch.column(text).to_pylist()
            found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            use = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            ready = [prepare(texts[i]) for i in use]
            for a, b in sampling.bounded(ready):
                p = softmax(model.logits(ready[a:b]) / model.temperature)
                for i, best, score in zip(use[a:b], p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    found[i], scores[i] = model.classes[best], score
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found), pa.array(scores, pa.float64())], names=[*(f.name for f in fields), *names])

        return step

    return common.per_batch(docs.select(*keep, F.col("text").cast("string").alias(text)), schema, make)


def recognised(docs: DataFrame, model: Model | None, min_score: float = MIN_SCORE) -> DataFrame:
    """Those of ``docs`` that have a language with a score of ``min_score`` or more; all columns, none added.

    Without a model (no document has a label to learn from) only texts that are null or have no letter go.
    """
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    names = common.fresh(docs.columns, "lang_pred"), common.fresh(docs.columns, "score")
    found = predict(docs, model, docs.columns, names)
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= min_score)).select(*docs.columns)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, train(docs), ["doc_id"])
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


SQL: dict[str, str] = {}
