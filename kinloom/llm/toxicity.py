"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is lower-cased; everything but letters and digits is a border. The bag of a text holds all character n-grams of
``N_MIN..N_MAX`` characters of its words, border marks included, and each longer word as a whole, hashed into
``BUCKETS``. The vectors of the bag are averaged and a linear softmax gives the two classes. A misspelt word shares
most n-grams, hence vectors, with the word it stands for.

Vectors and softmax are trained jointly, by the driver, in numpy, on a bounded sample (``SAMPLE`` labelled documents).
Training starts from what counting tells: the first number of a vector is the log-odds of its n-gram (documents of the
one class against the other, a prior of ``PRIOR`` documents), or zero where these are within ``LEAST_Z`` standard
errors. Steps are adaptive, so that a rare n-gram moves as far as a common one. One part in ``KEPT`` of the sample is
kept back: it chooses among ``RATES`` (a small sample bears smaller steps) and fits the line that turns the softmax's
margin into a probability, as the margins of texts learned from are too wide. Then all of the sample is learned from.

The average of a product is the product of the average: at prediction each bucket is one number, its vector times the
difference of the two softmax columns. Null, empty or without letters: an empty bag, whose score is the softmax of the
bias. Rows with the same id are scored one by one. Without any label all scores are 0. Other columns are ignored,
whatever their names; no rows, no result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import common, sampling

N_MIN, N_MAX = 3, 8
BUCKETS, DIM = 1 << 18, 4
SAMPLE = 4000
EPOCHS, BATCH, RATES, OUT_RATE, BIAS_RATE = 6, 32, (0.002, 0.4), 1.0, 0.3
#: Texts that an n-gram must occur in.
LEAST = 3
PRIOR, LEAST_Z = 10.0, 3.0
KEPT = 5
_BORDER = re.compile(r"[\W_]+")
THRESHOLD = 0.3
#: Characters of a text beyond which it is scored in pieces.
LONG = 1 << 18


def prepare(text: str | None) -> str:
    return _BORDER.sub(" ", (text or "").lower()).strip(" ")


def bag(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the prepared texts, and where each text's begin (one more at the end)."""
    codes, starts = sampling.code_points(texts)
    n = len(codes)
    space = np.flatnonzero(codes == 32)
    following = space[np.minimum(np.searchsorted(space, np.arange(1, n + 1)), len(space) - 1)]
    inner = np.where(following > np.arange(n), following - np.arange(n), 0)  # characters up to the next border
    codes = np.concatenate([codes.astype(np.uint64), np.zeros(N_MAX, np.uint64)])
    h, parts, places = np.zeros(n, np.uint64), [], []
    for k in range(1, N_MAX + 1):
        h = h * np.uint64(0x100000001B3) + codes[k - 1 : k - 1 + n] + np.uint64(1)
        if k >= N_MIN:  # borders may only be its first and its last character
            at = np.flatnonzero(inner >= k - 1)
            parts.append((common.mix(h[at]) % np.uint64(BUCKETS)).astype(np.int64))
            places.append(at)
    begin, end = space[:-1], space[1:] + 1  # whole words with their borders, longer than any n-gram
    long = end - begin > N_MAX
    parts.append((common.range_hashes(codes[:n], begin[long], end[long]) % np.uint64(BUCKETS)).astype(np.int64))
    places.append(begin[long])
    place, found = np.concatenate(places), np.concatenate(parts)
    order = np.argsort(place, kind="stable")
    return found[order], np.searchsorted(place[order], starts)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket in the mean
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > LONG:
            total, n = map(sum, zip(*(self._sums([part]) for part in _parts(texts[0]))))
        else:
            total, n = self._sums(texts)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -40, 40)))

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Total weight and size of each text's bag."""
        found, starts = bag(texts)
        total = np.concatenate([[0.0], np.cumsum(self.weight[found], dtype=np.float64)])
        return total[starts[1:]] - total[starts[:-1]], np.diff(starts)


def _parts(text: str):
    """Pieces of a very long text, cut at spaces: an n-gram never reaches over one, so the bags add up."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + LONG)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


class Bags:
    """The bags of a sample: distinct buckets of each text and their shares."""

    def __init__(self, texts: list[str]) -> None:
        sizes, at, shares = [], [], []
        for t in texts:
            found = bag([t])[0]
            own, times = np.unique(found, return_counts=True)
            sizes.append(len(own))
            at.append(own)
            shares.append((times / max(len(found), 1)).astype(np.float32))
        self.ends = np.cumsum(sizes)
        self.sizes, self.at, self.shares = np.array(sizes), np.concatenate(at), np.concatenate(shares)

    def some(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets and shares of some texts, and which of them each is of."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends, sizes)
        return self.at[where], self.shares[where], np.repeat(np.arange(len(rows)), sizes)

    def means(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        at, share, of = self.some(rows)
        return np.bincount(of, weights=weight[at] * share, minlength=len(rows))


def _log_odds(bags: Bags, rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket the log-odds between the classes, 0 if they may be chance, and whether it is in few texts."""
    seen = [np.bincount(bags.some(rows[y[rows] == k])[0], minlength=BUCKETS) if (y[rows] == k).any() else np.zeros(BUCKETS) for k in (0, 1)]
    n = [max(int((y[rows] == k).sum()), 1) for k in (0, 1)]
    expected = PRIOR * (seen[0] + seen[1] + 1) / (len(rows) + 2)
    no, yes = seen[0] + expected, seen[1] + expected
    odds = np.log(yes / (n[1] + PRIOR - yes).clip(0.1)) - np.log(no / (n[0] + PRIOR - no).clip(0.1))
    rare = seen[0] + seen[1] < LEAST
    return np.where((np.abs(odds) * np.sqrt(yes * no / (yes + no)) > LEAST_Z) & ~rare, odds, 0), rare


def _learn(bags: Bags, rows: np.ndarray, y: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """Weight of each bucket and bias, from some of the texts."""
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.001, (BUCKETS, DIM)).astype(np.float32)
    start, rare = _log_odds(bags, rows, y)
    vectors[:, 0] += start
    vectors[rare] = 0  # too few texts to learn from
    moves = (~rare).astype(np.float32)
    out = random.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    out[0] = -2, 2
    bias = np.log(np.maximum(np.bincount(y[rows], minlength=2), 1) / len(rows))
    grown_v, grown_o, grown_b = np.full(BUCKETS, 1e-8, np.float32), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    for epoch in range(EPOCHS):
        part = 1 - epoch / EPOCHS
        order = random.permutation(rows)
        for some in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
            at, share, of = bags.some(some)
            means = np.stack([np.bincount(of, weights=vectors[at, d] * share, minlength=len(some)) for d in range(DIM)], axis=1)
            z = means @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back, go, gb = p @ out.T, means.T @ p, p.sum(axis=0)
            grown_o += go * go
            grown_b += gb * gb
            g = np.stack([np.bincount(at, weights=share * back[of, d], minlength=BUCKETS) for d in range(DIM)], axis=1) * moves[:, None]
            grown_v += (g * g).mean(axis=1)
            vectors -= (part * rate * g / np.sqrt(grown_v)[:, None]).astype(np.float32)
            out -= (part * OUT_RATE * go / np.sqrt(grown_o)).astype(np.float32)
            bias -= part * BIAS_RATE * gb / np.sqrt(grown_b)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope and shift of the line that makes ``y`` likeliest given margins, by Newton steps, and the F1 at ``THRESHOLD``.

    A weak pull towards slope 1 and shift 0 keeps both finite where the margins tell the classes apart without fault.
    """
    x, line = np.stack([margin, np.ones(len(y))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -40, 40)))
        pull = 0.5 * (line - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), x.T @ (p - y) + pull)
        line = line - np.clip(step, -1, 1)
    said = 1 / (1 + np.exp(-np.clip(x @ line, -40, 40))) >= THRESHOLD
    return max(float(line[0]), 0.05), float(line[1]), float(2 * (said & (y == 1)).sum() / max(said.sum() + (y == 1).sum(), 1))


def fit(texts: list[str], y: np.ndarray, seed: int = 11) -> Model | None:
    """Train on prepared texts; None without labels."""
    if not len(y):
        return None
    bags, every = Bags(texts), np.arange(len(y))
    kept = np.random.default_rng(seed).permutation(len(y))[: len(y) // KEPT]
    best, line = RATES[-1], (1.0, 0.0)
    if len(np.unique(y[kept])) == 2:
        rest, tried = np.setdiff1d(every, kept), []
        for rate in RATES:
            weight, bias = _learn(bags, rest, y, rate, seed)
            slope, shift, f1 = calibrate(bags.means(kept, weight) + bias, y[kept])
            tried.append((-f1, rate, slope, shift))
        _, best, *line = min(tried)
    weight, bias = _learn(bags, every, y, best, seed)
    return Model(weight * line[0], bias * line[0] + line[1])


def score(docs: DataFrame, model, *, id_col: str = "doc_id") -> DataFrame:
    """One row for each document: ``id_col`` and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch):
            texts = [prepare(t) for t in batch.column("text").to_pylist()]
            found = [model.scores(texts[i:j]) for i, j in sampling.bounded(texts)] if model else [np.zeros(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(np.concatenate(found))], names=["row_id", "score"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    return common.per_batch(rows, "row_id long, score double", make).withColumnRenamed("row_id", id_col)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    texts, y = sampling.labelled(docs, labels, label, sample)
    return fit([prepare(t) for t in texts], np.minimum(y, 1))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
