"""Bounded samples of labelled rows, on which classifiers are fitted by the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm import common

#: Characters of a text that are fitted on; of a longer one a window of that size is taken, at a place drawn by its id.
#: Scores are always of whole texts.
WINDOW = 1 << 16
#: Classes that may be told apart.
MAX_CLASSES = 1000


def _order(doc_id: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")))


def _window(doc_id: Column, text: Column) -> Column:
    n = F.char_length(text)
    start = F.pmod(F.xxhash64(doc_id, F.lit("window")), F.greatest(n - WINDOW, F.lit(0)) + 1).cast("int")
    return F.when(n > WINDOW, F.substring(text, start + 1, F.lit(WINDOW))).otherwise(text)


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``bound`` labelled documents that are not held out, the first by a hash of the id.

    Labels whose document is missing or has no text do not count. Only the chosen labels are joined to the texts, so no
    text is shuffled; where ids repeat, the bound holds for the rows.
    """
    there = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"))
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    rows = rows.where(~common.held_out(F.col("id")) & F.col("y").isNotNull()).join(there, "id", "left_semi")
    chosen = rows.orderBy(_order(F.col("id")), "y").limit(bound)
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("id", _window(F.col("id"), F.col("text")).alias("text"), "y")
    found = found.orderBy(_order(F.col("id")), "y", "text").limit(bound).collect()
    found.sort(key=lambda r: (r["id"], r["y"], r["text"]))
    return [r["text"] for r in found], np.array([r["y"] for r in found], np.int64)


def by_class(docs: DataFrame, label: str, per_class: int) -> tuple[list[str], list[str]]:
    """Texts and classes of about ``per_class`` documents of each class that are not held out, chosen by a hash.

    More than ``MAX_CLASSES`` classes are an error, so the rows that the driver reads are bounded.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("y"))
    rows = rows.where(~common.held_out(F.col("id")) & F.col("y").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("y").count().limit(MAX_CLASSES + 1).collect()}
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    if not sizes:
        return [], []
    part = F.pmod(F.xxhash64(_order(F.col("id")), "text"), F.lit(1_000_003)) / 1_000_003
    rate = F.create_map(*(x for c, n in sizes.items() for x in (F.lit(c), F.lit(min(1.0, per_class / n)))))
    found = rows.where(part < F.element_at(rate, F.col("y"))).select("id", _window(F.col("id"), F.col("text")).alias("text"), "y").collect()
    found.sort(key=lambda r: (r["id"] is None, r["id"], r["y"], r["text"]))
    return [r["text"] for r in found], [r["y"] for r in found]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with a space before and after it, and where each begins (one more at the end)."""
    padded = [f" {t} " for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in padded])])
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def bounded(texts: list[str], size: int = 1 << 16):
    """Ranges of texts with about ``size`` characters in all; a text of that size or more is a range of its own."""
    i = total = 0
    for j, t in enumerate(texts):
        if len(t) >= size and j > i:
            yield i, j
            i, total = j, 0
        total += len(t)
        if total >= size:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the rows of each range; no range is empty."""
    return np.add.reduceat(values, starts[:-1], axis=0, dtype=np.float64)
