"""Shared pieces of the corpus operators: folds, Arrow loops and vectorised word scanning."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once by the vectorised kernels; a longer text is taken on its own.
CHUNK = 1 << 20
#: Rows of a batch that are handled at once.
ROWS = 1000
#: Ids that may be broadcast: 16 to 32 bytes each in memory, hence at most about 32 MB.
MAX_IDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4 (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 2


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array, and where each begins (one more at the end).

    A null text is an empty one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[starts[0] : starts[-1]], starts - starts[0]


def chunks(starts: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts that hold about ``size`` bytes, one text at least."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, or it with underscores behind it until it is none of ``taken`` (case does not count)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def restrict(rows: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``rows`` with ``ids`` (one column); they are broadcast only up to ``MAX_IDS``.

    Beyond that the rows themselves are shuffled. A null is no member of ``ids``.
    """
    name = fresh(rows.columns, "_one")
    few = ids.limit(MAX_IDS + 1).count() <= MAX_IDS
    ids = ids.toDF(name)
    return rows.join(F.broadcast(ids) if few else ids, rows[column] == ids[name], how)


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], least: int = 1000, part: int = 500) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and says in ``size`` how many rows hold it.

    A key with more than one in ``part`` of all rows would gather in one task. There are fewer than ``part`` of them, so
    they are broadcast, and their rows stay where they are; all others are joined by a shuffle. ``size`` is dropped.
    """
    total, most = table.agg(F.sum("size"), F.max("size")).first()
    limit = max(least, (total or 0) // part)
    slim = table.drop("size")
    if (most or 0) <= limit:
        return rows.join(slim, keys)
    heavy, light = table.where(F.col("size") > limit).drop("size"), table.where(F.col("size") <= limit).drop("size")
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))


def per_batch(
    df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]
) -> DataFrame:
    """``mapInArrow`` whose per-task state is built by ``make`` inside the worker.

    Spark bounds a batch by bytes; of its rows, which hold whole texts, ``ROWS`` are handled at once, so that what a
    step makes of them stays small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield from step(batch.slice(at, ROWS))
        del step
        tidy()

    return df.mapInArrow(run, schema)


def tidy() -> None:
    """Give memory back at the end of a task: a worker goes on to the tasks of other stages, and would keep the most that
    any of them took."""
    for which in _powers:
        _powers[which] = np.ones(1, np.uint64)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


_POWER = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier: powers of it can be undone modulo 2**64
_UNDO = np.uint64(pow(int(_POWER), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        step = _POWER if which == "up" else _UNDO
        out = np.full(max(n, 2 * len(have)), step, np.uint64)
        out[0] = 1
        have = _powers[which] = np.cumprod(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a polynomial hash depend on all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_spans(flat: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of each maximal run of bytes marked in ``is_word``; runs end where texts do."""
    mark = is_word[flat]
    opens, closes = mark.copy(), mark.copy()
    if len(flat):
        inner = starts[1:-1]
        inner = inner[(inner > 0) & (inner < len(flat))]
        opens[1:] &= ~mark[:-1]
        opens[inner] = mark[inner]
        closes[:-1] &= ~mark[1:]
        closes[inner - 1] = mark[inner - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def span_hashes(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from prefix sums of one polynomial over all bytes."""
    if len(flat) > 2 * CHUNK and len(begin) > 1:  # a very long text: by blocks of words, so that memory stays small
        cuts = np.append(np.unique(np.searchsorted(begin, np.arange(0, len(flat), CHUNK))), len(begin))
        return np.concatenate([
            span_hashes(flat[begin[i] : end[j - 1]], begin[i:j] - begin[i], end[i:j] - begin[i]) for i, j in zip(cuts, cuts[1:]) if j > i
        ])
    return range_hashes(flat, begin, end)


def range_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of numbers."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power("up", len(values)), out=total[1:])
    return mix((total[end] - total[begin]) * _power("down", len(values) + 1)[begin])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(h)


def byte_set(ranges: list[tuple[int, int]], inside: bool = True) -> np.ndarray:
    out = np.full(256, not inside)
    for a, b in ranges:
        out[a : b + 1] = inside
    return out


#: Words that white space separates: space, and tab to carriage return.
SPACED = byte_set([(0x20, 0x20), (0x09, 0x0D)], inside=False)
#: a-z, 0-9 and all beyond ASCII; texts are lower-cased first.
ALNUM = byte_set([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: Lower-cases A-Z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
