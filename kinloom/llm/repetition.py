"""Quality rules on repetition, from a suffix array over the words of each text.

Words are numbered by 64-bit hashes of their bytes (equal words, equal numbers). The suffix array of many short texts,
or of one long text, is built at once by prefix doubling; each round sorts only what is still tied. The longest common
prefixes of neighbours give, for each position, the longest repeated substring that starts there: the maximal ones of
the prefix intervals and their suffixes. The union of the spans of at least ``least`` words is the covered part. A text
is kept unless it fails the base rules, the covered fraction is above ``max_covered`` or one repeat is longer than
``max_repeat`` words.

Null, empty: no words; such a text fails the base rules. Texts are judged one by one, whatever their ids; rows that
repeat an id are rows of the result. Other columns are ignored, whatever their names. No rows, no result. A text is
never cut: a long one takes about sixteen times its size in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import common

LEAST = 8
MAX_COVERED = 0.3
MAX_REPEAT = 200
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")
#: Words up to which the ranks of all prefix lengths are kept, and common prefixes found from them at once.
MANY = 1 << 20
_SYMBOLS = common.byte_set([(ord(c), ord(c)) for c in "#*$%&|<>"])
_HEAD = common.byte_set([(0x80, 0xBF)], inside=False)  # bytes that begin a character


def suffix_ranks(words: np.ndarray, text: np.ndarray, left: np.ndarray) -> Iterator[np.ndarray]:
    """Ranks by prefixes of 1, 2, 4, ... words; the last one is the rank of the whole suffix, its place in the array.

    ``words``: numbers from 0 on; ``text``: which text a word is of; ``left``: words from here to the end of its text.
    Suffixes of different texts never tie, nor does one that ends before the prefix is complete. Each round sorts only
    what is still tied.
    """
    n = len(words)
    key = text * np.int64((words.max() if n else 0) + 1) + words
    active, rank, h = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), 0
    while len(active):
        if h:
            second = np.zeros(len(active), np.int64)
            inside = np.flatnonzero(left[active] > h)
            second[inside] = rank[active[inside] + h] + np.int64(1)
            key = rank[active] * np.int64(n + 1) + second
            del second, inside
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        del order
        old = rank[active]
        part = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], old[1:] != old[:-1]])
        index = np.arange(len(active), dtype=np.int32)
        begin = np.maximum.accumulate(np.where(part, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        rank = rank.copy()
        rank[active] = old + begin
        yield rank
        tied = ~part
        tied[:-1] |= ~part[1:]
        active, h = active[tied], 2 * h or 1


def _plain_prefixes(words: np.ndarray, left: np.ndarray, array: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, position by position: it falls by one word at
    most from a position to the next. Needs no more than the arrays themselves."""
    n = len(words)
    out = np.zeros(n, np.int32)
    w, rest, sa, place, to = (memoryview(np.ascontiguousarray(x, np.int32)) for x in (words, left, array, rank, out))
    k = 0
    for i in range(n):
        at = place[i]
        if at:
            j = sa[at - 1]
            most = min(rest[i], rest[j])
            k = min(k, most)
            while k < most and w[i + k] == w[j + k]:
                k += 1
            to[at] = k
            k = k - 1 if k else 0
        else:
            k = 0
    return out


def repeats(words: np.ndarray, text: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a repeat of ``least`` words or more starts, and the length of the longest one there.

    In the suffix array a suffix shares its longest prefix with a neighbour. The common prefix of two neighbours is
    found from the ranks at each prefix length, longest first, or one by one where these would take too much memory.
    Overlapping occurrences count.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels: list[np.ndarray] = []
    for rank in suffix_ranks(words, text, left):
        levels = [*levels, rank] if n <= MANY else [rank]
    array = np.empty(n, np.int32)
    array[levels[-1]] = np.arange(n, dtype=np.int32)
    length = np.zeros(n, np.int32)
    if n > MANY:
        same_text = np.zeros(n, bool)
        same_text[1:] = text[array[1:]] == text[array[:-1]]
        found = np.where(same_text, _plain_prefixes(words, left, array, levels[-1]), 0)
        length[array] = np.maximum(found, np.append(found[1:], 0))
    else:
        a, b = array[:-1], array[1:]
        near = levels[min(least.bit_length() - 1, len(levels) - 1)]  # the longest prefix of at most ``least`` words
        some = near[a] == near[b] if len(levels) >= least.bit_length() else np.zeros(n - 1, bool)
        a, b = a[some], b[some]
        common_prefix = np.zeros(len(a), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + common_prefix, b + common_prefix
            inside = np.flatnonzero((left[a] > common_prefix) & (left[b] > common_prefix))
            tied = inside[levels[k][x[inside]] == levels[k][y[inside]]]
            common_prefix[tied] += 1 << k
        np.maximum.at(length, a, common_prefix)
        np.maximum.at(length, b, common_prefix)
    at = np.flatnonzero(length >= least)
    return at, length[at]


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def _per_text(marked: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many bytes are marked in each text."""
    out = np.zeros(len(starts) - 1, np.int64)
    some = np.flatnonzero(starts[1:] > starts[:-1])
    if len(some):
        out[some] = np.add.reduceat(marked.view(np.uint8), starts[some], dtype=np.int64)
    return out


def measure(flat: np.ndarray, starts: np.ndarray, texts: Iterable[str | None], least: int = LEAST) -> dict[str, np.ndarray]:
    """All of ``FIELDS`` for each text."""
    n = len(starts) - 1
    chars, symbols = _per_text((_HEAD & common.SPACED)[flat], starts), _per_text(_SYMBOLS[flat], starts)
    lines = [duplicate_lines(t or "") for t in texts]
    begin, end, owner = common.word_spans(flat, starts, common.SPACED)
    owner = owner.astype(np.int32)
    n_words = np.bincount(owner, minlength=n)
    hashes = common.span_hashes(flat, begin, end)
    del begin, end
    words = np.unique(hashes, return_inverse=True)[1].astype(np.int32)
    del hashes
    left = (np.cumsum(n_words)[owner] - np.arange(len(words))).astype(np.int32)
    covered3 = _covered(len(words), _windows_twice(words, owner, left, 3), 3)
    start, length = repeats(words, owner, left, least)
    covered = _covered(len(words), start, length)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner[start], length)
    count = lambda marked: np.bincount(owner[marked], minlength=n)
    values = (n_words, chars, symbols, lines, count(covered3), count(covered), longest)
    return {name: np.asarray(v).astype(np.int64) for name, v in zip(FIELDS, values)}


def _covered(n: int, start: np.ndarray, length) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + length, -1)
    return np.cumsum(delta[:-1], dtype=np.int32) > 0


def _windows_twice(words: np.ndarray, text: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """Places where a window of k words begins that its text holds twice. Windows are numbered word by word."""
    at = np.flatnonzero(left >= k).astype(np.int32)
    if not len(at):
        return at
    most = np.int64(words.max()) + 1
    number = text[at].astype(np.int64)
    for j in range(k):
        number = np.unique(number * most + words[at + j], return_inverse=True)[1]
    return at[np.bincount(number)[number] > 1]


def rules(docs: DataFrame, *, least: int = LEAST, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, id_col: str = "doc_id") -> DataFrame:
    """One row for each document: ``id_col``, ``FIELDS``, base_failed, kept."""
    schema = ", ".join(["row_id long", *(f"{name} long" for name in FIELDS)])

    def make():
        def step(batch: pa.RecordBatch):
            flat, starts = common.text_bytes(batch.column("text"))
            for i, j in common.chunks(starts):
                part = slice(int(starts[i]), int(starts[j]))
                found = measure(flat[part], starts[i : j + 1] - starts[i], batch.column("text").slice(i, j - i).to_pylist(), least)
                yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(i, j - i), *map(pa.array, found.values())], names=["row_id", *FIELDS])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    found = common.per_batch(rows, schema, make).withColumnRenamed("row_id", id_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repeated = (F.col("n_covered") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_repeat)
    return found.select("*", failed.alias("base_failed"), (~failed & ~repeated).alias("kept"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = rules(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *FIELDS[:5], "base_failed", "kept", "n_covered", (F.col("longest_repeat") > MAX_REPEAT).alias("too_long"))


def _twice(k: int) -> str:
    """Windows of k words with how often their text holds them."""
    return f"""(SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, hash(array_to_string(ws[i:i + {k - 1}], ' ')) AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})))"""


SQL = {
    "op9_quality_rules": f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
three AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM {_twice(3)} WHERE c > 1) GROUP BY doc_id),
eight AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {LEAST})) AS p FROM {_twice(LEAST)} WHERE c > 1) GROUP BY doc_id),
long AS (SELECT DISTINCT doc_id FROM {_twice(MAX_REPEAT + 1)} WHERE c > 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(three.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(eight.n, 0) AS BIGINT) AS n_covered, long.doc_id IS NOT NULL AS too_long
    FROM w LEFT JOIN three USING (doc_id) LEFT JOIN eight USING (doc_id) LEFT JOIN long USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT too_long AND n_covered <= {MAX_COVERED}::DOUBLE * n_words AS kept FROM b
""",
}
