"""Benchmark decontamination by winnowing.

Words are the maximal runs of ASCII letters, digits and characters beyond ASCII, after A-Z is lower-cased. Of every
``window - k + 1`` consecutive k-grams the smallest hash is kept (ties: the rightmost), on both sides. Two texts that
share ``window`` consecutive words share all k-grams of that span, hence the kept one: no shared span is missed. A
kept document fingerprint is joined with the kept benchmark fingerprints; each hit is extended word by word in both
directions, and the run counts if it is at least ``window`` words long. An item of fewer than ``window`` words is
indexed whole, by the hash of all its words, under its own length.

The benchmark index is shipped to the workers. Its size is checked first: a benchmark of more than ``max_bytes`` of
text is cut into blocks (by a hash of the item) that are searched one after another; results are merged by document.

Null, empty: such a text has no words; it is never hit and an item without words has no window. A null item id counts
as the empty id. Rows with the same document id are judged one by one; rows with the same item id are one item. Other
columns are ignored, whatever their names; no documents, no rows; no items, no hits.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import common
from kinloom.session import shelve

WINDOW = 13
K = 7
MAX_BYTES = 8 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {i: i + 32 for i in range(0x41, 0x5B)}
SCHEMA = "row_id long, n_words long, n_hit long, hits array<struct<start:long,end:long>>, items array<string>"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_FOLD))


def winnow(grams: np.ndarray, owner: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost smallest hash in each window of ``w`` grams that one text owns, sorted, distinct.

    ``owner`` is the text number of each gram; a text of fewer than ``w`` grams has no window.
    """
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        less = grams[j : n + j] <= best
        best[less] = grams[j : n + j][less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at[owner[:n] == owner[w - 1 :]])


class Index:
    """Fingerprints of some benchmark items: (length of the gram, hash) -> (item, word position)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, k: int = K) -> None:
        self.window, self.k = window, k
        self.texts = [(str(i), words) for i, text in items if (words := words_of(text))]
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item, (_, words) in enumerate(self.texts):
            raw = [w.encode() for w in words]
            ends = np.cumsum([len(w) for w in raw])
            flat = np.frombuffer(b"".join(raw), np.uint8)
            hashes = common.span_hashes(flat, np.concatenate([[0], ends[:-1]]), ends)
            if len(words) < window:
                size, at = len(words), np.zeros(1, np.int64)
                grams = common.gram_hashes(hashes, size)
            else:
                size, grams = k, common.gram_hashes(hashes, k)
                at = winnow(grams, np.zeros(len(grams), np.int64), window - k + 1)
            key = size if len(words) < window else 0
            for p in at:
                self.places[key][int(grams[p])].append((item, int(p)))
        self.sorted = {key: np.sort(np.fromiter(found, np.uint64, len(found))) for key, found in self.places.items()}
        self.places = {key: dict(found) for key, found in self.places.items()}

    def seeds(self, hashes: np.ndarray, owner: np.ndarray):
        """Of the words of several texts: (key, word position, hash) wherever a kept fingerprint meets the index."""
        for key, known in self.sorted.items():
            size = key or self.k
            grams = common.gram_hashes(hashes, size)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            whole = owner[: len(grams)] == owner[size - 1 :]
            found = np.flatnonzero((known[at] == grams) & whole)
            if key == 0 and len(found):
                found = self._kept(grams, owner, found)
            for p in found:
                yield key, int(p), int(grams[p])

    def _kept(self, grams: np.ndarray, owner: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Those of ``found`` that winnowing keeps in their text."""
        w = self.window - self.k + 1
        inside = owner[: len(grams)] == owner[self.k - 1 :]
        owned = np.where(inside, owner[: len(grams)], -1 - np.arange(len(grams)))  # a gram over a border has no window
        return np.intersect1d(found, winnow(grams, owned, w), assume_unique=True)

    def extend(self, words: list[str], seeds: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of ``words`` that windows of items cover (merged), and the ids of those items.

        The words themselves are compared, so that equal hashes of different words do no harm.
        """
        spans, ids, done = [], set(), {}
        for key, p, h in seeds:
            for item, q in self.places[key][h]:
                name, other = self.texts[item]
                if done.get((item, p - q), -1) > p:
                    continue  # on a run that has been measured already
                size = key or self.k
                if words[p : p + size] != other[q : q + size]:
                    continue
                a, b = 0, size
                while p - a > 0 and q - a > 0 and words[p - a - 1] == other[q - a - 1]:
                    a += 1
                while p + b < len(words) and q + b < len(other) and words[p + b] == other[q + b]:
                    b += 1
                done[item, p - q] = p + b
                if a + b >= min(self.window, len(other)):
                    spans.append((p - a, p + b))
                    ids.add(name)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, ids


def _scan(df: DataFrame, index) -> DataFrame:
    """``df``: row_id, text."""

    def make():
        found: Index = index.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def step(batch: pa.RecordBatch):
            flat, starts = common.text_bytes(batch.column("text"))
            ids, texts = batch.column("row_id"), batch.column("text")
            for i, j in common.chunks(starts):
                low = common.LOWER[flat[starts[i] : starts[j]]]
                begin, end, owner = common.word_spans(low, starts[i : j + 1] - starts[i], common.ALNUM)
                n_words = np.bincount(owner, minlength=j - i)
                first = np.concatenate([[0], np.cumsum(n_words)])
                hits: list[list] = [[] for _ in range(j - i)]
                items: list[list] = [[] for _ in range(j - i)]
                seeds = defaultdict(list)
                for key, p, h in found.seeds(common.span_hashes(low, begin, end), owner):
                    seeds[int(owner[p])].append((key, p - int(first[owner[p]]), h))
                for d, own in seeds.items():
                    spans, names = found.extend(words_of(texts[i + d].as_py()), own)
                    hits[d], items[d] = [{"start": a, "end": b} for a, b in spans], sorted(names)
                n_hit = [sum(x["end"] - x["start"] for x in h) for h in hits]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))], names=["row_id", "n_words", "n_hit", "hits", "items"])

        return step

    return common.per_batch(df, SCHEMA, make)


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, k: int = K, max_bytes: int = MAX_BYTES, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_words, n_hit, hits (word ranges), items (their ids, sorted)."""
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and the window")
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n_blocks = -(-size // max_bytes) or 1
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    of = lambda b: items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b)
    index = lambda b: spark.sparkContext.broadcast(Index([(r.item, r.text) for r in of(b).collect()], window, k))
    if n_blocks == 1:
        return _scan(rows, index(0)).withColumnRenamed("row_id", id_col)
    # rows are told apart by their own text as well, so that rows with the same id are still judged one by one
    numbered = rows.withColumn("key", F.xxhash64("row_id", "text"))
    found = None
    for b in range(n_blocks):
        part = _scan(numbered.select(F.col("key").alias("row_id"), "text"), index(b)).where("n_hit > 0")
        found = part if found is None else found.union(part)
    union = found.groupBy("row_id").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = _scan(numbered.select(F.struct("row_id", "key").alias("both"), "text").select(F.col("both.key").alias("row_id"), "text"), spark.sparkContext.broadcast(Index([])))
    counted = counted.groupBy("row_id").agg(F.first("n_words").alias("n_words"))
    step = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.array().cast("array<struct<start:long,end:long>>").alias("out"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b")),
        lambda acc, x: F.when((acc.b >= 0) & (x.start <= acc.b), F.struct(acc.out.alias("out"), acc.a.alias("a"), F.greatest(acc.b, x.end).alias("b")))
        .otherwise(F.struct(F.when(acc.b >= 0, F.concat(acc.out, F.array(F.struct(acc.a.alias("start"), acc.b.alias("end"))))).otherwise(acc.out).alias("out"), x.start.alias("a"), x.end.alias("b"))),
        lambda acc: F.when(acc.b >= 0, F.concat(acc.out, F.array(F.struct(acc.a.alias("start"), acc.b.alias("end"))))).otherwise(acc.out),
    )
    merged = union.select("row_id", step.alias("hits"), "items")
    joined = numbered.select(F.col("row_id").alias(id_col), F.col("key").alias("row_id")).join(counted, "row_id").join(merged, "row_id", "left")
    none = F.array().cast("array<struct<start:long,end:long>>")
    return joined.select(
        id_col, "n_words", F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x.end - x.start), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; all columns, none added.

    A row is judged by its own text: rows that share an id go one by one, told apart by a hash of id and text.
    """
    key = common.fresh(docs.columns, "_key")
    text = F.col("text").cast("string")
    named = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("string"), text))
    found = find(named.select(key, "text"), benchmark, id_col=key, **how)
    bad = found.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(key).distinct()
    return common.restrict(named, key, shelve(bad, "contaminated", slim=True), "left_anti").drop(key)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


SQL = {
    "op1_decontaminate": """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
}
