"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity`` tokens; a piece of exactly that size is a sequence of its own.
The others are dealt evenly (not by a key) over partitions of about ``part_rows`` pieces and each partition is packed
by best-fit decreasing. Dual feasible functions give a lower bound on the bins that any packing of its pieces needs:
u(x) rounds x up to a multiple by the k-fold scale, and the threshold functions ignore pieces below a and count those
above capacity - a in full; the largest bound counts. A partition that meets its bound is certified and stays, but for
its emptiest bin. Partitions with a gap give up their bins that are not full. The pieces given up are dealt anew over
fewer partitions and packed again, until all is certified or no bin was saved (or ``max_rounds``, if given, have passed). A result
never has more bins than the round before.

Only lengths and ids are moved, never texts. Each round is a table in the shared folder, so a lost executor repeats
its own tasks on the same rows.

Null text: empty. An empty text is one piece that holds only the end id. Repeated rows are packed one by one. Other
columns are ignored, whatever their names; no rows, no result.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import common
from kinloom.session import shelve

CAPACITY = 2048
PART_ROWS = 100_000
#: Encoded words that a worker keeps; beyond that it starts anew.
CACHE = 1_000_000
#: Words that are encoded at once.
BULK = 20_000


class Merges:
    """Byte-pair merges of many words at once.

    All words take their best merge (lowest rank, then leftmost) in the same vectorised step; words that have no merge
    left go. Ranks are looked up in a table addressed by a multiplicative hash, with a second one for collisions.
    """

    NONE = np.int64(1 << 40)
    BITS = 20

    def __init__(self, vocabulary: dict[str, int], merges: list, byte_chars: dict[int, str], end: str) -> None:
        self.first = np.array([vocabulary[byte_chars[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[byte_chars[b] + end] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs] + [-1], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs] + [-1], np.int64)
        self.tables, left = [], np.arange(len(pairs))
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93):
            slots = np.full(1 << self.BITS, len(pairs), np.int32)
            at = self._slot(self.keys[left], factor)
            slots[at[::-1]] = left[::-1]
            self.tables.append((factor, slots))
            left = left[slots[at] != left]
        if len(left):
            raise ValueError("the merges do not fit three hash tables")

    def _slot(self, keys: np.ndarray, factor: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(factor)) >> np.uint64(64 - self.BITS)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges."""
        none = len(self.keys) - 1
        factor, slots = self.tables[0]
        out = slots[self._slot(keys, factor)].astype(np.int64)
        for factor, slots in self.tables[1:]:
            miss = np.flatnonzero((self.keys[out] != keys) & (out != none))
            if not len(miss):
                break
            out[miss] = slots[self._slot(keys[miss], factor)]
        out[self.keys[out] != keys] = none
        return out

    def apply(self, raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and for each id the word it is of. ``raw``: bytes of all words; ``begin``: where each begins."""
        symbols = self.first[raw]
        ends = np.append(begin[1:], len(raw)) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(raw))))
        none, done = len(self.keys) - 1, []
        while len(symbols):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rank = np.full(len(symbols), none, np.int64)
            rank[:-1] = self._rank(symbols[:-1] << 20 | symbols[1:])
            rank[begin[1:] - 1] = none
            best = np.minimum.reduceat(rank << 32 | np.arange(len(symbols)), begin)
            merging = best >> 32 < none
            keep = np.repeat(merging, np.diff(np.append(begin, len(symbols))))
            if not merging.all():  # words that are finished leave
                done.append((owner[~keep], symbols[~keep]))
            at = best[merging] & 0xFFFFFFFF
            symbols[at] = self.made[best[merging] >> 32]
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        owner = np.concatenate([o for o, _ in done])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([x for _, x in done])[order].astype(np.uint32), owner[order]


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable,
    else the next free one from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: Of bytes: 1 a letter (A-Z, a-z, or a part of a letter that is encoded as C3 and a byte), 2 a digit, 3 a mark, 0 any
#: other. Words without 0 are plain: their pre-tokens are runs of letters, single digits and runs of marks, and lower
#: case is all that the vocabulary's normaliser does to them. The apostrophe (contractions), "<" (special tokens) and
#: all else are left to the tokenizer itself.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[0x27, 0x3C]] = 0
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:0xC0] = _CLASS[0xC3] = 1
_CLASS[[0x97, 0xB7]] = 0  # the signs of multiplication and division
_LOWER = common.LOWER.copy()
_LOWER[0x80:0x9F] += 32  # the second byte of the capitals from U+00C0 to U+00DE


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of the ranges start, start + 1, ... start + size - 1, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Encoder:
    """Ids of whole texts, from the ids of their words.

    The vocabulary drops white space before it splits, so no token crosses white space and a text's ids are those of
    its words in order. Words are told apart by 64-bit hashes of their bytes. Plain ones are merged in bulk, all
    others go through the tokenizer itself; the ids of up to ``CACHE`` words are kept between calls.
    """

    def __init__(self, spec: str) -> None:
        """``spec``: the text of a tokenizer file."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        model = json.loads(spec)["model"]
        self.merges = Merges(model["vocab"], model["merges"], byte_chars(), model["end_of_word_suffix"])
        self._forget()

    def _forget(self) -> None:
        self.words = np.zeros(0, np.uint64)  # sorted hashes
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of their ids
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, flat: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Add words that are not known yet, ``hashes`` sorted."""
        odd = np.concatenate([[0], np.cumsum(_CLASS[flat] == 0)])
        plain = odd[end] == odd[begin]
        sizes = np.zeros(len(hashes), np.int64)
        parts, owners = [], []
        for some in np.array_split(np.flatnonzero(plain), plain.sum() // BULK + 1):
            if len(some):
                lengths = end[some] - begin[some]
                raw = flat[ragged(begin[some], lengths)]
                kind, word = _CLASS[raw], np.repeat(some, lengths)
                cut = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (word[1:] != word[:-1])]))
                ids, owner = self.merges.apply(_LOWER[raw], cut)
                parts.append(ids)
                owners.append(word[cut][owner])
        rest = np.flatnonzero(~plain)
        for i in range(0, len(rest), BULK):
            some = rest[i : i + BULK].tolist()
            texts = [flat[begin[w] : end[w]].tobytes().decode() for w in some]
            for w, x in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                parts.append(np.array(x.ids, np.uint32))
                owners.append(np.full(len(x.ids), w))
        if parts:
            owner = np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            sizes += np.bincount(owner, minlength=len(hashes))
            at = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, np.concatenate(parts)[order]])
        else:
            at = sizes
        words = np.concatenate([self.words, hashes])
        order = np.argsort(words, kind="stable")
        self.words, self.at, self.size = words[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, sizes])[order]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return at

    def encode(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        begin, end, owner = common.word_spans(flat, starts, common.SPACED)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(starts) - 1, np.int64)
        hashes, first, which = np.unique(common.span_hashes(flat, begin, end), return_index=True, return_inverse=True)
        if len(self.words) > CACHE:
            self._forget()
        new = self.words[self._find(hashes)] != hashes if len(self.words) else np.ones(len(hashes), bool)
        if new.any():
            self._learn(flat, hashes[new], begin[first[new]], end[first[new]])
        known = self._find(hashes)[which]
        sizes = self.size[known]
        counts = np.bincount(owner, weights=sizes, minlength=len(starts) - 1).astype(np.int64)
        return self.ids[ragged(self.at[known], sizes)], counts


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id") -> DataFrame:
    """One row for each piece: ``id_col``, piece, start, length, ids_crc32."""
    schema = "row_id long, piece int, start long, length long, ids_crc32 long"
    with open(tokenizer_path, encoding="utf-8") as file:  # read by the driver: executors need not have it
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def make():
        encoder, end = Encoder(spec.value), np.array([end_id], "<u4").tobytes()
        common.tidy()  # reading the vocabulary takes more than keeping it

        def step(batch: pa.RecordBatch):
            flat, starts = common.text_bytes(batch.column("text"))
            for i, j in common.chunks(starts, common.CHUNK // 2):
                ids, counts = encoder.encode(flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                yield cut(batch.column("row_id").slice(i, j - i).to_pylist(), ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist())

        def cut(names: list, ids: bytes, ends: list[int]) -> pa.RecordBatch:
            rows: list[tuple] = []
            for row, begin, stop in zip(names, [0, *ends], ends):
                own = ids[begin:stop] + end
                for i, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    rows.append((row, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["row_id", "piece", "start", "length", "ids_crc32"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    return common.per_batch(rows, schema, make).withColumnRenamed("row_id", id_col)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the sum and of two families of dual feasible functions."""
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((counts * x).sum()) // capacity)
    for a in range(1, capacity // 2 + 1):  # 0 below a, capacity above capacity - a, else x
        f = np.where(x < a, 0, np.where(x > capacity - a, capacity, x))
        best = max(best, -(-int((counts * f).sum()) // capacity))
    for k in range(1, 20):  # x if (k + 1) x is a multiple of capacity, else floor((k + 1) x / capacity) * capacity / k
        scaled = (k + 1) * x
        f = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, -(-int((counts * f).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each piece, and the number of bins.

    Bins are kept by the room they have left; a piece goes to the fullest bin that takes it.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted, distinct, those with bins
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            room, b, n = capacity, n, n + 1
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return bins, offsets, n


def _round(rows: DataFrame, n_parts: int, turn: int, capacity: int) -> DataFrame:
    """Pack each partition; ``given`` marks the pieces to exchange. Bins are numbered by turn, partition and bin."""
    # the sequence number leaves 28 bits for bins, 20 for partitions and 15 for turns
    if turn >> 15 or n_parts >> 20:
        raise ValueError(f"turn {turn} or {n_parts} partitions do not fit the sequence numbers")
    schema = "row_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, part int, bins long, bound long, given boolean"

    def run(batches):
        rows = pa.Table.from_batches(list(batches))
        if not rows.num_rows:
            return
        part = TaskContext.get().partitionId()
        sizes = rows.column("length").to_numpy()
        bins, offsets, n = best_fit(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        fill = np.bincount(bins, weights=sizes, minlength=n)
        give = fill < capacity if n > bound else np.arange(n) == np.argmin(fill)
        if n == bound and fill.min() == capacity:
            give[:] = False
        sequence = (turn << 48) + (part << 28) + bins
        out = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))
        for name, value in (("part", pa.array(np.full(len(sizes), part, np.int32))), ("bins", pa.array(np.full(len(sizes), n))), ("bound", pa.array(np.full(len(sizes), bound))), ("given", pa.array(give[bins]))):
            out = out.append_column(name, value)
        yield from out.combine_chunks().to_batches()

    return rows.repartition(n_parts).mapInArrow(run, schema)


def pack(found: DataFrame, *, capacity: int = CAPACITY, part_rows: int = PART_ROWS, max_rounds: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """``found`` (of ``pieces``) with sequence_id and offset.

    Rounds end when at most one bin is given up or none is saved; each other round saves one at least, so they do end.
    """
    columns = ["row_id", "piece", "start", "length", "ids_crc32"]
    cut = shelve(found.select(F.col(id_col).cast("long").alias("row_id"), F.col("piece").cast("int"), *columns[2:]), "pieces", slim=True)
    full = cut.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, kept = cut.where(F.col("length") < capacity), [full]
    n = rest.count()
    before = None
    for turn in count(1):
        if not n:
            break
        packed = shelve(_round(rest, -(-n // part_rows), turn, capacity), f"packed{turn}")
        what = packed.agg(F.count_distinct(F.when(F.col("given"), F.col("sequence_id"))).alias("bins"), F.count_if("given").alias("rows")).first()
        if before is not None and what is not None:
            total = packed.agg(F.count_distinct("sequence_id")).first()[0]
            if total >= before[0]:  # nothing saved: the bins of the round before stand
                kept.append(before[1])
                n = 0
                break
        done = packed.select(*columns, "sequence_id", "offset", "given")
        kept.append(done.where(~F.col("given")).drop("given"))
        before = (what["bins"], done.where("given").drop("given"))
        rest, n = done.where("given").select(*columns), what["rows"]
        if what["bins"] <= 1 or turn == max_rounds:
            kept.append(before[1])
            break
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("row_id", id_col)


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(common.table(spark, sf_dir, "documents"), tokenizer()))


SQL: dict[str, str] = {}
