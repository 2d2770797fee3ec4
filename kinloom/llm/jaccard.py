"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the distinct 5-word shingles of its lower-cased (A-Z) text, told apart by 64-bit hashes; with
fewer words the whole sequence is its one shingle. Two sets link when ``den * intersection >= num * union``.

1. Equal sets are one class, its smallest id the representative. Only representatives go on.
2. Tokens (shingles) are ordered by hash. If two sets of sizes n and m link, they share at least ``need(max(n, m))``
   tokens, so for each l their l-prefixes (the first n - need(n) + l tokens) share at least l: of the shared tokens the
   l smallest lie in both.
3. A sketch names hot tokens: those that several sets of one task have in their prefix, summed over tasks. Any such
   list is valid, it steers cost and never results; so it may be bounded (``MAX_HOT``) and broadcast.
4. Adaptive prefixes: a set's candidate cost is the hot tokens in its prefix. It lengthens the prefix to the smallest
   l whose l-prefix holds fewer than l hot tokens, and in exchange l shared prefix tokens are required: for two sets
   the smaller of the two l. One of so many shared tokens is not hot, so the set is indexed by those alone.
5. A set that is hot in three quarters or more has no such l. It takes half of its tokens as its prefix, with the l
   that belongs to it, and is indexed by all its tokens that are not hot; that finds its links with sets of the first
   kind, and with its own kind if a shared token is not hot. What is left are links of two such sets through hot
   tokens alone; each side must then have ``both(n, m)`` hot tokens, which bounds the partner's size. They meet in
   buckets of (hot token of the plain prefix, size class).
6. Buckets with the same members are one. In each, all members are compared with one pivot: linear work, and a family
   of near copies becomes one component at once. Only buckets that still hold several components go on: there the
   members outside the largest component are compared with all others, in blocks. A pair inside one component needs
   no comparison. No pair that could join two components is left out, so components are exact; there is no cap.
7. A comparison bounds the overlap by sizes and parity bitmaps, which are a small part of the texts. Texts are read
   again for pairs that pass, once a document: there the shared tokens of both prefixes are counted, and only a pair
   that shares as many as the smaller l asks for is verified on the whole sets.

Null or empty text, or no words: an empty set, linked with nothing but rows of its own id. Rows that repeat an id are
one node of the graph: they have one component, whatever their texts. A row without an id is a node of its own; it
links like any other, takes the smallest id that it reaches (null if there is none), and never names a component.
Other columns are ignored, whatever their names. No rows, no result.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.llm import common
from kinloom.operators.components import connected_components
from kinloom.session import shelve

SHINGLE = 5
NUM, DEN = 75, 100
HOT = 32
MAX_HOT = 1 << 18
TASK_HOT = 20_000
SIZE_STEP = np.log(1.1)
MAP = 1 << 12
#: Members of a bucket that a task holds at once, and members that one copy of a pivot is compared with.
BLOCK, STAR = 1024, 1 << 16
#: What becomes of a row in a comparison, in the order in which the rows of a block come.
HELD, QUERY, BOTH = 0, 1, 2
#: Bytes of text that are hashed at once, and rows of an Arrow batch: small, as two workers share an executor.
CHUNK, BATCH_ROWS = 1 << 18, 1000


def need(n):
    """Tokens that a set of n shares at least with any set it links with."""
    return -(-NUM * n // DEN)


def both(n, m):
    """Tokens that linked sets of n and m share at least."""
    return -(-NUM * (n + m) // (DEN + NUM))


def shingles(flat: np.ndarray, starts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each text, one text after another, and where each text's begin (one more at the end)."""
    low = common.LOWER[flat]
    begin, end, owner = common.word_spans(low, starts, common.SPACED)
    words = common.span_hashes(low, begin, end)
    n_words = np.bincount(owner, minlength=len(starts) - 1)
    first = np.concatenate([[0], np.cumsum(n_words)])
    grams = common.gram_hashes(words, k)
    whole = np.flatnonzero(owner[: len(grams)] == owner[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
    tokens, of = [grams[whole]], [owner[whole]]
    for i in np.flatnonzero((n_words > 0) & (n_words < k)).tolist():
        size = int(n_words[i])
        tokens.append(common.gram_hashes(words[first[i] : first[i + 1]], size) ^ np.uint64(size))
        of.append(np.array([i]))
    token, of = np.concatenate(tokens), np.concatenate(of)
    order = np.lexsort((token, of))
    token, of = token[order], of[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
    token, of = token[new], of[new]
    return token, np.searchsorted(of, np.arange(len(starts)))


def set_keys(tokens: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the tokens of each set; equal for equal sets."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([[np.uint64(0)], np.cumsum(common.mix(tokens ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[cuts[1:]] - total[cuts[:-1]]).astype(np.int64))
    return out[0], out[1]


def _sets(batch: pa.RecordBatch):
    """(rows, tokens, cuts) of a batch, a chunk of texts at a time."""
    flat, starts = common.text_bytes(batch.column("text"))
    for i, j in common.chunks(starts, CHUNK):
        yield i, j, *shingles(flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i])


def first_pass(docs: DataFrame) -> DataFrame:
    """kind 0: id, size and keys of each document. kind 1: a token and how many sets of the task have it in front."""
    schema = "kind int, id long, n long, k1 long, k2 long"

    def run(batches):
        seen: set[tuple[int, int]] = set()
        fronts: list[np.ndarray] = []
        hot = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def fold(hot, fronts):
            token, which = np.unique(np.concatenate([hot[0], *fronts]), return_inverse=True)
            times = np.bincount(which, weights=np.concatenate([hot[1], np.ones(len(which) - len(hot[0]))])).astype(np.int64)
            return token[times > 1], times[times > 1]

        def rows(kind, *columns):
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=["kind", "id", "n", "k1", "k2"])

        for batch in batches:
            for i, j, tokens, cuts in _sets(batch):
                n, (k1, k2) = np.diff(cuts), set_keys(tokens, cuts)
                yield rows(0, batch.column("id").slice(i, j - i), n, k1, k2)
                for d, key in enumerate(zip(k1.tolist(), k2.tolist())):
                    if n[d] and key not in seen:
                        seen.add(key)
                        fronts.append(tokens[cuts[d] : cuts[d] + n[d] - need(n[d]) + 1])
                if sum(map(len, fronts)) > 1_000_000:
                    hot, fronts = fold(hot, fronts), []
                    seen.clear()
        token, times = fold(hot, fronts)
        most = np.argsort(-times, kind="stable")[:TASK_HOT]
        none = np.zeros(len(most), np.int64)
        yield rows(1, token[most].astype(np.int64), times[most], none, none)
        common.tidy()

    return docs.select("id", "text").mapInArrow(run, schema)


def adaptive(tokens: np.ndarray, hot: np.ndarray) -> int:
    """The smallest l whose l-prefix holds fewer than l hot tokens; 0 if there is none."""
    n = len(tokens)
    base = n - need(n)
    before = np.cumsum(hot)[base:]  # hot tokens in the l-prefix, l = 1, 2, ...
    good = np.flatnonzero(before < np.arange(1, len(before) + 1))
    return int(good[0]) + 1 if len(good) else 0


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity bitmap of a set, addressed by the tokens' low bits: four to eight bits a token up to ``MAP`` bits, which is
    where families of near copies are told apart; in longer sets chance plays less, so that from ``MAP`` tokens on one
    to two bits a token are enough."""
    n = len(tokens)
    size = 1 << max(6, n.bit_length(), min((4 * n).bit_length(), MAP.bit_length() - 1))
    place = (tokens & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


INDEX = "id long, n long, a long, keys array<long>, front array<long>, level int, map binary"


def second_pass(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Index of each representative: its size n, its hot tokens a, the tokens it is indexed by (keys), the hot tokens of
    its plain prefix if no prefix is long enough for it (front, else none), its l (level) and its bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(hot))

    def make():
        hot = shared.value

        def one(own: np.ndarray, warm: np.ndarray) -> tuple:
            n = len(own)
            level = adaptive(own, warm) if n else 1
            front = np.zeros(0, np.int64)
            if level:
                keys = own[: n - need(n) + level][~warm[: n - need(n) + level]]
            else:
                keys, front = own[~warm], own[: n - need(n) + 1][warm[: n - need(n) + 1]]
                level = max(1, n // 2 - (n - need(n)))
            return keys.astype(np.int64), front.astype(np.int64), level, bitmap(own)

        def step(batch: pa.RecordBatch):
            for i, j, tokens, cuts in _sets(batch):
                is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens if len(hot) else np.zeros(len(tokens), bool)
                rows = [one(tokens[a:b], is_hot[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                keys, fronts, levels, maps = zip(*rows)
                many = np.add.reduceat(np.append(is_hot, False).astype(np.int64), cuts[:-1]) * (np.diff(cuts) > 0)
                columns = [batch.column("id").slice(i, j - i), pa.array(np.diff(cuts)), pa.array(many), _lists(keys), _lists(fronts)]
                columns += [pa.array(levels, pa.int32()), pa.array(maps, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in INDEX.split(", ")])

        return step

    return common.per_batch(docs.select("id", "text"), INDEX, make)


def _lists(parts: tuple[np.ndarray, ...]) -> pa.Array:
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)))


def sizes_fit(n, m):
    """Whether sets of n and m tokens can link (numbers or Columns)."""
    return (DEN * n >= NUM * m) & (DEN * m >= NUM * n)


def plain_buckets(index: DataFrame) -> DataFrame:
    """(bucket, id, n, pivot, m) for all tokens that are not hot and that several sets are indexed by; m: the pivot's n.

    Tokens with the same sets are one bucket, named by the smallest. The index is shuffled once, by token: the sizes are
    counted there and the members of the chosen tokens picked from the same shuffle. A token in one of a hundred sets or
    more is in the list of hot ones (fewer than a hundred times the length of a prefix can be as frequent, and a task
    reports ``TASK_HOT``), so no token here outweighs the fair share of a ten-thousandth of the tokens' rows.
    """
    rows = index.select("id", "n", F.explode("keys").alias("token")).where("token IS NOT NULL").repartition("token")  # the join's own filter, or it shuffles anew
    by_token = rows.groupBy("token").agg(
        F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("pivot"), F.expr("bit_xor(xxhash64(id))").alias("members"), F.expr("bit_xor(xxhash64(id, 1))").alias("also")
    )
    chosen = by_token.where("size > 1").groupBy("members", "also", "size", "pivot").agg(F.min("token").alias("token"))
    return rows.join(chosen.select("token", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("m")), "token").withColumnRenamed("token", "bucket")


def hot_buckets(index: DataFrame) -> DataFrame:
    """(bucket, id, n, pivot, m) for sets without an adaptive prefix; m: the pivot's n."""
    limit = F.floor(F.col("a") * (DEN + NUM) / NUM + 1e-9) - F.col("n")  # the largest partner its hot tokens allow
    cls = lambda n: F.floor(F.log(F.greatest(n, F.lit(1))) / float(SIZE_STEP) + 1e-9).cast("int")
    top = F.least(F.col("n"), limit)
    rows = index.where(F.size("front") > 0).select("id", "n", "a", "front", cls(F.col("n")).alias("own"), (limit >= F.col("n")).alias("able"), cls(F.ceil(F.col("n") * NUM / DEN)).alias("low"), cls(top).alias("high"))
    # as the larger set of a pair it visits the classes of smaller partners, its own class included where allowed
    rows = rows.where("high >= low").withColumn("class", F.explode(F.sequence("low", "high")))
    rows = rows.withColumn("first", F.col("able") & (F.col("class") == F.col("own")))
    rows = rows.select("id", "n", "class", "first", (F.col("a") / F.col("n") * F.col("first").cast("int")).alias("rank"), F.explode("front").alias("token"))
    best = rows.groupBy("token", "class").agg(F.max(F.struct("first", "rank", (-F.col("id")).alias("back"), "n")).alias("best"), F.count("*").alias("size"))
    best = best.where("best.first AND size > 1").select("token", "class", (-F.col("best.back")).alias("pivot"), F.col("best.n").alias("m"), "size")
    return common.look_up(rows.select("id", "n", "token", "class"), best, ["token", "class"]).select(F.xxhash64("token", "class").alias("bucket"), "id", "n", "pivot", "m")


def shared_tokens(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sorted arrays: members of the one that occur in the other."""
    if not len(a) or not len(b):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


class Mark:
    """What is known of a set before its text is read again: its size and its bitmap."""

    def __init__(self, n: int, bits: bytes) -> None:
        self.n, self.bits, self.size = n, int.from_bytes(bits, "little"), 8 * len(bits)

    def may_link(self, other: Mark) -> bool:
        """Whether two sets can link, by their sizes and bitmaps (the longer one is folded)."""
        n, m = self.n, other.n
        if not sizes_fit(n, m):
            return False
        x, y, long, short = self.bits, other.bits, self.size, other.size
        if long < short:
            x, y, long, short = y, x, short, long
        while long > short:
            long //= 2
            x = (x >> long) ^ (x & ((1 << long) - 1))
        return (n + m - (x ^ y).bit_count()) // 2 >= both(n, m)


class Whole:
    """A whole set with its l."""

    def __init__(self, tokens: bytes, level: int) -> None:
        self.tokens, self.level = np.frombuffer(tokens, "<u8"), level
        n = len(self.tokens)
        self.prefix = self.tokens[: n - need(n) + level]

    def may_link(self, other: Whole) -> bool:
        """Whether two sets link: first the shared tokens of their prefixes are counted, then those of the whole sets."""
        if shared_tokens(self.prefix, other.prefix) < min(self.level, other.level):
            return False
        n, m = len(self.tokens), len(other.tokens)
        shared = shared_tokens(self.tokens, other.tokens)
        return shared > 0 and DEN * shared >= NUM * (n + m - shared)


def compare(dealt: DataFrame, known: DataFrame, kind: type, columns: list[str]) -> DataFrame:
    """Pairs (a, b), a < b, that may link (``kind``: by marks or whole sets, made of ``columns`` of ``known``).

    ``dealt``: place, block, role, id, label. A task holds the rows of one block that are to be held, and compares each
    query, as it streams by, with those held so far; rows of role ``BOTH`` are compared first and then held. Two rows
    with the same label are not compared.
    """
    rows = dealt.join(known, "id").repartition("place", "block").sortWithinPartitions("place", "block", "role")

    def run(batches):
        at, held = None, []
        for batch in batches:
            a, b = [], []
            values = [batch.column(c).to_pylist() for c in columns]
            for place, block, role, i, label, *own in zip(*(batch.column(c).to_pylist() for c in ("place", "block", "role", "id", "label")), *values):
                if (place, block) != at:
                    at, held = (place, block), []
                mark = kind(*own)
                for other, its_label, its in held if role != HELD else ():
                    if its_label != label and mark.may_link(its):
                        a.append(min(i, other))
                        b.append(max(i, other))
                if role != QUERY:
                    held.append((i, label, mark))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        held.clear()
        common.tidy()

    return rows.mapInArrow(run, "a long, b long").distinct()


def stars(pairs: DataFrame, known: DataFrame, kind: type, columns: list[str]) -> DataFrame:
    """Those of ``pairs`` (a, b; distinct) that may link. The pairs of one a are dealt over blocks of about ``STAR``,
    and a is sent once to each."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / STAR).cast("int"))
    members = common.look_up(pairs, sizes, ["a"]).select(F.col("a").alias("place"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(QUERY).alias("role"), F.col("b").alias("id"))
    centres = sizes.select(F.col("a").alias("place"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(HELD).alias("role"), F.col("a").alias("id"))
    return compare(members.unionByName(centres).withColumn("label", F.col("id")), known, kind, columns)


MARKS = ["n", "map"]


def crossing(rows: DataFrame, marks: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) of a bucket that have different labels and that their marks do not rule out.

    ``rows``: bucket, id, n, label. In each bucket the commonest label needs no comparison within itself: the others are
    the queries, compared with all members. A bucket of up to ``block`` members is sent whole, each row once, but for
    those that no other size in the bucket fits. Members and queries of a larger one are dealt over parts of about that
    size, and each part of the members meets each part of the queries. Pairs that are ruled out are never rows.
    """
    by_label = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size"), F.count("*").alias("labels"))
    parts = lambda n: F.ceil(n / block).cast("int")
    mixed = mixed.where("labels > 1").select("bucket", F.col("most.label").alias("main"), "size", parts(F.col("size")).alias("blocks"), parts(F.col("size") - F.col("most.n")).alias("turns"))
    rows = common.look_up(rows, shelve(mixed, "mixed", slim=True), ["bucket"])
    small, large, by_size = rows.where("blocks = 1"), rows.where("blocks > 1"), Window.partitionBy("bucket").orderBy("n")
    small = small.select("*", F.lag("n").over(by_size).alias("less"), F.lead("n").over(by_size).alias("more"))
    small = small.where(sizes_fit(F.col("n"), F.col("less")) | sizes_fit(F.col("n"), F.col("more")))
    members = small.select(F.col("bucket").alias("place"), F.lit(0).alias("block"), F.lit(BOTH).alias("role"), "id", "label")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda rows, role: rows.select(F.col("bucket").alias("place"), (F.col("i") * F.col("turns") + F.col("j")).alias("block"), F.lit(role).alias("role"), "id", "label")
    members = members.unionByName(place(large.withColumn("i", own("blocks")).withColumn("j", every("turns")), HELD))
    queries = place(large.where("label <> main").withColumn("j", own("turns")).withColumn("i", every("blocks")), QUERY)
    return compare(members.unionByName(queries), marks, Mark, MARKS)


def whole_sets(texts: DataFrame) -> DataFrame:
    """id and the tokens of each set."""

    def make():
        def step(batch: pa.RecordBatch):
            for i, j, tokens, cuts in _sets(batch):
                whole = [tokens[a:b].astype("<u8").tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(whole, pa.binary())], names=["id", "tokens"])

        return step

    return common.per_batch(texts, "id long, tokens binary", make)


def links(close: DataFrame, docs: DataFrame, levels: DataFrame) -> DataFrame:
    """Those of ``close`` (pairs a, b; a table) that link, by their whole sets. Only texts that are in a pair are read."""
    ids = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
    ids = shelve(ids.join(levels, "id"), "close_ids", slim=True)
    sets = whole_sets(common.restrict(docs, "id", ids.select("id"), "left_semi")).join(ids, "id")
    return stars(close, sets, Whole, ["tokens", "level"])


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own."""
    counts = docs.select(F.col(id_col).cast("long").alias("id")).groupBy("id").count()
    return not counts.where("id IS NULL OR count > 1").head(1)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", hot_from: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_shingles, component_id."""
    with small_batches(docs.sparkSession):  # all Python stages are written inside; the result itself is plain joins
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        if unique_ids(rows, "id"):
            return _near_duplicates(rows, hot_from).toDF(id_col, "n_shingles", "component_id")
        named = shelve(rows.select("id", "text", F.monotonically_increasing_id().alias("row")), "numbered")
        found = _near_duplicates(named.select(F.col("row").alias("id"), "text"), hot_from).toDF("row", "n", "component")
        found = shelve(found.join(named.select("row", F.col("id").alias("name")), "row"), "by_row", slim=True)
        return _merged(found).toDF(id_col, "n_shingles", "component_id")


def _merged(found: DataFrame) -> DataFrame:
    """(name, n, smallest name) of rows (row, n, component, name): rows of one name belong together."""
    steps = found.where("name IS NOT NULL").groupBy("name", "component").agg(F.count("*").alias("n"))
    firsts = steps.groupBy("name").agg(F.min("component").alias("a"), F.count("*").alias("size")).where("size > 1")
    edges = common.look_up(steps.select("name", F.col("component").alias("b")), shelve(firsts, "firsts", slim=True), ["name"]).select("a", "b")
    known = connected_components(edges)
    rows = found.join(known, found.component == known.node, "left").select("name", "n", F.coalesce(known.component, found.component).alias("component"))
    rows = shelve(rows, "merged", slim=True)
    least = shelve(rows.groupBy("component").agg(F.min("name").alias("least"), F.count("*").alias("size")), "least", slim=True)
    return common.look_up(rows, least, ["component"]).select("name", "n", "least")


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Arrow batches of at most ``rows`` rows for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _indexed(docs: DataFrame, hot_from: int) -> tuple[DataFrame, ...]:
    """Sets, their representatives, both kinds of buckets, and the marks of the representatives."""
    first = shelve(first_pass(docs), "sets", slim=True)
    sets = first.where("kind = 0").drop("kind")
    classes = shelve(sets.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "classes", slim=True)
    placed = shelve(common.look_up(sets.where("n > 0"), classes, ["k1", "k2"]).select("id", "n", "rep"), "placed", slim=True)
    heavy = first.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= hot_from)
    hot = heavy.orderBy(F.desc("n"), "id").limit(MAX_HOT).select("id").toArrow().column("id").to_numpy().astype(np.int64).view(np.uint64)
    reps = common.restrict(docs, "id", placed.where("id <> rep").select("id"), "left_anti")
    index = shelve(second_pass(reps, hot).where("n > 0"), "index")
    plain = shelve(plain_buckets(index), "buckets", slim=True)
    hots = shelve(hot_buckets(index), "hot_buckets", slim=True)
    return sets, classes, placed, plain, hots, index.select("id", "level", *MARKS)


def _members(plain: DataFrame, hots: DataFrame) -> DataFrame:
    """(bucket, id, n) of both kinds of buckets. Hot buckets that share members are one family: their sets share most
    tokens, hence most buckets."""
    rows = plain.select("bucket", "id", "n")
    if not hots.head(1):
        return rows
    family = connected_components(hots.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    sizes = hots.select("id", "n").distinct()
    return rows.unionByName(family.join(sizes, family.node == sizes.id).select(F.xxhash64(F.lit("family"), "component").alias("bucket"), "id", "n"))


def _near_duplicates(docs: DataFrame, hot_from: int) -> DataFrame:
    """(id, n, component) of ``docs`` (id: long, unique, not null; text)."""
    sets, classes, placed, plain, hots, index = _indexed(docs, hot_from)
    marks, levels = index.drop("level"), index.select("id", "level")
    pairs = plain.unionByName(hots).where((F.col("id") != F.col("pivot")) & sizes_fit(F.col("n"), F.col("m")))
    pairs = pairs.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    found = shelve(links(shelve(stars(pairs, marks, Mark, MARKS), "close", slim=True), docs, levels), "links", slim=True)
    known = connected_components(found)
    # buckets that still hold several components; pairs with the pivot are done
    rows = _members(plain.where("id <> pivot"), hots)
    rows = rows.join(known, rows.id == known.node, "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("label"))
    rest = shelve(links(shelve(crossing(shelve(rows, "labelled", slim=True), marks, BLOCK), "close", slim=True), docs, levels), "links", slim=True)
    known = connected_components(found.union(rest)) if rest.head(1) else known
    named = classes.join(known, classes.rep == known.node, "left").select("rep", "size", F.coalesce("component", "rep").alias("component"))
    done = common.look_up(placed, shelve(named, "named", slim=True), ["rep"]).select("id", "n", "component")
    return done.union(sets.where("n = 0").select("id", "n", F.col("id").alias("component")))


def near_links(docs: DataFrame, *, id_col: str = "doc_id", hot_from: int = HOT) -> tuple[DataFrame, DataFrame]:
    """All links (a, b, a < b) between representatives of equal sets, and the members (``id_col``, rep) of these.

    Ids must be unique. Two documents link if they have one representative or if their representatives link. A bucket's
    pairs are all compared, also those within a component, so the rows grow with the links, which a large family has
    many of.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    if not unique_ids(rows, "id"):
        raise ValueError("links are between ids, so these must be there and unique")
    with small_batches(docs.sparkSession):
        _, _, placed, plain, hots, index = _indexed(rows, hot_from)
        found = _members(plain, hots).withColumn("label", F.col("id"))
        close = shelve(crossing(shelve(found, "labelled", slim=True), index.drop("level"), BLOCK), "close", slim=True)
        return shelve(links(close, rows, index.select("id", "level")), "links", slim=True), placed.select(F.col("id").alias(id_col), "rep")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


SQL = {
    "op10_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
keyed AS (SELECT doc_id, hash(array_to_string(list_sort(list(g)), chr(10))) AS k FROM s GROUP BY doc_id),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS r FROM keyed),
one AS (SELECT s.doc_id, g, n FROM s JOIN rep USING (doc_id) JOIN n USING (doc_id) WHERE doc_id = r),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM one x JOIN one y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
      HAVING 100 * count(*) >= 75 * (max(x.n) + max(y.n) - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT doc_id, r FROM rep WHERE doc_id <> r UNION SELECT r, doc_id FROM rep WHERE doc_id <> r),
c(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.node, e.b FROM c JOIN e ON c.reach = e.a),
m AS (SELECT node, min(reach) AS component_id FROM c GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
""",
}
