"""Token counts by dynamic programming over a trie of pre-tokens.

The unigram model takes its pieces from a public vocabulary file whose pieces stand in order of merging; by Zipf's law
the piece at rank r has probability 1 / (r * H), H the harmonic sum. A pre-token is a word between white space with
the word mark before it. Its best segmentation is the one of the highest probability (ties: fewer tokens). A character
that is no piece falls back to its bytes, one token each, every one ``UNKNOWN`` below the least likely piece.

The distinct pre-tokens are inserted in a trie. A node holds the forward score of its prefix (best score and the tokens
that give it), computed once, when the node is made, for all pre-tokens that share the prefix; the node at a pre-token's
end marks it as a terminal, whose count is the pre-token's. A worker keeps its trie from batch to batch and starts a
new one beyond ``NODES`` nodes; counts of up to ``CACHE`` pre-tokens are found by hash without another walk.

The probabilities are assumed, not trained: the counts are those of this model and of no published tokenizer.

Null, empty: no pre-tokens and no tokens. Rows with the same id are counted one by one. Other columns are ignored,
whatever their names; no rows, no result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import common

MARK = "▁"
UNKNOWN = 10.0
CACHE, NODES = 2_000_000, 400_000
#: Characters of a pre-token beyond which it is not inserted.
LONG = 1000


def unigram(path: str) -> tuple[dict[str, float], float]:
    """Log-probability of each ordinary piece, and of one byte of an unknown character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ordinary.sort(key=lambda i: (-model.get_score(i), i))
    whole = math.log(sum(1 / r for r in range(1, len(ordinary) + 1)))
    scores = {model.id_to_piece(i): -math.log(r) - whole for r, i in enumerate(ordinary, 1)}
    return scores, min(scores.values()) - UNKNOWN


class Trie:
    """Pre-tokens and the forward scores of all their prefixes."""

    def __init__(self, pieces: dict[str, float], byte: float) -> None:
        # all suffixes of pieces: a string that is none ends the search for longer ones
        self.pieces: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(len(p))}
        self.pieces.update(pieces)
        self.byte = byte
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node and code point -> node
        self.score, self.count = [0.0], [0]  # of each node; the root is the empty prefix
        self.terminal: dict[int, int] = {}  # node -> tokens of the pre-token that ends there

    def insert(self, word: str) -> int:
        """Tokens of a pre-token."""
        text = MARK + word
        if len(text) > LONG:
            return self._alone(text)
        child, score, count = self.child, self.score, self.count
        path = [0]
        for end, c in enumerate(text, 1):
            edge = path[-1] << 21 | ord(c)
            node = child.get(edge)
            if node is None:
                node = child[edge] = len(score)
                best, tokens = self._forward(text, end, path)
                score.append(best)
                count.append(tokens)
            path.append(node)
        return self.terminal.setdefault(path[-1], count[path[-1]])

    def _forward(self, text: str, end: int, path: list[int]) -> tuple[float, int]:
        """The best score of text[:end] and its tokens; the last of ``path`` are the nodes of its longest prefixes."""
        known, best, n = self.pieces, -math.inf, 0
        for back in range(1, min(end, len(path)) + 1):
            piece = known.get(text[end - back : end], False)
            if piece is False:
                break
            if piece is not None:
                value, tokens = self.score[path[-back]] + piece, self.count[path[-back]] + 1
                if value > best or value == best and tokens < n:
                    best, n = value, tokens
        if best == -math.inf:
            size = len(text[end - 1].encode())
            best, n = self.score[path[-1]] + size * self.byte, self.count[path[-1]] + size
        return best, n

    def _alone(self, text: str) -> int:
        """Tokens of a very long pre-token, of which only as many prefixes are kept as a piece is long."""
        kept = len(self.score)
        path, most = [0], max(map(len, self.pieces), default=1)
        for end in range(1, len(text) + 1):
            found = self._forward(text, end, path)
            if len(path) <= most:
                path.append(len(self.score))
                self.score.append(found[0])
                self.count.append(found[1])
            else:  # the node that no piece reaches any more is used again
                path.append(path.pop(0) or len(self.score))
                if path[-1] == len(self.score):
                    self.score.append(0.0)
                    self.count.append(0)
                self.score[path[-1]], self.count[path[-1]] = found
        tokens = self.count[path[-1]]
        del self.score[kept:], self.count[kept:]
        return tokens


class Counter:
    """Token counts of words, kept by a 64-bit hash of their bytes."""

    def __init__(self, pieces: dict[str, float], byte: float) -> None:
        self.trie = Trie(pieces, byte)
        self.words, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        n = len(starts) - 1
        begin, end, owner = common.word_spans(flat, starts, common.SPACED)
        if not len(begin):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        hashes, first, which = np.unique(common.span_hashes(flat, begin, end), return_index=True, return_inverse=True)
        if len(self.words) > CACHE:
            self.words, self.tokens = self.words[:0], self.tokens[:0]
        new = np.ones(len(hashes), bool)
        if len(self.words):
            new = self.words[np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)] != hashes
        if new.any():
            raw, at = flat.tobytes(), first[new]
            tokens = np.zeros(len(at), np.int64)
            for i, (a, b) in enumerate(zip(begin[at].tolist(), end[at].tolist())):
                if len(self.trie.score) > NODES:
                    self.trie.clear()
                tokens[i] = self.trie.insert(raw[a:b].decode())
            words = np.concatenate([self.words, hashes[new]])
            order = np.argsort(words, kind="stable")
            self.words, self.tokens = words[order], np.concatenate([self.tokens, tokens])[order]
        tokens = self.tokens[np.searchsorted(self.words, hashes)][which]
        return np.bincount(owner, minlength=n), np.bincount(owner, weights=tokens, minlength=n).astype(np.int64)


def count(docs: DataFrame, model_path: str, *, id_col: str = "doc_id") -> DataFrame:
    """One row for each document: ``id_col``, n_words, n_tokens."""
    model = docs.sparkSession.sparkContext.broadcast(unigram(model_path))

    def make():
        counter = Counter(*model.value)

        def step(batch: pa.RecordBatch):
            flat, starts = common.text_bytes(batch.column("text"))
            for i, j in common.chunks(starts):
                found = counter.count(flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(i, j - i), *map(pa.array, found)], names=["row_id", "n_words", "n_tokens"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    return common.per_batch(rows, "row_id long, n_words long, n_tokens long", make).withColumnRenamed("row_id", id_col)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


SQL: dict[str, str] = {}
