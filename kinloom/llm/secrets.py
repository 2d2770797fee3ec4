"""Secret scan: keyword automaton, anchored patterns near its hits, checksums.

An Aho-Corasick automaton over the lower-cased text finds the places of all keywords in one pass. Only there the
pattern that belongs to the keyword is tried, anchored at the hit. Hexadecimal runs have no keyword of their own; their
"keyword" is a run of ``HEX_LEAST`` bytes of the hexadecimal class, searched for in the text mapped to that class.
Formats that carry a checksum are reported only if it holds: CRC-32 in base 62 (access tokens of code hosts and
package registries), the bech32 polynomial (secret keys ``AGE-SECRET-KEY-1``) and a double SHA-256 in base 58
(extended private keys ``xprv``).

Spans are in code points, the end is exclusive. Null: an empty text. Matches of one kind do not overlap and are taken
from the left; a match that is too short is dropped but still consumes its characters, as when a pattern is run over
the whole text. Rows with the same id are scanned one by one. Other columns are ignored (``find``) or kept (``redact``),
whatever their names. No rows, no result.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm import common

KINDS = ("assign", "access", "hex", "crc_token", "age_key", "xprv_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
# Keywords and patterns of the contract, prefixes and alphabets of public formats.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CRC_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CRC_TOKEN = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
AGE = re.compile(rb"AGE-SECRET-KEY-1([QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58})(?![A-Z0-9])")
XPRV = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
_HEX = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))


def crc_holds(body: bytes, check: bytes) -> bool:
    """Whether ``check`` is the CRC-32 of ``body``, six digits in base 62."""
    value = 0
    for c in check.decode():
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body)


def bech32_holds(prefix: str, data: str) -> bool:
    state = 1
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    for v in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            state ^= g if top >> i & 1 else 0
    return state == 1


def base58_holds(text: str) -> bool:
    """Whether the last four of the 82 bytes are the first of the double SHA-256 of the others."""
    value = 0
    for c in text:
        value = value * 58 + BASE58.index(c)
    if value.bit_length() > 82 * 8:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    words = [(w, "assign") for w in ASSIGN_WORDS] + [("akia", "access")] + [(w, "crc_token") for w in CRC_WORDS]
    for word, kind in [*words, ("age-secret-key-1", "age_key"), ("xprv", "xprv_key")]:
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def _at(kind: str, raw: bytes, start: int) -> tuple[int, bool] | None:
    """End of the match of ``kind`` at ``start``, and whether it passes its test; None where there is no match."""
    if kind == "assign":
        m = ASSIGN.match(raw, start)
        return m and (m.end(), len(m[1]) >= ASSIGN_LEAST)
    if kind == "access":
        m = ACCESS.match(raw, start)
        return m and (m.end(), m.end() - start >= ACCESS_LEAST)
    if kind == "crc_token":
        m = CRC_TOKEN.match(raw, start)
        return m and (m.end(), crc_holds(m[1], m[2]))
    if kind == "age_key":
        m = AGE.match(raw, start)
        return m and (m.end(), bech32_holds("age-secret-key-", m[1].decode().lower()))
    m = XPRV.match(raw, start)
    return m and (m.end(), base58_holds(m[0].decode()))


def scan(text: str | None, words) -> list[tuple[str, int, int]]:
    """All secrets of a text by start, then kind: (kind, start, end) in code points."""
    raw = (text or "").encode()
    hits = [(kind, end - size + 1) for end, (kind, size) in words.iter(raw.lower().decode("latin-1"))]
    hits.sort(key=lambda x: x[1])
    found: list[tuple[str, int, int]] = []
    after = dict.fromkeys(KINDS, 0)
    for kind, start in hits:
        if start >= after[kind] and (m := _at(kind, raw, start)):
            if m[1] or kind in ("assign", "access"):
                after[kind] = m[0]
            if m[1]:
                found.append((kind, start, m[0]))
    classes = raw.translate(_HEX)
    start = classes.find(b"h" * HEX_LEAST)
    while start >= 0:
        end = classes.find(b".", start)
        end = len(raw) if end < 0 else end
        found.append(("hex", start, end))
        start = classes.find(b"h" * HEX_LEAST, end)
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    if len(raw) != len(text or ""):
        found = _in_code_points(raw, found)
    return found


def _in_code_points(raw: bytes, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    place, done, count = {}, 0, 0
    for b in sorted({x for _, s, e in found for x in (s, e)}):
        count += len(raw[done:b].decode())
        place[b], done = count, b
    return [(kind, place[s], place[e]) for kind, s, e in found]


def find(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row for each of ``docs``: ``id_col`` and its spans."""
    return _scan(docs.select(F.col(id_col), F.col("text").cast("string").alias("text")), [id_col])


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with each secret (overlapping ones as one) replaced by ``mask``; n_chars, if there, follows.

    Null texts stay null. All columns stay, in their order.
    """
    return _scan(docs, docs.columns, mask).select(*docs.columns)


def _scan(docs: DataFrame, keep: list[str], mask: str | None = None) -> DataFrame:
    fields = [docs.schema[c] for c in keep]
    name = common.fresh(docs.columns, "_spans")
    spans_type = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*fields, T.StructField(name, spans_type)])
    counted = mask is not None and any(f.name == "n_chars" and f.dataType.simpleString() == "bigint" for f in fields)

    def make():
        words = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def step(batch: pa.RecordBatch):
            texts = batch.column("text").to_pylist()
            spans = [scan(t, words) for t in texts]
            columns = {f.name: batch.column(f.name) for f in fields}
            if mask is not None:
                columns["text"] = pa.array([masked(t, s, mask) for t, s in zip(texts, spans)], batch.column("text").type)
                if counted:
                    sizes = zip(columns["text"], columns["n_chars"], spans)
                    columns["n_chars"] = pa.array([len(t.as_py()) if s else n.as_py() for t, n, s in sizes], pa.int64())
            columns[name] = pa.array([[dict(zip(("kind", "start", "end"), x)) for x in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return step

    found = common.per_batch(docs, schema, make)
    return found if mask is not None else found.withColumnRenamed(name, "spans")


def masked(text: str | None, spans: list[tuple[str, int, int]], mask: str) -> str | None:
    out, done = [], 0
    for _, start, end in spans:
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]]) if spans else text


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))
    base = KINDS[:3]
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(kind) for kind in base),
        F.sha2(joined(F.filter("spans", lambda x: x.kind.isin(*base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


SQL: dict[str, str] = {}
