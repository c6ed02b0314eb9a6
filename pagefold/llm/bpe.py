"""Byte-level BPE by a segment tree.

For each match of the pattern, a segment tree over its byte positions holds the leftmost minimum pair rank. A merge takes
the root's pair and makes three point updates, at the pair and its live neighbours, each of logarithmic cost, so a match
of n bytes costs n log n however long it is. Matches of one size are merged together, a step of all of them at a time.
"""

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagefold.llm.chunks import Chunks, in_steps, slices
from pagefold.llm.common import read, texts

NONE = np.int64(1 << 62)
LOW = np.int64((1 << 32) - 1)
#: Positions up to which trees of one size are merged together, and table cells of one group.
WIDE, CELLS = 256, 1 << 20


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def tokens_of(path: str) -> list[bytes]:
    ids = ranks_of(path)
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = token
    return out


class Ranks:
    """The tokens of a rank file, and the ranks of pairs of them."""

    def __init__(self, path: str):
        self.ids = ranks_of(path)
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, i in self.ids.items():
            for k in range(1, len(token)):
                if (a := self.ids.get(token[:k])) is not None and (b := self.ids.get(token[k:])) is not None:
                    pairs[a << 20 | b] = i
        keys = np.array(sorted(pairs), np.int64)
        self.pairs, self.keys = pairs, np.append(keys, NONE)
        self.ranks = np.append(np.array([pairs[k] for k in keys.tolist()], np.int64), NONE)

    def rank(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank << 32 | position, so that the least is the leftmost of the least rank; NONE where no token is there."""
        key = a << 20 | b
        k = np.searchsorted(self.keys, key)
        return np.where((self.keys[k] == key) & (a >= 0) & (b >= 0), self.ranks[k] << 32 | at, NONE)


def _together(ranks: Ranks, pieces: list[bytes], size: int) -> list[bytes]:
    """The ids of pieces of at most size bytes, size a power of two: a tree for each row."""
    m = len(pieces)
    n = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
    at = np.arange(size)
    tok = np.full((m, size + 1), -1, np.int64)
    tok[:, :size] = np.where(at < n[:, None], ranks.byte_ids[raw], -1)
    nxt = np.tile(np.arange(1, size + 2), (m, 1))
    nxt[:, size] = size
    prv = np.tile(np.arange(-1, size), (m, 1))
    tree = np.full((m, 2 * size), NONE, np.int64)
    tree[:, size:] = ranks.rank(tok[:, :size], tok[:, 1:], at)
    k = size
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    rows = np.arange(m)

    def put(leaf: np.ndarray, value: np.ndarray) -> None:
        k = leaf + size
        tree[rows, k] = value
        while size > 1 and k[0] > 1:
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

    while True:
        rows = rows[tree[rows, 1] < NONE]
        if not len(rows):
            break
        best = tree[rows, 1]
        pos, merged = best & LOW, best >> 32
        right = nxt[rows, pos]
        after = nxt[rows, right]
        before = prv[rows, pos]
        tok[rows, pos], tok[rows, right] = merged, -1
        nxt[rows, pos], prv[rows, after] = after, pos
        put(right, np.full(len(rows), NONE))
        put(pos, ranks.rank(merged, tok[rows, after], pos))
        has = before >= 0
        if has.any():
            rows, before, merged, keep = rows[has], before[has], merged[has], rows
            put(before, ranks.rank(tok[rows, before], merged, before))
            rows = keep
    live = tok[:, :size] >= 0
    flat, ends = tok[:, :size][live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _alone(ranks: Ranks, piece: bytes) -> bytes:
    """The ids of one long piece, by the same tree."""
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    none, pairs = int(NONE), ranks.pairs
    tok = ranks.byte_ids[np.frombuffer(piece, np.uint8)].tolist() + [-1]
    nxt, prv = list(range(1, n + 1)) + [n], list(range(-1, n))
    tree = [none] * (2 * size)

    def value(i: int, j: int) -> int:
        r = pairs.get(tok[i] << 20 | tok[j]) if j < n else None
        return none if r is None else r << 32 | i

    def put(i: int, v: int) -> None:
        k = i + size
        tree[k] = v
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

    for i in range(n):
        tree[size + i] = value(i, i + 1)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    while tree[1] < none:
        i, merged = tree[1] & int(LOW), tree[1] >> 32
        j = nxt[i]
        k = nxt[j]
        tok[i], tok[j], nxt[i] = merged, -1, k
        prv[k] = i
        put(j, none)
        put(i, value(i, k))
        if prv[i] >= 0:
            put(prv[i], value(prv[i], i))
    return np.array([t for t in tok[:n] if t >= 0], "<u4").tobytes()


def merge(ranks: Ranks, pieces: list[bytes]) -> list[bytes]:
    """The ids of each piece (none empty), as little-endian unsigned 32-bit integers."""
    out = [b""] * len(pieces)
    by_size: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        if (i := ranks.ids.get(p)) is not None:
            out[k] = i.to_bytes(4, "little")
        elif len(p) > WIDE:
            out[k] = _alone(ranks, p)
        else:
            by_size.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
    for size, ks in by_size.items():
        step = CELLS // size
        for a in range(0, len(ks), step):
            for k, ids in zip(ks[a : a + step], _together(ranks, [pieces[k] for k in ks[a : a + step]], size), strict=True):
                out[k] = ids
    return out


@functools.lru_cache(2)
def coder(path: str, pattern: str) -> tuple[Ranks, Chunks]:
    """Of this worker."""
    ranks = Ranks(path)

    def encode(chunks: list[str]) -> list[bytes]:
        cut = [known.matches(c) for c in chunks]
        pieces = list({p for c in cut for p in c})
        ids = dict(zip(pieces, merge(ranks, [p.encode() for p in pieces]), strict=True))
        return [b"".join(map(ids.__getitem__, c)) for c in cut]

    known = Chunks(encode, pattern)
    return ranks, known


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids: the ids of each text as little-endian unsigned 32-bit integers, in one binary value.

    A null or empty text has no ids. Repeated rows give repeated rows; a null doc_id stays null; other columns are not
    carried. path must be readable on every executor. Nothing is shuffled.
    """

    def run(batches):
        _, known = coder(path, pattern)
        for b in slices(batches):
            ids = [i for step in in_steps(b.column("text").to_pylist()) for i in known.ids(step)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    d = texts(docs, id_col, text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """The rows of encoded() with bytes: what the ids stand for."""

    def run(batches):
        tokens = tokens_of(path)
        for b in slices(batches):
            out = [b"".join(map(tokens.__getitem__, np.frombuffer(i, "<u4").tolist())) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    return ids.mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, ids binary, bytes binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = decoded(encoded(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
