"""Token ids in files of Simple-8b words.

A file holds the documents of one range of doc_id, in ascending order. Its ids are cut into blocks of BLOCK ids. A word
of 64 bits has a selector in its upper 4 bits and as many ids in the rest as fit by one width; selector 0 is the escape:
the next word is one value of over 60 bits. The offset of each block's first word is stored, so that blocks, and within
them all words of a selector at once, are decoded without looking at what precedes.

Layout, little-endian: MAGIC; n_docs, n_ids, n_blocks (u64); doc_id (i64), null flag (u8) and number of ids (u64) of each
document, column by column; first word of each block (u64), and the number of words at the end; the words.
"""

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefold.llm.chunks import LONG, STOPS, cut, slices
from pagefold.llm.common import new_path, read, texts, written

MAGIC = b"SIMPLE8B"
BLOCK = 1 << 16
#: Ids of a word and their width, by selector from 1; 0 is the escape.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([1] + [c for c, _ in SELECTORS] + [0])
#: The width of each value under 2 to the 16.
WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _visible() -> dict[int, str]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others in
    turn for those from 256."""
    out = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + sum(ord(c) > 255 for c in out.values()))
    return out


VISIBLE = _visible()


def pack(values: np.ndarray) -> np.ndarray:
    """The words of one block of unsigned 64-bit integers. The last word may be filled up with zeros."""
    v = values.astype(np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64)
    width = WIDTHS[v.astype(np.uint16)] if v.max() < 1 << 16 else np.frexp(v.astype(np.float64))[1] if v.max() < 1 << 53 else np.searchsorted(np.array([1 << k for k in range(64)], np.uint64), v, "right")
    chosen = np.zeros(n, np.int8)
    for s, (count, bits) in reversed(list(enumerate(SELECTORS, 1))):
        run, have = np.ones(n + count, bool), 1  # where so many values from here on fit; what follows the last one fits
        np.less_equal(width, bits, out=run[:n])
        while have < count and run[:n].any():
            step = min(have, count - have)
            run, have = run[:-step] & run[step:], have + step
        np.copyto(chosen, s, where=run[:n])
    follows = (np.arange(n) + COUNTS[chosen]).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = follows[i]
    first = np.array(starts)
    sel = chosen[first]
    at = np.cumsum(np.where(sel == 0, 2, 1))
    out = np.zeros(at[-1], np.uint64)
    at -= np.where(sel == 0, 2, 1)
    padded = np.append(v, np.zeros(60, np.uint64))
    for s, (count, bits) in enumerate(SELECTORS, 1):
        if len(k := np.flatnonzero(sel == s)):
            parts = padded[first[k][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            out[at[k]] = np.bitwise_or.reduce(parts, axis=1) | np.uint64(s << 60)
    if len(k := np.flatnonzero(sel == 0)):
        out[at[k] + 1] = v[first[k]]
    return out


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of one block."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for k in np.flatnonzero(sel == 0).tolist():
        if not raw[k]:
            raw[k + 1] = True
    counts = np.where(raw, 0, COUNTS[sel])
    at = np.cumsum(counts) - counts
    out = np.zeros(n + 60, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS, 1):
        if len(k := np.flatnonzero((sel == s) & ~raw)):
            parts = (words[k][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            out[at[k][:, None] + np.arange(count)] = parts
    if len(k := np.flatnonzero((sel == 0) & ~raw)):
        out[at[k]] = words[k + 1]
    return out[:n]


def to_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate([*ids, np.zeros(0, np.uint64)])
    blocks = [pack(flat[a : a + BLOCK]) for a in range(0, len(flat), BLOCK)]
    return b"".join(
        [
            MAGIC,
            np.array([len(ids), len(flat), len(blocks)], "<u8").tobytes(),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([len(i) for i in ids], "<u8").tobytes(),
            np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes(),
            *(b.astype("<u8").tobytes() for b in blocks),
        ]
    )


def from_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, the number of ids of each document, and all ids."""
    if content[:8] != MAGIC:
        raise ValueError("not a file of Simple-8b words")
    at = 8

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, n, at)
        at += out.nbytes
        return out

    n_docs, n_ids, n_blocks = map(int, take("<u8", 3))
    doc_ids, null, lengths, first = take("<i8", n_docs), take(np.uint8, n_docs), take("<u8", n_docs), take("<u8", n_blocks + 1)
    words = take("<u8", int(first[-1]))
    out = [unpack(words[int(a) : int(b)], min(BLOCK, n_ids - k * BLOCK)) for k, (a, b) in enumerate(zip(first, first[1:], strict=False))]
    return [None if x else d for d, x in zip(doc_ids.tolist(), null, strict=True)], lengths.astype(np.int64), np.concatenate([*out, np.zeros(0, np.uint64)])


class Known(dict):
    """Ids of chunks, each encoded when it is first looked up. What has not been looked up since the one before was filled
    is forgotten with it (see later)."""

    def __init__(self, encode: Callable[[str], bytes], stops: dict[str, bytes], old: dict[str, bytes] | None = None):
        self.encode, self.stops, self.old = encode, stops, old or {}

    def __missing__(self, c: str) -> bytes:
        found = self.old.get(c)
        if found is None:
            # a word and a stop are two matches: the word alone is encoded
            found = self[c[:-1]] + self.stops[c[-1]] if c[-1:] in self.stops and c[:-1].isalpha() else self.encode(c)
        if len(c) <= LONG:
            self[c] = found
        return found

    def later(self, room: int) -> "Known":
        """Itself, or once it holds over room chunks an empty one that still looks them up here."""
        if len(self) <= room:
            return self
        self.old = {}
        return Known(self.encode, self.stops, self)


class Coder:
    """The ids of texts as the library's encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str, pattern: str, plain: bool = False, room: int = 300_000):
        """plain: the strings of added tokens in a text are ordinary text. About twice room chunks after a space are
        remembered, and as many others."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.added = [] if plain else [a.content for a in self.library.get_added_tokens_decoder().values()]
        self.room = room
        matches, tokenize, space = regex.compile(pattern).findall, self.library.model.tokenize, VISIBLE[32]
        packed = [struct.Struct(f"<{n}{'H' if self.kind == '<u2' else 'I'}").pack for n in range(LONG)]

        # what the library's own encode() does, less its account of where in the text each token came from
        def of(words: list[str]) -> bytes:
            found = [x.id for w in words for x in tokenize(w)]
            return packed[len(found)](*found) if len(found) < LONG else np.array(found, self.kind).tobytes()

        def visible(match: str) -> str:
            return match.encode().decode("latin-1").translate(VISIBLE)

        def bare(c: str) -> bytes:
            return of([visible(p) for p in matches(c)])

        def spaced(c: str) -> bytes:
            if c.isalpha():  # one match
                return of([space + (c if c.isascii() else visible(c))])
            return bare(" " + c)

        stops = {c: bare(c) for c in STOPS}
        self.matches = matches
        self.bare, self.spaced = Known(bare, stops), Known(spaced, stops)

    def _own(self, text: str) -> bytes:
        if any(a in text for a in self.added):  # the library cuts these at its added tokens first
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        self.bare, self.spaced = self.bare.later(self.room), self.spaced.later(self.room)
        head, rest = cut(text, self.matches)
        return b"".join(map(self.bare.__getitem__, head)) + b"".join(map(self.spaced.__getitem__, rest))

    def ids(self, texts: list[str]) -> list[bytes]:
        return [self._own(t) for t in texts]


@functools.lru_cache(2)
def coder(path: str, pattern: str, plain: bool) -> Coder:
    """Of this worker."""
    return Coder(path, pattern, plain)


def write(docs: DataFrame, path: str, pattern: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", docs_per_file: int = 8192, file_ids: int = 1 << 22, plain: bool = False) -> DataFrame:
    """Writes files to folder, a URI that executors can write to, and returns their manifest: range, part, file, n_docs,
    n_ids. Ascending doc_id (a long; null first) runs through the files in order of range and part.

    The documents are dealt by ranges of doc_id of about docs_per_file rows, encoded and written where they come to lie. A
    file is closed at file_ids ids. Each is written under another name and then renamed, so a task that is run again
    leaves the same files. A null or empty text has its end id alone; rows that repeat a doc_id stand in the order of a
    hash of their texts, and may fill many ranges; an empty table gives no file. plain: the strings of the tokenizer's
    added tokens are ordinary text; else they get their own ids, as by default in the library.
    """
    d = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = max(1, -(-d.count() // docs_per_file))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    end = int(end_id)

    def save(batches):
        from pyarrow import fs

        known = coder(path, pattern, plain)
        last = np.array([end], known.kind).tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        now, part, names, held, size = 0, 0, [], [], 0

        def close():
            nonlocal part, names, held, size
            file = f"{now:09d}-{part:06d}.s8b"
            with store.open_output_stream(draft := f"{root}/_{file}-{uuid.uuid4().hex}") as f:
                f.write(to_file(names, held))
            store.move(draft, f"{root}/{file}")
            row = (now, part, file, len(held), size)
            part, names, held, size = part + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["range", "part", "file", "n_docs", "n_ids"])

        for b in slices(batches, 100):
            now = b.column("range")[0].as_py()
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), known.ids(b.column("text").to_pylist()), strict=True):
                names.append(doc_id)
                held.append(np.frombuffer(ids + last, known.kind))
                size += len(held[-1])
                if size >= file_ids:
                    yield close()
        if held:
            yield close()

    dealt = d.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = dealt.select(F.spark_partition_id().cast("long").alias("range"), "doc_id", "text")
    return written(ranged.mapInArrow(save, "range long, part long, file string, n_docs long, n_ids long"), "manifest")


def load(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """One row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    unsigned 32-bit). The running total is over the manifest, a row for each file."""
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    order = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = manifest.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))

    def rows(batches):
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                doc_ids, lengths, ids = from_file(content.as_py())
                flat, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                own = [flat[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                for a in range(0, len(own), 1000):
                    z = slice(a, a + 1000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(own[z])), pa.array(doc_ids[z], pa.int64()), pa.array((ends - lengths)[z]), pa.array(lengths[z]), pa.array([zlib.crc32(x) for x in own[z]], pa.int64()), pa.array(own[z], pa.binary())],
                        ["file", "doc_id", "within", "n_tokens", "ids_crc32", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    out = files.mapInArrow(rows, "file string, doc_id long, within long, n_tokens long, ids_crc32 long, ids binary")
    return out.join(before, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    manifest = write(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, folder, 2)
    return load(spark, folder, manifest).drop("ids")
