"""Removal of byte strings that occur twice, by suffix arrays over shards.

Equal texts are one text from the start: all of theirs repeats. Every window of `width` bytes picks the least hash among its
grams, the leftmost of equals; equal windows pick equal grams at the same place. The windows of a text that pick the same
gram follow each other and make one segment. So equal windows lie in segments of one anchor hash, and only segments of
anchors that occur twice are looked at further. Where all segments of an anchor are equal, all their windows repeat.

The other segments are cut into runs of GRAIN windows at most, by the windows' distance from the anchor, and dealt by anchor,
run and the bytes that all windows of a run share. Equal windows have those in common, so they stay together, and what
differs around a common passage goes to different shards. Equal runs meet as one with a count. Shards are brought together
into tasks of a bounded size, each of which gets a suffix array by induced sorting and permuted common prefixes: a window is
repeated if its suffix shares width bytes with a neighbour. Every window lies in one run of one shard, so none is missed.
The windows of a shard of more than MANY different runs, as at the ends of a passage that very many texts share, are
counted one by one instead, by 128-bit hashes of their bytes.
"""

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import read, written
from pagefold.llm.suffixes import common_prefixes, suffix_array

GRAM = 32
#: Bytes that are hashed together, and bytes of a task's runs.
STEP, SHARD = 1 << 18, 1 << 20
#: Windows of a run, and different runs of a shard, at most.
GRAIN, MANY = 64, 4_000
MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of an odd base and of its inverse modulo 2 to the 64."""
    base = 0xD1342543DE82EF95
    size = 2 * STEP + 1024
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64), np.cumprod(up), np.cumprod(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of some bytes, by prefix sums."""

    def __init__(self, data: np.ndarray):
        table, up, self.down = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def _parts(docs, width: int):
    """Lists of (document, place of the first byte, bytes) of about STEP bytes; long documents are cut so that each window
    lies in one part."""
    group, size = [], 0
    for d, raw in docs:
        for a in range(0, max(1, len(raw) - width + 1), STEP):
            part = raw[a : a + STEP + width - 1]
            if len(part) < width:
                continue
            if size + len(part) > 2 * STEP:
                yield group
                group, size = [], 0
            group.append((d, a, part))
            size += len(part)
    if group:
        yield group


def segments(docs, width: int):
    """docs: pairs of a key and bytes. Arrays for each group of parts: key, first window, windows, anchor hash, place of
    the anchor from the first window, hash of the segment."""
    span = width - GRAM + 1
    for group in _parts(docs, width):
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        length = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(length)
        hashes = Hashes(data)
        n = len(data) - GRAM + 1
        at = np.arange(n)
        h = hashes.of(at, at + GRAM)
        ranked = (h >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
        rows = -(-n // span)
        square = np.append(ranked, np.full(rows * span - n, np.iinfo(np.uint64).max)).reshape(rows, span)
        ahead = np.minimum.accumulate(square, axis=1).ravel()
        behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(data) - width + 1
        best = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
        pick = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
        part = np.repeat(np.arange(len(group)), length)[:windows]
        inside = at[:windows] + width <= ends[part]
        first = np.append(True, (pick[1:] != pick[:-1]) | (part[1:] != part[:-1])) & inside
        a = np.flatnonzero(first)
        stop = np.append(a[1:], windows)
        b = np.minimum(stop, ends[part[a]] - width + 1)
        begin = (ends - length)[part[a]]
        keys = np.array([k for k, _, _ in group], np.int64)
        base = np.array([o for _, o, _ in group], np.int64)
        yield keys[part[a]], base[part[a]] + a - begin, b - a, h[pick[a]].astype(np.int64), pick[a] - a, hashes.of(a, b + width - 1).astype(np.int64)


def runs_of(first: np.ndarray, count: np.ndarray, lead: np.ndarray, grain: int) -> tuple[np.ndarray, ...]:
    """The windows first..first+count of segments whose anchors lie lead bytes after the first, cut where their distance
    from the anchor passes a multiple of grain: (segment, number of the run, first window, windows)."""
    top = lead // grain
    m = top - (lead - count + 1) // grain + 1
    own = np.repeat(np.arange(len(first)), m)
    run = top[own] - (np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m))
    far = lead[own] - run * grain
    a = np.maximum(0, far - grain + 1)
    return own, run, first[own] + a, np.minimum(count[own] - 1, far) - a + 1


def matched(raws: list[bytes], counts: list[int], width: int) -> list[list[tuple[int, int]]]:
    """For each of some different byte strings that occur so often, the runs (from, to) of its windows that occur twice."""
    most = max(len(r) for r in raws)
    length = np.array([len(r) for r in raws])
    starts = np.cumsum(length + 1) - length - 1
    t = np.frombuffer(b"\0".join(raws) + b"\0\0", np.uint8)  # text has no bytes over 0xF4
    t = (t + 2).astype(np.uint8)
    t[starts + length] = 1
    t[-1] = 0
    sa = suffix_array(t)
    fresh = np.zeros(len(t), bool)
    fresh[starts] = True
    before, shared = common_prefixes(t, sa, fresh, most + 8)
    window = np.zeros(len(t) + 1, np.int32)
    np.add.at(window, starts, 1)
    np.add.at(window, starts + np.maximum(length - width + 1, 0), -1)
    window = np.cumsum(window)[:-1] > 0
    twice = (shared >= width) & window
    twice[before[np.flatnonzero(twice)]] = True
    twice |= window & np.repeat(np.append(np.array(counts) > 1, False), np.append(length + 1, 1))
    edge = np.diff(np.append(False, np.append(twice, False)).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    own = np.searchsorted(starts, a, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in raws]
    for k, x, y in zip(own.tolist(), (a - starts[own]).tolist(), (b - starts[own]).tolist(), strict=True):
        out[k].append((x, y))
    return out


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def node(text_col: str):
    """128 bits that stand for a text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


ANCHORS = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("anchor", pa.int64()), ("hash", pa.int64())])
PIECES = pa.schema([("shard", pa.int64()), ("hash", pa.int64()), ("windows", pa.int32()), ("raw", pa.binary()), ("n", pa.int64()), ("id", pa.int64()), ("first", pa.int64())])
RUNS = pa.schema([("shard", pa.int64()), ("hash", pa.int64()), ("windows", pa.int32()), ("runs", pa.list_(pa.int32()))])
KEY = ["shard", "hash", "windows"]


def _cut(batches, width: int):
    """id, raw, s (segments): a row with raw for each different run among so many, and one with id and first for each
    occurrence."""
    for b in batches:
        own, ends = b.column("s").values, b.column("s").offsets.to_numpy()
        at, anchor = own.field("at").to_numpy(), own.field("anchor").to_numpy().view(np.uint64)
        first, count, lead = at >> 16, at >> 8 & 255, at & 255
        ids = b.column("id").to_numpy()
        for group in _parts(((k, r.as_py()) for k, r in enumerate(b.column("raw"))), width):
            data = b"".join(p for _, _, p in group)
            hashes, base, held, shift = Hashes(np.frombuffer(data, np.uint8)), 0, [], []
            for k, a, part in group:
                here = ends[k] + np.flatnonzero(first[ends[k] : ends[k + 1]] // STEP == a // STEP)
                held.append(here)
                shift.append(np.full(len(here), base - a))
                base += len(part)
            here, shift = np.concatenate(held), np.concatenate(shift)
            seg, run, start, n = runs_of(first[here] + shift, count[here], lead[here], GRAIN)
            shared = (first[here] + shift + lead[here])[seg] - run * GRAIN  # where the last window of a whole run begins
            core = hashes.of(shared, shared - GRAIN + 1 + width)
            shard = _mix(anchor[here][seg] ^ _mix(core + run.astype(np.uint64) * MIX)).view(np.int64)
            digest = hashes.of(start, start + n - 1 + width).view(np.int64)
            own_ids = np.repeat(ids[[k for k, _, _ in group]], [len(h) for h in held])[seg]
            none = [None] * len(seg)
            yield _batch(PIECES, shard, digest, n.astype(np.int32), none, none, own_ids, start - shift[seg])
            order = np.lexsort((n, digest, shard))
            new = np.append(True, (np.diff(shard[order]) != 0) | (np.diff(digest[order]) != 0) | (np.diff(n[order]) != 0))[: len(order)]
            one, times = order[new], np.diff(np.append(np.flatnonzero(new), len(order)))
            for x in range(0, len(one), 5000):
                k = one[x : x + 5000]
                raws = [data[i : i + c - 1 + width] for i, c in zip(start[k].tolist(), n[k].tolist(), strict=True)]
                none = [None] * len(k)
                yield _batch(PIECES, shard[k], digest[k], n[k].astype(np.int32), raws, times[x : x + 5000], none, none)


def _sorted(table: pa.Table, width: int) -> pa.Table:
    """The runs of windows that repeat, of each run of some shards."""
    own: dict[tuple[int, int, int], list] = {}
    for s, h, w, raw, n in zip(*(table.column(c).to_pylist() for c in (*KEY, "raw", "n")), strict=True):
        if v := own.get((s, h, w)):
            v[1] += n
        else:
            own[s, h, w] = [raw, n]
    # a run that is all there is of its shard has nothing to be sorted among: only its own copies repeat it
    alike = Counter(s for s, _, _ in own)
    rows = [(*k, [0, k[2]]) for k, v in own.items() if alike[k[0]] == 1 and v[1] > 1]
    if several := {k: v for k, v in own.items() if alike[k[0]] > 1}:
        hit = matched([v[0] for v in several.values()], [v[1] for v in several.values()], width)
        rows += [(*k, [x for r in m for x in r]) for k, m in zip(several, hit, strict=True) if m]
    return pa.Table.from_batches([_batch(RUNS, *zip(*rows, strict=True))] if rows else [], RUNS)


def _singly(pieces: DataFrame, width: int) -> DataFrame:
    """The same for runs of large shards, by counting each window among all."""
    import hashlib

    schema = pa.schema([*(RUNS.field(c) for c in KEY), ("k", pa.int32()), ("window", pa.binary()), ("n", pa.int64())])

    def windows(batches):
        for b in batches:
            for *key, raw, n in zip(*(b.column(c).to_pylist() for c in (*KEY, "raw", "n")), strict=True):
                w = [hashlib.blake2b(raw[k : k + width], digest_size=16).digest() for k in range(key[2])]
                yield _batch(schema, *([x] * len(w) for x in key), range(len(w)), w, [n] * len(w))

    alike = pieces.groupBy(*KEY).agg(F.first("raw").alias("raw"), F.sum("n").alias("n"))
    each = written(alike.mapInArrow(windows, "shard long, hash long, windows int, k int, window binary, n long"), "windows")
    twice = each.groupBy("window").agg(F.sum("n").alias("n")).filter("n > 1").select("window")
    return each.join(twice, "window").groupBy(*KEY).agg(F.flatten(F.collect_list(F.array("k", F.col("k") + 1))).alias("runs"))


def repeated(docs: DataFrame, width: int = 200, text_col: str = "text") -> DataFrame:
    """node (see node()) and spans: arrays of from, to, the byte ranges of a text covered by windows that occur elsewhere too,
    in any order; texts without any are left out."""
    if not max(2 * GRAM, GRAIN) <= width < 255 + GRAM:
        raise ValueError(f"width must be {max(2 * GRAM, GRAIN)} to {254 + GRAM} bytes")
    raw = docs.select(node(text_col).alias("node"), F.col(text_col).cast("binary").alias("raw")).filter(F.octet_length("raw") >= width)
    texts = written(raw.groupBy("node").agg(F.first("raw").alias("raw"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "texts")

    def anchors(batches):
        for b in batches:
            rows = ((k, r.as_py()) for k, r in zip(b.column("id").to_pylist(), b.column("raw"), strict=True))
            for id_, first, count, anchor, lead, own in segments(rows, width):
                yield _batch(ANCHORS, id_, first << 16 | count << 8 | lead, anchor, own)

    all_ = written(texts.select("id", "raw").mapInArrow(anchors, "id long, at long, anchor long, hash long"), "anchors")
    bounds = F.col("at").bitwiseAND(F.lit(65535))
    least = [f(c) for f in (F.min, F.max) for c in ("hash", bounds)]
    seen = all_.groupBy("anchor").agg(F.count("*").alias("n"), *(x.alias(c) for c, x in zip("abcd", least, strict=True))).filter("n > 1")
    # written, so that the join below deals both sides itself and can split a hot anchor
    twice = written(seen.select("anchor", F.expr("a <> c or b <> d").alias("several")), "twice")
    held = written(all_.join(twice.hint("merge"), "anchor").select("id", "at", "anchor", "several"), "held")
    cut = held.filter("several").groupBy("id").agg(F.collect_list(F.struct("at", "anchor")).alias("s")).join(texts.select("id", "raw"), "id")
    pieces = written(cut.select("id", "raw", "s").mapInArrow(lambda b: _cut(b, width), "shard long, hash long, windows int, raw binary, n long, id long, first long"), "pieces")
    runs = pieces.filter("raw is not null").select(*KEY, "raw", "n")
    total = runs.agg(F.sum(F.octet_length("raw"))).first()[0]
    large = written(runs.groupBy("shard").agg(F.count("*").alias("k")).filter(F.col("k") > MANY).select("shard"), "large")
    tasks = max(1, -(-(total or 0) // SHARD))
    small = runs.join(large.hint("merge"), "shard", "left_anti") if large.head(1) else runs
    dealt = small.withColumn("task", F.pmod(F.xxhash64("shard"), F.lit(tasks)))
    hits = dealt.groupBy("task").applyInArrow(lambda t: _sorted(t, width), "shard long, hash long, windows int, runs array<int>")
    if large.head(1):
        hits = hits.unionByName(_singly(runs.join(large.hint("merge"), "shard", "left_semi"), width))
    hits = written(hits, "runs")
    span = lambda a, b: F.array(F.col("first") + a, F.col("first") + b + (width - 1))
    found = pieces.filter("id is not null").select(*KEY, "id", "first").join(hits, KEY)
    found = found.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda k: span(F.get("runs", k), F.get("runs", k + 1)))).alias("s"))
    whole = held.filter("not several").select("id", F.shiftright("at", 16).alias("first"), F.shiftright("at", 8).bitwiseAND(F.lit(255)).alias("n")).select("id", span(F.lit(0), F.col("n")).alias("s"))
    spans = found.unionByName(whole).groupBy("id").agg(F.collect_list("s").alias("spans"))
    copies = F.when(F.col("n") > 1, F.array(F.array(F.lit(0).cast("long"), F.octet_length("raw").cast("long"))))
    out = texts.select("id", "node", copies.alias("all")).join(spans, "id", "left").select("node", F.coalesce("all", "spans").alias("spans"))
    return written(out.filter("spans is not null"), "spans")


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _whole(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The characters wholly inside a..b."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def cut_out(docs: DataFrame, width: int = 200, text_col: str = "text", characters: bool = False) -> DataFrame:
    """All columns of docs, and kept (binary, the bytes that stay), n_removed and n_spans (long).

    Every byte covered by a string of width bytes that also starts anywhere else goes, from each of the places, in the
    same row too; strings never cross rows and are judged on the input. A null text counts as empty. Repeated rows are
    each other's repeats. With characters, those cut by the edge of a span stay whole. Columns of docs may have any names;
    those called kept, n_removed and n_spans are replaced. An empty table gives no rows. Texts are told apart by 128 bits,
    and so are segments and runs.
    """
    spans = repeated(docs, width, text_col).hint("merge")  # its size grows with docs
    columns = [c for c in docs.columns if c not in ("kept", "n_removed", "n_spans")]
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"), node(text_col).alias("node")).join(spans, "node", "left")

    @F.pandas_udf("struct<kept binary, n_removed long, n_spans long>")
    def cut(raw, spans):
        import pandas as pd

        out = []
        for r, s in zip(raw, spans, strict=True):
            gone = union([tuple(map(int, x)) for x in s])
            if characters:
                gone = [x for x in (_whole(r, a, b) for a, b in gone) if x[0] < x[1]]
            ends = [0, *(x for g in gone for x in g), len(r)]
            out.append((b"".join(r[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)), sum(b - a for a, b in gone), len(gone)))
        return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    with_ = d.withColumn("cut", cut("raw", F.coalesce("spans", F.array().cast("array<array<bigint>>"))))
    return with_.select(*(F.col("row").getField(c).alias(c) for c in columns), "cut.kept", "cut.n_removed", "cut.n_spans")


def query(spark, sf_dir: str) -> DataFrame:
    out = cut_out(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
