"""Near copies by Order MinHash, verified by banded alignment.

A text's five-word shingles are labelled with their occurrence. Each of SKETCHES takes the two labelled shingles of least
hash and keeps their order in the text; texts with a sketch in common are candidates. Two of them are linked if a banded
alignment matches 0.8 or more of the longer one's words. A sketch agrees with about the square of the labelled shingles'
Jaccard similarity: at 0.8 (one word in 50 changed) all SKETCHES differ once in a billion links, at 0.63 (one in 20) once
in 30,000, at 0.5 three times in a thousand.

Equal texts are one node from the start. A group of candidates is first compared with one pivot, the least node, which is
the same in all groups of the same texts: k - 1 pairs. A group that then still has several components is settled exactly,
by one task if it has up to LISTED texts: bit sets of their words rule out the pairs that differ in too many, and what they
leave between different components is compared, first along a forest of the likeliest pairs, then all the rest; a pair
that has several such groups is compared in one. Only links leave the task, fewer than texts. A larger group, or one of
very long texts, is cut into blocks by length and hash, and each two blocks whose lengths allow a link are one task's group;
large groups of the same texts are one. So two candidates are always compared, or lie in one class already.
"""

import functools
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import read, written
from pagefold.llm.components import joined
from pagefold.llm.suffixdedup import STEP, Hashes, _mix

WORDS = 5
SKETCHES = 20
LEAST = 0.8
#: Longs of the least bit set of words.
BITS = 16
#: Texts of a group, and their words, that one task looks at; of larger groups it gets two blocks of about half as many.
LISTED, HELD = 1_000, 1 << 23
#: Words of a text from which places are lists, and words between two looks at how far an alignment has come.
LONG, ROWS = 4_096, 64


def _lower(raw: bytes) -> bytes:
    return raw.lower()  # of bytes: ASCII letters only


def words(raw: bytes) -> np.ndarray:
    """A hash of each word: a run of bytes other than ASCII white space, ASCII letters lowered."""
    out = [h for _, h, _ in _words([raw])]
    return out[0] if out else np.zeros(0, np.int64)


def _cuts(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings and ends of all words of some texts laid behind each other, and the texts' ends."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.append(True, white).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1), np.cumsum([len(r) + 1 for r in raws])


def _words(raws: list[bytes]):
    """(place among raws, hashes of the words, their count) of each text with a word; raws of STEP bytes at most together,
    or one alone."""
    raws = [_lower(r) for r in raws]
    if sum(map(len, raws)) + len(raws) > 2 * STEP:  # one very long text: by parts that end with a word
        parts, raw, a = [], raws[0], 0
        while a < len(raw):
            b = a + STEP
            while b < len(raw) and raw[b] not in b" \t\n\v\f\r" and b < a + 2 * STEP - 8:
                b += 1
            parts.append(raw[a:b])
            a = b
        found = np.concatenate([h for p in parts for _, h, _ in _words([p])] or [np.zeros(0, np.int64)])
        if len(found):
            yield 0, found, len(found)
        return
    a, b, ends = _cuts(raws)
    h = Hashes(np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)).of(a, b)
    at = np.searchsorted(a, np.append(0, ends))
    for k in range(len(raws)):
        if at[k + 1] > at[k]:
            yield k, h[at[k] : at[k + 1]], int(at[k + 1] - at[k])


def shingles(w: np.ndarray) -> np.ndarray:
    """A hash of each run of WORDS words; of all words, if there are fewer."""
    n = max(1, len(w) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(w))):
        h = _mix(h * np.uint64(0xBF58476D1CE4E5B9) + w[k : k + n].astype(np.uint64))
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles that occur again get other hashes, by their occurrence in the text."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])
    if new.all():
        return h
    place = np.arange(len(h))
    count = place - np.maximum.accumulate(np.where(new, place, 0))
    out = np.empty_like(h)
    out[order] = np.where(count > 0, _mix(s + count.astype(np.uint64) * np.uint64(0x94D049BB133111EB)), s)
    return out


def sketches(docs: list[np.ndarray]) -> np.ndarray:
    """SKETCHES hashes of each of some texts, given by their labelled shingles."""
    length = np.array([len(d) for d in docs])
    start = np.cumsum(length) - length
    h = np.concatenate(docs)
    at = np.arange(len(h), dtype=np.int64)
    top = np.uint64(np.iinfo(np.uint64).max)
    out = np.empty((len(docs), SKETCHES), np.int64)
    for r in range(SKETCHES):
        v = _mix(h ^ np.uint64((r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        ends = []
        for _ in range(2):
            least = np.minimum.reduceat(v, start)
            hit = np.flatnonzero(v == np.repeat(least, length))
            own = np.searchsorted(start, hit, "right") - 1
            first = np.append(True, own[1:] != own[:-1])
            ends.append(at[hit[first]])
            v[hit[first]] = top
        a, b = np.minimum(*ends), np.maximum(*ends)
        out[:, r] = _mix(_mix(h[a] + np.uint64(r)) * np.uint64(31) + h[b]).astype(np.int64)
    return out


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Of two bags of hashes."""
    return len(np.intersect1d(labelled(x), labelled(y), assume_unique=True))


def places(y: list[int]) -> dict[int, int | list[int]]:
    """Of each word of a text its places as the bits of an integer; as a list in a long text, where bits would take too
    much room."""
    out: dict = {}
    if len(y) > LONG:
        for j, h in enumerate(y):
            out.setdefault(h, []).append(j)
    else:
        for j, h in enumerate(y):
            out[h] = out.get(h, 0) | 1 << j
    return out


def banded(x: list[int], at: dict, m: int, least: int) -> bool:
    """Whether an alignment matches least words of x with those of a text of m words, given by its places: a bit vector of
    the text's words and a step for each word of x, looking only at places of the band in which an alignment with so few
    unmatched words stays."""
    n, full = len(x), (1 << m) - 1
    v = full  # a bit is unset where the longest alignment up to there grows
    if least <= 0:
        return True
    for a in range(0, n, ROWS):
        band = (1 << min(m, a + ROWS + m - least)) - (1 << max(0, min(m, a - n + least)))
        for h in x[a : a + ROWS]:
            if (p := at.get(h)) is not None:
                u = v & band & (p if isinstance(p, int) else sum(1 << j for j in p))
                if u:
                    v = (v + u | v - u) & full
        done = m - v.bit_count()
        if done >= least:
            return True
        if done + n - min(n, a + ROWS) < least:
            return False
    return False


def aligned(x: np.ndarray, y: np.ndarray, least: float = LEAST) -> bool:
    """Whether an alignment matches least of the longer text's words."""
    n, m = len(x), len(y)
    return banded(x.tolist(), places(y.tolist()), m, int(np.ceil(least * max(n, m) - 1e-9)))


def chained(x: np.ndarray, y: np.ndarray, k: int = 3) -> int:
    """Words that an alignment matches at least: those of runs of k words that each text has once, chained in the order
    of both."""
    if min(len(x), len(y)) < k:
        return 0

    def once(w):
        h = np.zeros(len(w) - k + 1, np.uint64)
        for t in range(k):
            h = _mix(h * np.uint64(0xBF58476D1CE4E5B9) + w[t : t + len(h)].astype(np.uint64))
        kinds, first, n = np.unique(h, return_index=True, return_counts=True)
        return kinds[n == 1], first[n == 1]

    (h, i), (g, j) = once(x), once(y)
    _, a, b = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    order = np.argsort(i[a])
    i, j = i[a][order], j[b][order]
    if len(i) and (np.diff(j) <= 0).any():
        tops, ends, back = [], [], []
        for t, v in enumerate(j.tolist()):
            at = bisect_left(tops, v)
            tops[at : at + 1], ends[at : at + 1] = [v], [t]
            back.append(ends[at - 1] if at else -1)
        t, chain = ends[-1], []
        while t >= 0:
            chain.append(t)
            t = back[t]
        i, j = i[chain[::-1]], j[chain[::-1]]
    return int(np.minimum(k, np.minimum(np.diff(i), np.diff(j))).sum()) + k if len(i) else 0


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether an alignment matches LEAST of the longer one's words, given by their hashes."""
    n = max(len(x), len(y))
    if not len(x) or not len(y) or in_common(x, y) < LEAST * n - 1e-9:
        return False
    if chained(x, y) >= LEAST * n:
        return True  # the full alignment matches as many or more
    # of the longer text's pairs of words, two go with each unmatched word, and one with each unmatched word of the other
    pairs = lambda w: _mix(w[:-1].astype(np.uint64) * np.uint64(31) + w[1:].astype(np.uint64))
    if n > 2 and in_common(pairs(x), pairs(y)) < n - 1 - 3 * (1 - LEAST) * n - 1e-9:
        return False
    return aligned(x, y)


def similar(a: bytes, b: bytes) -> bool:
    return alike(words(a), words(b))


def bit_set(w: np.ndarray) -> list[int]:
    """BITS longs, or as often twice as many as to have two bits a word, with a bit for each labelled word: bits that another
    text lacks are words, or more, that it lacks."""
    size = 64 * BITS
    while size < 2 * len(w):
        size *= 2
    bits = np.zeros(size, bool)
    bits[(labelled(w) >> np.uint64(32)) % np.uint64(size)] = True
    return np.packbits(bits).view(np.int64).tolist()


def possible(n: np.ndarray, bits: list[np.ndarray], root: list) -> np.ndarray:
    """For each two of some texts, how few bits of one the other lacks (below 0), where they may be linked and are not of one
    root; -inf elsewhere."""
    k = len(n)
    out = np.full((k, k), -np.inf, np.float32)
    size = np.array([len(b) for b in bits])
    kinds = np.unique(np.array(root, object), return_inverse=True)[1]
    for s in np.unique(size).tolist():
        # texts of this size, and those of twice the size folded to it; larger ones have too many words more
        own = np.flatnonzero((size == s) | (size == 2 * s))
        shared, count = np.zeros((len(own), len(own)), np.float32), np.zeros(len(own), np.float32)
        for a in range(0, s, BITS):
            part = np.stack([bits[i][a : a + BITS] | (bits[i][a + s : a + s + BITS] if size[i] > s else 0) for i in own])
            part = np.unpackbits(part.view(np.uint8), axis=1).astype(np.float32)
            shared += part @ part.T
            count += part.sum(1)
        m = n[own].astype(np.float32)
        least = np.maximum(m[:, None], m) * LEAST - 1e-3
        lacks = count[:, None] - shared
        fine = (np.minimum(m[:, None], m) >= least) & (lacks <= m[:, None] - least) & (lacks.T <= m - least) & (kinds[own][:, None] != kinds[own])
        fine &= np.minimum(size[own][:, None], size[own]) == s
        out[np.ix_(own, own)] = np.where(fine, -(lacks + lacks.T), out[np.ix_(own, own)])
    return out


def forest(weight: np.ndarray, root: list) -> list[tuple[int, int]]:
    """The pairs of a spanning forest of greatest weight; nodes of one root hang together without a pair."""
    kinds = np.unique(np.array(root, object), return_inverse=True)[1]
    k, out = len(weight), []
    best, by, open_ = np.full(k, -np.inf), np.full(k, -1), np.ones(k, bool)
    for _ in range(k):
        i = int(np.argmax(np.where(open_, best, -np.inf)))
        if not open_[i]:
            i = int(np.argmax(open_))
        elif np.isfinite(best[i]):
            out.append((int(by[i]), i))
        open_[i] = False
        row = np.where(kinds == kinds[i], np.inf, weight[i])
        better = row > best
        best[better], by[better] = row[better], i
    return out


def _sketched(batches):
    """node, n (words), keys and bits of each row; no keys for a text without words."""
    schema = pa.schema([("node", pa.binary()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
    for b in batches:
        nodes, raws = b.column("node").to_pylist(), [r.as_py() for r in b.column("raw")]
        group, size = [], 0
        for k, r in enumerate([*raws, None]):
            if group and (r is None or size + len(r) > STEP):
                found = [(group[i], labelled(shingles(w)), n, bit_set(w)) for i, w, n in _words([raws[g] for g in group])]
                keys = dict(zip([k for k, *_ in found], sketches([s for _, s, *_ in found]).tolist(), strict=True)) if found else {}
                sizes, bits = {k: n for k, _, n, _ in found}, {k: b for k, *_, b in found}
                yield pa.RecordBatch.from_arrays([pa.array([nodes[g] for g in group], pa.binary()), pa.array([sizes.get(g, 0) for g in group]), pa.array([keys.get(g, []) for g in group], pa.list_(pa.int64())), pa.array([bits.get(g, []) for g in group], pa.list_(pa.int64()))], schema=schema)
                group, size = [], 0
            group.append(k)
            size += len(r) if r is not None else 0


def _squeezed(batches):
    import zstandard

    z = zstandard.ZstdCompressor(3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([z.compress(r.as_py()) for r in b.column("raw")], pa.binary())], ["node", "raw"])


def _verified(batches):
    import zstandard

    z = zstandard.ZstdDecompressor()
    held = functools.lru_cache(64)(lambda raw: words(z.decompress(raw)))  # a pivot is met again and again
    get = lambda raw: held(raw) if len(raw) < 100_000 else words(z.decompress(raw))
    for b in batches:
        ok = [alike(get(x.as_py()), get(y.as_py())) for x, y in zip(b.column("ra"), b.column("rb"), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok)], ["a", "b", "ok"])


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def links(nodes: list, n: np.ndarray, bits: list[np.ndarray], root: list, elsewhere: np.ndarray, text) -> list[tuple[int, int]]:
    """Links that tie all texts of a group that any chain of its links ties. elsewhere: pairs that another group looks at;
    text: the word hashes of the k-th."""
    weight = np.where(elsewhere, np.float32(-np.inf), possible(n, bits, root))
    top = np.unique(np.array(root, object), return_inverse=True)[1].tolist()
    own: dict[int, list[int]] = {}
    for k, t in enumerate(top):
        own.setdefault(t, []).append(k)
    out, tried = [], set()

    def compare(i: int, js: list[int]) -> None:
        y, at = text(i), None
        bag = np.sort(labelled(y))
        for j in js:
            if top[i] == top[j] or (min(i, j), max(i, j)) in tried:
                continue
            tried.add((min(i, j), max(i, j)))
            x = text(j)
            least = int(np.ceil(LEAST * max(len(x), len(y)) - 1e-9))
            if len(np.intersect1d(labelled(x), bag, assume_unique=True)) < least:
                continue
            at = at or places(y.tolist())
            if banded(x.tolist(), at, len(y), least):
                out.append((i, j))
                a, b = sorted((top[i], top[j]), key=lambda t: len(own[t]))
                for k in own[a]:
                    top[k] = b
                own[b] += own.pop(a)

    for i, j in forest(weight, root):
        compare(i, [j])
    for i in sorted(range(len(nodes)), key=lambda k: len(own[top[k]])):
        js = np.flatnonzero(np.isfinite(weight[i]))
        if len(js):
            compare(i, js[np.argsort(-weight[i, js], kind="stable")].tolist())
    return out


def _linked(table: pa.Table) -> pa.Table:
    """Of one group (gid, gids, node, n, bits, root, raw): its links."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    table = table.sort_by("node")
    gid, nodes, raws = table.column("gid")[0].as_py(), table.column("node").to_pylist(), table.column("raw").to_pylist()
    held: dict[int, list[int]] = {}
    for k, g in enumerate(table.column("gids").to_pylist()):
        for x in g:
            if x < gid:
                held.setdefault(x, []).append(k)
    elsewhere = np.zeros((len(nodes), len(nodes)), bool)
    for ks in held.values():
        elsewhere[np.ix_(ks, ks)] = True
    text = functools.lru_cache(256)(lambda k: words(z.decompress(raws[k])))
    bits = [np.array(b, np.int64) for b in table.column("bits").to_pylist()]
    found = links(nodes, table.column("n").to_numpy(), bits, table.column("root").to_pylist(), elsewhere, text)
    return pa.Table.from_arrays([pa.array([f(nodes[i], nodes[j]) for i, j in found], pa.binary()) for f in (min, max)], schema=LINKS)


def tiles(large: DataFrame) -> DataFrame:
    """large: gid, node, n of groups. gid, node, n of groups that one task can hold: each two texts of a group whose lengths
    allow a link are together in one of these.

    Texts of a group are dealt to bands of length, so wide that linked texts are in one or in neighbouring ones, and those
    of a band by hash to blocks; a tile is two blocks of a band, the same twice too, or of neighbouring ones."""
    name = F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1))
    alike_ = large.groupBy("gid").agg(F.count("*").alias("c"), F.sum(name).alias("s"), F.sum(name.bitwiseXOR(F.lit(0x5555555555)) % 1_000_003).alias("t"))
    once = alike_.groupBy("c", "s", "t").agg(F.min("gid").alias("gid")).select("gid")
    band = F.floor(F.log(F.col("n") + 0.5) / -np.log(LEAST) - 1e-9).cast("int")
    banded_ = written(large.join(once.hint("merge"), "gid", "left_semi").select("gid", "node", "n", band.alias("band")), "banded")
    counts = banded_.groupBy("gid", "band").agg(F.greatest(F.lit(1), F.ceil(2 * F.count("*") / LISTED), F.ceil(2 * F.sum("n") / HELD)).cast("int").alias("blocks"))
    at = lambda c, step: counts.select("gid", (F.col("band") + step).alias("band"), F.col("blocks").alias(c)).hint("merge")
    known = banded_.join(at("blocks", 0), ["gid", "band"]).join(at("below", 1), ["gid", "band"], "left").join(at("above", -1), ["gid", "band"], "left")
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    each = lambda n, tile: F.transform(F.filter(F.sequence(F.lit(-1), F.coalesce(n, F.lit(0)) - 1), lambda k: k >= 0), tile)
    named = lambda lower, i, upper, j: F.xxhash64(F.col("gid"), lower, i, upper, j)
    own = each(F.col("blocks"), lambda k: named(F.col("band"), F.least(k, F.col("block")), F.col("band"), F.greatest(k, F.col("block"))))
    below = each(F.col("below"), lambda k: named(F.col("band") - 1, k, F.col("band"), F.col("block")))
    above = each(F.col("above"), lambda k: named(F.col("band"), F.col("block"), F.col("band") + 1, k))
    return written(known.withColumn("block", block).select(F.explode(F.concat(own, below, above)).alias("gid"), "node", "n"), "tiles")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, node (MD5 of its text), class_id (the least doc_id of its class), n_class (the
    different texts of its class) and kept (true for one row of each class, of that doc_id).

    A null text counts as empty. Texts without words are of one class with equal texts only. Of rows that repeat an id, also
    with other texts of the class, one at most is kept; a null doc_id is class_id only where a class has no other. Other
    columns are not carried; an empty table gives no rows. A text is compared whole, however long.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.cast("binary").alias("raw"))
    ids = written(own.select("doc_id", "node").withColumn("row", F.monotonically_increasing_id()), "ids")
    nodes = written(own.select("node", "raw").mapInArrow(_sketched, "node binary, n long, keys array<long>, bits array<long>").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "sketches")

    def grouped(keyed: DataFrame) -> DataFrame:
        """gid, node, n: with k (texts), words (of all) and p (the pivot) of each group of two or more."""
        groups = written(keyed.groupBy("gid").agg(F.count("*").alias("k"), F.sum("n").alias("words"), F.min(F.struct("node", "n")).alias("p")).filter("k > 1"), "groups")
        return written(keyed.join(groups.hint("merge"), "gid").select("gid", "node", "n", "k", "words", "p"), "members")

    members = grouped(nodes.select("node", "n", F.explode("keys").alias("gid")))
    raws = written(
        own.select("node", "raw").mapInArrow(_squeezed, "node binary, raw binary").groupBy("node").agg(F.first("raw").alias("raw")).join(members.select("node").distinct(), "node", "left_semi"), "texts"
    )
    # each group with its pivot
    close = (F.least("n", "p.n") >= LEAST * F.greatest("n", "p.n")) & (F.col("node") != F.col("p.node"))
    pairs = written(members.filter(close).select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    at = lambda c: raws.select(F.col("node").alias(c), F.col("raw").alias(f"r{c}")).hint("merge")
    both = pairs.join(at("b"), "b").join(at("a"), "a").select("a", "b", "ra", "rb")
    roots = joined(None, written(both.mapInArrow(_verified, "a binary, b binary, ok boolean"), "tried").filter("ok"))

    def unsettled(members: DataFrame) -> DataFrame:
        """Members, with their roots, of groups with several."""
        rooted = written(members.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        several = written(rooted.groupBy("gid").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("gid"), "several")
        return written(rooted.join(several.hint("merge"), "gid"), "unsettled")

    rest = unsettled(members)
    fits = (F.col("k") <= LISTED) & (F.col("words") <= HELD)
    small, large = rest.filter(fits).select("gid", "node", "n"), rest.filter(~fits)
    if large.head(1):
        small = small.unionByName(tiles(large))
    small = unsettled(small)
    if small.head(1):
        several = small.groupBy("node").agg(F.collect_list("gid").alias("gids")).join(nodes.select("node", "bits").hint("merge"), "node").join(raws.hint("merge"), "node")
        told = written(several, "told")
        roots = joined(roots, written(small.join(told.hint("merge"), "node").groupBy("gid").applyInArrow(_linked, "a binary, b binary"), "links"))
    own_ = ids.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")).join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    own_ = written(own_, "nodes")
    classes = written(own_.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("n_class")), "classes")
    of = written(own_.select("node", "root").join(classes.hint("merge"), "root").select("node", F.col("least.doc_id").alias("class_id"), F.col("least.row").alias("first"), "n_class"), "of")
    return ids.join(of.hint("merge"), "node").select("doc_id", "node", "class_id", "n_class", (F.col("row") == F.col("first")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_copies(read(spark, sf_dir, "documents")).drop("node")
