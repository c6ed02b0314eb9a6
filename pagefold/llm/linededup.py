"""Line dedup by pairwise alignment.

A text is a sequence of line hashes, each with the line's number of words. What finds a document's partners is a run of
successive lines, the shortest from each line on, or up to it, that has min_words words: one line of that many, or a few
short ones. Each document is first aligned with the earliest that has its rarest run, then, for lines left over, with
the earliest that have other runs of it, with the next in which these are left over too, and at the end with every earlier
one that has them. Each pair is aligned by patience diff; aligned blocks of min_words words are deleted from the later
document. As each line of such a block lies in a run within the block, what is deleted, blank lines aside, is what an
alignment of all pairs would delete, though a run of n documents makes about n - 1 pairs. Texts themselves move once, when
the lines are cut out. Documents of the same lines are one: only the earliest of them is aligned, as the others lose all
their lines to it.
"""

from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import read, written


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of their first, whose second rises too: the patience sort."""
    tops, ends, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        tops[at:at + 1], ends[at:at + 1] = [j], [k]
        back[k] = ends[at - 1] if at else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


#: Pairs of equal lines from which the longest common subsequence is found by halves.
MANY = 1 << 20
#: Pairs for each held run, at most, to which lines left over are paired with all that have them.
BOUND = 4
#: Rounds of looking for further partners of lines left over, before all that have them are met.
ROUNDS = 8
#: The low bits of a line's hash are its words, as many as min_words at most: 0 for a blank line.
WORDS = 15
#: Scripts without spaces: two letters count as a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def _ends(a: list[int], b: list[int]) -> list[int]:
    """The length of the longest common subsequence of a and b[:j], for each j: bit j of v is unset where it grows."""
    mask, full = {}, (1 << len(b)) - 1
    for j, h in enumerate(b):
        mask[h] = mask.get(h, 0) | 1 << j
    v = full
    for h in a:
        u = v & mask.get(h, 0)
        v = (v + u | v - u) & full
    out = [0]
    for c in reversed(f"{v:0{len(b)}b}" if b else ""):
        out.append(out[-1] + (c == "0"))
    return out


def longest(a: list[int], b: list[int], i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """The places, counted from i and j, of a longest common subsequence."""
    one, two = Counter(a), Counter(b)
    if sum(n * two[h] for h, n in one.items()) <= MANY or len(a) == 1:
        places = defaultdict(list)
        for k in range(len(b) - 1, -1, -1):
            places[b[k]].append(j + k)
        return _rising([(i + k, y) for k, h in enumerate(a) for y in places.get(h, ())])
    half = len(a) // 2
    sums = [x + y for x, y in zip(_ends(a[:half], b), reversed(_ends(a[half:][::-1], b[::-1])), strict=True)]
    cut = sums.index(max(sums))
    return longest(a[:half], b[:cut], i, j) + longest(a[half:], b[cut:], i + half, j + cut)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The aligned places (in a, in b), both rising; a longest common subsequence where no line is unique on both sides."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, m, j, n = open_.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        one, two = Counter(a[i:m]), Counter(b[j:n])
        place = {h: k for k, h in enumerate(b[j:n], j) if two[h] == 1}
        kept = _rising([(k, place[h]) for k, h in enumerate(a[i:m], i) if one[h] == 1 and h in place])
        if not kept:
            out += longest(a[i:m], b[j:n], i, j)
            continue
        for x, y in kept:
            open_.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        open_.append((i, m, j, n))
    return sorted(out)


def shared_lines(early: list[int], late: list[int], min_words: int = 5) -> list[int]:
    """Lines of late in aligned blocks that have so many words."""
    out, block, last = [], [], None
    for x, y in [*patience(early, late), (None, None)]:
        if last is None or x != last[0] + 1 or y != last[1] + 1:
            if sum(late[k] & WORDS for k in block) >= min_words:
                out += block
            block = []
        if x is not None:
            block.append(y)
        last = (x, y) if x is not None else None
    return out


def runs(h: np.ndarray, text: np.ndarray, gone: np.ndarray, min_words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hash of each run of lines that are not all gone; blank lines don't count. text: each line's, rising."""
    h, text, gone = (v[h & WORDS > 0] for v in (h, text, gone))
    words = h & WORDS
    upto, there = np.cumsum(words), np.cumsum(~gone)
    before, k = upto - words, np.arange(len(h))
    last = np.searchsorted(upto, before + min_words)
    first = np.searchsorted(before, upto - min_words, "right") - 1
    forth, back = (last < len(h)).nonzero()[0], (first >= 0).nonzero()[0]
    a, z = np.concatenate([k[forth], first[back]]), np.concatenate([last[forth], k[back]])
    fine = (text[a] == text[z]) & (there[z] - there[a] + ~gone[a] > 0)
    a, z = np.unique(np.stack([a[fine], z[fine]]), axis=1)
    key = np.full(len(a), 1, np.uint64)
    for step in range(min_words):
        on = a + step <= z
        x = (key[on] ^ h[a[on] + step].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key[on] = x ^ x >> np.uint64(29)
    found = np.unique(np.stack([text[a], key.view(np.int64)]), axis=1)
    return found[0], found[1]


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """doc_id and lines: the places, from 0, of the lines to delete; documents without any are left out. min_words: 1 to 15."""
    if not 1 <= min_words <= WORDS:
        raise ValueError(f"min_words must be from 1 to {WORDS}")
    line = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")

    def mark(x):
        unspaced = F.when(F.octet_length(x) > F.char_length(x), F.floor(F.regexp_count(x, F.lit(UNSPACED)) / 2)).otherwise(F.lit(0))
        words = F.when(F.trim(x) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(F.lit(min_words), F.greatest(F.size(F.split(F.trim(x), r"\s+", min_words)), unspaced))))
        return F.xxhash64(F.trim(x)).bitwiseAND(F.lit(~WORDS)).bitwiseOR(words.cast("long"))

    all_ = written(docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.transform(line, mark).alias("h")).withColumns({"a": F.xxhash64("h"), "b": F.hash("h")}), "lines")
    # written, so that the join can be split where there are very many copies
    earliest = written(all_.groupBy("a", "b").agg(F.min("doc_id").alias("earliest")), "earliest")
    known = written(all_.join(earliest.hint("merge"), ["a", "b"]).select("doc_id", "h", (F.col("doc_id") > F.col("earliest")).alias("copy")), "known")
    hashed, enough = known.filter("not copy").select("doc_id", "h"), F.aggregate("h", F.lit(0).cast("long"), lambda n, x: n + x.bitwiseAND(F.lit(WORDS)))
    copies = known.filter("copy").filter(enough >= min_words).select("doc_id", F.sequence(F.lit(0), F.size("h") - 1).alias("lines"))
    kind = hashed.schema["doc_id"].dataType.simpleString()

    def found_by(batches):
        """doc_id and line, the hash of each run of the text that is not wholly in lines."""
        for b in batches:
            h, lines = b.column("h"), b.column("lines")
            size, less = h.value_lengths().to_numpy(), lines.value_lengths().to_numpy()
            gone = np.zeros(size.sum(), bool)
            gone[np.repeat(np.cumsum(size) - size, less) + lines.flatten().to_numpy()] = True
            row, key = runs(h.flatten().to_numpy(), np.repeat(np.arange(len(size)), size), gone, min_words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(key)], ["doc_id", "line"])

    def finding(texts: DataFrame) -> DataFrame:
        return texts.mapInArrow(found_by, f"doc_id {kind}, line long")

    none = F.array().cast("array<int>")
    seen = written(finding(hashed.select("doc_id", "h", none.alias("lines"))), "runs")
    first = written(seen.groupBy("line").agg(F.min("doc_id").alias("early"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("early < last").drop("last"), "first")
    held = written(seen.join(first, "line").select("line", "early", "n", "doc_id"), "held")

    def align(batches):
        for b in batches:
            found = [shared_lines(x, y, min_words) for x, y in zip(b.column("eh").to_pylist(), b.column("h").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "lines"])

    def aligned(pairs: DataFrame) -> DataFrame:
        both = pairs.join(hashed.select(F.col("doc_id").alias("early"), F.col("h").alias("eh")), "early").join(hashed, "doc_id").select("doc_id", "eh", "h")
        return written(both.mapInArrow(align, f"doc_id {kind}, lines array<int>").filter(F.size("lines") > 0), "aligned")

    def union(found: DataFrame) -> DataFrame:
        return found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))

    def left_over(tried: DataFrame, found: DataFrame) -> DataFrame:
        """doc_id and line: the runs that an earlier document has and that are not all deleted."""
        texts = hashed.join(tried.select("doc_id").distinct(), "doc_id", "left_semi").join(union(found), "doc_id", "left")
        left = finding(texts.select("doc_id", "h", F.coalesce("lines", none).alias("lines"))).distinct()
        return written(left.join(held.filter("early < doc_id").select("doc_id", "line"), ["doc_id", "line"], "left_semi"), "left")

    def untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
        return written(pairs.filter("early < doc_id").select("early", "doc_id").distinct().join(tried, ["early", "doc_id"], "left_anti"), "pairs")

    tried = written(held.filter("early < doc_id").groupBy("doc_id").agg(F.min_by("early", F.struct("n", "early", "line")).alias("early")).select("early", "doc_id"), "pairs")
    found = aligned(tried)
    more = untried(left_over(tried, found).join(first, "line"), tried)
    tried, found = tried.unionByName(more), found.unionByName(aligned(more))
    pivots, bound, changed, rounds = first.select("line", "early"), BOUND * held.count(), True, 0
    while True:
        rounds += 1
        left = left_over(tried, found)
        work = left.groupBy("line").agg(F.count("*").alias("k")).join(first, "line").agg(F.sum(F.col("k") * F.col("n"))).first()[0] or 0
        # lines left over meet all earlier documents that have them once these are few, or no round helps any more, or there were many
        last = work <= bound or not changed or rounds > ROUNDS
        if last:
            more = left.join(held.select("line", F.col("doc_id").alias("early")), "line")
        else:
            seek = left.join(pivots, "line").filter("doc_id > early").select("line", "doc_id")
            pivots = written(seek.groupBy("line").agg(F.min("doc_id").alias("early")), "pivots")
            more = seek.join(pivots, "line")
        more = untried(more, tried)
        new = aligned(more)
        found = found.unionByName(new)
        if last:
            return union(found.unionByName(copies))
        tried, changed = tried.unionByName(more), new.head(1) != []


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """docs with what earlier documents (by id) have already deleted from text_col, and n_lines_removed (long).

    A null text stays null and an empty one empty. A text all of whose lines go becomes empty; no row is dropped. Equal
    lines need not be unique: where none is, a longest common subsequence is aligned. What is shared with fewer than
    min_words words in a row stays. Rows that repeat an id
    count as one document and are cut alike. A row whose id is null is left as it is. Other columns stay, whatever their
    names, but for n_lines_removed.
    """
    at, gone = (next(n for n in (c + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns) for c in ("__id", "__lines"))
    found = written(repeated(docs, id_col, text_col, min_words), "found")
    found = found.select(F.col("doc_id").alias(at), F.col("lines").alias(gone)).hint("merge")  # its size grows with docs
    d = docs.drop("n_lines_removed").join(found, F.col(id_col) == F.col(at), "left")
    lines = F.split(F.col(text_col), "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.transform(F.array(lines), lambda x: F.array_join(F.transform(rest, lambda k: F.get(x, k)), "\n"))[0]
    return d.withColumn("n_lines_removed", F.coalesce(F.size(gone), F.lit(0)).cast("long")).withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)).drop(at, gone)


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines_removed", F.octet_length("text").cast("long").alias("n_bytes_kept"), F.md5("text").alias("kept_md5"))
