"""Code lengths by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ORDER bytes, held as tables: for each context the symbols that follow it in the
training texts, and how often. A symbol is sought from the longest context that was seen; where a context lacks it, the code
escapes to the context without its first byte, and the symbols of the longer context, which would have been taken there,
are excluded from the counts of the shorter one. Escapes are estimated by method D: each symbol of a context gives half a
count to them. A shorter context counts a symbol once for each longer one that has it (update exclusion), since only
there it would have been asked for. After the empty context all symbols not seen there are alike. The 257 symbols are the bytes and an end, so that the probabilities of all
texts add up to one; a text is read as if it followed ORDER line breaks.

Each task packs its texts into blocks and counts the block's contexts with their symbols, and its words. Only these counts
are shuffled: by context, level by level, to get the probability of each context and symbol that stands in any text, and
back to the blocks, whose texts then need their own part of the model alone. Words come back only where other blocks have
them too. No task holds more of a context than its 257 symbols, and no table of the model is broadcast.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.llm.common import read, texts, written

#: Bytes of the longest context, 1 to 6: a context and a symbol are one long.
ORDER = 5
#: What escapes take from the count of each symbol that a context has.
ESCAPED = 0.5
END, SYMBOLS, SYMBOL_BITS = 256, 257, 9
#: Bytes of the texts of a block, or one longer text, and bytes looked at together.
BLOCK, PIECE = 32 << 20, 1 << 19
#: Grams of pieces that are held before they are summed.
MERGED = 1 << 20


def parts(texts: list[bytes], order: int = ORDER):
    """Lists of (number of the text, what stands before, bytes, whether the text ends there), PIECE bytes each."""
    held, size = [], 0
    for k, t in enumerate(texts):
        before = b"\n" * order
        for a in range(0, max(1, len(t)), PIECE):
            part = t[a : a + PIECE]
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((k, before, part, a + PIECE >= len(t)))
            before, size = (before + part)[-order:], size + len(part)
    if held:
        yield held


def grams(pieces: list[tuple[int, bytes, bytes, bool]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Context << SYMBOL_BITS | symbol of each byte, and of each end, of some parts, and how many each part has."""
    raw = np.frombuffer(b"".join(b + t for _, b, t, _ in pieces) + b"\0", np.uint8)
    size = np.array([len(t) for _, _, t, _ in pieces])
    last = np.array([x for *_, x in pieces])
    n = len(raw) - order
    key = np.zeros(n, np.int64)
    for k in range(order):
        key = key << 8 | raw[k : k + n]
    symbol, ends = raw[order:].astype(np.int64), np.cumsum(size + order) - order
    symbol[ends] = END
    fine = np.ones(n, bool)
    fine[ends[~last]] = False
    for k in range(1, order):
        fine[ends[:-1] + k] = False
    return (key << SYMBOL_BITS | symbol)[fine], size + last


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, rising, with the sum of its counts."""
    key, n = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    if not len(key):
        return key, n
    by = np.argsort(key, kind="stable")
    key = key[by]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[start], np.add.reduceat(n[by], start)


def counted(texts: list[bytes], held: list[bool], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """Of a block's texts: all grams, rising, with their counts in the texts that are not held out; the same of words."""
    keys, counts, size = [], [], 0
    for pieces in parts(texts, order):
        for out in (False, True):
            if own := [p for p in pieces if held[p[0]] == out]:
                key, n = np.unique(grams(own, order)[0], return_counts=True)
                keys.append(key)
                counts.append(np.zeros(len(key), np.int64) if out else n)
                size += len(key)
        if size > MERGED:
            keys, counts = ([x] for x in summed(keys, counts))
            size = 0
    return *summed(keys, counts), word_counts(texts, held)


def word_counts(texts: list[bytes], held: list[bool]) -> dict[bytes, int]:
    words: Counter = Counter()
    for t, out in zip(texts, held, strict=True):
        if not out:
            words.update(t.lower().split())  # of bytes: ASCII letters and white space only
    for t, out in zip(texts, held, strict=True):
        if out:
            for w in t.lower().split():
                words.setdefault(w, 0)
    return words


def trie(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """counts: gram, n: how often it stands in the training texts, also 0. gram and value: the logarithm (base 10) of the
    symbol's probability after its context.

    From the root on, each level takes from the one above what a symbol costs where its own context lacks it. The symbols
    of a context were all seen after the shorter one too, so those of the context before alone are to be excluded."""
    levels = {order: written(counts.select(F.shiftright("gram", SYMBOL_BITS).alias("context"), F.col("gram").bitwiseAND(F.lit((1 << SYMBOL_BITS) - 1)).alias("symbol"), "n"), "contexts")}
    shorter = lambda k: F.col("context").bitwiseAND(F.lit((1 << 8 * k) - 1))
    for k in range(order - 1, -1, -1):
        levels[k] = written(levels[k + 1].groupBy(shorter(k).alias("context"), "symbol").agg(F.count(F.when(F.col("n") > 0, 1)).alias("n")), "contexts")
    own = Window.partitionBy("context")
    total, kinds = F.sum("n").over(own).alias("total"), F.sum((F.col("n") > 0).cast("long")).over(own).alias("kinds")
    seen, entered = F.col("n") > 0, F.col("total") > 0
    # whole: the cost from this context on, without exclusions; escaped: that of what comes after an escape from it
    direct, escape = F.log10((F.col("n") - ESCAPED) / F.col("total")), F.log10(ESCAPED * F.col("kinds") / F.col("total"))
    at = levels[0].select("context", "symbol", "n", total, kinds).withColumn("escaped", F.when(~seen, -F.log10(SYMBOLS - F.col("kinds"))))
    at = at.withColumn("whole", F.when(seen, direct).when(entered, escape + F.col("escaped")).otherwise(F.col("escaped")))
    for k in range(1, order + 1):
        up = at.select(F.col("context").alias("suffix"), "symbol", *(F.col(c).alias(f"up_{c}") for c in ("n", "total", "kinds", "escaped", "whole")))
        both = levels[k].withColumn("suffix", shorter(k - 1)).join(up.hint("merge"), ["suffix", "symbol"])
        taken = F.sum(F.when(seen, F.col("up_n")).otherwise(0)).over(own)
        here = both.select("context", "symbol", "n", "up_n", "up_escaped", "up_whole", total, kinds, (F.col("up_total") - taken).alias("rest"), "up_kinds")
        fresh = F.col("up_kinds") - F.col("kinds")
        again = F.when(fresh > 0, F.log10(ESCAPED * fresh / F.col("rest"))).otherwise(F.lit(0.0))  # where all are excluded, an escape is certain
        escaped = F.when(F.col("up_n") > 0, F.log10((F.col("up_n") - ESCAPED) / F.col("rest"))).otherwise(again + F.col("up_escaped"))
        at = here.withColumn("escaped", F.when(~seen & entered, escaped))
        at = at.withColumn("whole", F.when(seen, direct).when(entered, escape + F.col("escaped")).otherwise(F.col("up_whole"))).select("context", "symbol", "n", "total", "kinds", "escaped", "whole")
    return at.select(F.shiftleft("context", SYMBOL_BITS).bitwiseOR(F.col("symbol")).alias("gram"), F.col("whole").alias("value"))


PACKED = "block long, words boolean, keys binary, numbers binary, first binary"
#: Rows that a task gathers for the blocks before it sends them.
GATHERED = 1 << 20


def _packs(key: str, number: str, first: str | None = None):
    """Of rows block, key, number and first, on their way to the blocks: a row for each block of GATHERED rows or the task's."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(3).compress

        def packed(held):
            t = pa.Table.from_batches(held).combine_chunks().sort_by([("block", "ascending"), (key, "ascending")])
            block = t.column("block").to_numpy()
            start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            rows = []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(block)], strict=True):
                own = t.slice(a, b - a)
                raw = b" ".join(own.column(key).to_pylist()) if first else np.diff(own.column(key).to_numpy(), prepend=0).tobytes()
                rows.append((int(block[a]), bool(first), press(raw), press(own.column(number).to_numpy().tobytes()), press(np.packbits(own.column(first).to_numpy(zero_copy_only=False)).tobytes()) if first else None))
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= GATHERED:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return run


def _unpacked(packs: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, int, bool]]]:
    """Grams, rising, with their values; words with their counts, and whether the block is the first that has them."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    keys, values, words = [np.zeros(0, np.int64)], [np.zeros(0)], []
    for r in packs.to_pylist():
        if r["words"]:
            names = open_(r["keys"]).split(b" ")
            words += zip(names, np.frombuffer(open_(r["numbers"]), np.int64).tolist(), np.unpackbits(np.frombuffer(open_(r["first"]), np.uint8))[: len(names)].astype(bool).tolist(), strict=True)
        else:
            keys.append(np.cumsum(np.frombuffer(open_(r["keys"]), np.int64)))
            values.append(np.frombuffer(open_(r["numbers"]), np.float64))
    key = np.concatenate(keys)
    by = np.argsort(key)
    return key[by], np.concatenate(values)[by], words


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score and score, the
    logarithm (base 10) of the text's probability under the model of all rows that are not held out.

    Tokens are words of other than ASCII white space, ASCII letters lowered, and an end; base_score is that of single tokens
    with 0.1 added to each count. A null text counts as empty and is an end alone. Where held_out is null, so is a row's id
    as a rule, and the row is held out. Rows that repeat are counted and scored each. If no row is left to learn from, all
    symbols are alike. A text is scored whole, however long; other columns are not carried; an empty table gives no rows.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be from 1 to 6")
    d = texts(docs.withColumn("__held", F.coalesce(held_out, F.lit(True))), id_col, text_col, "__held")
    kind = d.schema["doc_id"].dataType.simpleString()
    packed_ = f"block long, ids array<{kind}>, held array<boolean>, sizes array<int>, texts binary, grams array<long>, gram_n array<long>, words array<binary>, word_n array<long>"

    def packed(batches):
        import zstandard

        number = TaskContext.get().partitionId() << 32

        def block(ids, raws, held, id_type):
            key, n, words = counted(raws, held, order)
            one = lambda values, t: pa.array([values], pa.list_(t))
            return pa.RecordBatch.from_arrays([
                pa.array([number]), one(ids, id_type), one(held, pa.bool_()), one([len(r) for r in raws], pa.int32()),
                pa.array([zstandard.ZstdCompressor(3).compress(b"".join(raws))], pa.binary()), one(key, pa.int64()), one(n, pa.int64()), one(list(words), pa.binary()), one(list(words.values()), pa.int64()),
            ], [x.split()[0] for x in packed_.split(", ")])

        ids, raws, held, size = [], [], [], 0
        for b in batches:
            id_type = b.schema.field("doc_id").type
            for i, t, out in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("__held").to_pylist(), strict=True):
                raw = t.as_py().encode()
                if raws and size + len(raw) > block_bytes:
                    yield block(ids, raws, held, id_type)
                    ids, raws, held, size, number = [], [], [], 0, number + 1
                ids.append(i)  # a value: a slice would keep its batch in memory
                raws.append(raw)
                held.append(out)
                size += len(raw)
        if raws:
            yield block(ids, raws, held, id_type)

    blocks = written(d.mapInArrow(packed, packed_), "blocks")
    each = blocks.select("block", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("gram_n").alias("n"))))
    values = each.select("block", "gram").join(trie(each.groupBy("gram").agg(F.sum("n").alias("n")), order).hint("merge"), "gram")
    # of words only those come back of which other blocks have some too; first: in this block first
    same = Window.partitionBy("word")
    words = blocks.select("block", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("word_n").alias("n"))))
    words = words.select("block", "word", "n", F.sum("n").over(same).alias("total"), F.min(F.when(F.col("n") > 0, F.col("block"))).over(same).alias("first")).filter("total <> n")
    words = words.select("block", "word", "total", (F.col("first") == F.col("block")).alias("first"))
    back = values.select("block", "gram", "value").mapInArrow(_packs("gram", "value"), PACKED).unionByName(words.mapInArrow(_packs("word", "total", "first"), PACKED))
    out = f"doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, logs double, score double, new_words long"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        raw, size = zstandard.ZstdDecompressor().decompress(left.column("texts")[0].as_py()), left.column("sizes")[0].as_py()
        held, ends = left.column("held")[0].as_py(), np.cumsum([0, *size]).tolist()
        raws = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        keys, value, known = _unpacked(right)
        code = np.zeros(len(raws))
        for pieces in parts(raws, order):
            key, n = grams(pieces, order)
            end = np.cumsum(n)
            for a, b in zip((end - n).tolist(), end.tolist(), strict=True):
                key[a:b].sort()  # sought in order, a text's own are found near each other
            start, full = (end - n)[n > 0], np.array([p[0] for p in pieces])[n > 0]
            if len(full):
                np.add.at(code, full, np.add.reduceat(value[np.searchsorted(keys, key)], start))
        count = word_counts(raws, held)
        fresh = sum(n > 0 for n in count.values())
        for w, n, first in known:
            fresh -= (count[w] > 0) - first
            count[w] = n
        tokens, found, logs = [], [], []
        for t in raws:
            n = np.array([count[w] for w in t.lower().split()], np.float64)
            tokens.append(len(n) + 1)
            found.append(int((n > 0).sum()))
            logs.append(float(np.log10(n + 0.1).sum()))
        return pa.Table.from_arrays([
            left.column("ids").combine_chunks().flatten(), pa.array(held, pa.bool_()), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(found, pa.int64()), pa.array(logs, pa.float64()),
            pa.array(code, pa.float64()), pa.array([fresh] + [0] * (len(raws) - 1), pa.int64()),
        ], ["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "logs", "score", "new_words"])

    texts_ = blocks.select(F.col("block").alias("own"), "ids", "held", "sizes", "texts")
    rows = written(texts_.groupBy("own").cogroup(back.groupBy("block")).applyInArrow(score, out), "scored")
    learnt = ~F.col("held_out")
    sums = rows.agg(F.sum(F.when(learnt, F.col("n_tokens"))).alias("n"), F.count(F.when(learnt, 1)).alias("ends"), F.sum("new_words").alias("v")).first()  # three numbers
    n, ends, v = sums["n"] or 0, sums["ends"], (sums["v"] or 0) + (sums["ends"] > 0)
    base = F.col("logs") + F.log10(F.lit(ends + 0.1)) - F.col("n_tokens") * F.log10(F.lit(n + 0.1 * (v + 1)))
    return rows.select("doc_id", "held_out", "n_bytes", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return scored(read(spark, sf_dir, "documents"), held_out)
