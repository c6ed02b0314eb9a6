"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt into shards of a bounded number. Each shard has TREES trees: the sorted array of 64-bit hash strings, a bit for
each random hyperplane. A query descends to its longest matching prefixes in all trees and then ascends in all at once,
a bit at a time, until the ranges that share the prefixes hold enough candidates, whose cosines are computed exactly.
Since a shard's size doesn't change with the table, neither does recall. The query set meets all shards in blocks.

Equal vectors tie, so of each only the `k` + 1 with the least ids can be among anyone's k nearest; the rest of a group of
copies, however large, is left aside before the search.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefold.llm.common import read, written

TREES, BITS = 32, 64
#: Candidates of a query in a shard at least, counted in each tree that finds them (all, in a smaller shard).
ENOUGH = 8_000
#: Vectors of a shard and queries of a block, about. Each vector is sent once for each block, each query once for each shard.
SHARD, BLOCK = 12_000, 10_000


def hashes(x: np.ndarray) -> np.ndarray:
    """TREES rows of hash strings of the rows of x, as unsigned integers with the first bit on top."""
    out = np.empty((TREES, len(x)), np.uint64)
    for t in range(TREES):
        planes = np.random.default_rng(t).normal(size=(x.shape[1], BITS))
        out[t] = np.packbits(x @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, enough: int = ENOUGH):
    """Rows (query id, id, cosine): the k best candidates of each query."""
    own = hashes(x)
    order = np.argsort(own, axis=1, kind="stable")
    own = np.take_along_axis(own, order, axis=1)
    h = hashes(q)
    # by powers of two, which is exact, so that no norm under- or overflows; the cosine stays the same
    x, q = (np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0.0, keepdims=True))[1]) for v in (x, q))
    norm, q_norm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    low, high = np.zeros((TREES, len(q)), np.int64), np.full((TREES, len(q)), len(x))
    open_ = np.arange(len(q))
    for depth in range(BITS, 0, -1):  # ascend, until enough share a prefix of this length
        if not len(open_):
            break
        rest = np.uint64((1 << (BITS - depth)) - 1)
        a = np.stack([np.searchsorted(own[t], h[t, open_] & ~rest, "left") for t in range(TREES)])
        b = np.stack([np.searchsorted(own[t], h[t, open_] | rest, "right") for t in range(TREES)])
        done = (b - a).sum(0) >= enough
        low[:, open_[done]], high[:, open_[done]] = a[:, done], b[:, done]
        open_ = open_[~done]
    out = []
    for j in range(len(q)):
        found = np.zeros(len(x), bool)
        for t in range(TREES):
            found[order[t, low[t, j] : high[t, j]]] = True
        c = np.flatnonzero(found & (ids != query_ids[j]))
        score = (x[c] * q[j]).sum(1) / (norm[c] * q_norm[j])
        best = np.lexsort((ids[c], -score))[:k]
        out += [(int(query_ids[j]), int(i), float(s)) for i, s in zip(ids[c[best]], score[best], strict=True)]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors found nearest to each query by cosine, other than its own id;
    ties go to the lesser id.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part on either side, nor do null
    ids. Vectors of different lengths are not compared. Of rows that repeat an id, the one with the least vector counts. An
    empty table gives no rows; other columns are not carried.
    """

    def valid(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.filter(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))

    alike = Window.partitionBy("h1", "h2").orderBy("id")
    held = valid(vectors).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}).withColumn("copy", F.row_number().over(alike)).filter(F.col("copy") <= k + 1)
    held = written(held.select("id", "v", F.size("v").alias("dim")), "vectors")
    asked = written(valid(queries).select("id", "v", F.size("v").alias("dim")), "queries")
    shards, blocks = max(1, -(-held.count() // SHARD)), max(1, -(-asked.count() // BLOCK))
    deal = lambda n, name: F.pmod(F.xxhash64("id", F.lit(name)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = held.select("*", deal(shards, "shard").alias("shard"), every(blocks).alias("block"))
    right = asked.select("*", deal(blocks, "block").alias("block"), every(shards).alias("shard"))
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def visit(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return kind.empty_table()
        (ids, x), (query_ids, q) = ((t.column("id").to_numpy(), np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)) for t in (a, b))
        rows = search(ids, x, query_ids, q, k)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ([], [], []), kind, strict=True)], schema=kind)

    key = ("dim", "shard", "block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(visit, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
