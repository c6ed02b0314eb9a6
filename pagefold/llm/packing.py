"""Conflict-constrained best-fit packing of documents into sequences of a fixed length.

Pieces are dealt by a hash of their id and number into shards of a bounded number of pieces, whatever their source or cluster,
and each shard fills bins of its own. Bins stand in order of their free room. Each has a bitmap of its duplicate clusters and
bitmaps of its sources, one for each allowed document of a source. For each document, longest first, the search starts
at the least room that holds it and goes to the next bin until one has no conflict: the tightest compatible bin.
"""

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import read, written

SCHEMA = "doc_id {id}, piece long, shard long, bin long, start long, length long"


class Bins:
    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set if a bin has room r
        self.room: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []  # bit s of the k-th: over k documents of source s

    def after(self, least: int) -> Iterator[int]:
        """Bins with at least so much room, tightest first, then oldest first."""
        left = self.rooms >> least << least
        while left:
            low = left & -left
            yield from self.by_room[low.bit_length() - 1]
            left ^= low

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """source, cluster: a bit, or 0 for none. Returns the bin and the place in it."""
        clusters, sources = self.clusters, self.sources
        for b in self.after(length):
            if not clusters[b] & cluster and not sources[b][-1] & source:
                self._move(b, self.room[b] - length)
                break
        else:
            b = len(self.room)
            self.room.append(self.capacity)
            clusters.append(0)
            sources.append([0] * self.per_source)
            self._move(b, self.capacity - length, new=True)
        clusters[b] |= cluster
        for k, held in enumerate(sources[b]):
            if not held & source:
                sources[b][k] |= source
                break
        return b, self.capacity - self.room[b] - length

    def _move(self, b: int, room: int, new: bool = False) -> None:
        if not new:
            own = self.by_room[self.room[b]]
            del own[bisect_left(own, b)]
            if not own:
                self.rooms ^= 1 << self.room[b]
        self.room[b] = room
        insort(self.by_room[room], b)
        self.rooms |= 1 << room


def fill(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """rows: doc_id, piece, length, source, cluster. Adds bin and start."""
    rows = rows.sort_values(["length", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], na_position="first", kind="stable")
    bit = lambda s, twice: [0 if k < 0 else 1 << k for k in pd.factorize(s.where(s.duplicated(keep=False)) if twice else s)[0].tolist()]
    bins = Bins(capacity, per_source)
    placed = [bins.put(*x) for x in zip(rows["length"].tolist(), bit(rows["source"], False), bit(rows["cluster"], True), strict=True)]
    return rows.assign(bin=[b for b, _ in placed], start=[a for _, a in placed])


def pack(
    docs: DataFrame, capacity: int = 8192, per_source: int = 4, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    length: Column | None = None, cluster: Column | None = None, rows_per_shard: int = 4096,
) -> DataFrame:
    """Rows doc_id, piece, shard, bin, start, length: where each piece of each document lies. (shard, bin) names a bin.

    length: by default a quarter of the UTF-8 bytes, rounded up. A longer document than capacity is cut into pieces of
    capacity and a rest. cluster: by default the text itself; no bin holds two rows of a cluster, nor two of its own
    pieces unless cluster is null, nor over per_source rows of a source. A null source or cluster conflicts with none. A
    null or empty text or a null length is one piece of length 0. Repeated rows are rows of one cluster, each placed, also with null ids. Longest pieces are placed first, equally
    long ones by id (null first), piece and cluster. An
    empty table gives no rows; other columns are not carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.greatest(F.coalesce((F.ceil(F.octet_length(text) / 4) if length is None else length).cast("long"), F.lit(0)), F.lit(0))
    sized = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.md5(text) if cluster is None else cluster.cast("string")).alias("cluster"), n.alias("n")), "sized"
    )
    pieces = sized.select(
        "doc_id", "source", "cluster", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / capacity).cast("long") - 1))).alias("piece")
    ).withColumn("length", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity))
    n_pieces = sized.agg(F.sum(F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / capacity).cast("long")))).first()[0] or 0
    shards = max(1, -(-n_pieces // rows_per_shard))
    schema = SCHEMA.format(id=sized.schema["doc_id"].dataType.simpleString())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return fill(rows, capacity, per_source)[["doc_id", "piece", "shard", "bin", "start", "length"]]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)))
    return dealt.drop("n").groupBy("shard").applyInPandas(run, schema)


def sequences(placed: DataFrame, encoded: DataFrame, capacity: int = 8192) -> DataFrame:
    """Rows shard, bin, doc_ids, starts, ids: each bin's token ids, 32-bit integers one after another, and what begins where.

    placed: rows of pack() with the same capacity, whose lengths count tokens. encoded: doc_id and ids, as bpe.encoded()
    gives them; of rows that repeat a doc_id, the least ids count. A null doc_id is one more id. A placed row whose document
    is not in encoded adds no ids. Empty tables give no rows.
    """
    ids = encoded.groupBy(F.col("doc_id").alias("__id")).agg(F.min("ids").alias("ids"))
    part = F.coalesce(F.expr(f"substring(ids, cast(piece * {4 * capacity} + 1 as int), cast(length * 4 as int))"), F.lit("").cast("binary"))
    rows = placed.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("shard", "bin", F.struct("start", "doc_id", "piece", part.alias("ids")).alias("row"))
    bins = rows.groupBy("shard", "bin").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    joined = F.aggregate("rows", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return bins.select("shard", "bin", F.col("rows.doc_id").alias("doc_ids"), F.col("rows.start").alias("starts"), joined.alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
