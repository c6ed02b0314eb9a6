"""The prefix trie of conversations, by preorder intervals.

A conversation is a sequence of turns; each distinct beginning of one is a node. A node's name is its depth with two running
sums of hashes of its turns and their places, so that names need no walk along the conversation. Different conversations
are ranked lexicographically (by hashes of their turns, in so far as others share them), and nodes by the first conversation that has
them and their depth: that is a preorder, in which a subtree is an interval. It ends where the last conversation of
the node ends. Prefix sums over the preorder then give a subtree's leaves and savings as differences between its ends.

Prefix sums are distributed: rows are dealt by ranges of their keys, each task sums its own, and only a total for each task
passes through the driver. No conversation, turn or node is one task's, however many rows share it.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import read, written

#: Running sums are taken modulo a power of two, so that a sum of two is still a long.
MASK = (1 << 62) - 1
#: Every conversation is rebuilt on the first of FAMILY successive ids, with up to HEADS - 1 of its turns.
FAMILY, HEADS = 5, 9
#: Ids of conversations written one after another before they are hashed: those with the same higher bits.
CHUNK_BITS = 16
NODE = ("depth", "one", "two")


def running(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with at, the number of a row in the order of keys, from 1, and for each of some columns (0 to MASK) the sum up to
    the row, modulo MASK + 1, as sum_<column>. keys should tell all rows apart, if only so that they can be dealt evenly."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sums = ["at", *(f"sum_{c}" for c in columns)]

    def local(batches):
        part, held = TaskContext.get().partitionId(), [np.int64(0)] * len(sums)
        for b in batches:
            if b.num_rows:
                values = [np.ones(b.num_rows, np.int64), *(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)]
                here = [(np.cumsum(v) + h) & MASK for v, h in zip(values, held, strict=True)]  # wraps, and is masked afterwards
                held = [x[-1] for x in here]
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, here), pa.array(np.full(b.num_rows, part))], [*b.schema.names, *sums, "part"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    out = written(ordered.mapInArrow(local, f"{kinds}, {', '.join(f'`{s}` long' for s in sums)}, part long"), "running")
    totals = sorted(out.groupBy("part").agg(*(F.max_by(s, "at").alias(s) for s in sums)).collect())  # a row for each task
    before, rows = [0] * len(sums), []
    for t in totals:
        rows.append((t["part"], *before))
        before = [x + t[s] & MASK for x, s in zip(before, sums, strict=True)]
    offsets = df.sparkSession.createDataFrame(rows or [(-1, *before)], ", ".join(["part long", *(f"`before_{s}` long" for s in sums)]))
    added = out.join(F.broadcast(offsets), "part")
    return added.select(*df.columns, *((F.col(s) + F.col(f"before_{s}")).bitwiseAND(F.lit(MASK)).alias(s) for s in sums))


def _less(a: str, b: str):
    """a - b modulo MASK + 1."""
    return (F.col(a) - F.col(b)).bitwiseAND(F.lit(MASK))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), bytes of the text, and a, b: 60 bits each of a digest of role and text. In order of turn, null
    first; equal turns in order of role and text. Rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    bits = lambda k: F.conv(F.substring(digest, k, 15), 16, 10).cast("long")
    d = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    named = d.select("conv_id", "turn", "role", "text", F.octet_length("text").cast("long").alias("bytes"), bits(1).alias("a"), bits(16).alias("b"))
    ordered = running(named.select("conv_id", "turn", "role", "text", "bytes", "a", "b"), ["conv_id", "turn", "role", "text"], []).select("conv_id", "bytes", "a", "b", "at")
    first = ordered.groupBy("conv_id").agg(F.min("at").alias("first"))
    return written(ordered.join(first.hint("merge"), "conv_id").select("conv_id", (F.col("at") - F.col("first") + 1).alias("place"), "bytes", "a", "b"), "turns")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own: turns(). The rebuilt conversations' turns, and all conv_ids. The first h turns are those of the family's first
    conversation (fewer if it has fewer, none if there is none), then come the own turns after the first h; h follows from
    the id: crc32 of its decimals, modulo HEADS."""
    ids = written(own.groupBy("conv_id").agg(F.count("*").alias("n")), "ids")
    heads = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("heads")
    asked = ids.select("conv_id", heads, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("donor"))
    asked = asked.join(ids.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n")).hint("merge"), "donor", "left")
    asked = written(asked.select("conv_id", "heads", "donor", F.least("heads", F.coalesce("donor_n", F.lit(0))).alias("given")), "asked")
    given = own.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS)).withColumnRenamed("conv_id", "donor")
    front = asked.filter("given > 0").join(given.hint("merge"), "donor").filter("place <= heads").select("conv_id", "place", "bytes", "a", "b")
    rest = own.join(asked.hint("merge"), "conv_id").filter("place > heads").select("conv_id", (F.col("place") - F.col("heads") + F.col("given")).alias("place"), "bytes", "a", "b")
    return front.unionByName(rest), ids.select("conv_id")


def sha256_of_ids(members: DataFrame) -> DataFrame:
    """members: the columns of NODE, conv_id. For each node the SHA-256 of its members' decimal ids, ascending, with commas."""
    chunks = members.groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    text = chunks.select(*NODE, "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def hashed(batches):
        """A node's chunks follow each other."""
        now, digest, done = None, None, []

        def rows():
            return pa.RecordBatch.from_arrays([*(pa.array([d[0][k] for d in done], pa.int64()) for k in range(3)), pa.array([d[1] for d in done], pa.string())], [*NODE, "ends_sha256"])

        for b in batches:
            for *node, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield rows()
            done = []
        if now is not None:
            done.append((now, digest.hexdigest()))
            yield rows()

    # one chunk is hashed where it lies; the chunks of larger nodes are dealt by their node, and stream through one hash
    several = text.groupBy(*NODE).agg(F.count("*").alias("k"), F.first("ids").alias("ids"))
    single = several.filter("k = 1").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    large = text.join(several.filter("k > 1").select(*NODE).hint("merge"), list(NODE), "left_semi")
    streamed = large.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    return single.unionByName(streamed.mapInArrow(hashed, "depth long, one long, two long, ends_sha256 string"))


def trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows: conv_id, place (from 1, without gaps), bytes, a, b; ids: every conv_id, also of conversations without turns.

    One row for each node: conv_id (the smallest of its members), depth, parent_conv_id, preorder (from 1), subtree_end (the
    preorder of its last descendant or of itself), n_convs, n_children, n_leaves, saved_tokens (bytes) and ends_sha256. No
    conversations, no nodes. The key by which conversations are ranked has 16 bytes for each turn that they share with others.
    """
    lane = lambda k: F.xxhash64(F.lit(k), "place", "a", "b").bitwiseAND(F.lit(MASK))
    placed = written(running(rows.withColumns({"x": lane(1), "y": lane(2)}), ["conv_id", "place"], ["x", "y"]).drop("at"), "placed")
    # each conversation's beginning, and what its sums come to at its end
    bounds = placed.groupBy("conv_id").agg(F.max(F.struct("place", "sum_x", "sum_y")).alias("z"), F.min(F.struct("place", "sum_x", "sum_y", "x", "y")).alias("s"))
    bounds = bounds.select("conv_id", "z.*", F.col("s.sum_x").alias("sx"), F.col("s.sum_y").alias("sy"), F.col("s.x").alias("x"), F.col("s.y").alias("y"))
    bounds = bounds.select("conv_id", "place", "sum_x", "sum_y", _less("sx", "x").alias("from_x"), _less("sy", "y").alias("from_y"))
    bounds = bounds.select("conv_id", "from_x", "from_y", F.col("place").alias("depth"), _less("sum_x", "from_x").alias("one"), _less("sum_y", "from_y").alias("two"))
    ends = written(ids.join(bounds.hint("merge"), "conv_id", "left").na.fill(0, [*NODE, "from_x", "from_y"]), "ends")
    # equal conversations are one from here on
    kinds = ends.groupBy(*NODE).agg(F.min(F.struct("conv_id", "from_x", "from_y")).alias("least"), F.count("*").alias("weight"))
    kinds = written(kinds.select(*NODE, "least.*", "weight"), "kinds")
    of = placed.join(kinds.select("conv_id", "weight", "from_x", "from_y").hint("merge"), "conv_id")
    of = of.select("conv_id", "weight", "bytes", "a", "b", "x", "y", F.col("place").alias("depth"), _less("sum_x", "from_x").alias("one"), _less("sum_y", "from_y").alias("two"))
    of = written(of, "different")
    shared = of.groupBy(*NODE).agg(F.count("*").alias("k")).filter("k > 1").select(*NODE)
    deepest = of.join(shared.hint("merge"), list(NODE), "left_semi").groupBy("conv_id").agg(F.max("depth").alias("most"))
    keyed = of.join(deepest.hint("merge"), "conv_id", "left").filter(F.col("depth") <= F.coalesce("most", F.lit(0)) + 1)
    keys = keyed.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "a", "b"))), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"))).alias("key"))
    all_keys = kinds.select("conv_id", *NODE).join(keys.hint("merge"), "conv_id", "left").withColumn("key", F.coalesce("key", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    ranked = written(running(all_keys, ["key", "conv_id"], []).drop("key").withColumnRenamed("at", "rank"), "ranked")

    ranked_rows = of.join(ranked.select("conv_id", "rank").hint("merge"), "conv_id").withColumns({"up_one": _less("one", "x"), "up_two": _less("two", "y")})
    least, total = F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs")
    nodes = ranked_rows.groupBy(*NODE).agg(least, total, F.min("rank").alias("first"), F.max("rank").alias("last"), F.first("bytes").alias("bytes"), F.first("up_one").alias("up_one"), F.first("up_two").alias("up_two"))
    root = kinds.agg(least, total, F.count("*").alias("last")).filter("last > 0")
    root = root.select(*(F.lit(0).cast("long").alias(c) for c in NODE), "conv_id", "n_convs", F.lit(1).cast("long").alias("first"), "last", *(F.lit(0).cast("long").alias(c) for c in ("bytes", "up_one", "up_two")))
    nodes = written(nodes.unionByName(root), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_one").alias("one"), F.col("up_two").alias("two")).agg(F.count("*").alias("n_children"))
    full = nodes.join(children.hint("merge"), list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    full = full.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    order = written(running(full, ["first", "depth"], ["leaf", "saved"]).withColumnRenamed("at", "preorder"), "preorder")

    # where each conversation ends in the preorder, and what the sums are there
    end = ranked.select("rank", *NODE).join(order.select(*NODE, "preorder", "sum_leaf", "sum_saved").hint("merge"), list(NODE))
    end = end.select(F.col("rank").alias("last"), F.col("preorder").alias("subtree_end"), F.col("sum_leaf").alias("end_leaf"), F.col("sum_saved").alias("end_saved"))
    up = order.select((F.col("depth") + 1).alias("depth"), F.col("one").alias("up_one"), F.col("two").alias("up_two"), F.col("conv_id").alias("parent_conv_id"))
    known = written(order.join(end.hint("merge"), "last"), "intervals")
    known = written(known.join(up.hint("merge"), ["depth", "up_one", "up_two"], "left"), "children")
    out = known.join(sha256_of_ids(ends.select("conv_id", *NODE)).hint("merge"), list(NODE), "left")
    inside = lambda c: (F.col(f"end_{c}") - F.col(f"sum_{c}") + F.col(c)).cast("long")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "preorder", "subtree_end", "n_convs", "n_children", inside("leaf").alias("n_leaves"), inside("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conversations: conv_id, turn, role, text. The trie of the rebuilt conversations; see rebuilt() and trie().

    Null roles and texts count as empty, null turns come first. Equal turns of a conversation stand in order of role and text, and repeated rows are
    turns of their own. Rows without conv_id are left out; a conversation that is left without turns is a member of the root. Other columns are not carried; an empty
    table gives no rows.
    """
    return trie(*rebuilt(turns(conversations)))


def query(spark, sf_dir: str) -> DataFrame:
    out = prefix_trie(read(spark, sf_dir, "conversations"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "preorder", "subtree_end")
