"""The prefix trie against a plain recursive one, and the cases the docstrings define."""

import collections
import hashlib
import os
import random
import zlib

import pytest

from pagefold.llm import conversations

SF = "/root/testdata/sf0.01"


def rebuild(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[: heads[c]] + v[heads[c] :] for c, v in own.items()}


def nodes_of(convs):
    members, kids, out = collections.defaultdict(list), collections.defaultdict(list), []
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    sums = {}
    for n in sorted(members, key=len, reverse=True):
        own = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        leaves, saved = (sum(sums[k][i] for k in kids[n]) for i in range(2))
        sums[n] = (leaves or 1, saved + own)
        ends = ",".join(map(str, sorted(c for c in members[n] if len(convs[c]) == len(n))))
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), *sums[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def made(seed=1):
    r = random.Random(seed)
    rows = []
    for c in [*range(-40, 120), 10**15, 10**15 + 1, -(10**15)]:
        for t in range(r.choice([0, 1, 2, 3, 9, 14])):
            rows.append((c, r.choice([t, t, t, None, 3]), r.choice(["user", "bot", None]), r.choice(["a", "b", "é", "", None, "日本"])))
    rows += [(500, k, "user", "same") for k in range(12)] + [(501, k, "user", "same") for k in range(12)]
    rows += [(None, 1, "user", "no id"), (7, 1, "user", "twice"), (7, 1, "user", "twice"), (600, 1, "user", "x" * 2_000_000)]
    # beginnings that differ only in where the role ends
    return rows + [(700 + k, t, *x) for k in range(10) for t, x in enumerate([("a", "bc"), ("ab", "c")] * 5)][:60]


def test_against_a_plain_trie(spark):
    rows = made()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, place int, depth int, rank int").repartition(5)
    out = conversations.prefix_trie(df)
    assert got(out) == nodes_of(rebuild(rows))
    preorder = sorted((r["preorder"], r["subtree_end"], r["depth"]) for r in out.collect())
    assert [p for p, *_ in preorder] == list(range(1, len(preorder) + 1))
    for k, (p, end, depth) in enumerate(preorder):  # what follows and is deeper, up to the end, and no more
        below = next((j for j in range(k + 1, len(preorder)) if preorder[j][2] <= depth), len(preorder))
        assert end == preorder[below - 1][0]


def test_hot_conversations(spark):
    """Thousands of conversations of the same turns, one very long one, and ids of more than one chunk."""
    rows = [(c * 5, t, "user", f"hello {t}") for c in range(3_000) for t in range(3)] + [(7_000_000 + c, 0, "bot", "other") for c in range(0, 900, 5)] + [(9_000_000, t, "u", str(t % 7)) for t in range(2_500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(conversations.prefix_trie(df)) == nodes_of(rebuild(rows))


def test_ids_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK_BITS", 2)
    ids = [*range(-9, 40), 10**12]
    members = spark.createDataFrame([(1, k % 3, 0, c) for k, c in enumerate(ids)], "depth long, one long, two long, conv_id long")
    want = {k: hashlib.sha256(",".join(map(str, sorted(ids[k::3]))).encode()).hexdigest() for k in range(3)}
    assert {r["one"]: r["ends_sha256"] for r in conversations.sha256_of_ids(members).collect()} == want


def test_no_turns_and_no_conversations(spark):
    kind = "conv_id long, turn int, role string, text string"
    assert conversations.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    assert conversations.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], kind)).count() == 0
    alone = [(c, 1, "a", "b") for c in range(1, 5)]  # their family's first is absent: all but the turns after the first h go
    assert got(conversations.prefix_trie(spark.createDataFrame(alone, kind))) == nodes_of(rebuild(alone))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(conversations.query(spark, SF)) == nodes_of(rebuild(rows))


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 50), k, r.randint(0, conversations.MASK)) for k in range(3_000)]
    df = spark.createDataFrame(rows, "g int, k int, v long").repartition(7)
    out = sorted(map(tuple, conversations.running(df, ["g", "k"], ["v"]).collect()))
    total = 0
    for n, ((g, k, v), o) in enumerate(zip(sorted(rows), out, strict=True), 1):
        total += v
        assert o == (g, k, v, n, total & conversations.MASK)
