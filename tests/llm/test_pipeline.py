import collections
import os
import random

import pytest
from pyspark.sql import functions as F
from test_operators import brute_packing

import __spark_entry__ as entry
import corpus_pipeline
from pagefold.llm import linededup, nearcopies, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.written(stage(spark, docs, SF), name)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and docs.filter(F.char_length("text") != F.col("n_chars")).count() == 0
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == ids and (packed.groupby(["shard", "bin"]).length.sum() <= 8192).all()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_registered():
    assert "pipeline" in entry.queries() and len([q for q in entry.queries() if q.startswith("op")]) == 13


def corpus():
    """Documents with shared lines, exact and near copies, a shared passage, one longer than a bin, junk, nulls, repeated rows."""
    r = random.Random(21)
    vocabulary = ["".join(r.choice("bdklmnrst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(3000)]
    common = "the of and to in is that it was for on as with be by at this".split()
    say = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    lines = {i: [say(r.randint(8, 20)) for _ in range(4)] for i in range(20)}
    lines |= {20 + k: [say(12), *lines[k][1:3], say(9)] for k in range(5)} | {25 + k: lines[5 + k] for k in range(5)}
    for k in range(5):
        words = say(70).split()
        lines |= {40 + k: [" ".join(words)], 45 + k: [" ".join([*words[:30], "other", *words[31:]])]}
    passage = say(60)
    lines |= {50 + k: [f"{say(90)[:-1]} {'éĩũƩ'[k]}{passage}{'abcd'[k]} {say(90)}"] for k in range(4)}  # these end alike in UTF-8
    lines |= {60: [say(20) for _ in range(400)], **{70 + k: [" ".join(r.choice(["#$%", "&&&", "BUY", "!!!"]) for _ in range(40))] for k in range(8)}}
    rows = [(i, "\n".join(x), None if i % 9 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}") for i, x in lines.items()]
    rows += [rows[3], (80, None, "en", "s1"), (81, "", "en", "s1"), (None, say(30), "en", "s2")]
    return [(*x, len(x[1] or "")) for x in rows]


def line_dedup(rows):
    """Every document against all earlier ones."""
    known, own = {}, {}
    for i, text, *_ in rows:
        own[i] = [16 * known.setdefault(x, len(known) + 1) + min(5, len(x.split())) for x in (text or "").split("\n")]
    gone = {i: {y for j in own if None not in (i, j) and j < i for y in linededup.shared_lines(own[j], h)} for i, h in own.items()}
    return [(i, text and "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i]), *rest) for i, text, *rest in rows]


def near_dedup(rows):
    """The least id of each class of all pairs; of repeated rows one."""
    texts = sorted({x[1] or "" for x in rows})
    root = {t: t for t in texts}
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b] and nearcopies.similar(a.encode(), b.encode()):
                old, new = root[b], root[a]
                root = {t: new if x == old else x for t, x in root.items()}
    least = {}
    for i, text, *_ in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        least.setdefault(root[text or ""], i)
    return list({(x[0], x[1]): x for x in rows if least[root[x[1] or ""]] == x[0]}.values())


def suffix_dedup(rows, width=200):
    """Characters all of whose bytes lie in strings of width bytes that occur twice."""
    raws = [(x[1] or "").encode() for x in rows]
    count = collections.Counter(raw[k : k + width] for raw in raws for k in range(len(raw) - width + 1))
    out = []
    for (i, _, *rest), raw in zip(rows, raws, strict=True):
        bad = {k + j for k in range(len(raw) - width + 1) if count[raw[k : k + width]] > 1 for j in range(width)}
        kept, at = [], 0
        for c in raw.decode():
            n = len(c.encode())
            kept += [] if bad.issuperset(range(at, at + n)) else [c]
            at += n
        out.append((i, "".join(kept), *rest))
    return out


def packing(rows, capacity=8192):
    pieces = []
    for i, text, _, source, _ in rows:
        n = -(-len(text.encode()) // 4)
        pieces += [(i, k, min(capacity, n - k * capacity), source, text) for k in range(max(1, -(-n // capacity)))]
    pieces.sort(key=lambda x: (-x[2], x[0] is not None, x[0], x[1]))
    return [(i, k, 0, b, a, n) for (i, k, n, *_), (b, a) in zip(pieces, brute_packing([x[2:] for x in pieces], capacity, 4), strict=True)]


def test_against_brute_force(spark, tmp_path):
    """run() against the stages in plain Python, on the same fitted scorer; and what each stage is there for."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    scorer = quality.fit(docs)
    good = [x for x in rows if scorer.score((x[1] or "").split()) >= 0.5]
    ids = lambda x: {i for i, *_ in x}
    assert ids(rows) - ids(good) == set(range(70, 78))
    lines = line_dedup(good)
    text = lambda x: {i: t for i, t, *_ in x}
    assert all(text(lines)[25 + k] == "" and text(lines)[20 + k].count("\n") == 1 and text(lines)[k] == text(good)[k] for k in range(5))
    near = near_dedup(lines)
    assert ids(lines) - ids(near) == {*range(26, 30), *range(45, 50), 80, 81} and len(near) == len(ids(near))
    cut = suffix_dedup(near)
    assert {i for i, t in text(cut).items() if t != text(near)[i]} == {50, 51, 52, 53} and all("éĩũƩ"[k] in text(cut)[50 + k] for k in range(4))
    want = packing(cut)
    assert sum(i == 60 for i, *_ in want) == 2
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").select("doc_id", "piece", "shard", "bin", "start", "length").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
