"""Each operator against brute force, a round trip or held-out labels, and the cases its docstring defines."""

import collections
import hashlib
import os
import random
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagefold.llm import ann, bpe, chunks, components, linededup, nearcopies, packing, quality, rules, suffixdedup, suffixes, tokenfiles, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
ODD = [(None, "some words of a row without id " * 9), (7, None), (8, ""), (9, "x" * 30_000), (10, "same words in two rows, twice the same " * 8), (10, "same words in two rows, twice the same " * 8), (11, "same words in two rows, twice the same " * 8), (12, " \n \n")]


@pytest.fixture
def odd(spark):
    """Nulls, an empty text, a long word, repeated rows, ties, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "s", 1, "k") for r in ODD], "doc_id long, text string, source string, n long, key string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


ALPHABET = [" ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "23", "'s", "'t", ".", "$$", " ", "　", "\x1c", "\x85", "😀", "日本", "the ", "ing", "\r\n", "<|endoftext|>"]


def strings(n, most=40, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, most))) for _ in range(n)]


# 1


def brute_packing(rows, capacity, per_source):
    bins, out = [], []
    for length, source, cluster in rows:
        fit = [k for k, b in enumerate(bins) if b["room"] >= length and (cluster is None or cluster not in b["clusters"]) and (source is None or b["sources"][source] < per_source)]
        if not fit:
            bins.append({"room": capacity, "clusters": set(), "sources": collections.Counter()})
            fit = [len(bins) - 1]
        best = min(fit, key=lambda k: (bins[k]["room"], k))
        b = bins[best]
        out.append((best, capacity - b["room"]))
        b["room"] -= length
        b["clusters"].add(cluster)
        b["sources"][source] += 1
    return out


def test_packing_is_best_fit():
    r = random.Random(0)
    for _ in range(20):
        n = 200
        cluster = pd.Series([r.choice(["x", None, *map(str, range(60))]) for _ in range(n)], dtype="string")
        df = pd.DataFrame({"doc_id": range(n), "piece": 0, "length": [r.randint(0, 64) for _ in range(n)], "source": [r.choice(["a", "a", "b", "c", None]) for _ in range(n)], "cluster": cluster})
        got = packing.fill(df, 64, 3)
        rows = [(a, None if pd.isna(b) else b, None if pd.isna(c) else c) for a, b, c in zip(got.length, got.source, got.cluster, strict=True)]
        assert list(zip(got["bin"], got["start"], strict=True)) == brute_packing(rows, 64, 3)


def test_many_full_pieces():
    """Bins without room are never looked at again, and cost no sorting."""
    rows = pd.DataFrame({"doc_id": range(100_000), "piece": 0, "length": [64] * 99_000 + [7] * 1_000, "source": [str(k % 50) for k in range(100_000)], "cluster": [str(k) for k in range(100_000)]})
    began = time.perf_counter()
    out = packing.fill(rows, 64, 4)
    assert time.perf_counter() - began < 10
    assert out[out.length == 64].bin.nunique() == 99_000 and out.groupby("bin").length.sum().max() <= 64


def test_sequences_of_tokens(spark, odd, empty):
    """Bins packed by token counts hold each document's ids, piece after piece."""
    path = P.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(k, "some words " * k, f"s{k % 3}") for k in range(40)] + [(None, "no id", None)], "doc_id long, text string, source string")
    ids = bpe.encoded(docs, path, P.PATTERN)
    sized = docs.join(ids.withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i")))
    placed = packing.pack(sized, capacity=32, length=F.octet_length("ids") / 4)
    whole, pieces = {r["doc_id"]: r["ids"] for r in ids.collect()}, collections.defaultdict(list)
    lengths = {(r["shard"], r["bin"], r["start"], r["doc_id"]): (r["piece"], r["length"]) for r in placed.collect() if r["length"]}
    for r in packing.sequences(placed, ids, 32).collect():
        assert len(r["ids"]) <= 4 * 32
        for i, start in zip(r["doc_ids"], r["starts"], strict=True):
            piece, length = lengths.get((r["shard"], r["bin"], start, i), (0, 0))
            pieces[i].append((piece, r["ids"][4 * start : 4 * (start + length)]))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items() if i != 0} == {i: bytes(b) for i, b in whole.items() if i != 0}
    none = bpe.encoded(empty, path, P.PATTERN)
    assert packing.sequences(packing.pack(empty), none).count() == 0 and packing.sequences(packing.pack(odd), none).agg(F.sum(F.octet_length("ids"))).first()[0] == 0


def test_packing_edges(odd, empty):
    got = packing.pack(odd, capacity=1000).toPandas()
    assert sorted(got.groupby("doc_id", dropna=False).length.sum()) == sorted(pd.DataFrame(ODD).assign(n=lambda d: d[1].fillna("").map(lambda t: -(-len(t) // 4))).groupby(0, dropna=False).n.sum())
    assert (got.groupby(["shard", "bin"]).length.sum() <= 1000).all() and got[got.doc_id == 10].groupby(["shard", "bin"]).size().max() == 1
    assert packing.pack(empty).count() == 0


# 2 and 9


def reference(text):
    import base64

    import tiktoken

    global _encoding
    if "_encoding" not in globals():
        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoding.encode_ordinary(text)


LONG = ["a" * 3000, "ab" * 700, "", "x" * 300, "é" * 1000 + " b", " ", "a ", " a"]


def test_bpe_is_exact():
    _, known = bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    known.spaced.room = 100  # the bound on what is remembered changes nothing
    texts = strings(1500) + LONG
    for step in chunks.in_steps(texts, 2000):
        for text, ids in zip(step, known.ids(step), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == reference(text), text


def test_bpe_edges(spark, odd, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.decoded(bpe.encoded(odd, path, P.PATTERN), path).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["bytes"])) for r in got) == sorted((d or 0, (t or "").encode()) for d, t in ODD)
    assert bpe.encoded(empty, path, P.PATTERN).count() == 0


def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for k in range(200):
        n = int(r.integers(0, 400))
        v = (r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) >> r.integers(0, 64, n).astype(np.uint64)
        v = v * np.uint64(k % 3 > 0)
        assert (tokenfiles.unpack(tokenfiles.pack(v), n) == v).all()
    docs = [np.arange(k * 900, dtype=np.uint64) for k in (0, 1, 200, 3)]
    ids, lengths, flat = tokenfiles.from_file(tokenfiles.to_file([1, None, 5, 9], docs))
    assert ids == [1, None, 5, 9] and lengths.tolist() == [len(d) for d in docs] and (flat == np.concatenate(docs)).all()


def test_token_files(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/tokens"
    own = odd.select("doc_id", "text", "key").union(spark.createDataFrame([(13, "a <|endoftext|> b<|endoftext|>", "k")], odd.select("doc_id", "text", "key").schema))
    manifest = tokenfiles.write(own, path, P.PATTERN, folder, 2, docs_per_file=3, file_ids=4000)
    got = tokenfiles.load(spark, folder, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 7, 8, 9, 10, 10, 11, 12, 13] and manifest.count() > 1
    at = 0
    for r, text in zip(got, [*[t or "" for _, t in ODD], "a <|endoftext|> b<|endoftext|>"], strict=True):
        want = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(want) // 4, zlib.crc32(want), want)
        at += len(want) // 4
    none = f"file://{tmp_path}/none"
    assert tokenfiles.load(spark, none, tokenfiles.write(empty, path, P.PATTERN, none, 2)).count() == 0


@pytest.mark.parametrize("plain", [False, True])
def test_library_chunks(plain):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    known = tokenfiles.Coder(path, P.PATTERN, plain)
    texts = [*strings(800, seed=4), *LONG, "a <|endoftext|> b", "<|endoftext|>"]
    for text, ids in zip(texts, known.ids(texts), strict=True):
        assert np.frombuffer(ids, known.kind).tolist() == t.encode(text, add_special_tokens=False).ids
    assert (50256 in np.frombuffer(known.ids(["a <|endoftext|> b"])[0], known.kind)) != plain


def test_library_chunks_are_encoded_once_and_forgotten():
    texts = [" ".join(f"{chr(97 + k % 26) * (k % 9 + 1)}{chr(97 + k // 26)}{'.,!'[k % 3]}" for k in range(a, a + 40)) for a in range(0, 600, 10)]
    known = tokenfiles.Coder(P.path("byte_bpe_50k.json"), P.PATTERN, room=100)
    asked, encode = [], known.spaced.encode
    known.spaced.encode = lambda c: asked.append(c) or encode(c)
    for text, ids in zip(texts, known.ids(texts), strict=True):
        assert np.frombuffer(ids, known.kind).tolist() == known.library.encode(text, add_special_tokens=False).ids
        assert len(known.spaced) + len(known.spaced.old) <= 400
    assert len(asked) == len(set(asked)) > 400  # each comes back before it is forgotten
    assert not any(c[-1] in ".," for c in asked)


# 3


def test_accuracies_are_found_without_labels():
    r = np.random.default_rng(1)
    n, right = 20_000, np.array([0.9, 0.8, 0.85, 0.7, 0.9, 0.75, 0.8])
    good = r.random(n) < 0.8
    v = np.where(r.random((n, 7)) < right, good[:, None], ~good[:, None]) * 2
    v[r.random((n, 7)) < 0.2] = 1
    counts = collections.Counter(quality.pattern(x) for x in v.tolist())
    share, chance = quality.accuracies(counts)
    guess = quality.posterior(share, chance, v) > 0.5
    assert abs(share - 0.8) < 0.05 and (guess == good).mean() > 0.9


@tables
def test_quality_against_labels(spark):
    got = quality.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id").toPandas()
    assert got[got.label == 1].keep.mean() > 0.95 and got[got.label == 0].keep.mean() < 0.1


def test_quality_edges(odd, empty):
    got = quality.scored(odd, quality.fit(odd)).toPandas()
    assert len(got) == len(ODD) and got[got.text.isna()].keep.all() and got.quality.between(0, 1).all()
    assert quality.scored(odd.withColumnsRenamed({"n": "quality", "key": "keep"}), quality.fit(odd)).columns == ["doc_id", "text", "source", "quality", "keep"]
    assert quality.scored(empty, quality.fit(empty)).count() == 0


def test_scorer_by_brute_force(spark, monkeypatch):
    """Votes, posteriors, parts of the sample and their mean, in plain Python."""
    monkeypatch.setattr(quality, "PART", 20)
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "of", "and", "house", "Garden", "walks", "is."]) for _ in range(r.randint(9, 60))) for _ in range(40)]
    texts += [" ".join(r.choice(["#$%", "&&&", "BUY", "!!!"]) for _ in range(r.randint(9, 60))) for _ in range(20)]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:7], None, "few words"]], "text string")
    got = quality.fit(docs, sample=40)
    counts = collections.Counter(quality.pattern(quality.votes((t or "").split(), t or "")) for t in [*texts, *texts[:7], None, "few words"])
    share, chance = quality.accuracies(counts)
    key = {t["text"]: (t["k"], t["p"]) for t in docs.na.fill("").distinct().selectExpr("text", "xxhash64(text) as k", "pmod(xxhash64('part', xxhash64(text)), 2) as p").collect()}
    chosen, total, n = sorted(key, key=lambda t: key[t][0])[:40], 0, 0
    for part in (0, 1):
        rows = [(float(quality.posterior(share, chance, np.array([quality.votes(t.split(), t)]))[0]), *quality.features(t.split())) for t in chosen if key[t][1] == part]
        rows = sorted((g, p.astype("<i4").tobytes(), v.astype("<f4").tobytes()) for g, p, v in rows)
        total = total + len(rows) * quality._trained([(np.frombuffer(p, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float), g) for g, p, v in rows])
        n += len(rows)
    assert n == 40 and np.allclose(got.weights, total / n) and got.share == share
    assert all(got.score(t.split()) > 0.5 for t in texts[:40]) and all(got.score(t.split()) < 0.5 for t in texts[40:])
    w = np.array(got.weights)
    for t in texts[::9]:
        p, v = quality.features(t.split())
        assert abs(got.score(t.split()) - 1 / (1 + np.exp(-(w[p] @ v + w[-1])))) < 1e-9


# 4


def test_patience():
    r = random.Random(2)
    for _ in range(300):
        a = [r.randint(0, 30) for _ in range(r.randint(0, 40))]
        b = [x if r.random() < 0.9 else r.randint(0, 60) for x in a]
        pairs = linededup.patience(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert linededup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    five = [16 * k + 5 for k in range(6)]
    assert linededup.shared_lines(five[:4], [five[4], *five[:2], five[5], *five[2:4]]) == [1, 2, 4, 5]
    assert linededup.shared_lines([18, 34], [18, 34]) == [] and linededup.shared_lines([18, 35], [18, 35]) == [0, 1]


def test_runs_of_lines():
    """Each line of a block of min_words words is in a run within it, and equal blocks have equal runs wherever they stand."""
    r = random.Random(12)
    for _ in range(300):
        block = [16 * r.randint(1, 9) + r.choice([0, 1, 1, 2, 3, 5]) for _ in range(r.randint(1, 9))]
        texts = [[16 * r.randint(100, 199) + r.choice([0, 1, 4, 5]) for _ in range(r.randint(0, 4))] + block + [16 * r.randint(100, 199) + 5] for _ in range(2)]
        k = np.repeat([0, 1], [len(t) for t in texts])
        row, key = linededup.runs(np.array(sum(texts, [])), k, np.zeros(len(k), bool))
        alone = set(linededup.runs(np.array(block), np.zeros(len(block), int), np.zeros(len(block), bool))[1].tolist())
        assert bool(alone) == (sum(h & 15 for h in block) >= 5) and all(alone <= set(key[row == t].tolist()) for t in (0, 1))
        for x in range(len(block)) if alone else ():
            left = np.ones(len(block), bool)
            left[x] = False
            assert bool(len(linededup.runs(np.array(block), np.zeros(len(block), int), left)[1])) == (block[x] & 15 > 0)


def test_lines_go_from_later_documents(spark, odd, empty):
    line = lambda k: f"this is line number {k} of a text"
    rows = [(1, "\n".join(map(line, range(6)))), (2, "\n".join(["own words stand here and there", line(1), "x", line(2)])), (3, "\n".join(map(line, range(6)))), (4, "x\ny")]
    got = {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("own words stand here and there\nx", 2), 3: ("", 6), 4: ("x\ny", 0)}
    rows = [(1, "one\n\ntwo three\nfour five"), (2, "one\n\ntwo three\nfour five\nsix"), (3, "吾輩は猫である名前はまだ無い\n二"), (4, "三\n吾輩は猫である名前はまだ無い"), (5, "one\n\ntwo")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "six", 3: rows[2][1], 4: "三", 5: rows[4][1]}
    out = linededup.dedup(odd).toPandas()
    assert len(out) == len(ODD) and out[out.doc_id == 11].text.tolist() == [""] and out[out.doc_id == 10].n_lines_removed.tolist() == [0, 0] and out[out.doc_id == 7].text.isna().all()
    assert linededup.dedup(empty).count() == 0
    clash = spark.createDataFrame([(1, "five words in a line", "a", 5), (2, "five words in a line", "b", 6)], "doc_id long, text string, __id string, __lines int")
    assert sorted(map(tuple, linededup.dedup(clash).collect())) == [(1, "five words in a line", "a", 5, 0), (2, "", "b", 6, 1)]


def test_copies_with_a_line_that_moves(spark):
    """60 copies of an article with one line more, at one of four places: copies of the same places are one document."""
    article = [f"this is line number {k} of an article" for k in range(12)]
    texts = [[*article[: 3 * (k % 4)], "five words of an advertisement", *article[3 * (k % 4) :]] for k in range(60)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got[0] == "\n".join(texts[0]) and all(got[k] == "five words of an advertisement" for k in (1, 2, 3)) and all(got[k] == "" for k in range(4, 60))


def test_longest(monkeypatch):
    r = random.Random(8)
    for many in (0, 1 << 20):
        monkeypatch.setattr(linededup, "MANY", many)
        for _ in range(100):
            a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 25))] for _ in range(2))
            pairs = linededup.longest(a, b)
            assert len(pairs) == common(a, b) and all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("bound", [0, 4])
def test_lines_against_all_pairs(spark, monkeypatch, bound):
    """Passages that the first document has twice or in another order, and short lines, against alignments of all pairs."""
    r = random.Random(4)
    line = lambda k: f"this is line number {k} of a text"
    passage, texts = [1, 2, 3], [[100, 1, 2, 3, 101, 1, 2, 3, 102], [110, 1, 2, 3, 111], [120, 1, 2, 3, 121], [13, 12, 11, 10], [10, 11, 12, 13], [10, 11, 12, 13]]
    texts += [[200 + k, *passage, 300 + k, *passage, 400 + k] for k in range(3)] + [r.sample(range(20, 27), 6) for _ in range(20)]
    short = [[r.randint(1000, 1005) for _ in range(r.randint(1, 8))] for _ in range(40)]  # of two words and of three, or blank
    texts += short
    words = lambda k: 5 if k < 1000 else (0, 2, 3)[k % 3]
    own = [[16 * (k + 1 if words(k) else 0) + words(k) for k in t] for t in texts]
    want = [sorted({y for j in range(k) for y in linededup.shared_lines(own[j], t)}) for k, t in enumerate(own)]
    assert want[1] == want[2] == [1, 2, 3] and want[5] == [0, 1, 2, 3]
    spell = lambda k: " ".join([f"w{k}"] * words(k)) if k >= 1000 else line(k)
    docs = spark.createDataFrame([(k, "\n".join(map(spell, t))) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(linededup, "BOUND", bound)
    got = {r["doc_id"]: sorted(r["lines"]) for r in linededup.repeated(docs).collect()}
    full = lambda k, lines: [y for y in lines if own[k][y] & 15]
    assert {k: full(k, v) for k, v in got.items()} == {k: full(k, v) for k, v in enumerate(want) if v}


# 5


def brute_segments(s):
    out = []

    def inside(lo, hi):
        best = max(((sum(s[i:j]), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
        if best[0] > 1e-12:
            inside(lo, best[1])
            out.append(best[1:])
            inside(best[2], hi)

    inside(0, len(s))
    return out


def test_maximal_segments():
    r = random.Random(0)
    for _ in range(200):
        s = np.array([r.choice([-1.03, -0.5, 0.7, 1.01, 2.3, -2.7]) + r.random() * 1e-3 for _ in range(r.randint(0, 13))])
        assert [(a, b) for a, b, _ in toxicity.maximal(s)] == brute_segments(s)


@tables
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    toxic, clean = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert ((toxic[:, None] > clean).mean() + (toxic[:, None] == clean).mean() / 2) > 0.9
    assert got[got.toxic == 0].predicted.mean() < 0.02 and got[got.toxic == 1].predicted.mean() > 0.8


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([(10, 1), (11, 0), (None, 1), (12, None)], "doc_id long, toxic int")
    for docs, rows in ((odd, labels), (odd, labels.limit(0)), (empty, labels)):
        got = toxicity.scored(docs, toxicity.fit(docs, rows)).toPandas()
        assert len(got) == docs.count() and got.score.between(0, 1).all()


# 6


@tables
def test_recall(spark):
    got = ann.query(spark, SF).toPandas()
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(t.embedding).astype(float), t.vec_id.to_numpy()
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in ids[ids % 50 == 0]:
        score = x @ x[ids == q][0]
        score[ids == q] = -9
        hits += len(set(ids[np.lexsort((ids, -score))[:5]]) & set(got[got.query_id == q].vec_id))
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_forest_recall_within_a_shard():
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 64))
    q = x[:40] + 0.3 * r.normal(size=(40, 64))
    rows = ann.search(np.arange(6000), x, np.arange(10_000, 10_040), q, 5, enough=3000)
    best = np.argsort(-(q @ x.T) / np.linalg.norm(x, axis=1), axis=1)[:, :5]
    assert sum(b in best[a - 10_000] for a, b, _ in rows) >= 0.9 * 200


def test_vectors_that_take_no_part(spark):
    rows = [(50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [0.0, 1.0]), (None, [1.0, 1.0]), (10, [1.0, 0.0, 0.0]), (9, [0.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.nearest(v, v.filter("vec_id % 50 = 0")).orderBy("rank").collect()]
    assert got == [(50, 1, 1, 1.0), (50, 2, 2, 1.0), (50, 3, 9, 0.0)]
    many = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(1, 300)] + [(300, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in ann.nearest(many, many.filter("vec_id = 300")).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    assert ann.nearest(v.limit(0), v.limit(0)).count() == 0
    far = spark.createDataFrame([(50, [2.0**-700, 0.0]), (1, [3 * 2.0**-700, 2.0**-698]), (2, [3 * 2.0**700, 2.0**702]), (3, [1e-320, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[2:] for r in ann.nearest(far, far.filter("vec_id = 50")).orderBy("rank").collect()] == [(3, 1.0), (1, 0.6), (2, 0.6)]


# 7


def test_rules(spark, odd, empty):
    got = rules.measure(odd).toPandas()
    assert len(got) == len(ODD)
    for r, (_, t) in zip(got.itertuples(), ODD, strict=True):
        words = (t or "").split()
        tri = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        again = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.n_repeat_words) == (len(words), len(again))
    book = rules.ledger(odd)
    assert rules.apply(book).filter("kept and base_failed").count() == 0
    assert rules.ablations(book).filter("n_only_this > n_failed").count() == 0 and rules.ledger(empty).count() == 0


# 8


def common(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(p[j] + 1 if x == y else max(p[j + 1], q[j]))
        p = q
    return p[-1]


@pytest.mark.parametrize("long, rows", [(4_096, 64), (0, 3)])
def test_alignment(monkeypatch, long, rows):
    monkeypatch.setattr(nearcopies, "LONG", long)
    monkeypatch.setattr(nearcopies, "ROWS", rows)
    r = random.Random(1)
    for _ in range(800):
        a = [r.randint(0, 8) for _ in range(r.randint(1, 40))]
        b = [r.randint(0, 8) if r.random() < 0.1 else x for x in a if r.random() < 0.93] or [1]
        x, y = np.array(a), np.array(b)
        assert nearcopies.aligned(x, y) == (common(a, b) >= 0.8 * max(len(a), len(b)) - 1e-9)
        assert nearcopies.chained(x, y) <= common(a, b)


@tables
def test_classes_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = nearcopies.near_copies(docs).toPandas()
    x = docs.toPandas()
    sh = [nearcopies.labelled(nearcopies.shingles(nearcopies.words(t.encode()))) for t in x.text]
    held = collections.defaultdict(list)
    for i, s in enumerate(sh):
        for h in s.tolist():
            held[h].append(i)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sh):
        for j, n in collections.Counter(j for h in s.tolist() for j in held[h] if j > i).items():
            if n > 0.05 * len(s) and nearcopies.similar(x.text[i].encode(), x.text[j].encode()):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = collections.defaultdict(lambda: 1 << 60)
    for i in range(len(x)):
        least[find(i)] = min(least[find(i)], int(x.doc_id[i]))
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == {int(x.doc_id[i]): least[find(i)] for i in range(len(x))}


def classes(spark, texts):
    got = nearcopies.near_copies(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).toPandas()
    assert got.groupby("class_id").kept.sum().eq(1).all()
    return dict(zip(got.doc_id, got.class_id, strict=True))


@pytest.mark.parametrize("listed", [1_000, 12])
def test_classes_within_groups_of_a_shared_passage(spark, monkeypatch, listed):
    """Texts that share a passage, and few of which are near copies, against all pairs with a sketch in common."""
    monkeypatch.setattr(nearcopies, "LISTED", listed)
    r = random.Random(6)
    own = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    passage = own(102)
    texts = [passage + own(r.choice([28, 28, 28, 90, 200, 900])) for _ in range(40)]
    texts += [[*t[:105], *own(25)] for t in texts[::4] if len(t) == 130]
    raws = [" ".join(t).encode() for t in texts]
    keys = nearcopies.sketches([nearcopies.labelled(nearcopies.shingles(nearcopies.words(x))) for x in raws]).tolist()
    root = list(range(len(raws)))
    for i in range(len(raws)):
        for j in range(i):
            if set(keys[i]) & set(keys[j]) and nearcopies.similar(raws[i], raws[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert len(set(root)) < len(raws)
    assert classes(spark, texts) == dict(enumerate(root))


@pytest.mark.parametrize("listed, least", [(1_000, 400), (200, 400)])
def test_near_copies_among_texts_of_one_passage(spark, monkeypatch, listed, least):
    """400 pairs with one word in 20 changed, and three quarters of all texts' words in common."""
    monkeypatch.setattr(nearcopies, "LISTED", listed)
    r = random.Random(12)
    own = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    passage, texts = own(152), []
    for _ in range(400):
        texts.append(passage + own(48))
        texts.append([x if r.random() > 0.05 else f"c{r.randint(0, 10**6)}" for x in texts[-1]])
    got = classes(spark, texts)
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(400)) >= least
    assert len(set(got.values())) >= 396


def test_each_pair_of_a_large_group_has_a_tile(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "LISTED", 12)
    r = random.Random(3)
    size = {f"{g}{k}": r.randint(1, 400) for g in "ab" for k in range(90)}
    rows = [(7 if x[0] == "a" else 8, bytearray(x.encode()), n) for x, n in size.items()] + [(9, bytearray(x.encode()), n) for x, n in size.items() if x[0] == "a"]
    got = nearcopies.tiles(spark.createDataFrame(rows, "gid long, node binary, n long")).toPandas()
    held = got.groupby("gid").node.apply(lambda v: {x.decode() for x in v})
    together = {tuple(sorted((x, y))) for v in held for x in v for y in v if x < y}
    assert {(x, y) for x in size for y in size if x < y and x[0] == y[0] and min(size[x], size[y]) >= 0.8 * max(size[x], size[y])} <= together
    assert all(x[0] == y[0] for x, y in together) and held.map(len).max() <= 24 and len(got) < 180 * 40  # groups of the same texts are one


def test_classes_that_share_most_words(spark, monkeypatch):
    """Three classes that share 78 % of their words, in groups larger than a task's: as many rows as tiles need, no more."""
    monkeypatch.setattr(nearcopies, "LISTED", 20)
    r = random.Random(45)
    own = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    passage = own(156)
    base = [passage + own(44) for _ in range(3)]
    texts = [[x if r.random() > 0.02 else f"c{r.randint(0, 10**6)}" for x in base[k % 3]] for k in range(45)]
    got = classes(spark, texts)
    assert [got[k] for k in range(45)] == [k % 3 for k in range(45)]


def test_long_near_copies(spark):
    """Texts of over 2 MB, one word in 50 changed; and of other words."""
    r = random.Random(13)
    long = [f"w{r.randint(0, 10**5)}" for _ in range(300_000)]
    got = classes(spark, [long, [x if k % 50 else "c" for k, x in enumerate(long)], long[150_000:], long[::-1]])
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_pairs_of_a_group():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 1 << 62, n, np.uint64) for n in (100, 600, 1200)]
    texts += [np.where(r.random(len(t)) < 0.1, r.integers(0, 1 << 62, len(t), np.uint64), t) for t in texts] + [texts[1][:520]]
    n, bits = np.array(list(map(len, texts))), [np.array(nearcopies.bit_set(t), np.int64) for t in texts]
    assert {len(b) for b in bits} == {16, 32, 64}
    assert np.argwhere(np.triu(np.isfinite(nearcopies.possible(n, bits, [*"abcdefg"])))).tolist() == [[0, 3], [1, 4], [1, 6], [2, 5], [4, 6]]
    weight = nearcopies.possible(n, bits, [*"abcdebg"])
    assert sorted(map(sorted, nearcopies.forest(weight, [*"abcdebg"]))) in ([[0, 3], [1, 4], [1, 6], [2, 5]], [[0, 3], [1, 6], [2, 5], [4, 6]])


def test_near_copies_edges(odd, empty):
    got = nearcopies.near_copies(odd).toPandas()
    assert len(got) == len(ODD) and set(got[got.doc_id.isin([10, 11])].class_id) == {10} and set(got[got.doc_id.isin([7, 8])].class_id) == {7}
    assert got.kept.sum() == got.groupby("class_id", dropna=False).ngroups and got[got.doc_id.isna()].kept.all() and nearcopies.near_copies(empty).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 3)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    roots = components.joined(None, table([(1, 2), (5, 6), (8, 9)]))
    assert dict(components.joined(roots, table([(2, 6), (6, 20), (30, 31)])).collect()) == {1: 1, 2: 1, 5: 1, 6: 1, 20: 1, 8: 8, 9: 8, 30: 30, 31: 30}


# 10


def test_suffix_arrays(monkeypatch):
    r = random.Random(0)
    for _ in range(400):
        n, k = r.randint(1, 60), r.choice([1, 2, 3, 5, 200])
        t = np.array([r.randint(1, k) for _ in range(n)] + [0])
        want = sorted(range(n + 1), key=lambda i, s=t.tolist(): s[i:])
        for small in (512, 0):
            monkeypatch.setattr(suffixes, "SMALL", small)
            assert suffixes.suffix_array(t).tolist() == want
        before, shared = suffixes.common_prefixes(t.astype(np.uint8), np.array(want), np.zeros(n + 1, bool), 10**6)
        for a, b in zip(want, want[1:], strict=False):
            x, y = t.tolist()[a:], t.tolist()[b:]
            n_ = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert (before[b], shared[b]) == (a, n_)


def brute_repeats(rows, width=200):
    raws = [(t or "").encode() for _, t in rows]
    count = collections.Counter(raw[i : i + width] for raw in raws for i in range(len(raw) - width + 1))
    want = []
    for (d, _), raw in zip(rows, raws, strict=True):
        spans = suffixdedup.union([(i, i + width) for i in range(len(raw) - width + 1) if count[raw[i : i + width]] > 1])
        kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)], strict=True))
        want.append((-1 if d is None else d, len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(want)


def cut_rows(spark, rows):
    got = suffixdedup.cut_out(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("coalesce(doc_id, -1)", "n_removed", "n_spans", "sha2(kept, 256)")
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("grain, many", [(64, 4_000), (8, 3), (64, 1)])
def test_repeated_bytes(spark, monkeypatch, grain, many):
    monkeypatch.setattr(suffixdedup, "GRAIN", grain)
    monkeypatch.setattr(suffixdedup, "MANY", many)
    r = random.Random(3)
    words = lambda n: "".join(r.choice(["th", "er", "né", "and ", ". ", "\n", "日"]) for _ in range(n))
    passages = [words(150), words(150), "ab" * 200, "a" * 500]
    rows = [(i, words(r.randint(0, 200)) + "".join(p[(a := r.randint(0, len(p))) : a + r.randint(100, 400)] + words(r.randint(0, 60)) for p in r.sample(passages, 2))) for i in range(40)]
    rows += [(None, words(200)), (None, None), (70, ""), (70, rows[3][1]), (3, rows[3][1])]
    assert cut_rows(spark, rows) == brute_repeats(rows)


@pytest.mark.parametrize("many", [4_000, 5])
def test_windows_at_the_ends_of_passages(spark, monkeypatch, many):
    """Long and short shares of a passage that many texts have, brought together in small tasks."""
    monkeypatch.setattr(suffixdedup, "MANY", many)
    monkeypatch.setattr(suffixdedup, "SHARD", 500)
    r = random.Random(5)
    words = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p = words(500)
    rows = [(i, words(50) + p[(a := r.randint(0, 290)) : a + 200 + (i % 7)] + words(50)) for i in range(40)] + [(i, words(50) + p + words(50)) for i in range(40, 44)]
    assert cut_rows(spark, rows) == brute_repeats(rows)


def test_an_anchor_of_many_texts(spark):
    """At the shipped settings: a passage in 9,000 texts, each of which goes on in its own way; equal rows; a long text."""
    r = random.Random(9)
    words = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p, long = words(230), words(3_000_000)
    rows = [(i, f"{i} {p[i % 3 :]} {i * 7919}") for i in range(9_000)] + [(10_000 + i, words(210)) for i in range(3)]
    rows += [(20_000, p * 2)] * 200 + [(30_000, long), (30_001, words(90) + long[1_000_000:1_400_000] + words(90))]
    assert cut_rows(spark, rows) == brute_repeats(rows)


def test_repeated_bytes_edges(odd, empty):
    got = suffixdedup.cut_out(odd, characters=True).toPandas()
    assert len(got) == len(ODD) and "source" in got.columns and got[got.doc_id == 12].n_removed.tolist() == [0]
    assert suffixdedup.cut_out(empty).count() == 0
