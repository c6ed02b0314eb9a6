"""Code lengths against a trie of plain dictionaries, and the cases the docstring defines."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagefold.llm import ppm


def trained(texts, order):
    """Symbols and counts of each context: of the longest by occurrence, of shorter ones by the longer contexts that have them."""
    trie = collections.defaultdict(collections.Counter)
    for t in texts:
        padded = b"\n" * order + t
        for i, s in enumerate([*t, ppm.END]):
            trie[padded[i : i + order]][s] += 1
    for k in range(order, 0, -1):
        for c, symbols in [x for x in trie.items() if len(x[0]) == k]:
            for s in symbols:
                trie[c[1:]][s] += 1
    return trie


def coded(trie, text, order):
    padded, total = b"\n" * order + text, 0.0
    for i, s in enumerate([*text, ppm.END]):
        out, done = set(), False
        for k in range(order, -1, -1):
            have = {x: n for x, n in trie.get(padded[i + order - k : i + order], {}).items() if x not in out}
            if have:
                if s in have:
                    total += math.log10((have[s] - 0.5) / sum(have.values()))
                    done = True
                    break
                total += math.log10(0.5 * len(have) / sum(have.values()))
                out |= set(have)
        if not done:
            total -= math.log10(257 - len(out))
    return total


def base(rows, held):
    c, n = collections.Counter(), 0
    for (_, t), out in zip(rows, held, strict=True):
        if not out:
            words = [*(t or "").encode().lower().split(), None]
            c.update(words)
            n += len(words)
    each = []
    for _, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        each.append((len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in words)))
    return each


def is_held(d):
    return d is None or zlib.crc32(str(d).encode()) % 10 == 0


def made(seed=5):
    r = random.Random(seed)
    words = ["the", "The", "of", "ing", "é", "日本", "\x85", "a" * 70, "b.", "\x1f", "\0", "c"]
    rows = [(k, "".join(r.choice(words) + r.choice([" ", "\n", "\t", "  ", "", "　"]) for _ in range(r.choice([0, 1, 3, 40, 300])))) for k in range(120)]
    return [*rows, (None, "a row without id"), (7, None), (8, ""), (10, "twice twice"), (10, "twice twice"), (34, "never seen ÿÿ zq" * 3)]


def run(spark, rows, order, block=ppm.BLOCK, columns="doc_id long, text string, __held int, block long, gram string"):
    docs = spark.createDataFrame([(*r, 1, 2, "g") for r in rows], columns).repartition(4)
    return ppm.scored(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, order=order, block_bytes=block).collect()


@pytest.mark.parametrize("order, block, piece", [(5, 32 << 20, 1 << 20), (3, 2_000, 50), (1, 300, 7)])
def test_against_a_trie_of_dictionaries(spark, monkeypatch, order, block, piece):
    rows = made()
    held = [is_held(d) for d, _ in rows]
    assert 3 < sum(held) < len(held) - 3
    if piece < 1_000:  # executors read the module anew, so pieces are tried here
        texts = [(t or "").encode() for _, t in rows]
        whole = ppm.counted(texts, held, order)
        monkeypatch.setattr(ppm, "PIECE", piece)
        cut = ppm.counted(texts, held, order)
        assert all(np.array_equal(a, b) for a, b in zip(whole[:2], cut[:2], strict=True)) and whole[2] == cut[2]
    trie = trained([(t or "").encode() for (_, t), out in zip(rows, held, strict=True) if not out], order)
    want = sorted((repr(d), out, *b[:3], round(b[3], 6), round(coded(trie, (t or "").encode(), order), 6)) for (d, t), out, b in zip(rows, held, base(rows, held), strict=True))
    got = sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in run(spark, rows, order, block))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=2e-6)


def test_all_continuations_add_up_to_one(spark):
    """After some beginning, the 257 symbols' probabilities: those of texts that end there, and of texts that go on."""
    rows = [(1, "abab"), (2, "abac"), (3, "b")]
    texts = [b"ab" + bytes([s]) for s in range(256)]
    grams = ppm.grams([(k, b"\n" * 3, t, True) for k, t in enumerate(texts)], 3)[0].reshape(257 - 1, 4)[:, 2].tolist() + [int(ppm.grams([(0, b"\n" * 3, b"ab", True)], 3)[0][2])]
    key, n, _ = ppm.counted([t.encode() for _, t in rows], [False] * 3, 3)
    asked = {g: 0 for g in grams} | dict(zip(key.tolist(), n.tolist(), strict=True))
    values = {r["gram"]: r["value"] for r in ppm.trie(spark.createDataFrame(list(asked.items()), "gram long, n long"), 3).collect()}
    assert abs(sum(10 ** values[g] for g in set(grams)) - 1) < 1e-9


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.scored(none, F.lit(False)).count() == 0
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], round(r["score"], 9)) for r in ppm.scored(docs, F.lit(True)).collect()}
    assert got == {1: (2, 0, 0, 0.0, round(-4 * math.log10(257), 9)), 2: (1, 0, 0, 0.0, round(-math.log10(257), 9))}


def test_a_long_text(spark):
    rows = [(1, "some words of a long text " * 100_000), (2, "some words of a long text "), (34, "other words")]
    got = {r["doc_id"]: r for r in run(spark, rows, 5)}
    assert got[1]["n_bytes"] == 2_600_000 and got[1]["n_tokens"] == 600_001 and got[1]["score"] > -100
