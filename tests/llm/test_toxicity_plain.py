"""The fit and the scores of toxicity against plain Python on a small table."""

import math
import random
import re

import numpy as np
import pytest

from pagefold.llm import toxicity


def words_of(text):
    return re.findall(r"[^\W\d_]+", text.lower())


def with_beginnings(w):
    return [w] + [w[:k] + "-" for k in (4, 5, 6, 7) if len(w) > k]


def best_segments(s):
    """All maximal segments: the best one, and those of what lies before and behind it."""
    best = max(((sum(s[i:j]), -i, -j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    i, j = -best[1], -best[2]
    return best_segments(s[:i]) + [best[0]] + best_segments(s[j:])


def plain(texts, labels):
    """texts: id to text; labels: id to 0 or 1. The score of every text."""
    count = [{}, {}]
    for d, y in labels.items():
        for p in {p for w in set(words_of(texts[d])) for p in with_beginnings(w)}:
            count[y][p] = count[y].get(p, 0) + 1
    n = [sum(v for w, v in c.items() if not w.endswith("-")) for c in count]
    odds, sure = {}, {}
    for w in set(count[0]) | set(count[1]):
        c, t = count[0].get(w, 0), count[1].get(w, 0)
        prior = 0.5 + 1000 * (c + t) / sum(n)
        a, b = t + prior, c + prior
        z = math.log(a / (n[1] + 1000 - a)) - math.log(b / (n[0] + 1000 - b))
        odds[w], sure[w] = min(max(z, -2.0), 6.0), abs(z) / math.sqrt(1 / a + 1 / b)

    def value(w):
        known = [(sure[p], odds[p]) for p in with_beginnings(w) if sure.get(p, 0) >= 3.5]
        return max(known, default=(0.0, 0.0))[1] - 0.4

    runs = {d: [value(w) for w in words_of(t)] for d, t in texts.items()}
    clean = [d for d, y in labels.items() if y == 0]
    share = {}
    for d in clean:
        for v in runs[d]:
            share[round(v, 2)] = share.get(round(v, 2), 0) + 1
    total = sum(share.values())
    excess = lambda lam: sum(m * math.exp(lam * v) for v, m in share.items()) / total - 1
    assert any(v > 0 for v in share) and sum(v * m for v, m in share.items()) < 0
    lam = next(x / 1000 for x in range(1, 64_000) if excess(x / 1000) > 0)  # to a thousandth
    return runs, clean, lam


def test_fit_and_scores(spark):
    r = random.Random(7)
    common, toxic, mild = [f"plain{c}" for c in "abcdefghijklmnop"], [f"vile{c}{c}" for c in "abcd"], [f"gentle{c}" for c in "abcd"]
    texts, labels = {}, {}
    for d in range(900):
        y = int(d % 3 == 0)
        own = r.choices(common, k=r.randint(3, 9)) + r.choices(toxic if y != (r.random() < 0.1) else mild, k=r.randint(1, 3))
        r.shuffle(own)
        texts[d], labels[d] = " ".join(own) + r.choice(["", "!", " 12"]), y
    texts |= {1000: "", 1001: "vileaa vilebb vilecc", 1002: "plaina plainb", 1003: "VILEaa plaina vilebb gentlea viledd"}
    runs, clean, lam = plain(texts, labels)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    assert abs(model.rate - lam) < 2e-3
    # what an executor finds in each text, with the fitted rate
    got = {row["doc_id"]: row for row in toxicity.scored(docs, model).collect()}
    best = {d: best_segments(s) for d, s in runs.items()}
    tops = np.array([max(best[d], default=0.0) for d in clean])
    x = max(float(np.quantile(tops, 0.95)), 0.5)
    k = max(float((tops > x).sum()), 0.5) * math.exp(model.rate * x) / sum(len(runs[d]) for d in clean)
    assert model.k == pytest.approx(k, rel=1e-6)

    def features(d):
        e = [model.rate * s - math.log(max(k * len(runs[d]), 1e-9)) for s in best[d]]
        return (min(max(max(e), -3.0), 30.0), min(sum(v > -math.log(0.05) for v in e), 10)) if e else (-3.0, 0)

    rows = np.array([[1.0, *features(d)] for d in labels])
    y = np.array(list(labels.values()), float)
    w = np.zeros(3)
    for _ in range(20_000):  # the same penalised likelihood, climbed step by step
        p = 1 / (1 + np.exp(-rows @ w))
        w += np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + 2e-3 * np.eye(3), rows.T @ (y - p) - 1e-3 * w) * 0.5
        if np.abs(rows.T @ (y - p) - 1e-3 * w).max() < 1e-9:
            break
    for d in texts:
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ [1.0, *features(d)])))))
        assert got[d]["score"] == pytest.approx(want, abs=1e-4), d
        assert len(got[d]["passages"]) == sum(model.rate * s - math.log(max(k * len(runs[d]), 1e-9)) > -math.log(0.05) for s in best[d])
    assert got[1001]["score"] > 0.5 > got[1002]["score"]


def test_labels_are_told_once(spark):
    """Repeated ids count once, with the greatest label; labels of other values and of no id do not count."""
    docs = spark.createDataFrame([(d, f"vile words {d}" if d % 2 else f"kind words {d}") for d in range(60)] * 2, "doc_id long, text string")
    labels = [(d, d % 2) for d in range(60)]
    one = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    more = toxicity.fit(docs, spark.createDataFrame(labels + [(1, 0), (3, None), (5, 2), (None, 1)], "doc_id long, toxic int"))
    assert one.odds == more.odds and np.allclose(one.weights, more.weights) and one.rate == more.rate
