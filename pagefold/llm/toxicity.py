"""Toxic passages by maximum-scoring segments.

Words and their beginnings, counted once in a text as some texts repeat a word without end, have log-odds between toxic
and other labelled texts, under a Dirichlet prior of their common frequency; a word scores by the surest of its own and its beginnings' odds, less a drift. A linear scan finds all maximal segments of a text. A segment's score is held against the
extreme-value distribution of a clean text of that length (Karlin and Altschul's lambda and K, from the labelled clean
texts), and a text's score is a logistic function, fitted on the labelled texts, of its best segment's log significance
and the number of significant ones.
"""

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import read, texts, written

TOKENS = re.compile(r"[^\W\d_]+").findall
BEGINNINGS = (4, 5, 6, 7)
#: Labelled texts that the model is fitted on at most (a documented parameter), prior words in all and of each at least, and
#: the drift of a word.
SAMPLE, PRIOR, FLOOR, DRIFT = 30_000, 1000.0, 0.5, 0.4
#: How sure (z value) the odds of a word or beginning must be to count; as the texts are bounded, so is the number of these.
SURE = 3.5
SIGNIFICANT = 0.05


def tokens(text: str) -> list[str]:
    return TOKENS(text.lower())


def parts(word: str) -> list[str]:
    """A word and its beginnings, which are marked as such."""
    return [word, *(f"{word[:k]}-" for k in BEGINNINGS if len(word) > k)]


def maximal(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score), in order: Ruzzo and Tompa's linear scan over positive scores."""
    total = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    stack: list[tuple[int, int, float, float, int]] = []  # from, to, sum before, sum to the end, the last below with a lesser sum before
    for i, r in zip(at.tolist(), total[at].tolist(), strict=True):
        left, begin = r - float(scores[i]), i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= r:
                stack.append((begin, i + 1, left, r, j))
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - left) for a, b, left, r, _ in stack]


class Model:
    def __init__(self, odds: dict[str, tuple[float, float]], rate: float, k: float, weights: np.ndarray):
        """odds: of words and beginnings, how sure they are (the absolute z value) and the log-odds."""
        self.odds, self.rate, self.k, self.weights = odds, rate, k, weights
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[word] = max(map(self.odds.get, parts(word), repeat((0.0, 0.0))))[1] - DRIFT
        return found

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens(text)
        scores = np.fromiter(map(self.word, words), np.float64, len(words))
        return len(words), maximal(scores)

    def features(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, int]:
        """The best segment's log of 1 / E-value, and the significant segments."""
        if not found:
            return -3.0, 0
        e = [self.rate * s - math.log(max(self.k * n, 1e-9)) for _, _, s in found]
        return min(max(max(e), -3.0), 30.0), sum(x > -math.log(SIGNIFICANT) for x in e)

    def score(self, best: float, significant: int) -> float:
        w = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[0] + w[1] * best + w[2] * min(significant, 10))))))


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda with sum share * exp(lambda * score) = 1."""
    if not (scores > 0).any() or share @ scores >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while share @ np.exp(high * scores) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if share @ np.exp(mid * scores) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ (y - p) - 1e-3 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """From sample rows at most of labels (doc_id, toxic), those of least hash; broadcast, as their number is bounded. An id
    that is repeated counts once, with its greatest label and the least of its texts. Without rows of both labels, no word scores."""
    chosen = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = written(found.select("text", "toxic"), "labelled")

    def count(batches):
        c = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                c[toxic].update({p for w in set(tokens(text)) for p in parts(w)})
        words = list(c[0].keys() | c[1].keys())
        for a in range(0, len(words), 10_000):
            w = words[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(w), *(pa.array([k[x] for x in w], pa.int64()) for k in c)], ["word", "clean", "toxic"])

    counts = written(sample.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "counts")
    n0, n1 = counts.filter("not endswith(word, '-')").agg(F.sum("clean"), F.sum("toxic")).first()
    if not n0 or not n1:
        return Model({}, 1.0, 1.0, np.array([-5.0, 0.0, 0.0]))
    prior = FLOOR + PRIOR * (F.col("clean") + F.col("toxic")) / (n0 + n1)
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / (n1 + PRIOR - a)) - F.log(b / (n0 + PRIOR - b))
    scored = counts.select("word", "clean", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    # a word tells something if its odds are sure; others only drift
    known = scored.filter(F.abs("z") >= SURE).collect()
    model = Model({r["word"]: (abs(r["z"]), min(max(r["odds"], -2.0), 6.0)) for r in known}, 1.0, 1.0, np.zeros(3))

    def spread(batches):
        c = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                c.update(round(model.word(w), 2) for w in tokens(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64()), pa.array(list(c.values()), pa.int64())], ["score", "n"])

    held = sample.filter("toxic = 0").mapInArrow(spread, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()  # 801 scores at most
    share = np.array([r["n"] for r in held], float)
    model.rate = _rate(np.array([r["score"] for r in held]), share / share.sum())

    def best(batches):
        for b in batches:
            rows = [(n, max((s for _, _, s in f), default=0.0)) for n, f in map(model.segments, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows]), b.column("toxic")], ["n", "best", "toxic"])

    clean = np.array([(r["n"], r["best"]) for r in sample.filter("toxic = 0").mapInArrow(best, "n long, best double, toxic int").collect()], float).reshape(-1, 2)
    # expected number of segments over x in n words: K n exp(-lambda x), at the score that one clean text in 20 passes
    x = max(float(np.quantile(clean[:, 1], 0.95)), 0.5)
    model.k = max(float((clean[:, 1] > x).sum()), 0.5) * math.exp(model.rate * x) / max(float(clean[:, 0].sum()), 1.0)

    def measured(batches):
        for b in batches:
            rows = [model.features(n, f) for n, f in map(model.segments, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.float64()), pa.array([k for _, k in rows], pa.int64()), b.column("toxic")], ["best", "significant", "toxic"])

    seen = np.array([(r["best"], min(r["significant"], 10), r["toxic"]) for r in sample.mapInArrow(measured, "best double, significant long, toxic int").collect()], float)
    model.weights = _logistic(seen[:, :2], seen[:, 2])
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, score (0 to 1), and passages: from, to (in words) and score of each
    significant segment. A null or empty text has none, and the score of a text without toxic words. Repeated rows give
    repeated rows, ties in a passage's bounds go to the earlier one, a null doc_id stays null, other columns are not
    carried, and an empty table gives no rows."""
    d = texts(docs, id_col, text_col)
    sent = d.sparkSession.sparkContext.broadcast(model)  # the sure words of a bounded number of texts

    def run(batches):
        m = sent.value
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            score, passages = [], []
            for text in b.column("text").to_pylist():
                n, found = m.segments(text)
                score.append(m.score(*m.features(n, found)))
                passages.append([{"from": a, "to": e, "score": s} for a, e, s in found if m.features(n, [(a, e, s)])[1]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<`from`:bigint,`to`:bigint,score:double>>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # a null id has no label
    model = fit(docs, read(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic"))
    out = scored(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
