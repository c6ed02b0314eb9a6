"""Quality by weak labels.

Heuristic labellers vote good, bad or nothing on each text. Votes are counted by pattern over all texts, and expectation-
maximisation over those counts (3 to the number of labellers at most) estimates how often each labeller is right on
good and on bad texts. The posterior labels of a bounded sample then train a linear scorer over hashed words and
word shapes, which decides on every text: executors train one on each part of the sample, and its weights are their mean.
"""

import functools
import math
import re
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import read

BAD, NONE, GOOD = 0, 1, 2
#: Different texts that train the scorer at most, texts of a part of them, and the scorer's hashed features.
SAMPLE, PART, FEATURES = 8_000, 1_000, 1 << 14
#: No labeller votes on texts of fewer words; the fewer they have, the nearer they are scored to the share of good texts.
FEW = 8

# Common function words of the languages of the corpus.
COMMON = frozenset(
    "the of and to in is that it was for on as with be by at this from or are an a not "
    "de la le et les des en un une du que qui dans pour par sur est au avec "
    "der die und das von zu den mit ein eine auf für ist im dem nicht "
    "el los las y del con se una por para es al como".split()
)


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def votes(words: list[str], text: str) -> list[int]:
    """Of the labellers: symbols, shouting, repetition, neighbours, common words, word length, sentences."""
    n = len(words)
    if n < FEW:
        return [NONE] * 7
    symbols = sum(map(text.count, "#*$%&|<>")) / n
    loud = (sum(map(str.isupper, words)) + text.count("!")) / n
    unlike = len(set(words)) / n
    twins = sum(map(eq, words, words[1:])) / n
    common = sum(map(COMMON.__contains__, map(str.lower, words))) / n
    size = (len(text) - n + 1) / n
    stops = text.count(".") / n
    return [
        _vote(symbols > 0.25, symbols < 0.01),
        _vote(loud > 0.4, loud < 0.1),
        _vote(unlike < 0.2, unlike > 0.45),
        _vote(twins > 0.15, twins < 0.02),
        _vote(common < 0.03, common > 0.12),
        _vote(size > 12 or size < 2.5, 3.5 < size < 9),
        _vote(stops < 0.005 and n > 60, 0.02 < stops < 0.3),
    ]


def pattern(v: list[int]) -> int:
    return functools.reduce(lambda a, b: 3 * a + b, v, 0)


LABELLERS = 7


def accuracies(patterns: dict[int, int], rounds: int = 100) -> tuple[float, np.ndarray]:
    """The share of good texts, and the probability of each vote of each labeller on bad and on good texts."""
    if not patterns:
        return 0.5, np.full((LABELLERS, 2, 3), 1 / 3)
    p = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[k] for k in sorted(patterns)], float)
    v = p[:, None] // 3 ** np.arange(LABELLERS - 1, -1, -1) % 3
    one = v[:, :, None] == np.arange(3)
    # at first a bad vote weighs as much as all good ones: most texts are good, and each kind of bad text has one labeller
    good = np.where((v == BAD).any(1), 0.2, 0.9)
    for _ in range(rounds):
        w = np.stack([n * (1 - good), n * good])
        chance = (np.einsum("cp,plv->lcv", w, one) + 1.0) / (w.sum(1)[None, :, None] + 3.0)
        share = w[1].sum() / n.sum()
        good = posterior(share, chance, v)
    return share, chance


def posterior(share: float, chance: np.ndarray, v: np.ndarray) -> np.ndarray:
    likely = np.log(chance[np.arange(LABELLERS)[None, :], :, v]).sum(1)
    return 1 / (1 + np.exp(np.clip(likely[:, 0] - likely[:, 1] + np.log(max(1 - share, 1e-9) / max(share, 1e-9)), -50, 50)))


SHAPE = [(re.compile(r"[^\W\d_a-z]*[A-ZÀ-Þ][^\W\d_a-z]*"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0")]


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits by one character each; others as they are."""
    for what, by in SHAPE:
        word = what.sub(by, word)
    return word[:8]


def hashed(word: str) -> tuple[int, int]:
    return zlib.crc32(word.lower().encode()) % FEATURES, zlib.crc32(b" " + shape(word).encode()) % FEATURES


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and shares of words, shapes and equal neighbours."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.array([k for w in words for k in hashed(w)] + [0] * (2 * sum(map(eq, words, words[1:]))))
    places, n = np.unique(at, return_counts=True)
    return places, n / len(words)


def _trained(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 300) -> np.ndarray:
    """Weights, the last of which is the bias: logistic loss, both posterior classes weighing alike, by Adagrad."""
    w = np.zeros(FEATURES + 1)
    if not rows:
        return w
    place = np.concatenate([p for p, _, _ in rows])
    value = np.concatenate([v for _, v, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(p) for p, _, _ in rows])
    y = np.array([g for _, _, g in rows])
    weight = np.where(y > 0.5, 0.5 / max(y.sum(), 1.0), 0.5 / max((1 - y).sum(), 1.0))
    past = np.full(FEATURES + 1, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[place], len(rows)) + w[-1], -30, 30)))
        g = weight * (p - y)
        step = np.append(np.bincount(place, value * g[row], FEATURES), g.sum()) + 1e-6 * w
        past += step**2
        w -= 0.5 * step / np.sqrt(past)
    return w


class Scorer:
    def __init__(self, weights: np.ndarray, share: float):
        self.weights, self.share = weights.tolist(), share
        self.known: dict[str, float] = {}

    def score(self, words: list[str]) -> float:
        """The probability that a text is good."""
        if not words:
            return self.share
        known, w = self.known, self.weights
        if len(known) > 300_000:
            known.clear()
        for x in set(words).difference(known):
            a, b = hashed(x)
            known[x] = w[a] + w[b]
        z = (sum(map(known.__getitem__, words)) + 2 * w[0] * sum(map(eq, words, words[1:]))) / len(words) + w[-1]
        if len(words) < FEW:
            share = min(max(self.share, 1e-6), 1 - 1e-6)
            z = z * len(words) / FEW + math.log(share / (1 - share)) * (1 - len(words) / FEW)
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """All texts vote; sample different ones at most, those of least hash, train the scorer, each once however often it
    is there. Only pattern counts and the weights of each part of the sample reach the driver."""
    d = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches):
        c: dict[int, int] = {}
        for b in batches:
            for text in b.column("text").to_pylist():
                p = pattern(votes(text.split(), text))
                c[p] = c.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], ["pattern", "n"])

    found = d.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    share, chance = accuracies({r["pattern"]: r["n"] for r in found})
    key = F.xxhash64("text").alias("key")
    most = d.select(key).distinct().orderBy("key").limit(sample).agg(F.max("key")).first()[0]
    if most is None:
        return Scorer(_trained([]), float(share))

    def measured(batches):
        for b in batches:
            for k, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = text.split()
                places, value = features(words)
                good = float(posterior(share, chance, np.array([votes(words, text)]))[0])
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([places.astype("<i4").tobytes()]), pa.array([value.astype("<f4").tobytes()]), pa.array([good])], ["key", "places", "value", "good"])

    rows = d.select(key, "text").filter(F.col("key") <= most).mapInArrow(measured, "key long, places binary, value binary, good double")
    each = rows.groupBy("key").agg(F.first("places").alias("places"), F.first("value").alias("value"), F.first("good").alias("good"))
    parts = max(1, -(-sample // PART))

    def train(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("good", "places", "value")), strict=True))
        w = _trained([(np.frombuffer(p, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float), g) for g, p, v in rows])
        return pa.table({"n": [len(rows)], "w": [w.tolist()]})

    trained = each.groupBy(F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(parts)).alias("part")).applyInArrow(train, "n long, w array<double>").collect()
    return Scorer(_mean(trained), float(share))


def _mean(trained) -> np.ndarray:
    """The weights of all parts, each by its number of texts."""
    return sum(r["n"] * np.array(r["w"]) for r in sorted(trained, key=lambda r: r["w"])) / sum(r["n"] for r in trained)


def scored(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """All columns of docs, and quality (the probability of a good text) and keep (quality of least or more).

    A null or empty text has the share of good texts as its quality. Repeated rows are scored alike; the id is not looked at.
    Other columns stay; those called quality and keep are replaced. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def quality(text):
        import pandas as pd

        s = sent.value
        return pd.Series([s.score((t or "").split()) for t in text], dtype=float)

    return docs.withColumn("quality", quality(F.col(text_col))).withColumn("keep", F.col("quality") >= least)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs.select("doc_id", "text"), fit(docs)).select("doc_id", "quality", "keep")
