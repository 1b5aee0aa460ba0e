"""Toxicity by maximum-scoring segments.

Every word of the training documents scores by its log-odds between toxic and other documents, with a Dirichlet
prior in proportion to the two kinds, so that rare words score little and unknown ones nothing; and each word costs
DRIFT. Innocent words so speak against a passage, and mildly toxic ones for it. In a text's sequence of scores, the
linear-time scan of Ruzzo and Tompa finds all maximal segments. A segment of score s among n words has
E = K n exp(-lambda s), with lambda from the scores of other documents' words (Karlin and Altschul) and K from their
maxima. Segments with E below EXPECT are passages. A logistic curve over -ln E of the best segment and the number of
passages, all of them, gives the document's score.

Defined results: a null text counts as empty; a text without a positive word, also the empty one, gets the rate of
toxic documents among such; repeated rows get equal results; labels that are null or of unknown documents
don't count, and of several labels of a doc_id the largest counts; without labels of both kinds every score is
the rate of toxic labels (0 without any); only doc_id and text, and of labels doc_id and toxic, are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut

#: The bounded sample of labelled documents, and the most words of the model, by how sure their odds are.
SAMPLE, LEXICON = 20_000, 100_000
DRIFT, EXPECT, FOLDS, FOLD, LIKELY = -0.5, 0.05, 4, 2, 0.3
#: Documents that each word is taken to have been seen in before, in proportion to the two kinds.
PRIOR = 8.0
word = re.compile(r"[^\W\d_]+")


class Odds(dict):
    """Scores of words; any other word costs DRIFT."""

    def __missing__(self, _: str) -> float:
        return DRIFT


class Model(NamedTuple):
    scores: Odds
    rate: float  # lambda
    scale: float  # K
    weights: tuple[float, float, float]


class Segment(NamedTuple):
    first: int  # word
    last: int
    score: float


def fold() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def segments(scores: np.ndarray) -> list[Segment]:
    """All maximal scoring segments of a sequence.

    Each candidate keeps the totals before and after it, and a link to the last candidate before it with a
    smaller total before; candidates in between can't join it, so links make the scan linear.
    """
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    done: list[list] = []  # first, last, total before, total after, link
    places = np.flatnonzero(scores > 0)
    for place, before, after in zip(places.tolist(), totals[places].tolist(), totals[places + 1].tolist(), strict=True):
        now = [place, place, before, after, -1]
        j = len(done) - 1
        while True:
            while j >= 0 and done[j][2] >= now[2]:
                j = done[j][4]
            if j < 0 or done[j][3] >= now[3]:
                now[4] = j
                done.append(now)
                break
            now[0], now[2] = done[j][0], done[j][2]
            del done[j:]
            j = len(done) - 1
    return [Segment(a, b, after - before) for a, b, before, after, _ in done]


def scores_of(text: str, model: Model) -> np.ndarray:
    words = word.findall(text.lower())
    return np.fromiter(map(model.scores.__getitem__, words), np.float64, len(words))


def decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1, by bisection."""
    low, high = 1e-6, 50.0
    total = lambda r: float((shares * np.exp(np.minimum(700, r * scores))).sum())
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return low


def features(text: str, model: Model) -> tuple[float, int, list[tuple[Segment, float]]]:
    """-ln E of the best segment (0 without one), number of passages, and the passages with their E."""
    scores = scores_of(text, model)
    found = [(s, model.scale * len(scores) * math.exp(-min(700.0, model.rate * s.score))) for s in segments(scores)]
    if not found:
        return 0.0, 0, []
    passages = [(s, e) for s, e in found if e <= EXPECT]
    return min(60.0, max(0.05, -math.log(max(1e-300, min(e for _, e in found))) + 5)), len(passages), passages


def probability(best: float, n: int, weights: tuple[float, float, float]) -> float:
    z = weights[0] + weights[1] * best + weights[2] * math.log1p(n)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a slight ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 1e-2 * np.r_[0, w[1:]]
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), grad)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 17) -> Model:
    """Fit on a bounded sample of labels outside the held-out fold, chosen by a seeded hash."""
    usable = labels.filter((fold() != FOLD) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    n = usable.count()
    by_hash = F.xxhash64(F.lit(seed), "doc_id")
    chosen = usable.filter(F.pmod(by_hash, F.lit(max(1, n))) < sample).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(by_hash, "doc_id").limit(2 * sample)
    texts = cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select((F.col("toxic") > 0).alias("toxic"), "text"), "toxic-sample")
    each = texts.select(F.monotonically_increasing_id().alias("uid"), "toxic", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    in_text = each.groupBy("uid", "toxic", "word").agg(F.count("*").alias("times"))
    one, other = F.when(F.col("toxic"), 1.0).otherwise(0.0), F.when(F.col("toxic"), 0).otherwise(F.col("times"))
    counts = cut(in_text.groupBy("word").agg(F.sum(one).alias("pos"), F.count("*").cast("double").alias("all"), F.sum(other).cast("double").alias("clean")), "toxic-words")
    pos, every, clean = (v or 0.0 for v in counts.agg(F.sum("pos"), F.sum("all"), F.sum("clean")).first())
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base = sizes.get(True, 0) / max(1, sum(sizes.values()))
    flat = (math.log(max(base, 1e-9) / max(1 - base, 1e-9)), 0.0, 0.0)
    if not sizes.get(True) or not sizes.get(False) or not pos or pos == every:
        return Model(Odds(), 1.0, 1.0, flat)
    y1, y0 = F.col("pos") + PRIOR * pos / every, F.col("all") - F.col("pos") + PRIOR * (every - pos) / every
    odds = F.log(y1 / pos) - F.log(y0 / (every - pos))
    sure = F.abs(odds) / F.sqrt(1 / y1 + 1 / y0)
    top = counts.withColumn("odds", odds).withColumn("sure", sure).orderBy(F.desc("sure"), "word").limit(LEXICON).select("word", "odds", "clean").collect()
    scores = Odds({r["word"]: float(r["odds"]) + DRIFT for r in top})
    model = Model(scores, 1.0, 1.0, flat)
    best = measured(texts, model, raw=True)
    # how often each score occurs among the words of other documents; words outside the model cost DRIFT
    shares = np.array([r["clean"] for r in top]) / max(1.0, clean)
    rate = decay(np.array([*scores.values(), DRIFT]), np.array([*shares, max(1e-9, 1 - shares.sum())]))
    of_clean = [(n, s) for toxic, n, s in best if not toxic]
    scale = (len(of_clean) + 1) / (sum(n * math.exp(-min(700.0, rate * s)) for n, s in of_clean) + 1)
    model = Model(scores, rate, scale, flat)
    rows = measured(texts, model, raw=False)
    x, y = np.array([[1.0, best, math.log1p(n)] for _, n, best in rows]), np.array([float(toxic) for toxic, *_ in rows])
    return model._replace(weights=tuple(float(v) for v in logistic(x, y)))


def measured(texts: DataFrame, model: Model, raw: bool) -> list[tuple[bool, int, float]]:
    """Of each text of the bounded sample: toxic, and the number of words and the best segment's score (raw), or
    the two features of the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, best = [], []
            for text in batch.column(1):
                if raw:
                    scores = scores_of(text.as_py(), model)
                    n.append(len(scores))
                    best.append(max((s.score for s in segments(scores)), default=0.0))
                else:
                    value, passages, _ = features(text.as_py(), model)
                    n.append(passages)
                    best.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(best, pa.float64())], ["toxic", "n", "best"])

    return sorted((r["toxic"], r["n"], r["best"]) for r in texts.select("toxic", "text").mapInArrow(run, "toxic boolean, n long, best double").collect())


def scored(docs: DataFrame, model: Model, likely: float = LIKELY) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (start:end in code points, comma-joined) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                text = value.as_py() or ""
                best, n, passages = features(text, model)
                score = probability(best, n, model.weights)
                where = ""
                if passages:
                    low = text.lower()
                    spans = [m.span() for m in word.finditer(low if len(low) == len(text) else text)]
                    where = ",".join(f"{spans[s.first][0]}:{spans[s.last][1]}" for s, _ in passages if s.last < len(spans))
                rows.append((score, int(score >= likely), where))
            score, predicted, where = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(predicted, pa.int32()), pa.array(where, pa.string())], ["doc_id", "held_out", "score", "predicted", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (fold() == FOLD).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, passages string")
