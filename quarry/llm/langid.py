"""Language identification by a byte convolutional network, trained here in numpy.

A text's lower-cased bytes are cut into windows of fixed length. Filters of two, three and four bytes run over
each window, their maxima are pooled, and a softmax layer gives the window's languages. A document's scores are
the mean of its windows' probabilities by length; all windows of the whole text count. Bytes fall into 64
classes (the most frequent of the sample, and one for the rest), so that a filter's first and last two bytes
are looked up as pairs.

Defined results: `und` with score 0 if the text is null or has no letter (a character of Unicode's categories L:
fractions, circled digits and the like are none); ties go to the language first in code
point order; repeated rows get equal results; without labelled rows every text is `und`; only doc_id, text and
lang are read, lang for training alone, so other columns can't clash.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import holding

#: The bounded sample: labelled documents that the network is fitted on, and windows from each.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 4000, 4
WINDOW, CLASSES, FILTERS, WIDTHS = 128, 64, 12, (2, 3, 4)
EPOCHS, STEPS, BATCH, RATE, FOLDS = 6, 400, 256, 0.01, 5
UNKNOWN = "und"
#: What may be a letter; has_letter() asks Unicode.
maybe_letter = re.compile(r"[^\W\d_]")
#: Times its share by chance that a language has to reach to stand out among several.
CHANCE = 1.2


def has_letter(text: str) -> bool:
    return any(unicodedata.category(m[0])[0] == "L" for m in maybe_letter.finditer(text))


def held_out(folds: int = FOLDS) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


class Network:
    def __init__(self, languages: list[str], classes: np.ndarray, rng: np.random.Generator):
        self.languages, self.classes = languages, classes
        self.filters = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def pooled(self, c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """c: windows x bytes, padded by three. The maxima and their places, by width."""
        found, places = [], []
        n = c.shape[1] - 3
        for f in self.filters:
            act = sum(f[j][c[:, j : j + n]] for j in range(len(f)))
            places.append(act.argmax(axis=1))
            found.append(np.take_along_axis(act, places[-1][:, None], 1)[:, 0])
        return np.concatenate(found, axis=1), places

    def fit(self, windows: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> None:
        params = [*self.filters, self.out, self.bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        column = np.arange(FILTERS)[None, :]
        epochs = max(EPOCHS, -(-STEPS // -(-len(windows) // BATCH)))  # a small sample is read more often
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                c, y = windows[rows], labels[rows]
                h, places = self.pooled(c)
                d = softmax(h @ self.out + self.bias)
                d[np.arange(len(rows)), y] -= 1
                d /= len(rows)
                back = d @ self.out.T
                grads = []
                for k, (f, place) in enumerate(zip(self.filters, places, strict=True)):
                    g, part = np.zeros_like(f), back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(f)):
                        np.add.at(g[j], (np.take_along_axis(c, place + j, 1), column), part)
                    grads.append(g)
                grads += [h.T @ d + 1e-4 * self.out, d.sum(axis=0)]
                step += 1
                rate = RATE * 0.125 ** (epoch / epochs)
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the first and the last two bytes of each filter add, by pair."""
        zero = np.zeros((CLASSES, FILTERS), np.float32)
        rows = [[f[j] if j < len(f) else zero for j in range(4)] for f in self.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, FILTERS)
        return tuple(np.ascontiguousarray(np.concatenate([pair(r[i], r[i + 1]) for r in rows], axis=1)) for i in (0, 2))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Scorer:
    """Predicts whole texts, a bounded number of windows at a time."""

    step = 128

    def __init__(self, net: Network):
        self.net, (self.front, self.back) = net, net.tables()

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        rows, owner, size = [], [], []
        for i, b in enumerate(data):
            n = -(-len(b) // WINDOW)
            rows.append(b.ljust(n * WINDOW, b"\0"))
            owner += [i] * n
            size += [WINDOW] * (n - 1) + [len(b) - WINDOW * (n - 1)] * (n > 0)
        codes = self.net.classes[np.frombuffer(b"".join(rows), np.uint8)].reshape(-1, WINDOW)
        return codes, np.array(owner, np.int64), np.array(size, np.float64)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(codes), self.step):
            c = np.pad(codes[at : at + self.step], ((0, 0), (0, 3))).astype(np.int32)
            pairs = c[:, :-1] * CLASSES + c[:, 1:]
            act = self.front.take(pairs[:, :WINDOW], axis=0)
            act += self.back.take(pairs[:, 2:], axis=0)
            out.append(softmax(act.max(axis=1) @ self.net.out + self.net.bias))
        return np.concatenate(out)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        codes, owner, size = self.windows(texts)
        total = np.zeros((len(texts), len(self.net.languages)))
        if len(codes):
            np.add.at(total, owner, self.probabilities(codes) * size[:, None])
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-9)
        best = total.argmax(axis=1)
        return [(self.net.languages[b], float(min(1.0, p[b]))) if has_letter(t) else (UNKNOWN, 0.0) for t, b, p in zip(texts, best, total, strict=True)]


def train(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, seed: int = 3) -> Network | None:
    """Fit on a bounded sample of labelled documents outside the held-out fold, chosen by a seeded hash."""
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = usable.select("doc_id").count()
    by_hash = F.xxhash64(F.lit(seed), "doc_id", "text")
    chosen = usable.filter(F.pmod(by_hash, F.lit(max(1, n))) < documents)
    length = F.greatest(F.length("text") - WINDOW, F.lit(0))
    starts = [(length * i / max(1, SAMPLE_WINDOWS - 1)).cast("int") + 1 for i in range(SAMPLE_WINDOWS)]
    sample = chosen.select("doc_id", "lang", by_hash.alias("hash"), F.array_distinct(F.array(*[F.substring("text", s, F.lit(WINDOW)) for s in starts])).alias("parts"))
    # in order, so that it's the same sample in each run, however rows repeat
    sample = sample.orderBy("hash", "doc_id", "lang", "parts").limit(2 * documents).toPandas()
    languages = sorted(sample["lang"].unique())
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for lang, parts in zip(sample["lang"], sample["parts"], strict=True):
        for part in parts:
            b = part.encode("utf-8", "surrogatepass").lower()[:WINDOW]
            if b.strip():
                texts.append(b[: rng.integers(12, WINDOW)] if rng.random() < 0.3 else b)
                labels.append(languages.index(lang))
    counts = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
    classes = np.zeros(256, np.uint8)
    for k, byte in enumerate(np.argsort(-counts, kind="stable")[: CLASSES - 1]):
        classes[byte] = k + 1 if byte else 0
    net = Network(languages, classes, rng)
    windows = classes[np.frombuffer(b"".join(t.ljust(WINDOW + 3, b"\0") for t in texts), np.uint8)].reshape(-1, WINDOW + 3)
    net.fit(windows.astype(np.int64), np.array(labels), rng)
    return net


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    scorer = Scorer(net) if net else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("langid", lambda: None)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(2).to_pylist()]
                found = scorer.predict(texts) if scorer else [(UNKNOWN, 0.0)] * len(texts)
                lang, score = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def least_score(n_languages: int) -> float:
    """The score below which no language of several stands out. One or two always do: a text of both is no junk."""
    return CHANCE / n_languages if n_languages > 2 else 0.0


def in_known_language(docs: DataFrame, net: Network | None, least: float | None = None) -> DataFrame:
    """The documents in which a language is found, with the columns of docs. Rejected are those without a
    letter and those whose best language scores below `least` (least_score() by default). Without a network, for
    lack of labelled rows, only the former."""
    scorer, columns = Scorer(net) if net else None, docs.columns
    bound = least if least is not None else least_score(len(net.languages) if net else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("langid", lambda: None)
        for batch in batches:
            texts, good = batch.column(columns.index("text")), []
            for at in range(0, batch.num_rows, 64):
                part = [t or "" for t in texts[at : at + 64].to_pylist()]
                good += [lang != UNKNOWN and score >= bound for lang, score in scorer.predict(part)] if scorer else map(has_letter, part)
            yield batch.filter(pa.array(good, pa.bool_()))

    # by place: a name with a dot in it can't be looked up
    named = [f"c{i}" for i in range(len(columns))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(named, docs.schema, strict=True)])
    return docs.toDF(*named).mapInArrow(run, schema).toDF(*columns)
