"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - w . x): one weight vector shared by all ordered thresholds.  Features
are log counts of words (A-Z lower-cased; runs of letters, digits and non-ASCII bytes) and of their first
`PREFIXES` bytes, so that compounds of one stem count together.  Only features that set toxic training
texts apart are kept: the signed root of the likelihood ratio of their document frequency must exceed
what the largest of as many chance values would reach.  The labels only say toxic or not; the grade of a
toxic text grows with how many different words hold such a feature, so the severity grades are 0 (not
toxic), 1 (mild), 2 (strong) and 3 (severe).  The output is the expected grade.

Training takes a bounded sample (`TRAIN_DOCS` labelled rows by a hash of their id, texts of at most
`crf.TRAIN_BYTES`), never from the held-out fold; scoring reads every whole text.

Defined results: a null or empty text has no features; repeated rows get equal scores; rows without label
or id do not train; without training rows of both kinds the expected severity is 0; an empty table gives
no rows; a result takes the place of a given column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, crf

TRAIN_DOCS = 8000
GRADES = 4
STEPS = (1, 2, 4)  # distinct marked words from which a toxic text is mild, strong, severe
LEAST = 3  # training texts that hold a feature
MOST = 2000  # features
PREFIXES = (4, 5, 6, 7, 8)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WORD[0x80:] = True


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, 44-bit hash) of every feature; `word` tells the words of the column apart."""
    data, bounds = blocks.text_buffer(column)
    data = blocks.LOWER[data]
    start, end, row = blocks.word_bounds(data, bounds, _WORD)
    rolling, index = blocks.RollingHash(data), np.arange(len(start))
    rows, words, hashes = [row], [index], [rolling.of(start, end) ^ np.uint64(1 << 63)]
    for k in PREFIXES:
        long = np.flatnonzero(end - start >= k)
        rows.append(row[long])
        words.append(long)
        hashes.append(rolling.of(start[long], start[long] + k))
    return np.concatenate(rows), np.concatenate(words), np.concatenate(hashes) >> np.uint64(20)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def grade_probabilities(z: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    below = _sigmoid(thresholds[None, :] - z[:, None])
    full = np.column_stack([np.zeros(len(z)), below, np.ones(len(z))])
    return np.diff(full, axis=1)


def counts(row: np.ndarray, at: np.ndarray, n_rows: int, n_words: int) -> np.ndarray:
    return np.log1p(np.bincount(row * n_words + at, minlength=n_rows * n_words).reshape(n_rows, n_words))


def select_words(key: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that mark toxic texts, sorted, from distinct (feature << 20 | row) of at most 2**20 rows."""
    words, inverse = np.unique(key >> np.uint64(20), return_inverse=True)
    is_toxic = toxic[(key & np.uint64((1 << 20) - 1)).astype(np.int64)] == 1
    a = np.bincount(inverse[is_toxic], minlength=len(words)).astype(float)
    b = np.bincount(inverse[~is_toxic], minlength=len(words)).astype(float)
    n_a, n_b = max(1, (toxic == 1).sum()), max(1, (toxic == 0).sum())
    share = n_a / (n_a + n_b)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num(a * np.log(a / ((a + b) * share))) + np.nan_to_num(b * np.log(b / ((a + b) * (1 - share))))
    often = a + b >= LEAST
    z = np.where(often & (a > (a + b) * share), np.sqrt(np.maximum(2 * ratio, 0)), 0.0)
    bar = max(3.0, np.sqrt(2 * np.log(max(often.sum(), 1))))
    best = np.argsort(-z, kind="stable")[:MOST]
    return np.sort(words[best[z[best] >= bar]])


def train(texts: list[str | None], toxic: list[int], steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> dict:
    empty = {"words": np.zeros(0, np.uint64), "w": np.zeros(0), "thresholds": np.array([50.0, 51.0, 52.0])}
    y01 = np.asarray(toxic, np.int64)
    if not len(y01) or y01.min() == y01.max():
        return empty
    step = 128
    chunk = lambda i: features(pa.array(texts[i : i + step], pa.string()))
    keys = []
    for i in range(0, len(texts), step):
        row, _, feature = chunk(i)
        keys.append(np.unique((feature << np.uint64(20)) | (row + i).astype(np.uint64)))
    words = select_words(np.sort(np.concatenate(keys)), y01)
    if not len(words):
        return empty
    x = np.zeros((len(texts), len(words)))
    kinds = np.zeros(len(texts), np.int64)  # different marked words of each text
    for i in range(0, len(texts), step):
        row, word, feature = chunk(i)
        at = np.searchsorted(words, feature)
        at[at == len(words)] = 0
        hit = np.flatnonzero(words[at] == feature)
        n_rows = min(step, len(texts) - i)
        x[i : i + n_rows] = counts(row[hit], at[hit], n_rows, len(words))
        # a word counts once, under the smallest of its marked features
        order = np.lexsort((at[hit], word[hit]))
        first = hit[order][blocks.run_starts(word[hit][order])]
        seen = np.unique(row[first] * len(words) + at[first])
        np.add.at(kinds, i + seen // len(words), 1)
    grade = np.where(y01 == 1, np.searchsorted(STEPS, np.maximum(kinds, 1), "right"), 0)
    n, k = len(texts), GRADES - 1
    # thresholds rise: the first is free, the gaps are exponentials
    p = np.concatenate([np.ones(len(words)), [2.0], np.zeros(k - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, gaps = p[: len(words)], np.exp(p[len(words) + 1 :])
        theta = p[len(words)] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = x @ w
        below = _sigmoid(theta[None, :] - z[:, None])
        slope = np.column_stack([np.zeros(n), below * (1 - below), np.zeros(n)])
        full = np.column_stack([np.zeros(n), below, np.ones(n)])
        own = np.maximum(full[np.arange(n), grade + 1] - full[np.arange(n), grade], 1e-9)
        up, low = slope[np.arange(n), grade + 1] / own, slope[np.arange(n), grade] / own
        g_theta = np.array([up[grade == j].sum() - low[grade == j + 1].sum() for j in range(k)]) / n
        tails = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([x.T @ (low - up) / n - decay * w / len(words), [tails[0]], tails[1:] * gaps])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    theta = p[len(words)] + np.concatenate([[0.0], np.cumsum(np.exp(p[len(words) + 1 :]))])
    return {"words": words, "w": p[: len(words)], "thresholds": theta}


def linear_part(model: dict, column) -> np.ndarray:
    words, n = model["words"], len(column)
    if not len(words):
        return np.zeros(n)
    row, _, word = features(column)
    at = np.searchsorted(words, word)
    at[at == len(words)] = 0
    hit = np.flatnonzero(words[at] == word)
    key, times = np.unique(row[hit] * len(words) + at[hit], return_counts=True)
    return np.bincount(key // len(words), np.log1p(times) * model["w"][key % len(words)], minlength=n)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in blocks.chunks(batches, blocks.TEXT, limit=1 << 20):
            names = [c for c in batch.schema.names if c != blocks.TEXT]
            p = grade_probabilities(linear_part(model, batch.column(blocks.TEXT)), model["thresholds"])
            made = [pa.array(1 - p[:, 0]), pa.array(p @ np.arange(GRADES)), pa.array(p.argmax(1), pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "score", "expected_severity", "grade"])

    return run


def severity(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """`docs` without its text, plus score (probability of any grade above 0), expected_severity and grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST words
    given, fields = blocks.result_fields(docs.withColumnRenamed(text, blocks.TEXT), "score", "expected_severity", "grade")
    return given.mapInArrow(_scorer(shared), f"{fields}, score double, expected_severity double, grade int".lstrip(", "))


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> dict:
    rows = crf.training_rows(docs, labels, "toxic", limit, crf.TRAIN_BYTES)
    return train([r[0] for r in rows], [r[1] for r in rows])


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = severity(docs, model)
    return scored.select("doc_id", crf.held_out().alias("held_out"), "score", "expected_severity", "grade", (F.col("score") >= 0.5).cast("int").alias("predicted"))
