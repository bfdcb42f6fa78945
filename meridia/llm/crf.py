"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  A line's features are byte-class shares, lengths and repetition of the
line itself and of the lines before and after it; the chain adds start and transition weights.
Forward-backward gives each line's probability of being good; their average, weighted by length in bytes,
is the document's evidence, which a monotone logistic map (fitted on the same training rows) turns into
a probability.  Only documents have labels, so every line of a training document carries its label.

Training takes a bounded sample: `TRAIN_DOCS` labelled rows in the order of a hash of their id, of texts
of at most `TRAIN_BYTES` and, together, `TRAIN_LINES` lines; that bound is also what makes collecting them to the driver safe.  Scoring reads
every whole text in chunks.

Defined results: a null or empty text is one empty line and gets a score; repeated rows get equal
scores; rows without label or id do not train; without training rows every score is 0.5; an
empty table gives no rows; a result takes the place of a given column of its name.  A text is held whole, with about
250 bytes a line, and a chain of many lines is walked line by line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks

TRAIN_DOCS = 6000
TRAIN_BYTES = 65536
TRAIN_LINES = 300_000  # lines of the training texts together
SLICE = 1 << 18  # lines, and bytes, whose features are held at a time
THRESHOLD = 0.3
FOLDS = 5

_CLASSES = 9
_CLASS = np.full(256, 8, np.uint8)  # other punctuation and controls
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 3
_CLASS[0x80:] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[[ord(c) for c in "|<>{}[]\\/=_"]] = 6
_CLASS[[ord(c) for c in "*$%&#@^~+"]] = 7
_OWN = _CLASSES + 9
FEATURES = 3 * _OWN + 1


def held_out(key: str = "doc_id", folds: int = FOLDS):
    """Whether the remainder of crc32(id as text) is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def _lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the lines, split at line feeds; an end is after its line feed."""
    n_docs = len(bounds) - 1
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate([bounds[:-1], feeds + 1])
    doc = np.concatenate([np.arange(n_docs), np.searchsorted(bounds, feeds, "right") - 1])
    order = np.lexsort((starts, doc))  # a line that begins where its document ends stays with that document
    starts, doc = starts[order], doc[order]
    lines = len(starts)
    ends = np.empty(lines, np.int64)
    ends[:-1] = starts[1:]
    ends[-1] = len(data)
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    ends[last] = bounds[1:]
    return starts, ends, doc


def _slices(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(lines, their bytes, start and end of each in them): `SLICE` lines and bytes at a time, one longer line alone."""
    lo = 0
    while lo < len(starts):
        hi = min(lo + SLICE, max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE, "right"))))
        yield slice(lo, hi), data[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
        lo = hi


def _own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, again: np.ndarray) -> np.ndarray:
    """What a line itself shows; `again` tells lines that their document has more than once."""
    lines, size = len(starts), ends - starts
    counts = np.bincount(np.repeat(np.arange(lines), size) * _CLASSES + _CLASS[data], minlength=lines * _CLASSES).reshape(lines, _CLASSES).astype(np.float64)
    length = np.maximum(size, 1).astype(np.float64)

    w_start, w_end, _ = blocks.word_bounds(data, np.append(starts, len(data)))
    rolling = blocks.RollingHash(data)
    w_line = np.searchsorted(starts, w_start, "right") - 1
    words = np.bincount(w_line, minlength=lines).astype(np.float64)
    w_hash = rolling.of(w_start, w_end)
    key = np.sort((w_line.astype(np.uint64) << np.uint64(32)) | (w_hash >> np.uint64(32)))
    distinct = np.bincount((key[blocks.run_starts(key)] >> np.uint64(32)).astype(np.int64), minlength=lines)
    tail = _CLASS[data[w_end - 1]] if len(w_end) else np.zeros(0, np.uint8)
    marked = np.bincount(w_line[(tail == 5) | (tail == 7) | (tail == 6)], minlength=lines)
    shout = np.bincount(w_line[(_CLASS[data[w_start]] == 1) & (w_end - w_start > 1) & (_CLASS[data[np.minimum(w_start + 1, max(len(data) - 1, 0))]] == 1)], minlength=lines)

    many = np.maximum(words, 1.0)
    return np.column_stack([
        counts / length[:, None] * 4.0, np.log1p(size) / 4.0, np.log1p(words) / 3.0, np.minimum(length / many, 40.0) / 10.0,
        1.0 - np.minimum(distinct / many, 1.0) if lines else words, marked / many * 2.0, shout / many * 2.0, again * 1.0, words == 0, np.minimum(words, 3.0) / 3.0,
    ])


def _projected(data: np.ndarray, bounds: np.ndarray, project) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(project(own features) of all lines, line size, row, first line of each row and the end), a slice of lines at a time."""
    starts, ends, doc = _lines(data, bounds)
    hashes = np.empty(len(starts), np.uint64)
    for at, part, a, b in _slices(starts, ends, data):
        fed = part[np.maximum(b - 1, 0)] == 10 if len(part) else np.zeros(len(b), bool)
        hashes[at] = blocks.RollingHash(part).of(a, np.maximum(b - ((b > a) & fed), a))
    _, inverse, times = np.unique((doc.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)), return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    made = [project(_own_features(part, a, b, again[at])) for at, part, a, b in _slices(starts, ends, data)]
    length = np.maximum(ends - starts, 1).astype(np.float64)
    return np.concatenate(made), length, doc, np.searchsorted(doc, np.arange(len(bounds)))


def _neighbours(doc: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows moved to the next line and to the line before, within documents; zeros at their ends."""
    same = (doc[1:] == doc[:-1])[:, None]
    down, up = np.zeros_like(before), np.zeros_like(after)
    down[1:], up[:-1] = before[:-1] * same, after[1:] * same
    return down, up


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weight, first line of each row and the end): lines are split at line feeds."""
    own, length, doc, first = _projected(data, bounds, lambda x: x)
    return np.column_stack([own, *_neighbours(doc, own, own), np.ones(len(own))]), length, first


def line_scores(data: np.ndarray, bounds: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features @ w, weight, first line of each row and the end), without ever holding the features of all lines."""
    parts = np.hstack([w[:_OWN], w[_OWN : 2 * _OWN], w[2 * _OWN : 3 * _OWN]])
    made, length, doc, first = _projected(data, bounds, lambda x: x @ parts)
    down, up = _neighbours(doc, made[:, 2:4], made[:, 4:])
    return made[:, :2] + down + up + w[3 * _OWN], length, first


def _steps(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents by falling line count, and how many of them have a line at each step."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    steps = int(count.max(initial=0))
    return order, np.searchsorted(-count[order], -np.arange(steps), "left")


def marginals(emit: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Forward-backward over all documents at once: P(good) of each line, summed pair marginals and log Z."""
    order, alive = _steps(first)
    base = first[:-1][order]
    n, steps = len(order), len(alive)
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    log_z = np.zeros(n)
    for t in range(steps):
        at = base[: alive[t]] + t
        if t == 0:
            alpha[at] = emit[at] + start
        else:
            x = alpha[at - 1][:, :, None] + move
            alpha[at] = emit[at] + np.logaddexp(x[:, 0], x[:, 1])
    total = np.zeros((2, 2))
    ends = first[1:][order] - 1
    log_z[:] = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    for t in range(steps - 2, -1, -1):
        k = alive[t + 1]
        at = base[:k] + t
        x = move + (emit[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        if pairs:
            total += np.exp(alpha[at][:, :, None] + x - log_z[:k, None, None]).sum(0)
    by_doc = np.empty(n)
    by_doc[order] = log_z
    good = np.exp(alpha + beta - np.repeat(by_doc, np.diff(first))[:, None])
    return good, total, by_doc


def _lengths_mean(good: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(texts: list[str | None], labels: list[int], steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> dict:
    """Maximise the conditional likelihood of the line labels (Adam on the exact gradient)."""
    if not texts:
        return {"w": np.zeros((FEATURES, 2)), "start": np.zeros(2), "move": np.zeros((2, 2)), "map": (0.0, 0.0)}
    parts = [line_features(*blocks.text_buffer(pa.array(texts[i : i + 256], pa.string()))) for i in range(0, len(texts), 256)]
    x, weight = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    y = np.asarray(labels, np.int64)
    line_y = np.repeat(y, np.diff(first))
    one = np.eye(2)[line_y]
    n = len(texts)
    seen_start = np.eye(2)[y].sum(0)
    inside = np.diff(first) - 1
    seen_move = np.diag([inside[y == 0].sum(), inside[y == 1].sum()]).astype(float)
    parts = [np.zeros((FEATURES, 2)), np.zeros(2), np.zeros((2, 2))]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, steps + 1):
        good, moves, _ = marginals(x @ parts[0], first, parts[1], parts[2], pairs=True)
        grads = [x.T @ (one - good) / n, (seen_start - good[first[:-1]].sum(0)) / n, (seen_move - moves) / n]
        for p, g, a, b in zip(parts, grads, m, v):
            g = g - decay * p
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p += rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    model = {"w": parts[0], "start": parts[1], "move": parts[2], "map": (1.0, 0.0)}
    z = _logit(_lengths_mean(marginals(x @ parts[0], first, parts[1], parts[2])[0][:, 1], weight, first))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method for the logistic map, lightly held to the identity
        p = 1 / (1 + np.exp(-(a * z + b)))
        s = p * (1 - p)
        g = np.array([((y - p) * z).sum() - (a - 1), (y - p).sum() - 0.1 * b])
        h = np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -1, 1)
    model["map"] = (max(float(a), 1e-3), float(b))
    return model


def score_texts(model: dict, column) -> np.ndarray:
    emit, weight, first = line_scores(*blocks.text_buffer(column), model["w"])
    good = marginals(emit, first, model["start"], model["move"])[0][:, 1]
    a, b = model["map"]
    return 1 / (1 + np.exp(-(a * _logit(_lengths_mean(good, weight, first)) + b)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, max_bytes: int, folds: int = FOLDS) -> list[tuple[str, int]]:
    """At most `limit` labelled rows outside the held-out fold; the ids are few enough to be sent to all tasks."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", folds)).select("doc_id", F.col(label).alias("__y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "__y").limit(limit)
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes).join(F.broadcast(ids), "doc_id")
    return [(r[1], int(r[2])) for r in rows.orderBy("doc_id", "text").limit(limit).collect()]


def _scorer(shared, label: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.chunks(batches, blocks.TEXT, limit=1 << 20):
            names = [c for c in batch.schema.names if c != blocks.TEXT]
            score = score_texts(shared.value, batch.column(blocks.TEXT))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, label])

    return run


def score_documents(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` without its text, plus the score, which takes the place of a given column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers
    given, fields = blocks.result_fields(docs.withColumnRenamed(text, blocks.TEXT), name)
    return given.mapInArrow(_scorer(shared, name), f"{fields}, `{name}` double".lstrip(", "))


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> dict:
    rows = training_rows(docs, labels, "quality", limit, TRAIN_BYTES)
    lines = np.cumsum([(r[0] or "").count("\n") + 1 for r in rows])
    rows = [r for r, n in zip(rows, lines) if n <= TRAIN_LINES]
    model = train([r[0] for r in rows], [r[1] for r in rows])
    del rows
    blocks.trim_driver(docs.sparkSession)
    return model


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents the classifier does not reject, with their own columns."""
    model = fit_quality(docs, labels)
    names = docs.columns
    given = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col("text").alias("__in"))
    scored = score_documents(given, model, "__in", "__score")
    return scored.where(F.col("__score") >= threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op3_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
