"""Language-model scoring with Brown class-based bigrams.

P(text) = product of P(class | class before) * P(word | class).  What exchange clustering moves between
classes are units: every word that the training text holds `LEAST` times or more, each on its own, and the
rarer and unseen words grouped by a hash of their last three bytes, so every word has a class.  Transitions
back off to class frequencies; a class keeps the share of its singletons for words it has not seen.

All counts are over all training text.  A text is cut into words once; from there on words are numbers:
1. runs of documents of some megabytes make blocks, where they lie; a block is stored as its distinct words (64-bit
   hashes), their training counts and the sequence of word numbers.  Its words and counts go to buckets by hash range;
2. a bucket adds up and answers every block with the totals of that block's words, in the same order;
3. the opening: the `TOP` most frequent words and the suffix groups of all others are clustered on the driver;
   every unit starts in the class of its word or of its group;
4. rounds of distributed exchange: a block counts the classes before and after each of its units and sends these
   sparse counts to the buckets; a bucket adds them up, moves its units and answers every block with the classes
   of that block's units.  Rounds end when nothing moves, the likelihood rises by less than `TOLERANCE`
   a token, or after `ROUNDS`;
5. a block meets its answers and scores its documents.  No table of all words is held or sent anywhere.

The number of buckets follows the words that blocks send (`BUCKET_BYTES`), so a task's memory does not grow with the
corpus.  A text is held whole with about ten bytes a byte of text in its task.

Defined results: a null or empty text is the end token alone; rows without an id count as the id's empty text
for the fold; repeated rows are scored, and counted, one by one; an empty table gives no rows; without training
text all counts are 0.  Only `doc_id` and `text` are read, so other columns may have any names; `perplexity` is 10 to
the power of minus `score` a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, crf

FOLDS = 10
CLASSES = 64
TOP = 1024
GROUPS = 512
ROUNDS = 8
TOLERANCE = 0.02  # nats a token that a round must gain for another one
LEAST = 2
BACK_OFF = 5.0
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20  # of words and counts in a bucket
RANGE = 1 << 15  # units whose classes are counted at a time
PIECE = 1 << 20  # text bytes hashed at a time
_END = np.uint64(0xE0D0E0D0E0D0E0D1)


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, suffix group) of the words of each row and its end token, in order."""
    data, bounds = blocks.text_buffer(column)
    start, end, row = blocks.word_bounds(data, bounds)
    n, total = len(bounds) - 1, len(row) + len(bounds) - 1
    at = np.arange(len(row)) + row
    ends = np.cumsum(np.bincount(row, minlength=n)) + np.arange(n)
    hashes, group, rows = np.full(total, _END), np.full(total, GROUPS, np.uint16), np.empty(total, np.int32)
    rows[at], rows[ends] = row, np.arange(n)
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        a, b = start[i:j] - start[i], end[i:j] - start[i]
        rolling = blocks.RollingHash(blocks.LOWER[data[start[i] : end[j - 1]]])
        hashes[at[i:j]] = rolling.of(a, b)
        group[at[i:j]] = rolling.of(np.maximum(a, b - 3), b) % np.uint64(GROUPS)
        i = j
    return rows, hashes, group


def _bucket_edges(count: int) -> np.ndarray:
    return np.array([(i << 64) // count for i in range(1, count)], np.uint64)


def _split(hashes: np.ndarray, count: int) -> np.ndarray:
    """Where the buckets' ranges lie in sorted hashes."""
    return np.concatenate([[0], np.searchsorted(hashes, _bucket_edges(count), "left"), [len(hashes)]])


def _planes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second bytes, and so on: sorted or small ones then compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view("u1").reshape(len(x), x.itemsize).T).tobytes()


def _whole(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(size, -1).T).view(dtype).ravel()


def _rising(x: np.ndarray) -> bytes:
    """Rising numbers as planes of their steps."""
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _risen(raw: bytes, dtype: str) -> np.ndarray:
    return np.cumsum(_whole(raw, dtype), dtype=dtype)


def _coded_schema(key: str) -> str:
    return f"block bigint, ids array<{key}>, held binary, counts binary, n_words bigint, words binary, groups binary, times binary, stream binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its documents, its distinct words in order of their hashes, and all tokens as places among them."""
    block = TaskContext.get().partitionId() << 32
    for table in blocks.gathered(batches, limit=BLOCK_BYTES):
        rows, hashes, group = tokens(table.column("text"))
        held = table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        words, stream = np.unique(hashes, return_inverse=True)
        groups = np.empty(len(words), "<u2")
        groups[stream] = group
        times = np.bincount(stream[~held[rows]], minlength=len(words)).astype("<u4")
        counts = np.bincount(rows, minlength=table.num_rows).astype("<u4")
        ids = table.column("doc_id").combine_chunks()
        packed = [held.tobytes(), counts.tobytes(), len(words), _planes(words), groups.tobytes(), _planes(times), _planes(stream.astype("<u4"))]
        names = ["block", "ids", "held", "counts", "n_words", "words", "groups", "times", "stream"]
        columns = [pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
        columns += [pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in packed]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        block += 1


def _trained(row: dict, unit: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit before, unit) of a block's training tokens; every text begins after an end."""
    train = np.repeat(~np.frombuffer(row["held"], bool), np.frombuffer(row["counts"], "<u4"))
    now = unit[_whole(row["stream"], "<u4")[train]]
    return np.concatenate([[end], now[:-1]])[: len(now)], now


def _requests(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, times, group = _whole(row["words"], "<u8"), _whole(row["times"], "<u4"), np.frombuffer(row["groups"], "<u2")
                cut = _split(words, count)
                parts = [(i, cut[i], cut[i + 1]) for i in range(count) if cut[i] < cut[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, _ in parts], pa.int32()), pa.array([row["block"]] * len(parts), pa.int64()), *(pa.array([_planes(x[a:b]) for _, a, b in parts], pa.binary()) for x in (words, times, group))],
                    names=["bucket", "block", "words", "times", "groups"],
                )

    return run


_TOTALS = "block bigint, bucket int, totals binary, ranks binary, n_types bigint, n_tokens bigint, singles binary, top array<struct<word:bigint,times:bigint>>"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, table in blocks.runs(batches, "bucket"):
        asked = table.column("block").to_pylist()
        parts = [_whole(x, "<u8") for x in table.column("words").to_pylist()]
        times = np.concatenate([_whole(x, "<u4") for x in table.column("times").to_pylist()])
        groups = np.concatenate([_whole(x, "<u2") for x in table.column("groups").to_pylist()])
        words, first, inverse = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        total = np.bincount(inverse, times, minlength=len(words)).astype(np.int64)
        singles = np.bincount(groups[first[total == 1]], minlength=GROUPS + 1).astype("<i8")
        best = np.lexsort((words, -total))[:TOP]
        top = [{"word": int(words[i].view(np.int64)), "times": int(total[i])} for i in best if total[i] > 0 and words[i] != _END]
        end = np.cumsum([len(p) for p in parts])
        answers, ranks = total[inverse].astype("<u8"), inverse.astype("<u4")
        for i in range(0, len(parts), 64):
            some = range(i, min(i + 64, len(parts)))
            head = [j == 0 for j in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([asked[j] for j in some], pa.int64()),
                    pa.array([bucket for _ in some], pa.int32()),
                    pa.array([_planes(answers[end[j] - len(parts[j]) : end[j]]) for j in some], pa.binary()),
                    pa.array([_rising(ranks[end[j] - len(parts[j]) : end[j]]) for j in some], pa.binary()),
                    pa.array([int((total > 0).sum()) if h else 0 for h in head], pa.int64()),
                    pa.array([int(total.sum()) if h else 0 for h in head], pa.int64()),
                    pa.array([singles.tobytes() if h else None for h in head], pa.binary()),
                    pa.array([top if h else [] for h in head], pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())]))),
                ],
                names=["block", "bucket", "totals", "ranks", "n_types", "n_tokens", "singles", "top"],
            )


def _units(hashes: np.ndarray, group: np.ndarray, top: np.ndarray) -> np.ndarray:
    """0..len(top)-1: a frequent word; TOP + g: a suffix group; TOP + GROUPS: the end."""
    unit = group.astype(np.int64) + TOP
    if len(top):
        at = np.searchsorted(top, hashes)
        at[at == len(top)] = 0
        unit = np.where(top[at] == hashes, at, unit)
    return unit


UNITS = TOP + GROUPS + 1


def _pairs(shared, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(UNITS * UNITS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                unit = _units(_whole(row["words"], "<u8"), np.frombuffer(row["groups"], "<u2"), shared.value)
                before, now = _trained(row, unit, UNITS - 1)
                counts += np.bincount(before * UNITS + now, minlength=len(counts))
        code = np.flatnonzero(counts)
        if len(code):
            cut = np.searchsorted(code, np.linspace(0, len(counts), slices + 1))
            parts = [(i, cut[i], cut[i + 1]) for i in range(slices) if cut[i] < cut[i + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in parts], pa.int32()), *(pa.array([x[a:b].tobytes() for _, a, b in parts], pa.binary()) for x in (code.astype("<u4"), counts[code].astype("<u8")))], names=["slice", "codes", "times"])

    return run


def _add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, table in blocks.runs(batches, "slice"):
        code = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("codes").to_pylist()])
        times = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("times").to_pylist()])
        codes, inverse = np.unique(code, return_inverse=True)
        total = np.bincount(inverse, times, minlength=len(codes)).astype("<u8")
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([codes.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["slice", "codes", "times"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit; the last unit (the end) keeps class 0 to itself.

    The most frequent units open the classes; then each unit in turn, and again until nothing moves, goes to the
    class that raises the bigram likelihood of the units placed so far most,
    sum n(c, d) log n(c, d) - sum n(c) log n(c) - sum n(d) log n(d).
    """
    n = len(pairs)
    seen = pairs.sum(0) + pairs.sum(1)
    order = [int(u) for u in np.argsort(-seen, kind="stable") if u != n - 1]
    label = np.full(n, -1)
    label[n - 1] = 0
    for i, u in enumerate(order[: classes - 1]):
        label[u] = 1 + i
    m = np.zeros((classes, classes))
    placed = np.flatnonzero(label >= 0)
    np.add.at(m, (label[placed][:, None], label[placed][None, :]), pairs[np.ix_(placed, placed)])
    for _ in range(rounds + 1):
        moved = 0
        for u in order:
            if not seen[u]:
                label[u] = max(label[u], 1)
                continue
            old, own = label[u], float(pairs[u, u])
            out = np.bincount(label + 1, pairs[u], minlength=classes + 1)[1:]
            into = np.bincount(label + 1, pairs[:, u], minlength=classes + 1)[1:]
            if old >= 0:
                out[old] -= own
                into[old] -= own
                m[old] -= out
                m[:, old] -= into
                m[old, old] -= own
            f = _xlogx(m)
            row, column = _xlogx(m + out[None, :]) - f, _xlogx(m + into[:, None]) - f
            d = np.arange(classes)
            inner = _xlogx(m[d, d] + out + into + own) - f[d, d]
            left, right = m.sum(1), m.sum(0)
            gain = row.sum(1) - row[d, d] + column.sum(0) - column[d, d] + inner
            gain -= _xlogx(left + out.sum() + own) - _xlogx(left) + _xlogx(right + into.sum() + own) - _xlogx(right)
            gain[0] = -np.inf
            new = old if old >= 0 and gain[old] >= gain.max() - 1e-9 else int(gain.argmax())
            label[u] = new
            m[new] += out
            m[:, new] += into
            m[new, new] += own
            moved += new != old
        if not moved:
            break
    return label


def class_counts(pairs: np.ndarray, label: np.ndarray) -> np.ndarray:
    m = np.zeros((CLASSES, CLASSES))
    np.add.at(m, (label[:, None], label[None, :]), pairs)
    return m


def rates(m: np.ndarray, group_label: np.ndarray, singles: np.ndarray) -> dict:
    """Base-10 log transitions, class totals and unseen shares."""
    total = m.sum(0)
    prior = (total + 0.1) / (total.sum() + 0.1 * CLASSES)
    move = (m + BACK_OFF * prior[None, :]) / (m.sum(1, keepdims=True) + BACK_OFF)
    once = np.bincount(group_label, singles, minlength=CLASSES)
    unseen = np.minimum((once + 0.5) / (total + 1.0), 0.95)
    unseen[0] = 0.0 if total[0] else 0.5
    return {"move": np.log10(move), "total": total, "unseen": unseen}


def build_model(pairs: np.ndarray, singles: np.ndarray, top: np.ndarray) -> dict:
    """The opening: classes of the frequent words and the suffix groups, and the rates they give."""
    label = exchange(pairs.astype(np.float64))
    m = class_counts(pairs, label)
    return {"top": top, "label": label, "counts": m} | rates(m, label[TOP:], singles)


# ---------------------------------------------------------------- distributed exchange


def likelihood(m: np.ndarray) -> float:
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def gains(m: np.ndarray, at: np.ndarray, code: np.ndarray, times: np.ndarray, own: np.ndarray, old: np.ndarray) -> np.ndarray:
    """(unit, class): what the likelihood gains by placing the unit there, once it is taken out of its class.

    Sparse counts: unit `at` (ascending) is followed `times` by class `code`, or follows class `code` - classes;
    `own` counts a unit after itself, which is in no other count.  Most units have a few small counts, so terms are
    looked up in tables of small steps and summed over the counts that are there.
    """
    k, n = len(m), len(own)
    f = _xlogx
    sides = np.vstack([m.T, m])  # by code: what joins the counts of each class
    flat = f(sides)
    small = f(sides[None] + np.arange(1, 9)[:, None, None]) - flat
    rise = np.zeros((n, k))
    for i in range(0, len(at), 1 << 13):
        c, t, u = (x[i : i + (1 << 13)] for x in (code, times, at))
        x = small[np.minimum(t, 8) - 1, c]
        many = np.flatnonzero(t > 8)
        x[many] = f(sides[c[many]] + t[many, None]) - flat[c[many]]
        first = np.flatnonzero(blocks.run_starts(u))
        rise[u[first]] += np.add.reduceat(x, first)
    both = np.zeros((n, 2 * k))
    both[at, code] = times
    out, into = both[:, :k], both[:, k:]
    i, d = np.arange(n), np.arange(k)
    diagonal, left, right = m[d, d], m.sum(1), m.sum(0)

    # pairs with the class itself: only where the unit has counts on a class, or follows itself
    c = code % k
    once = (code < k) | (both[at, c] == 0)
    some = once & (own[at] == 0)
    u, c = at[some], c[some]
    x, y, z = diagonal[c], out[u, c], into[u, c]
    rise[u, c] += f(x + y + z) - f(x + y) - f(x + z) + f(x)
    u = np.flatnonzero(own)
    x, y, z = diagonal[None], out[u], into[u]
    rise[u] += f(x + y + z + own[u, None]) - f(x + y) - f(x + z) + f(x)

    # pairs with the class that the unit has left
    for row, mine, other in ((m.T, out, into), (m, into, out)):
        u = np.flatnonzero(mine[i, old])
        x, step = row[old[u]], mine[u, old[u], None]
        less = np.maximum(x - other[u], 0.0)
        rise[u] += f(less + step) - f(less) - f(x + step) + f(x)
    s, e = out.sum(1) + own, into.sum(1) + own
    for total, step in ((left, s), (right, e)):
        table = f(total + np.arange(256)[:, None]) - f(total)
        rise -= table[np.minimum(step, 255).astype(np.int64)]
        u = np.flatnonzero(step > 255)
        rise[u] += table[255] - (f(total + step[u, None]) - f(total))

    # staying: the same, with the unit's own counts taken out of its class
    cut = lambda x, y: f(x) - f(np.maximum(x - y, 0.0))
    o, c = old[at], code % k
    apart = o != c
    x = np.where(code < k, m[o, c], m[c, o])[apart]
    stay = np.bincount(at[apart], cut(x, times[apart]), minlength=n)
    stay += cut(diagonal[old], out[i, old] + into[i, old] + own) - cut(left[old], s) - cut(right[old], e)
    rise[i, old] = stay
    return rise


def move_units(m: np.ndarray, at: np.ndarray, code: np.ndarray, times: np.ndarray, own: np.ndarray, old: np.ndarray, step: int = 2048) -> np.ndarray:
    """New class of each unit; class 0 is the end's."""
    new = old.copy()
    for a in range(0, len(own), step):
        b = min(a + step, len(own))
        i, j = np.searchsorted(at, [a, b])
        gain = gains(m, at[i:j] - a, code[i:j], times[i:j], own[a:b], old[a:b])
        gain[:, 0] = -np.inf
        best = gain.argmax(1)
        n = np.arange(b - a)
        seen = np.bincount(at[i:j] - a, minlength=b - a) > 0
        new[a:b] = np.where(seen & (gain[n, best] > gain[n, old[a:b]] + 1e-9), best, old[a:b])
    return new


def _replies(table: pa.Table, column: str) -> list[tuple[int, bytes]]:
    """What the buckets answered to a block, in the order of its hashes."""
    return sorted((k, x) for k, x in zip(table.column("bucket").to_pylist(), table.column(column).to_pylist()) if x is not None)


def _known(table: pa.Table, column: str, dtype: str) -> np.ndarray:
    return np.concatenate([_whole(x, dtype) for _, x in _replies(table, column)] or [np.zeros(0, dtype)])


def _tell(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(answers, the block's own rows)."""
    first = int((table.column("bucket").to_numpy() >= 0).sum())
    return table.slice(0, first), table.slice(first)


_LOCAL = np.uint64(32)  # bits of a unit's number in its bucket


def _unit_keys(answers: pa.Table, group: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit of each word, whether that is the word itself, its total).

    A unit is a bucket and a number in it: numbers below `GROUPS` are suffix groups, dealt over the buckets, the others
    are ranks of words.
    """
    totals = _known(answers, "totals", "<u8")
    place = [(np.uint64(k) << _LOCAL) + np.uint64(GROUPS) + _risen(x, "<u4").astype(np.uint64) for k, x in _replies(answers, "ranks")]
    own = (totals >= LEAST) | (group == GROUPS)
    g = group.astype(np.uint64)
    return np.where(own, np.concatenate(place), (g % np.uint64(buckets) << _LOCAL) + g), own, totals


def _coder(shared, buckets: int):
    """A block's training text as numbers of its units, and where these units start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, label = shared.value
        for block, table in blocks.runs(batches, "block"):
            answers, mine = _tell(table)
            row = {c: mine.column(c)[0].as_py() for c in ("words", "groups", "held", "counts", "stream")}
            words, group = _whole(row["words"], "<u8"), np.frombuffer(row["groups"], "<u2")
            keys, own, _ = _unit_keys(answers, group, buckets)
            units, unit = np.unique(keys, return_inverse=True)
            first = np.where(own, label[_units(words, group, top)], label[TOP + group.astype(np.int64)])
            start = np.empty(len(units), "u1")
            start[unit] = first
            _, now = _trained(row, unit, 0)
            end = int(unit[group == GROUPS][0])  # every text has its end
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([end], pa.int64()), *(pa.array([x], pa.binary()) for x in (_rising(units), _planes(now.astype("<u4")), start.tobytes()))],
                names=["block", "text_end", "units", "stream", "classes"],
            )

    return run


def _distinct(key: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, times) of keys below `width` * `size`; counted in slices of `RANGE` units where these are few."""
    if size > 8 * RANGE:
        return np.unique(key, return_counts=True)
    found = []
    for lo in range(0, max(size, 1), RANGE):
        some = key if size <= RANGE else key[(key >= lo * width) & (key < (lo + RANGE) * width)]
        times = np.bincount(some - lo * width, minlength=1)
        at = np.flatnonzero(times)
        found.append((at + lo * width, times[at]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


_SENT = "bucket int, block bigint, units binary, classes binary, own binary, n binary, codes binary, times binary"


def _statistics(count: int):
    """Classes before and after the units of each block, to the units' buckets; one row a task has the class bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        names = ["bucket", "block", "units", "classes", "own", "n", "codes", "times"]
        m = np.zeros(CLASSES * CLASSES, "<i8")
        for block, table in blocks.runs(batches, "block"):
            answers, mine = _tell(table)
            if not mine.num_rows:
                continue
            units, start = _risen(mine.column("units")[0].as_py(), "<u8"), np.frombuffer(mine.column("classes")[0].as_py(), "u1")
            label = _known(answers, "classes", "u1") if answers.num_rows else start
            stream = _whole(mine.column("stream")[0].as_py(), "<u4").astype(np.int64)
            before = np.concatenate([mine.column("text_end").to_numpy(), stream[:-1]])[: len(stream)]
            a, b = label[before].astype(np.int64), label[stream].astype(np.int64)
            m += np.bincount(a * CLASSES + b, minlength=len(m))
            other = stream != before
            own = np.bincount(stream[~other], minlength=len(units))
            key, times = _distinct(np.concatenate([before[other] * (2 * CLASSES) + b[other], stream[other] * (2 * CLASSES) + CLASSES + a[other]]), 2 * CLASSES, len(units))
            n = np.bincount(key // (2 * CLASSES), minlength=len(units))
            end = np.concatenate([[0], np.cumsum(n)])
            cut = np.searchsorted(units, np.arange(count + 1, dtype=np.uint64) << _LOCAL)
            parts = [(i, cut[i], cut[i + 1]) for i in range(count) if cut[i] < cut[i + 1]]
            code = (key % (2 * CLASSES)).astype("u1")
            by_unit = [[_rising(units[i:j].astype("<u4")) for _, i, j in parts]]
            by_unit += [[_planes(x[i:j]) for _, i, j in parts] for x in (label, own.astype("<u4"), n.astype("u1"))]
            by_entry = [[_planes(x[end[i] : end[j]]) for _, i, j in parts] for x in (code, times.astype("<u4"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([[i for i, _, _ in parts], [block] * len(parts), *by_unit, *by_entry], kinds)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([-1, -1, None, None, None, None, None, m.tobytes()], kinds)], names=names)

    return run


_MOVED = "block bigint, bucket int, classes binary, moved bigint, unit_count bigint, groups binary"


def _mover(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, table in blocks.runs(batches, "bucket"):
            asked = table.column("block").to_pylist()
            get = lambda c, t: [_whole(x, t) for x in table.column(c).to_pylist()]
            parts = [_risen(x, "<u4") for x in table.column("units").to_pylist()]
            inverse = np.concatenate(parts).astype(np.int64)
            here = np.bincount(inverse) > 0
            units, inverse = np.flatnonzero(here), (np.cumsum(here) - 1)[inverse]
            old = np.empty(len(units), np.int64)
            old[inverse] = np.concatenate(get("classes", "u1"))
            own = np.bincount(inverse, np.concatenate(get("own", "<u4")), minlength=len(units)).astype(np.int64)
            key = np.repeat(inverse, np.concatenate(get("n", "u1"))) * (2 * CLASSES) + np.concatenate(get("codes", "u1"))
            key, where = np.unique(key, return_inverse=True)
            times = np.bincount(where, np.concatenate(get("times", "<u4")), minlength=len(key)).astype(np.int64)
            new = move_units(shared.value, key // (2 * CLASSES), key % (2 * CLASSES), times, own, old)
            new[old == 0] = 0  # the end
            groups = np.full(GROUPS, 255, "u1")
            groups[units[units < GROUPS]] = new[units < GROUPS]
            end, told = np.cumsum([len(p) for p in parts]), new.astype("u1")[inverse]
            for i in range(0, len(parts), 64):
                some = range(i, min(i + 64, len(parts)))
                head = [j == 0 for j in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([asked[j] for j in some], pa.int64()),
                        pa.array([bucket for _ in some], pa.int32()),
                        pa.array([told[end[j] - len(parts[j]) : end[j]].tobytes() for j in some], pa.binary()),
                        pa.array([int((new != old).sum()) if h else 0 for h in head], pa.int64()),
                        pa.array([len(units) if h else 0 for h in head], pa.int64()),
                        pa.array([groups.tobytes() if h else None for h in head], pa.binary()),
                    ],
                    names=["block", "bucket", "classes", "moved", "unit_count", "groups"],
                )

    return run


def _spread(count: int, spark: SparkSession) -> int:
    """Partitions for `count` blocks: some blocks in each, and more of them as the corpus grows."""
    return max(1, min(count, max(4 * blocks.partitions(spark), count // 16)))


def _meet(answers: DataFrame, own: DataFrame, count: int) -> DataFrame:
    """Each block's answers, then its own rows (bucket -1)."""
    met = answers.unionByName(own.withColumn("bucket", F.lit(-1)), allowMissingColumns=True)
    return met.repartition(_spread(count, own.sparkSession), "block").sortWithinPartitions("block", F.desc("bucket"))


def exchange_all(coded: DataFrame, group_label: np.ndarray, count: int, buckets: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(class bigrams, classes of the suffix groups, answers to the blocks) of the best round."""
    spark = coded.sparkSession
    now, best = coded.select("block", F.lit(0).alias("bucket"), "classes"), None
    start = now
    for done in range(rounds + 1):
        met = _meet(now, coded, count) if done else coded.withColumn("bucket", F.lit(-1)).sortWithinPartitions("block")
        sent = blocks.materialize(met.mapInArrow(_statistics(buckets), _SENT), "lm-sent")
        m = np.zeros(CLASSES * CLASSES, np.int64)
        for row in sent.where("bucket < 0").select("times").toLocalIterator():
            m += np.frombuffer(row[0], "<i8")
        m = m.reshape(CLASSES, CLASSES).astype(np.float64)
        rise = likelihood(m) - (likelihood(best[0]) if best else -np.inf)
        if rise <= 0:
            blocks.drop_table(sent)
            blocks.drop_table(now)
            break
        if best and best[2] is not start:
            blocks.drop_table(best[2])
        best, enough = (m, group_label, now), rise < TOLERANCE * m.sum()
        if done < rounds and not enough:
            shared = spark.sparkContext.broadcast(m)
            given = sent.where("bucket >= 0").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
            now = blocks.materialize(given.mapInArrow(_mover(shared), _MOVED), "lm-classes")
            heads = now.where("groups IS NOT NULL").select("groups", "moved", "unit_count").collect()
            group_label = group_label.copy()
            for row in heads:
                found = np.frombuffer(row["groups"], "u1")
                group_label[found < 255] = found[found < 255]
            moved = sum(r["moved"] for r in heads)
        blocks.drop_table(sent)
        blocks.forget_shuffles(spark)
        if enough:
            break
        if done < rounds and not moved:
            blocks.drop_table(now)
            break
    blocks.forget_shuffles(spark)
    if best[2] is not start:
        blocks.drop_table(coded)
    return best


def _scorer(shared, buckets: int, n_tokens: int, n_types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in blocks.runs(batches, "block"):
            answers, mine = _tell(table)
            row = {c: mine.column(c)[0].as_py() for c in ("groups", "counts", "stream")}
            n, known, base, own = _score_block(shared.value, row, answers, buckets, n_tokens, n_types)
            ids = mine.column("ids").combine_chunks().flatten()
            held = np.frombuffer(mine.column("held")[0].as_py(), bool)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), n_tokens), pa.int64()), pa.array(base), pa.array(own), pa.array(10.0 ** np.minimum(-own / n, 300.0))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return run


def _score_block(model: dict, row: dict, answers: pa.Table, buckets: int, n_tokens: int, n_types: int) -> tuple[np.ndarray, ...]:
    group, n = np.frombuffer(row["groups"], "<u2"), np.frombuffer(row["counts"], "<u4")
    keys, _, totals = _unit_keys(answers, group, buckets)
    c = totals.astype(np.float64)
    base = np.log10((c + 0.1) / (n_tokens + 0.1 * (n_types + 1)))
    _, unit = np.unique(keys, return_inverse=True)
    label = _known(answers, "classes", "u1")[unit].astype(np.int64)
    share = model["unseen"][label]
    emit = np.minimum(np.log10(np.where(c > 0, (1 - share) * c / np.maximum(model["total"][label], 1.0), share)), 0.0)
    stream = _whole(row["stream"], "<u4")
    first = np.cumsum(n.astype(np.int64)) - n
    now = label[stream]
    before = np.concatenate([[0], now[:-1]])
    before[first] = 0
    add = lambda x: np.add.reduceat(x, first)  # noqa: E731  every text has its end token
    return n, add((c > 0)[stream].astype(np.int64)), add(base[stream]), add(model["move"][before, now] + emit[stream])


def score_corpus(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Scores of documents with doc_id and text; the fold whose crc32 remainder is 0 does not train."""
    spark = docs.sparkSession
    parts = blocks.partitions(spark)
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    given = docs.select("doc_id", crf.held_out("doc_id", folds).alias("held_out"), "text")
    coded = blocks.materialize(given.mapInArrow(_encode, _coded_schema(key)), "lm-coded")
    r = coded.agg(F.count("*"), F.sum("n_words")).first()
    count, sent_bytes = int(r[0]), 14 * int(r[1] or 0)
    if not count:
        return spark.createDataFrame([], schema)
    buckets = max(parts, -(-sent_bytes // BUCKET_BYTES))

    sent = coded.select("block", "words", "times", "groups").mapInArrow(_requests(buckets), "bucket int, block bigint, words binary, times binary, groups binary")
    answers = blocks.materialize(sent.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_answers, _TOTALS), "lm-totals")
    blocks.forget_shuffles(spark)

    heads = answers.where("singles IS NOT NULL")
    r = heads.agg(F.sum("n_types"), F.sum("n_tokens")).first()
    n_types, n_tokens = int(r[0] or 0), int(r[1] or 0)
    best = heads.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("times"), "word").limit(TOP).collect()
    top = np.sort(np.array([x[0] for x in best], np.int64).view(np.uint64))
    place = F.posexplode(F.expr(f"transform(sequence(0, {GROUPS}), i -> conv(hex(reverse(substring(singles, i * 8 + 1, 8))), 16, 10))"))
    singles = np.zeros(GROUPS + 1)
    for row in heads.select(place.alias("g", "n")).groupBy("g").agg(F.sum(F.col("n").cast("bigint"))).collect():
        singles[row[0]] = row[1]

    shared = spark.sparkContext.broadcast(top)
    slices = min(parts, UNITS)
    counted = coded.select("words", "groups", "held", "counts", "stream").mapInArrow(_pairs(shared, slices), "slice int, codes binary, times binary")
    added = counted.repartitionById(slices, F.col("slice")).sortWithinPartitions("slice").mapInArrow(_add_pairs, "slice int, codes binary, times binary")
    pairs = np.zeros(UNITS * UNITS)
    for row in added.collect():  # at most UNITS ** 2 counts
        pairs[np.frombuffer(row["codes"], "<u4")] = np.frombuffer(row["times"], "<u8")
    del counted, added
    opening = build_model(pairs.reshape(UNITS, UNITS), singles, top)

    replies = answers.select("block", "bucket", "totals", "ranks")
    start = spark.sparkContext.broadcast((top, opening["label"]))
    own = coded.select("block", "words", "groups", "held", "counts", "stream")
    units = blocks.materialize(_meet(replies, own, count).mapInArrow(_coder(start, buckets), "block bigint, text_end bigint, units binary, stream binary, classes binary"), "lm-units")
    blocks.forget_shuffles(spark)
    m, group_label, classes = exchange_all(units, opening["label"][TOP : TOP + GROUPS], count, buckets)
    model = spark.sparkContext.broadcast(rates(m, np.append(group_label, 0), singles))

    told = replies.unionByName(classes.select("block", "bucket", "classes"), allowMissingColumns=True)
    return _meet(told, coded.select("block", "ids", "held", "counts", "groups", "stream"), count).mapInArrow(_scorer(model, buckets, n_tokens, n_types), schema)


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
