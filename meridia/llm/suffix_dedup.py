"""Exact substring deduplication by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte covered by a `LENGTH`-byte string that also starts earlier (smaller doc_id, or the same document and
an earlier start) is removed.  A transform of the whole corpus cannot be built in one place, so strings that
could be equal are brought together first:

1. Each window of LENGTH bytes is assigned to its anchor, the leftmost k-gram of least hash in it.  Equal windows have
   equal anchors at equal offsets.  The consecutive windows of one anchor are a unit; units travel as hashes,
   packed, to buckets by anchor hash.  Units of equal content are one: all but the earliest are wholly covered.
2. Different units with one anchor may share some windows.  Their texts are cut from the documents and go to
   buckets by anchor; an anchor with very many different units (a passage in ever new contexts) is split by
   offset and by the hash of the bytes that all windows of an offset range have in common.
3. A bucket builds the Burrows-Wheeler transform of its unit texts and derives common prefixes by increasing
   value: level by level, positions whose common prefix with the row before has just that value are extended backward
   through the transform, and the expansion stops at LENGTH.  Rows between what is left undivided share LENGTH
   bytes; all but the earliest start among them are covered.
4. Documents meet their ranges, and the bytes left are digested.

Ranges, units and texts are dealt by document block or by hash and never collected.  Documents are identified by a
hash of id and text.  Defined results: a null text is an empty one; shorter texts than LENGTH keep all; the rows that
share an id are one document for the order, so equal rows keep or lose the same bytes; a null id is before all others;
an empty table gives no rows; ids are integers, or cast to them; only `doc_id` and `text` are read, so other columns
may have any names.  A text is held whole, with about 40 bytes a byte, in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks

LENGTH = 100
GRAM = 32
HOT = 4096  # different units of an anchor from which its windows are split further
SPLIT = 16  # offsets of a split range
BATCH = 1 << 20  # bytes of text in one transform
FLUSH = 150_000  # units held in a task
CHUNK = 1 << 20  # text bytes whose windows are hashed at a time
_NO_ID = -(1 << 63)

# ---------------------------------------------------------------- the transform


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Cyclic suffixes in the order of their first `depth` symbols (ties in any order), by prefix doubling."""
    n = len(text)
    place = np.uint64(max(1, (n - 1).bit_length()))
    wide = text.astype(np.uint64)
    known = 4 if 36 + int(place) <= 64 else 2
    key = np.zeros(n, np.uint64)
    for j in range(known):
        key = (key << np.uint64(9)) | np.roll(wide, -j)
    packed = 3 * int(place) + 2 <= 64  # two ranks and a place fit into one word: a plain sort does
    index = np.arange(n, dtype=np.uint64)
    while True:
        if packed or known <= 4:
            both = np.sort((key << place) | index)
            order = (both & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
            ordered = both >> place
        else:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
        if known >= depth:
            return order
        border = blocks.run_starts(ordered)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(border).astype(np.uint64)
        if border.all():
            return order
        key = (rank << (place + np.uint64(1))) | np.roll(rank, -known) if packed else (rank << np.uint64(32)) | np.roll(rank, -known)
        known *= 2


def prefix_groups(bwt: np.ndarray, length: int) -> np.ndarray:
    """Group number of each row of the transform: rows of a group share `length` symbols.

    A border between two rows says that their common prefix is shorter.  Extending backward by symbol c
    takes the rows of an interval whose transform symbol is c to one interval of rows that begin with c; so a border
    at row p becomes, for every c on both its sides, a border at the row of the next c at or after p.  Level by
    level, the borders of common prefix v give those of v + 1 (breadth first) until `length`.
    Few borders are pushed through each symbol's rows; while there are many, all undivided rows are tested at once.
    """
    n = len(bwt)
    order = np.argsort(bwt, kind="stable")  # row q of the next level comes from row order[q]
    symbol = bwt[order]
    border = blocks.run_starts(symbol)
    new = np.flatnonzero(border)
    edges = np.append(new, n)
    rows_of = [order[a:b] for a, b in zip(edges, edges[1:])]
    open_rows = None
    for _ in range(1, length):
        if not len(new):
            break
        if len(new) * len(rows_of) * 4 > n:
            if open_rows is None:
                open_rows = np.flatnonzero(~border)
            else:
                open_rows = open_rows[~border[open_rows]]
            mark = np.zeros(n, np.int32)
            mark[new] = 1
            np.cumsum(mark, out=mark)
            new = open_rows[mark[order[open_rows]] > mark[order[open_rows - 1]]]
        else:
            found = []
            for first, rows in zip(edges, rows_of):
                at = np.searchsorted(rows, new)
                at = at[(at > 0) & (at < len(rows))]
                if len(at):
                    found.append(first + at)
            if not found:
                break
            new = np.unique(np.concatenate(found))
            new = new[~border[new]]
        border[new] = True
    return np.cumsum(border) - 1


def joined_windows(data: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the windows of `length` bytes of texts laid end to end; equal numbers mean equal windows."""
    at = np.arange(len(data)) + np.repeat(np.arange(len(size)), size)
    joined = np.zeros(len(data) + len(size), np.uint16)
    joined[at] = data
    joined[at] += 1
    order = suffix_order(joined, length)
    group = np.empty(len(joined), np.int64)
    group[order] = prefix_groups(joined[order - 1], length)
    count = np.maximum(size - length + 1, 0)
    first = np.cumsum(size + 1) - (size + 1)
    return group[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]


# ---------------------------------------------------------------- units


def units(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, content hash, first window's start, windows, offset of the anchor) of all units."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    rolling = blocks.RollingHash(data)
    hashes = rolling.windows(gram)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    key = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    # key[s] is now the anchor of the window that starts at s
    size = np.diff(bounds)
    row = np.flatnonzero(size >= length)
    count = size[row] - length + 1
    start = np.repeat(bounds[:-1][row] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    anchor = (key[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(blocks.run_starts(anchor))
    n = np.diff(np.append(first, len(anchor)))
    at, mark = start[first], anchor[first]
    own = np.searchsorted(bounds, at, "right") - 1
    # anchors have small hashes: mixed again, they spread evenly over ranges
    return own, blocks.mix(hashes[mark] ^ np.uint64(0x6A09E667F3BCC908)), rolling.of(at, at + n - 1 + length), at - bounds[own], n, mark - at


_RANGES = np.dtype([("key", "<u8"), ("start", "<u4"), ("size", "<u4")])
_UNITS = np.dtype([("key", "<u8"), ("doc", "<i8"), ("hash", "<u8"), ("start", "<u4"), ("count", "<u2"), ("offset", "u1"), ("hot", "u1")])
_ROWS = "block int, kind int, payload binary"


def _by_block(block: np.ndarray, kind: int, rows: np.ndarray) -> pa.RecordBatch | None:
    if not len(rows):
        return None
    order = np.argsort(block, kind="stable")
    block, rows = block[order], rows[order]
    cut = np.append(np.flatnonzero(blocks.run_starts(block)), len(block))
    return pa.RecordBatch.from_arrays(
        [pa.array(block[cut[:-1]], pa.int32()), pa.array(np.full(len(cut) - 1, kind), pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
        names=["block", "kind", "payload"],
    )


def _records(key, start, size) -> np.ndarray:
    out = np.empty(len(key), _RANGES)
    out["key"], out["start"], out["size"] = key, start, size
    return out


_FIELDS = "bucket int, hashes binary, contents binary, places binary, starts binary, counts binary, offsets binary, keys binary, docs binary, blocks binary"


def _send_units(buckets: int, length: int, gram: int):
    """Distinct units of some megabytes of text, packed by bucket."""

    def pack(held: list[tuple]) -> pa.RecordBatch:
        h, content, key, doc, block, start, count, offset = (np.concatenate(x) for x in zip(*held))
        h, content = h >> np.uint64(16), content & np.uint64((1 << 48) - 1)
        order = np.lexsort((start, doc, content, h))
        h, content, key, doc, block, start, count, offset = (x[order] for x in (h, content, key, doc, block, start, count, offset))
        fresh = blocks.run_starts(h, content)
        whole = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
        later = ~fresh & ((doc != doc[whole]) | (start != start[whole]))
        # a later copy is remembered without its content: bucket stage 1 only needs the earliest
        out = [[] for _ in range(10)]
        lost = np.flatnonzero(later)
        if len(lost):
            self_made = _by_block(block[lost], 0, _records(key[lost], start[lost], count[lost].astype(np.int64) + length - 1))
            for b, p in zip(self_made.column("block").to_pylist(), self_made.column("payload").to_pylist()):
                for col, value in zip(out, (int(b) % buckets, None, None, None, None, None, None, None, p, np.array([b], "<i4").tobytes())):
                    col.append(value)
        keep = np.flatnonzero(~later)
        h, content, key, doc, block, start, count, offset = (x[keep] for x in (h, content, key, doc, block, start, count, offset))
        cut = np.concatenate([[0], np.searchsorted(h, np.array([(i << 48) // buckets for i in range(1, buckets)], np.uint64)), [len(h)]])
        for i in range(buckets):
            a, b = cut[i], cut[i + 1]
            if a == b:
                continue
            _, first, place = np.unique(key[a:b], return_index=True, return_inverse=True)
            step = np.diff(h[a:b], prepend=np.uint64(0))
            c = content[a:b]
            row = (
                i,
                step[:1].tobytes() + (step[1:].astype("<u4").tobytes() if (step[1:] < 1 << 32).all() else step[1:].tobytes()),
                (c & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (c >> np.uint64(32)).astype("<u2").tobytes(),
                place.astype("<u2" if len(first) <= 1 << 16 else "<u4").tobytes(),
                start[a:b].astype("<u4").tobytes(),
                count[a:b].astype("u1").tobytes(),
                offset[a:b].astype("u1").tobytes(),
                key[a:b][first].tobytes(),
                doc[a:b][first].tobytes(),
                block[a:b][first].astype("<i4").tobytes(),
            )
            for col, value in zip(out, row):
                col.append(value)
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in blocks.chunks(batches, limit=CHUNK):
            data, bounds = blocks.text_buffer(batch.column("text"))
            row, h, content, start, count, offset = units(data, bounds, length, gram)
            key, doc, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc", "block"))
            held.append((h, content, key.view(np.uint64)[row], doc[row], block[row], start.astype(np.uint32), count.astype(np.uint8), offset.astype(np.uint8)))
            total += len(row)
            if total > FLUSH:
                yield pack(held)
                held, total = [], 0
        if total:
            yield pack(held)

    return run


def _meet_units(length: int):
    """Per anchor: ranges of later copies (kind 0), and the distinct units whose texts must be compared (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in blocks.runs(batches, "bucket"):
            parts: list[list] = [[] for _ in range(8)]
            for row in zip(*(table.column(f.split()[0]).to_pylist() for f in _FIELDS.split(", ")[1:])):
                steps, contents, places, starts, counts, offsets, keys, docs, home = row
                if steps is None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(home, "<i4")), pa.array([0], pa.int32()), pa.array([docs], pa.binary())], names=["block", "kind", "payload"])
                    continue
                own = len(keys) // 8
                place = np.frombuffer(places, "<u2" if own <= 1 << 16 else "<u4")
                n = len(place)
                step = np.concatenate([np.frombuffer(steps[:8], "<u8"), np.frombuffer(steps[8:], "<u4" if len(steps) == 8 + 4 * (n - 1) else "<u8").astype(np.uint64)])
                content = np.frombuffer(contents[: 4 * n], "<u4").astype(np.uint64) | (np.frombuffer(contents[4 * n :], "<u2").astype(np.uint64) << np.uint64(32))
                values = (
                    np.cumsum(step), content, np.frombuffer(keys, "<u8")[place], np.frombuffer(docs, "<i8")[place], np.frombuffer(home, "<i4")[place],
                    np.frombuffer(starts, "<u4"), np.frombuffer(counts, "u1"), np.frombuffer(offsets, "u1"),
                )
                for p, v in zip(parts, values):
                    p.append(v)
            if not parts[0]:
                continue
            h, content, key, doc, block, start, count, offset = (np.concatenate(p) for p in parts)
            order = np.lexsort((start, doc, content, h))
            h, content, key, doc, block, start, count, offset = (x[order] for x in (h, content, key, doc, block, start, count, offset))
            fresh = blocks.run_starts(h, content)
            whole = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
            lost = np.flatnonzero(~fresh & ((doc != doc[whole]) | (start != start[whole])))
            made = _by_block(block[lost], 0, _records(key[lost], start[lost], count[lost].astype(np.int64) + length - 1))
            if made is not None:
                yield made
            # of equal units at one place (equal rows) all take part, so that all lose the same
            heads = np.flatnonzero(fresh)
            group = np.cumsum(blocks.run_starts(h[heads])) - 1
            kinds = np.bincount(group, minlength=1)
            of = np.full(len(h), -1)
            of[heads] = group
            of = np.maximum.accumulate(of)
            take = np.ones(len(h), bool)
            take[lost] = False
            take &= kinds[of] > 1
            take = np.flatnonzero(take)
            out = np.empty(len(take), _UNITS)
            for name, v in (("key", key), ("doc", doc), ("hash", h), ("start", start), ("count", count), ("offset", offset)):
                out[name] = v[take]
            out["hot"] = kinds[of[take]] > HOT
            made = _by_block(block[take], 1, out)
            if made is not None:
                yield made

    return run


def _cut_texts(buckets: int, length: int):
    """Unit texts of a block's documents, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks.runs(batches, "block"):
            payloads = [x for x in table.column("payload").to_pylist() if x is not None]
            if not payloads:
                continue
            want = np.concatenate([np.frombuffer(x, _UNITS) for x in payloads])
            docs = table.slice(len(payloads))
            keys = docs.column("key").to_numpy().view(np.uint64)
            data, bounds = blocks.text_buffer(docs.column("text").combine_chunks())
            order = np.argsort(keys, kind="stable")
            row = order[np.minimum(np.searchsorted(keys[order], want["key"]), len(keys) - 1)]
            ok = keys[row] == want["key"]
            want, row = want[ok], row[ok]
            want, row = _split_hot(want, row)
            at = bounds[row] + want["start"]
            route = blocks.mix(want["hash"])
            hot = np.flatnonzero(want["hot"])
            if len(hot):
                # the bytes that all windows of the offset range hold
                slot = want["offset"][hot].astype(np.int64) // SPLIT
                a = at[hot] + want["offset"][hot] - (slot * SPLIT)
                core = blocks.RollingHash(data).of(a, a + length - SPLIT + 1)
                route[hot] = blocks.mix(route[hot] + core + slot.astype(np.uint64))
            to = (route % np.uint64(buckets)).astype(np.int64)
            size = want["count"].astype(np.int64) + length - 1
            order = np.argsort(to, kind="stable")
            cut = np.append(np.flatnonzero(blocks.run_starts(to[order])), len(order))
            for a, b in zip(cut, cut[1:]):
                pick = order[a:b]
                texts = data[_gather(at[pick], size[pick])]
                rec = want[pick].copy()
                rec["hash"] = route[pick]
                yield pa.RecordBatch.from_arrays([pa.array([int(to[order[a]])], pa.int32()), pa.array([block], pa.int32()), pa.array([rec.tobytes()], pa.binary()), pa.array([texts.tobytes()], pa.binary())], names=["bucket", "block", "payload", "texts"])

    return run


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of consecutive ranges."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _split_hot(want: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of hot anchors, cut where the offset passes a multiple of SPLIT."""
    hot = want["hot"] == 1
    if not hot.any():
        return want, row
    parts, rows = [want[~hot]], [row[~hot]]
    u, r = want[hot], row[hot]
    top, low = u["offset"].astype(np.int64), u["offset"].astype(np.int64) - u["count"] + 1
    for slot in range(int(top.max()) // SPLIT + 1):
        hi, lo = np.minimum(top, slot * SPLIT + SPLIT - 1), np.maximum(low, slot * SPLIT)
        on = hi >= lo
        v = u[on].copy()
        v["start"] = u["start"][on] + (top[on] - hi[on])
        v["count"] = (hi - lo + 1)[on]
        v["offset"] = hi[on]
        parts.append(v)
        rows.append(r[on])
    return np.concatenate(parts), np.concatenate(rows)


def _expand(length: int):
    """Ranges of windows that also start earlier, from the transform of a bucket's unit texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in blocks.runs(batches, "bucket"):
            rec = np.concatenate([np.frombuffer(x, _UNITS) for x in table.column("payload").to_pylist()])
            each = [len(x) // _UNITS.itemsize for x in table.column("payload").to_pylist()]
            home = np.repeat(table.column("block").to_numpy(), each)
            data = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("texts").to_pylist()])
            size = rec["count"].astype(np.int64) + length - 1
            at = np.cumsum(size) - size
            order = np.lexsort((rec["start"], rec["doc"], rec["hash"]))
            first = np.append(np.flatnonzero(blocks.run_starts(rec["hash"][order])), len(order))
            held = np.concatenate([[0], np.cumsum(size[order] + 1)])[first]
            lo = 0
            while lo < len(first) - 1:
                hi = min(max(int(np.searchsorted(held, held[lo] + BATCH, "right")) - 1, lo + 1), len(first) - 1)
                pick = order[first[lo] : first[hi]]
                pick = pick[np.lexsort((rec["start"][pick], rec["doc"][pick]))]
                if held[hi] - held[lo] <= 2 * BATCH:
                    batches_of = [(rec[pick], home[pick], data[_gather(at[pick], size[pick])])]
                else:  # one passage in very many contexts
                    batches_of = _repeated_windows(rec[pick], home[pick], data, at[pick], length)
                for some in batches_of:
                    made = _covered(*some, length)
                    if made is not None:
                        yield made
                lo = hi

    return run


def _repeated_windows(rec: np.ndarray, home: np.ndarray, data: np.ndarray, at: np.ndarray, length: int, batch: int = BATCH) -> Iterator[tuple]:
    """The windows of a group's units whose hash occurs again, as units of their own, `batch` bytes at a time.

    Equal windows have equal hashes, so the others cannot be covered.  Windows of one hash stay together; where they fill
    several batches, each batch has the earliest of them too.
    """
    count = rec["count"].astype(np.int64)
    ends, hashes, i = np.cumsum(count + length - 1), [], 0
    while i < len(rec):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + batch, "right")))
        size = count[i:j] + length - 1
        begin = _gather(np.cumsum(size) - size, count[i:j])
        hashes.append(blocks.RollingHash(data[_gather(at[i:j], size)]).of(begin, begin + length))
        i = j
    value = np.concatenate(hashes)
    _, kind, times = np.unique(value, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[kind] > 1)
    kind = kind[again]
    order = np.argsort(kind, kind="stable")  # units come by document and start, so the first of a kind is the earliest
    again, kind = again[order], kind[order]
    unit = np.repeat(np.arange(len(rec)), count)[again]
    offset = (again - (np.cumsum(count) - count)[unit]).astype(np.int64)
    first = np.flatnonzero(blocks.run_starts(kind))
    head = first[np.cumsum(blocks.run_starts(kind)) - 1] if len(kind) else kind
    most = max(2, batch // (length + 1))
    lo = 0
    while lo < len(kind):
        hi = min(lo + most, len(kind))
        if hi < len(kind) and head[hi] > lo:
            hi = int(head[hi])
        some = np.arange(lo, hi)
        if head[lo] < lo:
            some = np.append(head[lo], some)
        u = unit[some]
        cut = rec[u].copy()
        cut["start"], cut["count"] = rec["start"][u] + offset[some].astype(rec["start"].dtype), 1
        by = np.lexsort((cut["start"], cut["doc"]))
        yield cut[by], home[u][by], data[_gather((at[u] + offset[some])[by], np.full(len(by), length))]
        lo = hi


def _covered(rec: np.ndarray, home: np.ndarray, data: np.ndarray, length: int) -> pa.RecordBatch | None:
    """The units come by document and start, so windows do too: the first window of a group is the earliest."""
    count = rec["count"].astype(np.int64)
    group = joined_windows(data, count + length - 1, length)
    unit = np.repeat(np.arange(len(rec)), count)
    start = _gather(rec["start"].astype(np.int64), count)
    doc = rec["doc"][unit]
    head = np.zeros(group.max() + 1, np.int64)
    head[group[::-1]] = np.arange(len(group))[::-1]
    head = head[group]
    at = np.flatnonzero((doc != doc[head]) | (start != start[head]))
    if not len(at):
        return None
    runs = np.flatnonzero(blocks.run_starts(at - np.arange(len(at)), unit[at]))
    n = np.diff(np.append(runs, len(at)))
    which = unit[at[runs]]
    return _by_block(home[which], 0, _records(rec["key"][which], start[at[runs]], n + length - 1))


def _apply_ranges(with_text: bool):
    return lambda batches: _cut_ranges(batches, with_text)


def _cut_ranges(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for _, table in blocks.runs(batches, "block"):
        payloads = [x for x in table.column("payload").to_pylist() if x is not None]
        docs = table.slice(len(payloads))
        if not docs.num_rows:
            continue
        data, bounds = blocks.text_buffer(docs.column("text").combine_chunks())
        removed = np.zeros(len(data), bool)
        if payloads:
            rec = np.concatenate([np.frombuffer(x, _RANGES) for x in payloads])
            rec = rec[np.argsort(rec["key"], kind="stable")]
            keys = docs.column("key").to_numpy().view(np.uint64)
            a, b = np.searchsorted(rec["key"], keys, "left"), np.searchsorted(rec["key"], keys, "right")
            row = np.repeat(np.arange(len(keys)), b - a)
            which = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(len(row))
            at = bounds[row] + rec["start"][which]
            depth = np.bincount(at, minlength=len(data) + 1) - np.bincount(at + rec["size"][which], minlength=len(data) + 1)
            removed = np.cumsum(depth)[: len(data)] > 0
        total = np.concatenate([[0], np.cumsum(removed)])
        begins = removed.copy()
        begins[1:] &= ~removed[:-1]
        edges = bounds[:-1][bounds[:-1] < len(data)]
        begins[edges] = removed[edges]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept, digests = [], []
        for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
            part = data[lo:hi]
            left = (part[~removed[lo:hi]] if total[hi] > total[lo] else part).tobytes()
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(left)
        ends, begin = bounds[1:], bounds[:-1]
        columns = {"doc_id": docs.column("id").combine_chunks(), "n_bytes": pa.array(np.diff(bounds)), "n_removed": pa.array(total[ends] - total[begin]), "n_spans": pa.array(spans[ends] - spans[begin]), "kept_sha256": pa.array(digests, pa.string())}
        yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of documents with doc_id and text."""
    if not gram < length or length - gram >= 255:
        raise ValueError("gram must be shorter than length by less than 255")
    spark = docs.sparkSession
    count = blocks.block_count(docs, target=2 << 20)
    parts = blocks.buckets(spark, count, 32)
    given = docs.select(
        blocks.block_of(count).alias("block"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("doc"), F.col("doc_id").alias("id"), "text"
    )
    sent = given.select("block", "key", "doc", "text").mapInArrow(_send_units(parts, length, gram), _FIELDS)
    met = blocks.materialize(sent.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_meet_units(length), _ROWS), "repeat-units")

    def with_docs(records: DataFrame, columns: list[str]) -> DataFrame:
        """Records of a block first, then its documents."""
        nothing = [F.lit(None).cast(given.schema[c].dataType).alias(c) for c in columns]
        records = records.select("block", "payload", *nothing)
        both = records.unionByName(given.select("block", F.lit(None).cast("binary").alias("payload"), *columns))
        return both.repartition(blocks.spread(spark, count), "block").sortWithinPartitions("block", F.col("payload").isNull())

    texts = with_docs(met.where("kind = 1"), ["key", "text"]).mapInArrow(_cut_texts(parts, length), "bucket int, block int, payload binary, texts binary")
    found = blocks.materialize(texts.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_expand(length), _ROWS), "repeat-ranges")
    ranges = met.where("kind = 0").unionByName(found)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_docs(ranges, ["key", "id", "text"]).mapInArrow(_apply_ranges(with_text), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_text=False)
