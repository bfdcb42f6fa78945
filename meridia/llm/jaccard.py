"""N-gram Jaccard join with PartEnum signatures.

Two texts link when the Jaccard similarity of their sets of five-word shingles is at least `PERCENT` %.

Sets are put into size bands so that similar sets are in one band or in neighbouring ones; a set signs for its own
band and the one below.  In a band, similar sets differ in at most k elements.  The feature domain (the
shingle hashes) is cut into n1 partitions and each into n2 parts: some partition holds at most k2 of the
differences, and there some choice of n2 - k2 parts is equal in both sets.  All those choices are enumerated;
each is a signature, so similar sets share one.  A choice that holds frequent shingles only (those of passages that
one in `COMMON` documents has, or nothing) says little.  n1 has `spare` partitions more than needed, so a set
that has such choices in at most `spare` partitions leaves them out; a set with more keeps all, so no link is lost,
whatever the frequent shingles are.

Texts of equal sets are one class, which its smallest id stands for; only that one signs.  Signatures travel packed,
to buckets by range.  A bucket gives the lists of documents that share a signature, without those that lie inside
a longer list of the bucket.  First each list's members are compared with its smallest document only.  Where the
documents that lists connect (a family) are not one component yet, the lists' other pairs from different components
follow, inside tasks that hold sketches: 4096 parity bits a set, whose differing bits never exceed the differing
shingles.  Pairs that the sketch cannot rule out are compared; at first only as many as could join the components, then
all that are left.  Every true link lies in some list and is only skipped within one component, so components are exact,
and a group of thousands of similar texts costs about one comparison a member.  Comparisons are exact, on the sets
themselves (52-bit shingle hashes).

No task holds a whole family: beyond `NODES` documents a family is cut into blocks, and a task takes the pairs of two
blocks; the lists of a pair of blocks are dealt over tasks by the pairs they hold.  A document with more than `FAN`
pairs meets its pairs in several tasks.  :func:`similar_pairs` gives the links themselves, between classes.

Defined results: a null text or one without words has an empty set and links with nothing; with fewer words than
`words`, the whole sequence is the one shingle; rows that share an id are one node, which links if one of its texts
does; a row without id is its own component (null); an empty table gives no rows; ids are integers, or cast to
them; other columns may have any names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, graph

WORDS = 5
PERCENT = 80
LIST = 2048  # members of a list in one row
FLUSH = 1 << 19  # signatures held in a task
CODES = 1 << 20  # pairs of a task that are held, and remembered, at a time
NODES = 1 << 14  # documents of a family in a block
FAN = 1 << 12  # pairs of a document in a task
BIG = 1 << 12  # a family of so many documents, or with so many lists, is not shuffled by its number
CHUNK = 1 << 20  # text bytes shingled at a time
COMMON = 2000  # a shingle of one in so many documents is frequent; at most COMMON * (mean set size) shingles are
_BITS = 52
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(column, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(set bounds, 52-bit hashes sorted in each row) of at most 4096 rows."""
    data, bounds = blocks.text_buffer(column)
    data = blocks.LOWER[data]
    start, end, row = blocks.word_bounds(data, bounds)
    word = blocks.RollingHash(data).of(start, end)
    n, count = len(bounds) - 1, np.bincount(row, minlength=len(bounds) - 1)
    total = len(word) - words + 1
    rows, hashes = [], []
    if total > 0:
        inside = row[: total] == row[words - 1 :]
        sums = np.zeros(total, np.uint64)
        for j in range(words):
            sums += word[j : j + total] * _FACTORS[j]
        rows.append(row[:total][inside])
        hashes.append(blocks.mix(sums[inside]))
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        first = np.cumsum(count)[short] - count[short]
        sums = count[short].astype(np.uint64)
        for j in range(words - 1):
            has = count[short] > j
            sums[has] += word[first[has] + j] * _FACTORS[j]
        rows.append(short)
        hashes.append(blocks.mix(sums))
    if not rows:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint64)
    key = np.sort((np.concatenate(rows).astype(np.uint64) << np.uint64(_BITS)) | (np.concatenate(hashes) >> np.uint64(64 - _BITS)))
    key = key[blocks.run_starts(key)]
    at = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(_BITS)) if n < 4096 else np.append(np.searchsorted(key, np.arange(n, dtype=np.uint64) << np.uint64(_BITS)), len(key))
    return at, key & np.uint64((1 << _BITS) - 1)


@functools.cache
def _band_edges(percent: int) -> np.ndarray:
    """Band i holds sizes edges[i] .. edges[i + 1] - 1; a similar larger set is in band i or i + 1."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges)


def _differences(band: np.ndarray, percent: int) -> np.ndarray:
    """The most elements in which two similar sets can differ whose smaller one is in the band."""
    most = _band_edges(percent)[band + 1] - 1
    return (most + most * 100 // percent) * (100 - percent) // (100 + percent)


#: Few differences: one partition, so many parts.
_SMALL = {1: 8, 2: 7, 3: 7}


def _salt(*xs) -> np.ndarray:
    out = np.uint64(0)
    for f, x in zip(_FACTORS, xs):
        out = out + np.asarray(x).astype(np.uint64) * f
    return out


def signatures(at: np.ndarray, hashes: np.ndarray, percent: int = PERCENT, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all rows' sets; `frequent` are sorted hashes."""
    rare = np.ones(len(hashes), bool)
    if frequent is not None and len(frequent):
        near = np.searchsorted(frequent, hashes)
        near[near == len(frequent)] = 0
        rare = frequent[near] != hashes
    size = np.diff(at)
    own = np.searchsorted(_band_edges(percent), size, "right") - 1
    mixed = blocks.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    full = np.flatnonzero(size)
    rows, sigs = [full], [blocks.mix(sums[at[1:][full]] - sums[at[:-1][full]] + _salt(size[full], 99))]  # equal sets
    for below in (0, 1):
        band = own - below
        k = np.where((size > 0) & (band >= 0), _differences(np.maximum(band, 0), percent), 0)
        for few, parts in _SMALL.items():
            pick = np.flatnonzero(k == few)
            if len(pick):
                total, count = _cells(at, hashes, mixed, pick, np.full(len(pick), parts))[:2]
                total, count = total.reshape(-1, parts), count.reshape(-1, parts)
                for j, left_out in enumerate(itertools.combinations(range(parts), few)):
                    keep = [i for i in range(parts) if i not in left_out]
                    rows.append(pick)
                    sigs.append(blocks.mix(total[:, keep].sum(1, dtype=np.uint64) + _salt(count[:, keep].sum(1), band[pick], j, 7)))
        pick = np.flatnonzero(k > 3)
        if len(pick):
            need = k[pick] // 2 + 1
            spare = 1 + need // 10
            n1 = need + spare
            total, count, telling = (x.reshape(-1, 3) for x in _cells(at, hashes, mixed, pick, n1 * 3, rare))
            which = np.repeat(np.arange(len(pick)), n1)
            place = np.arange(len(which)) - np.repeat(np.cumsum(n1) - n1, n1)
            left = count.sum(1, keepdims=True) - count
            weak = telling.sum(1, keepdims=True) == telling
            thin = np.bincount(which, weak.any(1), minlength=len(pick)) <= spare
            kept = ~(weak & thin[which][:, None])
            whole = total.sum(1, dtype=np.uint64)
            for j in range(3):
                on = kept[:, j]
                rows.append(pick[which[on]])
                sigs.append(blocks.mix(whole[on] - total[on, j] + _salt(left[on, j], band[pick][which[on]], j, 11, place[on])))
    return np.concatenate(rows), np.concatenate(sigs)


def _cells(at, hashes, mixed, pick, cells, rare=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash sums, counts and rare counts of the cells of picked rows; a row's sorted hashes fall into cells in order."""
    size = np.diff(at)[pick]
    element = np.repeat(at[:-1][pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    base = np.cumsum(cells) - cells
    cell = (hashes[element].astype(np.float64) * np.repeat(cells / 2.0**_BITS, size)).astype(np.int64)
    cell = np.minimum(cell, np.repeat(cells - 1, size)) + np.repeat(base, size)
    count = np.bincount(cell, minlength=int(cells.sum()))
    end = np.cumsum(count)
    local = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[element])])
    telling = count if rare is None else np.bincount(cell[rare[element]], minlength=len(count))
    return local[end] - local[end - count], count, telling


# ---------------------------------------------------------------- stages


_SIGS = "bucket int, steps binary, ids binary, places binary"


def _count_shingles(buckets: int, words: int):
    """Counts of shingles that a task sees in two or more documents, and the digest and size of every set, packed by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets, total = [], [], 0

        def cuts(x: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
            cut = np.concatenate([[0], np.searchsorted(x, np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)), [len(x)]])
            return [(i, cut[i], cut[i + 1]) for i in range(buckets) if cut[i] < cut[i + 1]]

        def pack() -> Iterator[pa.RecordBatch]:
            h = np.sort(np.concatenate(held))
            first = np.flatnonzero(blocks.run_starts(h))
            times = np.diff(np.append(first, len(h)))
            h, times = h[first[times > 1]], times[times > 1].astype("<u4")
            d = np.concatenate(sets)
            d = d[np.argsort(d[:, 0])]
            for kind, parts, columns in ((0, cuts(h, _BITS), (h, times)), (1, cuts(d[:, 0], 64), (d, None))):
                for i in range(0, len(parts), 256):
                    some = parts[i : i + 256]
                    packed = [pa.array([None if c is None else c[a:b].tobytes() for _, a, b in some], pa.binary()) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in some], pa.int32()), pa.array([kind] * len(some), pa.int32()), *packed], names=["bucket", "kind", "hashes", "times"])

        for batch in blocks.chunks(batches, limit=CHUNK):
            at, hashes = shingle_sets(batch.column("text"), words)
            size = np.diff(at).astype(np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(blocks.mix(hashes))])
            digest = blocks.mix(sums[at[1:]] - sums[at[:-1]] + size)
            sets.append(np.column_stack([digest, batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), size]))
            held.append(hashes)
            total += len(hashes)
            if total > 2 * FLUSH:
                yield from pack()
                held, sets, total = [], [], 0
        if sets:
            yield from pack()

    return run


_CLASSES = "doc_id bigint, class_id bigint, n_shingles bigint, hashes binary"


def _classes(least: int):
    """Frequent shingles of a bucket, packed, and for every document the smallest id with an equal set."""
    names = ["doc_id", "class_id", "n_shingles", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in blocks.runs(batches, "bucket"):
            kind = table.column("kind").to_numpy()
            counts, sets = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
            if counts.num_rows:
                h = np.concatenate([np.frombuffer(x, np.uint64) for x in counts.column("hashes").to_pylist()])
                times = np.concatenate([np.frombuffer(x, "<u4") for x in counts.column("times").to_pylist()])
                own, inverse = np.unique(h, return_inverse=True)
                total = np.bincount(inverse, times)
                yield pa.RecordBatch.from_arrays([*(pa.array([None], pa.int64()) for _ in range(3)), pa.array([own[total >= least].tobytes()], pa.binary())], names=names)
            if sets.num_rows:
                digest, doc, size = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 3) for x in sets.column("hashes").to_pylist()]).T
                doc = doc.view(np.int64) if doc.flags.c_contiguous else np.ascontiguousarray(doc).view(np.int64)
                order = np.lexsort((doc, digest))
                digest, doc, size = digest[order], doc[order], size[order]
                first = np.maximum.accumulate(np.where(blocks.run_starts(digest), np.arange(len(doc)), 0))
                least_id = np.where(size > 0, doc[first], doc)  # texts without words are no class
                for lo in range(0, len(doc), 100_000):
                    some = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(least_id[some]), pa.array(size[some].astype(np.int64)), pa.nulls(len(doc[some]), pa.binary())], names=names)

    return run


def classes_of(given: DataFrame, words: int, parts: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, class_id, n_shingles) of every row, and sorted hashes of the shingles that about one in COMMON documents holds."""
    counted = given.select("doc_id", "text").mapInArrow(_count_shingles(parts, words), "bucket int, kind int, hashes binary, times binary")
    met = counted.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket")
    made = blocks.materialize(met.mapInArrow(_classes(max(20, given.count() // COMMON)), _CLASSES), "jaccard-classes")
    found = [np.frombuffer(r[0], np.uint64) for r in made.where("hashes IS NOT NULL").select("hashes").collect()]  # their number is bounded by COMMON * mean set size
    return made.where("hashes IS NULL").drop("hashes"), np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _sign(buckets: int, percent: int, words: int, shared=None):
    """Packed signatures by bucket."""

    def pack(rows: list[np.ndarray], sigs: list[np.ndarray]) -> pa.RecordBatch:
        ids, sig = np.concatenate(rows), np.concatenate(sigs) >> np.uint64(16)
        order = np.argsort(sig, kind="stable")
        ids, sig = ids[order], sig[order]
        cut = np.concatenate([[0], np.searchsorted(sig, np.array([(i << 48) // buckets for i in range(1, buckets)], np.uint64)), [len(sig)]])
        out: list[list] = [[], [], [], []]
        for i in range(buckets):
            a, b = cut[i], cut[i + 1]
            if a == b:
                continue
            own, place = np.unique(ids[a:b], return_inverse=True)
            step = np.diff(sig[a:b], prepend=np.uint64(0))
            out[0].append(i)
            out[1].append(step[:1].tobytes() + (step[1:].astype("<u4").tobytes() if (step[1:] < 1 << 32).all() else step[1:].tobytes()))
            out[2].append(own.astype("<i8").tobytes())
            out[3].append(place.astype("<u2" if len(own) <= 1 << 16 else "<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "steps", "ids", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sigs, held = [], [], 0
        for batch in blocks.chunks(batches, limit=CHUNK):
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            at, hashes = shingle_sets(batch.column("text"), words)
            row, sig = signatures(at, hashes, percent, shared.value if shared is not None else None)
            rows.append(doc[row])
            sigs.append(sig)
            held += len(sig)
            if held > FLUSH:
                yield pack(rows, sigs)
                rows, sigs, held = [], [], 0
        if held:
            yield pack(rows, sigs)

    return run


_LISTS = "gid bigint, leader bigint, list_size bigint, members array<bigint>"


def _outermost(starts: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Lists that do not lie inside a longer one: not all of their members have the same other list as their longest."""
    element = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    rank = np.empty(len(size), np.int64)
    rank[np.argsort(size, kind="stable")] = np.arange(len(size))
    _, member = np.unique(doc[element], return_inverse=True)
    longest = np.zeros(member.max() + 1, np.int64)
    np.maximum.at(longest, member, np.repeat(rank, size))
    of, at = longest[member], np.cumsum(size) - size
    low, high = np.minimum.reduceat(of, at), np.maximum.reduceat(of, at)
    return (low != high) | (low == rank)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct lists of two or more documents that share a signature."""
    for bucket, table in blocks.runs(batches, "bucket"):
        sigs, docs = [], []
        for steps, ids, places in zip(*(table.column(c).to_pylist() for c in ("steps", "ids", "places"))):
            own = np.frombuffer(ids, "<i8")
            place = np.frombuffer(places, "<u2" if len(own) <= 1 << 16 else "<u4")
            narrow = len(steps) == 8 + 4 * (len(place) - 1)
            step = np.concatenate([np.frombuffer(steps[:8], "<u8"), np.frombuffer(steps[8:], "<u4" if narrow else "<u8").astype(np.uint64)])
            sigs.append(np.cumsum(step))
            docs.append(own[place])
        sig, doc = np.concatenate(sigs), np.concatenate(docs)
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        fresh = blocks.run_starts(sig, doc)
        sig, doc = sig[fresh], doc[fresh]
        starts = np.flatnonzero(blocks.run_starts(sig))
        size = np.diff(np.append(starts, len(sig)))
        many = size > 1
        starts, size = starts[many], size[many]
        if not len(starts):
            continue
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(blocks.mix(doc.view(np.uint64)))])
        digest = blocks.mix(total[starts + size] - total[starts] + size.astype(np.uint64))
        _, one = np.unique(digest, return_index=True)
        one = one[_outermost(starts[one], size[one], doc)]
        gids, leaders, sizes, members = [], [], [], []
        for i in one:
            whole = doc[starts[i] : starts[i] + size[i]]
            for lo in range(0, len(whole), LIST):
                gids.append(int(digest[i].view(np.int64)))
                leaders.append(int(whole[0]))
                sizes.append(len(whole))
                members.append(whole[lo : lo + LIST])
            if len(gids) > 5000:
                yield _list_batch(gids, leaders, sizes, members)
                gids, leaders, sizes, members = [], [], [], []
        if gids:
            yield _list_batch(gids, leaders, sizes, members)


def _list_batch(gids: list, leaders: list, sizes: list, members: list) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, members)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(members)))
    return pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(leaders, pa.int64()), pa.array(sizes, pa.int64()), lists], names=["gid", "leader", "list_size", "members"])


SKETCH_BITS = 4096
PAIRS = 20_000_000  # list pairs from which a family is dealt over one more task


def _pack_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.chunks(batches, limit=CHUNK):
            at, hashes = shingle_sets(batch.column("text"), words)
            packed = pa.array([hashes[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
            place = (blocks.mix(hashes) % np.uint64(SKETCH_BITS)).astype(np.int64)
            sketches = []
            for a, b in zip(at, at[1:]):
                odd = np.bincount(place[a:b], minlength=SKETCH_BITS) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed, pa.array(np.diff(at)), pa.array(sketches, pa.binary())], names=["doc_id", "features", "n", "sketch"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                r, s = len(x) // 8, len(y) // 8
                if not r or not s or 100 * min(r, s) < percent * max(r, s):
                    ok.append(False)
                    continue
                if x == y:
                    ok.append(True)
                    continue
                both = np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (r + s - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _pairs_of(lists: Iterator[np.ndarray], root: np.ndarray, side: np.ndarray) -> Iterator[np.ndarray]:
    """Codes (smaller place * size + larger place) of the lists' pairs from different components.

    Where places lie on two sides, only pairs from different sides count.  Lists are taken in tiles."""
    n, held, total = len(root), [], 0
    cross = len(side) > 0 and side.min() != side.max()
    for idx in lists:
        idx = np.unique(idx)
        own, of = root[idx], side[idx]
        if (own == own[0]).all() or cross and (of == of[0]).all():
            continue
        for lo in range(0, len(idx), 1024):
            for at in range(lo, len(idx), 1024):
                a, b = slice(lo, lo + 1024), slice(at, at + 1024)
                apart = own[a, None] != own[None, b]
                if cross:
                    apart &= of[a, None] != of[None, b]
                i, j = np.nonzero(apart)
                i, j = idx[a][i], idx[b][j]
                code = (i * n + j)[i < j]
                held.append(code)
                total += len(code)
                if total > CODES:
                    yield np.unique(np.concatenate(held))
                    held, total = [], 0
    if held:
        yield np.unique(np.concatenate(held))


def _candidates(percent: int, forest: bool):
    """Pairs of a task that the sketches cannot rule out; as a forest, only pairs that would join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in blocks.runs(batches, "task"):
            kind = table.column("gid").is_null().to_numpy()
            nodes, lists = table.filter(pa.array(kind)), table.filter(pa.array(~kind))
            if not nodes.num_rows or not lists.num_rows:
                continue
            node = nodes.column("node").to_numpy()
            order = np.argsort(node, kind="stable")
            first = order[blocks.run_starts(node[order])]  # rows that share an id: see below
            ids, root, side = node[first], nodes.column("root").to_numpy()[first], nodes.column("side").to_numpy()[first]
            size = nodes.column("n").to_numpy()[first]
            shared = np.bincount(np.searchsorted(ids, node), minlength=len(ids)) > 1
            bits = np.frombuffer(b"".join(nodes.column("sketch").take(pa.array(first)).to_pylist()), np.uint64).reshape(len(ids), -1)
            column = lists.column("members").combine_chunks()
            values = np.searchsorted(ids, column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()])
            ends = column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()
            starts = np.append(np.flatnonzero(blocks.run_starts(lists.column("gid").to_numpy())), len(column))
            parent = {}

            def top(x: int) -> int:
                while x in parent:
                    x = parent[x]
                return x

            seen = np.zeros(0, np.int64)
            for codes in _pairs_of((values[ends[a] : ends[b]] for a, b in zip(starts, starts[1:])), root, side):
                codes = np.setdiff1d(codes, seen, assume_unique=True)
                seen = np.union1d(seen, codes) if len(seen) < CODES else codes
                keep_a, keep_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for lo in range(0, len(codes), 1 << 13):
                    i, j = np.divmod(codes[lo : lo + (1 << 14)], len(ids))
                    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
                    near = (apart * (100 + percent) <= (size[i] + size[j]) * (100 - percent)) | shared[i] | shared[j]
                    keep_a.append(i[near])
                    keep_b.append(j[near])
                i, j = np.concatenate(keep_a), np.concatenate(keep_b)
                if forest:
                    joins = np.zeros(len(i), bool)
                    for k, (x, y) in enumerate(zip(root[i].tolist(), root[j].tolist())):
                        x, y = top(x), top(y)
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                            joins[k] = True
                    i, j = i[joins], j[joins]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    return run


def _near(percent: int):
    """Pairs whose sketches do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                batch = whole.slice(lo, 8192)
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
                apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                size = batch.column("n").to_numpy() + batch.column("m").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(apart * (100 + percent) <= size * (100 - percent)))

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, key: str, **columns: str) -> DataFrame:
    """`pairs` with columns of the set of one side; a document of many pairs is repeated, and its pairs dealt over the repeats."""
    fan = pairs.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > FAN)
    fan = F.broadcast(fan.select(key, F.ceil(F.col("__n") / FAN).cast("int").alias("__s")))  # at most one in FAN pairs
    other = "b" if key == "a" else "a"
    left = pairs.join(fan, key, "left").withColumn("__salt", F.pmod(F.xxhash64(other), F.coalesce("__s", F.lit(1))).cast("int")).drop("__s")
    right = sets.select(F.col("doc_id").alias(key), *[F.col(c).alias(n) for n, c in columns.items()]).join(fan, key, "left")
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__s", F.lit(1)) - 1))).drop("__s")
    return left.join(right, [key, "__salt"]).drop("__salt")


def _near_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = _with_sets(_with_sets(pairs, sets, "b", y="sketch", m="n"), sets, "a", x="sketch", n="n")
    close = both.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    return close.select("a", "b", "x", "y", "n", "m").mapInArrow(_near(percent), "a bigint, b bigint").distinct()


def _true_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each side gets its set on its own and the two meet by pair, so few pairs never move the table of sets."""
    pairs = blocks.materialize(pairs, "jaccard-near")
    left, right = _with_sets(pairs, sets, "a", x="features"), _with_sets(pairs, sets, "b", y="features")
    return left.join(right, ["a", "b"]).select("a", "b", "x", "y").mapInArrow(_verify(percent), "a bigint, b bigint").distinct()


class _Join:
    """The lists of documents (doc_id, text) that share signatures, and what is needed to compare their members."""

    def __init__(self, docs: DataFrame, percent: int, words: int):
        self.spark, self.percent = docs.sparkSession, percent
        given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL")
        parts = blocks.buckets(self.spark, blocks.block_count(given), 4)
        self.classes, frequent = classes_of(given, words, parts)
        shared = self.spark.sparkContext.broadcast(frequent)
        standing = self.classes.where("class_id = doc_id AND n_shingles > 0").select("doc_id").distinct()
        # the ids grow with the documents: they are never broadcast
        signed = given.join(standing.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sign(parts, percent, words, shared), _SIGS)
        self.lists = blocks.materialize(signed.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_lists, _LISTS), "jaccard-lists")
        self.tried = blocks.materialize(self.lists.select(F.col("leader").alias("a"), F.explode("members").alias("b")).where("a <> b").distinct(), "jaccard-pairs")
        blocks.forget_shuffles(self.spark)
        wanted = self.tried.select("a").unionByName(self.tried.select(F.col("b").alias("a"))).select(F.col("a").alias("doc_id")).distinct()
        packed = given.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_pack_sets(words), "doc_id bigint, features binary, n bigint, sketch binary")
        self.sets = blocks.materialize(packed, "jaccard-sets")
        # families: what the lists connect, whether similar or not
        self.family = blocks.materialize(graph.components(self.tried, "a", "b").withColumnRenamed("root", "family"), "jaccard-families")
        blocks.forget_shuffles(self.spark)
        self.of_list = self.lists.join(self.family, self.lists["leader"] == self.family["node"]).select("family", "gid", "list_size", "members")

    def candidates(self, roots: DataFrame | None, forest: bool) -> DataFrame:
        """Pairs of lists' members from different components (`roots`; none: every document for itself) that may link."""
        own = self.family.withColumn("root", F.col("node")) if roots is None else self.family.join(roots, "node", "left").select("node", "family", F.coalesce("root", "node").alias("root"))
        own = blocks.materialize(own, "jaccard-own")
        # the smallest document of a family is its number, and its own root if the family is one component
        work = self.of_list.groupBy("family").agg(F.sum(F.size("members").cast("bigint") * F.size("members")).alias("work"), F.count("*").alias("n_lists"))
        size = own.groupBy("family").agg(F.count("*").alias("n_nodes"), F.bool_or(F.col("root") != F.col("family")).alias("open")).where("open")
        cut = size.join(work, "family").withColumn("n_blocks", F.ceil(F.col("n_nodes") / NODES).cast("int"))
        cut = cut.withColumn("n_tasks", F.ceil(F.col("work") / (F.col("n_blocks").cast("bigint") * (F.col("n_blocks") + 1) * PAIRS)).cast("int"))
        cut = blocks.materialize(cut.select("family", "n_blocks", "n_tasks", (F.greatest("n_nodes", "n_lists") >= BIG).alias("big")), "jaccard-cut")
        big, small = F.broadcast(cut.where("big").drop("big")), cut.where("NOT big").drop("big")  # at most one in BIG nodes and lists

        def spread(df: DataFrame) -> DataFrame:
            return df.join(big, "family").unionByName(df.join(big.select("family"), "family", "left_anti").join(small, "family"))

        block = lambda c: F.pmod(F.xxhash64(c), F.col("n_blocks")).cast("int")
        nodes = spread(own).withColumn("mine", block("node")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        nodes = nodes.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_tasks") - 1)))
        nodes = nodes.join(self.sets.select(F.col("doc_id").alias("node"), "n", "sketch"), "node")
        # a list goes to the pairs of blocks that its members lie in; one block only if two of them do
        lists = spread(self.of_list).withColumn("at", F.transform("members", block))
        whole = (F.col("list_size") == F.size("members"))  # else other rows of the list may hold the other block's members
        held = F.when(whole, F.array_distinct("at")).otherwise(F.sequence(F.lit(0), F.col("n_blocks") - 1))
        pair = lambda x: F.transform(F.filter("held", lambda y: y >= x), lambda y: F.struct(x.alias("lo"), y.alias("hi")))
        telling = lambda p: (p["lo"] < p["hi"]) | ~F.col("whole") | (F.size(F.filter("at", lambda z: z == p["lo"])) > 1)
        lists = lists.withColumns({"held": held, "whole": whole}).select("family", "gid", "n_blocks", "n_tasks", "members", F.explode(F.filter(F.flatten(F.transform("held", pair)), telling)).alias("p"))
        lists = lists.withColumn("lo", F.col("p.lo")).withColumn("hi", F.col("p.hi"))
        inside = F.filter("members", lambda x: block(x).isin(F.col("lo"), F.col("hi")))
        lists = lists.withColumn("members", F.when(F.col("n_blocks") == 1, F.col("members")).otherwise(inside)).where("size(members) > 0").withColumn("part", F.pmod("gid", F.col("n_tasks")).cast("int"))
        task = F.xxhash64("family", "lo", "hi", "part").alias("task")
        none = lambda **kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
        left = nodes.select(task, *none(gid="bigint"), "node", "root", F.col("mine").alias("side"), "n", "sketch", *none(members="array<bigint>"))
        right = lists.select(task, "gid", *none(node="bigint", root="bigint", side="int", n="bigint", sketch="binary"), "members")
        met = left.unionByName(right).repartition(2 * blocks.partitions(self.spark), "task").sortWithinPartitions("task", "gid")
        return met.mapInArrow(_candidates(self.percent, forest), "a bigint, b bigint").distinct()


def link_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(node, root) of documents (doc_id, text) that link with another, and (doc_id, class_id, n_shingles) of all with an id."""
    join = _Join(docs, percent, words)
    copies = join.classes.where("class_id <> doc_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    links = blocks.materialize(_true_links(_near_pairs(join.tried, join.sets, percent), join.sets, percent).unionByName(copies), "jaccard-links")
    roots = graph.components(links, "a", "b")
    blocks.forget_shuffles(join.spark)
    for forest in (True, False):
        found = blocks.materialize(_true_links(join.candidates(roots, forest), join.sets, percent), "jaccard-more")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = graph.components(links, "a", "b")
        blocks.forget_shuffles(join.spark)
    return roots, join.classes


def similar_pairs(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """All links (a < b) between classes, and the classes' members (doc_id, class_id, n_shingles).

    A class is the documents of one set of shingles, under its smallest id; its members link with each other and with
    all members of the classes that theirs links with.  Every pair that shares a signature is compared.
    """
    join = _Join(docs, percent, words)
    return _true_links(join.candidates(None, False), join.sets, percent), join.classes


def link_counts(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, class_id, n_links): how many other documents a document links with.  Rows that share an id count one by one."""
    pairs, classes = similar_pairs(docs, percent, words)
    pairs, classes = blocks.materialize(pairs, "jaccard-links"), classes.where("n_shingles > 0 OR class_id = doc_id")
    size = classes.groupBy("class_id").agg(F.count("*").alias("n"), F.max("n_shingles").alias("words"))
    both = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class_id"), F.col("a").alias("other")))
    beyond = both.join(size.select(F.col("class_id").alias("other"), "n"), "other").groupBy("class_id").agg(F.sum("n").alias("beyond"))
    n = size.join(beyond, "class_id", "left").select("class_id", F.when(F.col("words") > 0, F.col("n") - 1 + F.coalesce("beyond", F.lit(0))).otherwise(F.lit(0)).alias("n_links"))
    return classes.join(n, "class_id").select("doc_id", "class_id", "n_links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id), one row a document; class_id is the smallest id of an equal set."""
    roots, classes = link_components(docs, percent, words)
    known = classes.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), "class_id")
    none = F.lit(None).cast("bigint")
    return known.unionByName(shingle_counts(docs.where("doc_id IS NULL"), words).select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_shingles", none.alias("component_id"), none.alias("class_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The documents without those that link, directly or through others, to one of smaller id."""
    roots, _ = link_components(docs, percent, words)
    gone = roots.where("node <> root").select(F.col("node").alias("__node"))
    return docs.join(gone, docs["doc_id"] == gone["__node"], "left_anti")


def shingle_counts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.chunks(batches, limit=CHUNK):
            at, _ = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at))], names=["doc_id", "n_shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint")


def op2_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("class_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) m USING (doc_id)
"""
