"""The training-data operators against brute force, on small fixtures with all the awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridia.llm import blocks, brown_lm, crf, decontaminate, graph, jaccard, media, mixing, ordinal, preferences, suffix_dedup, token_files

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed=0, n=60):
    """Random texts with exact and near copies, nulls, empties, repeats and one long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 5, 30, 120, 400]))]
        text = " ".join(words)
        if i % 5 == 1 and rows:
            text = rng.choice(rows)[1]
        elif i % 5 == 2 and rows:
            near = (rng.choice(rows)[1] or "").split(" ")
            near[rng.randrange(len(near))] = "Changed"
            text = "\t".join(near)
        elif i % 5 == 3:
            text = text + "\n" + passage
        rows.append((i, text, "en", "s%d" % (i % 3), len(text or "")))
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, "  \n\n ", "en", "s1", 5), (None, passage, "en", None, 1), (103, "a" * 5000, "en", "s2", 5000)]
    rows += [(104, " ".join(vocab * 3), "en", "s2", 1), rows[30], rows[30]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 1


def brute_repeats(rows, length=100):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for s in range(len(b) - length + 1):
            k, v = b[s : s + length], (-math.inf if doc is None else doc, s)
            first[k] = min(first.get(k, v), v)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (-math.inf if doc is None else doc, s):
                gone[s : s + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeats(docs, monkeypatch, hot):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    if hot == 1:  # local tasks fork this process' module only through its source: exercise the split directly
        rec = np.zeros(2, suffix_dedup._UNITS)
        rec["count"], rec["offset"], rec["hot"], rec["start"] = [40, 3], [50, 2], 1, [7, 9]
        got, _ = suffix_dedup._split_hot(rec, np.array([0, 1]))
        assert got["count"].sum() == 43 and (got["offset"] // suffix_dedup.SPLIT == (got["offset"] - got["count"].astype(int) + 1) // suffix_dedup.SPLIT).all()
        return
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs.select("doc_id", "text")).drop("kept").collect()]
    assert sorted(got, key=key) == sorted(brute_repeats(rows), key=key)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=9), min_size=1, max_size=12), st.sampled_from([1, 20, 1000]))
def test_windows_of_a_hot_passage(texts, batch):
    """Units around one passage, taken a few windows at a time: what is covered is what the definition says."""
    length = 4
    texts = [t + "mmm"[: max(0, length - len(t))] for t in texts]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    rec = np.zeros(len(raw), suffix_dedup._UNITS)
    rec["count"], rec["doc"], rec["key"] = [len(r) - length + 1 for r in raw], np.arange(len(raw)), np.arange(len(raw))
    at = np.cumsum([len(r) for r in raw]) - [len(r) for r in raw]
    covered = set()
    for some in suffix_dedup._repeated_windows(rec, np.arange(len(raw)), np.concatenate(raw), at, length, batch):
        made = suffix_dedup._covered(*some, length)
        for payload in made.column("payload").to_pylist() if made is not None else []:
            for r in np.frombuffer(payload, suffix_dedup._RANGES):
                covered |= {(int(r["key"]), int(r["start"]) + i) for i in range(int(r["size"]) - length + 1)}
    first, want = {}, set()
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            if first.setdefault(t[i : i + length], (d, i)) != (d, i):
                want.add((d, i))
    assert covered == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=12), st.integers(2, 9))
def test_interval_expansion(texts, length):
    raw = [t.encode() for t in texts]
    group = suffix_dedup.joined_windows(np.frombuffer(b"".join(raw), np.uint8), np.array([len(t) for t in raw]), length)
    windows = [t[i : i + length] for t in raw for i in range(len(t) - length + 1)]
    assert len(group) == len(windows) and len(set(group.tolist())) == len(set(windows)) == len(set(zip(group.tolist(), windows)))


def test_repeats_empty(spark):
    assert suffix_dedup.remove_repeats(empty(spark).select("doc_id", "text")).count() == 0


# ---------------------------------------------------------------- 2


def shingles(text):
    w = WORDS.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    nodes = sorted({d for d, _ in rows if d is not None})
    label = {d: d for d in nodes}
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return [(d, len(shingles(t)), None if d is None else label[d]) for d, t in rows]


def test_jaccard(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in jaccard.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id").collect()]
    want = brute_components(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = {r.doc_id for r in jaccard.drop_near_duplicates(docs).collect()}
    assert kept == {d for d, _, c in want if d == c}


def brute_links(rows):
    """(links between documents, links between classes, class of each document)."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    least = {}
    for d, x in sets:
        least[frozenset(x)] = min(least.get(frozenset(x), d), d)
    of = [(d, least[frozenset(x)] if x else d) for d, x in sets]
    count, pairs = Counter(), set()
    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets):
            if i != j and x and y and 100 * len(x & y) >= 80 * len(x | y):
                count[i] += 1
                if of[i][1] < of[j][1]:
                    pairs.add((of[i][1], of[j][1]))
    return [(d, c, count[i]) for i, (d, c) in enumerate(of)], pairs


@pytest.mark.parametrize("cut", [False, True])
def test_families_of_near_misses(spark, monkeypatch, cut):
    """Texts around the bound, few of which link; with tiny bounds every family is cut into blocks and every pair list dealt out."""
    if cut:
        for name, value in (("NODES", 7), ("FAN", 3), ("BIG", 4), ("PAIRS", 60)):
            monkeypatch.setattr(jaccard, name, value)
    rng, rows = random.Random(7), []
    for family in range(3):
        base = ["f%dw%d" % (family, i) for i in range(90)]
        for i in range(40):
            words = list(base)
            for _ in range(rng.randrange(1, 7)):
                words[rng.randrange(90)] = "x%d" % rng.randrange(40)
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rng.sample(rows, 20))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(brute_components(rows))
    counts, pairs = brute_links(rows)
    assert len(pairs) > 50
    assert sorted(map(tuple, jaccard.link_counts(docs).collect())) == sorted(counts)
    assert set(map(tuple, jaccard.similar_pairs(docs)[0].collect())) == pairs


def _many_blocks(monkeypatch) -> list[tuple[int, str]]:
    """One family that is cut into ten blocks and more, at the bound of pairs that a task has in earnest."""
    for name, value in (("NODES", 2), ("BIG", 4)):
        monkeypatch.setattr(jaccard, name, value)
    rng, base = random.Random(5), ["w%d" % i for i in range(90)]
    return [(i, " ".join("x%d" % rng.randrange(40) if j in (k := rng.randrange(90), k + 1) else w for j, w in enumerate(base))) for i in range(60)]


def test_family_of_many_blocks(spark, monkeypatch):
    rows = _many_blocks(monkeypatch)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_pipeline_stage_of_many_blocks(spark, monkeypatch):
    import corpus_pipeline

    rows = _many_blocks(monkeypatch)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()
    assert sorted(r[0] for r in got) == sorted({c for _, _, c in brute_components(rows)})


def test_similar_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    counts, pairs = brute_links(rows)
    assert sorted(map(tuple, jaccard.link_counts(docs).collect())) == sorted(counts)
    assert set(map(tuple, jaccard.similar_pairs(docs)[0].collect())) == pairs


def test_tiles_and_outermost_lists():
    root, side = np.arange(3000) // 2, np.arange(3000) % 3 % 2
    code = np.concatenate(list(jaccard._pairs_of(iter([np.arange(3000), np.arange(0, 3000, 7)]), root, np.zeros(3000, int))))
    assert len(np.unique(code)) == 3000 * 2999 // 2 - 1500
    cross = np.unique(np.concatenate(list(jaccard._pairs_of(iter([np.arange(3000)]), root, side))))
    i, j = np.divmod(cross, 3000)
    assert (side[i] != side[j]).all() and len(cross) == sum(side == 0) * sum(side == 1) - sum(side[::2] != side[1::2])
    lists = [[1, 2, 3, 4], [2, 3], [3, 9], [1, 4], [8, 9], [7, 8, 9]]
    doc, size = np.concatenate(lists), np.array([len(x) for x in lists])
    kept = jaccard._outermost(np.cumsum(size) - size, size, doc)
    assert [x for x, k in zip(lists, kept) if k] == [[1, 2, 3, 4], [3, 9], [7, 8, 9]]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_similar_sets_share_a_signature(common, left, right, seed):
    if 100 * common < 80 * (common + left + right):
        return
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 1 << 52, common + left + right, dtype=np.uint64))
    rng.shuffle(h)
    common = len(h) - left - right
    a, b = np.sort(h[: common + left]), np.sort(np.concatenate([h[:common], h[common + left :]]))
    frequent = np.sort(h[: common // 2])
    row, sig = jaccard.signatures(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), 80, frequent)
    assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def test_jaccard_empty(spark):
    assert jaccard.near_duplicates(empty(spark).select("doc_id", "text")).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), min_size=1, max_size=30))
def test_both_component_ways(spark, edges):
    label = list(range(16))
    for _ in range(16):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = {i: label[i] for e in edges if e[0] != e[1] for i in e}
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    for small in (graph.SMALL_EDGES, 0):
        assert dict(map(tuple, graph.components(df, "a", "b", small).collect())) == want


# ---------------------------------------------------------------- 3 and 9


def test_quality_learns(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = crf.fit_quality(docs, labels)
    got = crf.score_documents(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(crf.held_out())
    good, bad = ([r.score for r in got.where(F.col("quality") == q).collect()] for q in (1, 0))
    assert all(0 <= s <= 1 for s in good + bad)
    assert not bad or np.mean([[g > b for g in good] for b in bad]) > 0.9


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    emit, start, move = rng.normal(size=(5, 2)), rng.normal(size=2), rng.normal(size=(2, 2))
    first = np.array([0, 3, 5])
    good, _, log_z = crf.marginals(emit, first, start, move)
    for d in range(2):
        lines = range(first[d], first[d + 1])
        total, per = 0.0, np.zeros(len(lines))
        for path in np.ndindex(*[2] * len(lines)):
            w = start[path[0]] + sum(emit[i, y] for i, y in zip(lines, path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
            total += math.exp(w)
            per += math.exp(w) * np.array(path)
        assert log_z[d] == pytest.approx(math.log(total)) and good[first[d] : first[d + 1], 1] == pytest.approx(per / total)


def test_scores_of_documents_against_brute_force(monkeypatch):
    """Every labelling of the lines, weighted; lines also a few at a time."""
    rng = np.random.default_rng(8)
    texts = ["Good words here, all fine.\n\nGood words here, all fine.\nxx", "", None, "\n", "a b C!\n|||\n", "ONE LINE 123"]
    model = {"w": rng.normal(size=(crf.FEATURES, 2)), "start": rng.normal(size=2), "move": rng.normal(size=(2, 2)), "map": (1.3, -0.2)}
    got = crf.score_texts(model, pa.array(texts))
    for text, score in zip(texts, got):
        x, weight, _ = crf.line_features(*blocks.text_buffer(pa.array([text], pa.string())))
        assert len(x) == len((text or "").split("\n")) and weight.tolist() == [max(1, len(line) + (i + 1 < len(x))) for i, line in enumerate((text or "").split("\n"))]
        emit, total, good = x @ model["w"], 0.0, np.zeros(len(x))
        for path in np.ndindex(*[2] * len(x)):
            w = math.exp(model["start"][path[0]] + sum(emit[i, y] for i, y in enumerate(path)) + sum(model["move"][a, b] for a, b in zip(path, path[1:])))
            total, good = total + w, good + w * np.array(path)
        p = float((good / total * weight).sum() / weight.sum())
        assert score == pytest.approx(1 / (1 + math.exp(-(1.3 * math.log(p / (1 - p)) - 0.2))))
    for size in (1, 7):
        monkeypatch.setattr(crf, "SLICE", size)
        assert crf.score_texts(model, pa.array(texts)) == pytest.approx(got)


def test_many_short_lines():
    """Half a million lines of two bytes: the features are never held together."""
    import tracemalloc

    column = pa.array(["a\n" * 500_000])
    tracemalloc.start()
    emit, weight, first = crf.line_scores(*blocks.text_buffer(column), np.ones((crf.FEATURES, 2)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(emit) == 500_001 and first.tolist() == [0, 500_001] and peak < 400e6


def test_training_stops_at_its_bound_of_lines(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x\n" * 9 if i % 2 else "Nice line.\n" * 9) for i in range(40)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(crf, "train", lambda texts, labels: seen.append(texts))
    monkeypatch.setattr(crf, "TRAIN_LINES", 55)
    crf.fit_quality(docs, labels)
    assert len(seen[0]) == 5


def test_quality_of_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 1), (50, None, None)], "doc_id bigint, quality int, toxic int")
    model = crf.fit_quality(docs, labels)
    got = crf.score_documents(docs.select("doc_id", "text"), model)
    assert got.count() == docs.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    none = crf.fit_quality(docs, labels.limit(0))
    assert {r.score for r in crf.score_documents(docs.select("doc_id", "text"), none).collect()} == {0.5}
    assert crf.keep_good(docs, labels.limit(0)).columns == docs.columns
    assert crf.score_documents(empty(spark), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            for _ in range(1 + i % 5):
                text[rng.randrange(40)] = rng.choice(["vileword", "vilething", "Awful,"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = ordinal.fit_toxicity(docs, lab)
    assert (np.diff(model["thresholds"]) > 0).all()
    got = {r.doc_id: r for r in ordinal.severity(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == (i % 6 == 0) for i in held) / len(held) > 0.95
    assert got[1000].expected_severity == got[1001].expected_severity < 0.5
    off = ordinal.fit_toxicity(docs, lab.where("toxic = 0"))
    assert ordinal.severity(docs, off).where("expected_severity > 1e-9").count() == 0


def test_severity_against_brute_force(spark, docs):
    """Features by regular expressions on the text, weights by hash, grades by the definition of the link."""
    rng = np.random.default_rng(1)
    texts = [r.text for r in docs.select("text").distinct().collect()]
    fold = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    spell = lambda t: Counter(f for w in fold(t) for f in [("word", w), *(("stem", w[:k]) for k in ordinal.PREFIXES if len(w) >= k)])
    known = {}
    for t in texts:  # hash of each feature, from texts of one word
        for w in set(fold(t)):
            if all(b < 128 for b in w) and ("word", w) not in known:
                row, _, h = ordinal.features(pa.array([w.decode()]))
                known.update(zip([("word", w), *(("stem", w[:k]) for k in ordinal.PREFIXES if len(w) >= k)], h.tolist()))
    chosen = sorted(known)[::3]
    assert len({known[f] for f in chosen}) == len(chosen)
    weight = {f: float(rng.normal()) for f in chosen}
    order = sorted(chosen, key=known.get)
    model = {"words": np.array([known[f] for f in order], np.uint64), "w": np.array([weight[f] for f in order]), "thresholds": np.array([0.5, 1.0, 2.5])}
    got = ordinal.severity(docs.select("doc_id", "text", F.col("text").alias("given")), model).collect()
    assert len(got) == docs.count()
    for r in got:
        z = sum(weight[f] * math.log1p(n) for f, n in spell(r.given).items() if f in weight)
        below = [0.0, *(1 / (1 + math.exp(-(t - z))) for t in model["thresholds"]), 1.0]
        grades = [b - a for a, b in zip(below, below[1:])]
        assert r.score == pytest.approx(1 - grades[0]) and r.expected_severity == pytest.approx(sum(i * p for i, p in enumerate(grades)))


# ---------------------------------------------------------------- 4


def test_language_model(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [r for r in brown_lm.score_corpus(docs.select("doc_id", "text")).collect()]
    count, train = Counter(), 0
    tok = lambda t: [*WORDS.findall((t or "").translate(LOW)), None]
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 10:
            count.update(tok(t))
    train, types = sum(count.values()), len(count)
    want = []
    for d, t in rows:
        k = tok(t)
        want.append((d, len(k), sum(count[w] > 0 for w in k), train, round(sum(math.log10((count[w] + 0.1) / (train + 0.1 * (types + 1))) for w in k), 6)))
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=key) == sorted(want, key=key)
    assert all(r.score < 0 for r in got)
    assert brown_lm.score_corpus(empty(spark).select("doc_id", "text")).count() == 0


def test_class_scores_against_brute_force(spark, docs, monkeypatch):
    """The classes are what the exchange found; counts, rates, scores and perplexity are worked out again word by word."""
    seen = {}

    def spy(coded, *args):
        seen["buckets"], seen["best"] = args[2], exchange_all(coded, *args)
        return seen["best"]

    exchange_all, materialize = brown_lm.exchange_all, blocks.materialize
    monkeypatch.setattr(brown_lm, "exchange_all", spy)
    monkeypatch.setattr(blocks, "materialize", lambda df, name: seen.setdefault(name, materialize(df, name)) if name in ("lm-coded", "lm-totals") else materialize(df, name))
    got = {r.doc_id: r for r in brown_lm.score_corpus(docs.select("doc_id", "text").where("doc_id < 104").distinct()).collect()}
    _, group_label, classes = seen["best"]
    told = {}
    for r in sorted(classes.select("block", "bucket", "classes").collect(), key=lambda r: (r.block, r.bucket)):
        told[r.block] = told.get(r.block, b"") + bytes(r.classes)
    kind, unit_of = {}, {}
    replies = seen["lm-totals"].toArrow()
    for r in seen["lm-coded"].collect():
        group = np.frombuffer(r.groups, "<u2")
        keys, own, _ = brown_lm._unit_keys(replies.filter(pa.compute.equal(replies["block"], r.block)), group, seen["buckets"])
        kind.update(zip(np.unique(keys).tolist(), told[r.block]))
        for h, u, alone, g in zip(brown_lm._whole(r.words, "<u8").tolist(), keys.tolist(), own, group.tolist()):
            assert unit_of.setdefault(h if alone else -1 - g, u) == u
    assert len(set(unit_of.values())) == len(unit_of)

    rows = {r.doc_id: r.text for r in docs.where("doc_id < 104").collect()}
    words = lambda t: WORDS.findall((t or "").translate(LOW))
    train = {d: words(t) for d, t in rows.items() if zlib.crc32(str(d).encode()) % 10}
    count = Counter(w for t in train.values() for w in t)
    k = brown_lm.CLASSES

    def at(w):
        if w is None:
            return 0
        _, h, g = brown_lm.tokens(pa.array([w]))
        return kind[unit_of[int(h[0])]] if count[w] >= 2 else int(group_label[g[0]])

    label = {w: at(w) for w in {w for t in rows.values() for w in words(t)} | {None}}
    move, once = np.zeros((k, k)), np.zeros(k)
    for t in train.values():
        for a, b in zip([None, *t], [*t, None]):
            move[label[a], label[b]] += 1
    for w, c in count.items():
        once[label[w]] += c == 1
    total = move.sum(0)
    prior = (total + 0.1) / (total.sum() + 0.1 * k)
    unseen = np.minimum((once + 0.5) / (total + 1), 0.95)
    unseen[0] = 0
    assert set(got) == set(rows)
    for d, t in rows.items():
        score = 0.0
        for a, b in zip([None, *words(t)], [*words(t), None]):
            x, y, c = label[a], label[b], len(train) if b is None else count[b]
            score += math.log10((move[x, y] + brown_lm.BACK_OFF * prior[y]) / (move[x].sum() + brown_lm.BACK_OFF))
            score += min(0.0, math.log10((1 - unseen[y]) * c / total[y] if c else unseen[y]))
        assert got[d].score == pytest.approx(score) and got[d].perplexity == pytest.approx(10 ** (-score / (len(words(t)) + 1)))


def test_long_and_unlike_blocks(spark, monkeypatch):
    """A text longer than a block, pieces of one word, more units than are counted at a time."""
    rng = np.random.default_rng(4)
    key = rng.integers(0, 9 * brown_lm.RANGE * 128, 5000)
    for size in (1, 2 * brown_lm.RANGE, 9 * brown_lm.RANGE):
        k = key[key < size * 128]
        a, b = brown_lm._distinct(k, 128, size), np.unique(k, return_counts=True)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    text = " ".join("w%d" % i for i in range(3000)) + " " + "x" * 5000
    whole = brown_lm.tokens(pa.array([text, "w1 end"]))
    monkeypatch.setattr(brown_lm, "PIECE", 100)
    assert all((x == y).all() for x, y in zip(whole, brown_lm.tokens(pa.array([text, "w1 end"]))))
    long = "ab cd " * (brown_lm.BLOCK_BYTES // 6 + 10)
    got = brown_lm.score_corpus(spark.createDataFrame([(1, long), (2, "ab"), (3, None)], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: 2 * (brown_lm.BLOCK_BYTES // 6 + 10) + 1, 2: 2, 3: 1}


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    pairs = np.zeros((41, 41))
    for a in range(40):  # two kinds of words that follow each other
        for _ in range(60):
            pairs[a, rng.integers(0, 20) + (20 if a < 20 else 0)] += 1
    pairs[40, :20] += 5
    label = brown_lm.exchange(pairs, classes=3)
    assert label[40] == 0 and len(set(label[:20])) == 1 and len(set(label[20:40])) == 1 and label[0] != label[20]


def test_transitions_add_up():
    pairs = np.random.default_rng(1).integers(0, 5, (brown_lm.UNITS, brown_lm.UNITS)) * (np.random.default_rng(2).random((brown_lm.UNITS, brown_lm.UNITS)) < 1e-3)
    model = brown_lm.build_model(pairs, np.ones(brown_lm.GROUPS + 1), np.arange(10, dtype=np.uint64))
    assert (10 ** model["move"]).sum(1) == pytest.approx(1)


def test_words_beyond_the_opening_have_their_own_class(spark):
    """Words that all end alike, none among the `TOP` most frequent, stand where one or another kind of frequent word stands."""
    rng = random.Random(11)
    kinds = [["%s%03dxyz" % (k, i) for i in range(150)] for k in "pq"]
    text = lambda p, q: " ".join(f"le {a} ba la {b} bo" for a, b in zip(p, q))
    fill = ["f%d" % i for i in range(brown_lm.TOP + 50)]
    texts = [" ".join(rng.sample(fill, len(fill))) for _ in range(40)]
    texts += [text(*([rng.choice([rng.choice(k), "%s%d" % (k[0][0], rng.randrange(5))]) for _ in range(10)] for k in kinds)) for _ in range(250)]
    ids = [i for i in range(10000, 20000) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(10000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    p, q = (k[:10] for k in kinds)
    rows = [*zip(ids, texts), (held[0], text(p, q)), (held[1], text(q, p))]
    got = {r.doc_id: r for r in brown_lm.score_corpus(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[held[0]].held_out and got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 5


def test_gains_of_moves():
    rng, n, k = np.random.default_rng(5), 40, 6
    pairs = rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.3)
    pairs[3, 7] = 30
    label = rng.integers(0, k, n)

    def counts(of):
        m = np.zeros((k, k))
        np.add.at(m, (of[:, None], of[None, :]), pairs)
        return m

    others = pairs * (1 - np.eye(n, dtype=int))
    sparse = np.hstack([others @ np.eye(k, dtype=int)[label], others.T @ np.eye(k, dtype=int)[label]])
    at, code = np.nonzero(sparse)
    gain = brown_lm.gains(counts(label), at, code, sparse[at, code], np.diag(pairs), label)
    for u in range(n):
        for c in range(k):
            moved = label.copy()
            moved[u] = c
            assert gain[u, c] - gain[u, label[u]] == pytest.approx(brown_lm.likelihood(counts(moved)) - brown_lm.likelihood(counts(label)), abs=1e-8)


# ---------------------------------------------------------------- 5


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=1500))
def test_media_round_trip(raw):
    payload = media.padded(raw)
    file = media.write_avi(payload)
    index, hist, back = media.decode(file)
    assert back == payload and len(hist) == len(index["frames"]) and (hist.sum(1) == media.WIDTH * media.HEIGHT).all()
    at = 0
    for a, n in index["frames"][:2].tolist():  # the general decoder reads the same coefficients
        co, quant, width, height = media.decode_frame(file[a : a + n])
        assert (width, height) == (media.WIDTH, media.HEIGHT) and (quant == 1).all()
        part = np.where(co < 0, co + 255, co).astype(np.uint8).tobytes()
        assert (payload + bytes(len(part)))[at : at + len(part)] == part
        at += len(part)


def test_media_in_runs_of_frames(monkeypatch):
    """Frames of both kinds, many runs: the same file and payload as in one run."""
    raw = media.padded(bytes(range(250)) * 30 + b"\xff" * 700 + b"abc" * 3000)
    whole = media.write_avi(raw), *media.decode(media.write_avi(raw))[1:]
    monkeypatch.setattr(media, "RUN", 3)
    file = media.write_avi(raw)
    assert file == whole[0] and media.decode(file)[2] == raw and (media.decode(file)[1] == whole[1]).all()


def test_shots_and_rows(spark, docs):
    flat = np.zeros((9, 16), int)
    flat[:4, 2] = flat[4:, 9] = 512
    assert media.shots(flat) == [(0, 4), (4, 9)] and media.shots(flat[:0]) == []
    got = media.read_media(media.encode_media(docs.select("doc_id", "text")))
    for r in got.collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes > 0 and sum(c.frames for c in r.clips) > 0
    by_text = got.join(docs.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.count_distinct("media_sha256").alias("n"))
    assert by_text.where("n > 1").count() == 0
    assert media.clips(got).where("end_s <= start_s").count() == 0
    assert media.read_media(media.encode_media(empty(spark).select("doc_id", "text"))).count() == 0


# ---------------------------------------------------------------- 6


def brute_contamination(rows, items, n=13):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = []
    for i, t in items:
        w = fold(t)
        windows += [("" if i is None else str(i), tuple(w[k : k + n])) for k in range(max(1, len(w) - n + 1))] if w else []
    out = []
    for d, t in rows:
        w, hit, names = fold(t), set(), set()
        for name, p in windows:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    names.add(name)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("shard", [decontaminate.SHARD_WORDS, 40])
def test_contamination(spark, docs, shard):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    source = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(1, " ".join(source[0].split()[5:30]).upper()), (2, source[1]), (10, " ".join(source[2].split()[:6])), (3, None), (4, ""), (None, " ".join(source[3].split()[2:17])), (1, " ".join(source[4].split()[:20]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.judge(decontaminate.find_passages(docs.select("doc_id", "text"), bench, shard_words=shard))
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=key) == sorted(brute_contamination(rows, items), key=key)
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert decontaminate.judge(decontaminate.find_passages(docs.select("doc_id", "text"), bench.limit(0))).where("n_hit > 0").count() == 0


def test_offsets_and_kept_text(spark):
    docs = spark.createDataFrame([(1, "¿Ab, cd! éé-x zz"), (2, None)], "doc_id bigint, body string")
    bench = spark.createDataFrame([(7, "CD éé x")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.find_passages(docs, bench, "body", keep_text=True, offsets=True).collect()}
    assert [got[1].body.encode()[s.start : s.end].decode() for s in got[1].byte_spans] == ["cd! éé-x"] and got[2].byte_spans == []


def test_codes():
    codes = [decontaminate._code(i) for i in (0, 0xD7FE, 0xD7FF, 1_112_062)]
    assert [ord(c) for c in codes] == [1, 0xD7FF, 0xE000, 0x10FFFF]


def test_byte_spans():
    text = "¿Ab, cd! éé-x"
    assert [text.encode()[a:b].decode() for a, b in decontaminate.byte_spans(text, [1, 3, 3, 4])] == ["cd! éé", "x"]


# ---------------------------------------------------------------- 7


def brute_preference(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    head = lambda t: "<|%s|>\n" % t[0]
    show = lambda ts: "".join(head(t) + t[1] + "<|end|>\n" for t in ts)

    def mask(ts):
        out, at = [], 0
        for t in ts:
            lo = at + len(head(t))
            at = lo + len(t[1]) + len("<|end|>\n")
            out += [(lo, at)] if t[0] == "assistant" else []
        return out

    return n, show(a[:n]), show(a[n:]), mask(a[n:]), show(b[n:]), mask(b[n:])


def test_preferences(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "é"), (2, 1, None, None), (3, 0, "user", "only"), (4, 0, "user", "x"), (4, 0, "user", "x"), (5, 1, "assistant", "b"), (5, None, "system", "s")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"), (2, 0, "user", "é"), (2, 1, None, None), (4, 0, "user", "x"), (6, 0, "assistant", "r")]
    schema = "pair_id bigint, turn bigint, role string, text string"
    got = {r.pair_id: r for r in preferences.format_preferences(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}

    def turns(rows, i):
        own = sorted([r for r in rows if r[0] == i], key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:]))
        return [(r[2] or "unknown", r[3] or "") for r in own]

    for i in range(1, 7):
        r = got[i]
        want = brute_preference(turns(chosen, i), turns(rejected, i))
        assert (r.n_prompt_turns, r.prompt, r.chosen, [tuple(m) for m in r.chosen_mask], r.rejected, [tuple(m) for m in r.rejected_mask]) == want
    none = spark.createDataFrame([], schema)
    assert preferences.format_preferences(none, none).count() == 0


# ---------------------------------------------------------------- 8


def water_level(sizes, weights=(1, 2, 3), cap=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), set()
    while True:
        rest, open_w = total - sum(cap * sizes[s] for s in fixed), sum(w[s] for s in names if s not in fixed)
        new = {s for s in names if s not in fixed and rest * w[s] / open_w > cap * sizes[s]} if open_w else set()
        if not new:
            return {s: cap * sizes[s] if s in fixed else rest * w[s] / open_w for s in names}
        fixed |= new


@pytest.mark.parametrize("leaf", [4096, 6])
def test_mixing(spark, docs, leaf):
    rows = docs.collect()
    size = lambda t: len(WORDS.findall(t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    want = water_level(sizes)
    got = mixing.mix_copies(docs, leaf=leaf, fan=2).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r.doc_id), size(r.text)) for r in rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and all(r.target == pytest.approx(want[s]) for r in own)
        share = want[s] / sizes[s] if sizes[s] else 0
        assert all(r.copies in (math.floor(share), math.ceil(share)) or math.isclose(r.copies, share) for r in own if r.size)
        assert abs(sum(r.size * r.copies for r in own) - want[s]) <= max(r.size for r in own)
    again = mixing.mix_copies(docs.repartition(5), leaf=leaf, fan=2).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    taken = Counter(r.doc_id for r in mixing.mix(docs, leaf=leaf, fan=2).collect())
    assert taken == +Counter({k: v for k, v in ((d, sum(r.copies for r in got if r.doc_id == d)) for d in {r.doc_id for r in got}) if v})
    assert mixing.mix_copies(empty(spark)).count() == 0


@pytest.mark.parametrize("words,miss", [(9_000, 0.002), (20_000, 0.04)])
def test_a_large_document_is_decided_first(spark, words, miss):
    """One document holds a fifth or a third of its source's words; the small ones make up for it as far as they reach."""
    rows = [(i, "s%d" % (i % 2), "w " * (words if i in (0, 1) else 7 + i % 5)) for i in range(8000)]
    got = mixing.mix_copies(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()
    assert len(got) == len(rows)
    for s in ("s0", "s1"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) < miss * own[0].target
        share = own[0].target / own[0].source_size
        assert {r.copies for r in own} <= {math.floor(share), math.ceil(share)}


def test_copies_are_unbiased(spark):
    """Many equal rows, ids apart or not: each is taken with its share's probability."""
    rows = [(i % 3000 if i < 6000 else None, "s%d" % (i % 3), "w " * 5) for i in range(9000)]
    got = mixing.mix_copies(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()
    for s in ("s0", "s1", "s2"):
        own = [r for r in got if r.source == s]
        share = own[0].target / own[0].source_size
        for part in ([r for r in own if r.doc_id is None], [r for r in own if r.doc_id is not None]):
            assert sum(r.copies for r in part) / len(part) == pytest.approx(share, abs=0.05)


# ---------------------------------------------------------------- 10


def test_token_files(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = sorted([(r.doc_id, r.text) for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    out = blocks.table_path(spark, "tok")
    manifest = token_files.write_tokens(docs, out, str(public_tokenizers.path("byte_bpe_50k.json")), parts=4)
    assert sum(m["n_docs"] for m in manifest) == len(rows) and manifest[0]["base"] == 0
    got = token_files.read_tokens(spark, out, manifest).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_files.token_output(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(), st.text("aé_1 '\n\tñI'sd.-"), st.sampled_from(["<|endoftext|> x", "a b", "x\x1cy", "日本 語", "½²"])))
def test_encoder_equals_the_library(text):
    import public_tokenizers

    coder = token_files.encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(coder.encode(text), coder.dtype).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- all


def test_clashing_extra_columns(spark, docs):
    """Columns named like the operators' own results stay what they are."""
    extra = docs.withColumn("score", F.lit("mine")).withColumn("n_words", F.lit(7)).withColumn("spans", F.lit("s")).withColumn("node", F.lit(1)).withColumn("size", F.lit(2)).withColumn("copies", F.lit(3))
    bench = spark.createDataFrame([(1, "q w e r t y u i o p a s d f")], "item_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id bigint, quality int")
    wild = extra.withColumns({c: F.lit("x") for c in ("n_bytes", "media", "clips", "shot", "payload_bytes", "feature", "grade", "expected_severity", "n_hit", "item_ids", "contaminated", "held_out", "block", "key", "perplexity", "n_shingles", "component_id", "root", "start", "n_tokens", "kept", "share", "p", "done", "taken", "level", "target")})
    model = crf.fit_quality(docs, labels)
    assert crf.score_documents(wild, model).where("score BETWEEN 0 AND 1").count() == docs.count()
    toxic = ordinal.severity(wild, {"words": np.zeros(0, np.uint64), "w": np.zeros(0), "thresholds": np.array([1.0, 2.0, 3.0])})
    assert toxic.schema["grade"].dataType.simpleString() == "int" and toxic.count() == docs.count()
    seen = media.read_media(media.encode_media(wild))
    assert seen.where("n_bytes >= 0 AND payload_bytes >= 64").count() == docs.count() and media.clips(seen).where("end_s > start_s").count() >= docs.count()
    judged = decontaminate.judge(decontaminate.find_passages(wild, bench, offsets=True))
    assert judged.where("n_hit = 0 AND NOT contaminated AND size(byte_spans) = 0").count() == docs.count()
    for made in (suffix_dedup.remove_repeats(wild), brown_lm.score_corpus(wild), jaccard.near_duplicates(wild), mixing.mix_copies(wild), token_files.token_output(wild)):
        assert made.count() == docs.count()
    talk = spark.createDataFrame([(1, 0, "user", "a", "x", "y"), (1, 1, "assistant", "b", "x", "y")], "pair_id bigint, turn bigint, role string, text string, prompt string, turns string")
    assert [tuple(r) for r in preferences.format_preferences(talk, talk).collect()] == [tuple(r) for r in preferences.format_preferences(talk.drop("prompt", "turns"), talk.drop("prompt", "turns")).collect()]
    for out in (crf.keep_good(extra, labels), jaccard.drop_near_duplicates(extra), decontaminate.decontaminate(extra, bench), mixing.mix(extra)):
        assert out.columns == extra.columns and out.where("n_words <> 7 OR size <> 2 OR copies <> 3 OR score <> 'mine'").count() == 0


def test_word_bounds():
    data, bounds = blocks.text_buffer(pa.array(["a b", None, "", " cd", "e"]))
    start, end, row = blocks.word_bounds(data, bounds)
    assert [(bytes(data[a:b]).decode(), int(r)) for a, b, r in zip(start, end, row)] == [("a", 0), ("b", 0), ("cd", 3), ("e", 4)]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = blocks.materialize(stage(spark, seen[-1], sf_dir), "test")
        assert out.columns == names
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3]
    rows = [(r.doc_id, r.text) for r in seen[1].collect()]
    assert ids[2] == {d for d, _, c in brute_components(rows) if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert ids[3] == {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in seen[2].collect()], items) if not r[5]}
    assert corpus_pipeline.STAGES[-1][1](spark, seen[4], sf_dir).count() == seen[4].count()


@pytest.mark.parametrize("name", ["op2_partenum_jaccard", "op6_decontaminate", "op7_preference_pairs"])
def test_oracle_sql(spark, sf_dir, name):
    import duckdb

    from meridia.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    want = con.sql(queries.ORACLE_SQL[name]).select(*names).fetchall()
    assert sorted(got, key=key) == sorted(want, key=key)
