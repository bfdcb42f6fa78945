"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark passages.

Words are mapped to code points of the benchmark's own vocabulary (anything else is one code that
no pattern has), so a document becomes a short string of word codes that the automaton scans once.
Matches are word ranges; they are mapped back to byte offsets of the original text.

The benchmark is the side that is sent to every task, so its size is checked: beyond
`shard_words` words it is cut into shards, and the documents pass one shard's automaton after the
other, written to the shared folder between passes.

Defined results: a null or wordless text has no words, no hits and is not contaminated; a null or
wordless item has no window; rows of one item_id are one item; a null item_id counts as an item
whose name is empty; repeated documents are judged alike; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks

WINDOW = 13
SHARD_WORDS = 1_000_000

#: Lower-cases A-Z and blanks every ASCII byte that is neither digit nor letter.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = np.array([b != 32 for b in _FOLD]) & True
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OTHER = "\0"
_built: dict[object, tuple] = {}


def fold_words(text: str | bytes | None) -> list[bytes]:
    """Normalised words of a text."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


def _code(i: int) -> str:
    """Code points but surrogates; a shard has fewer words than there are."""
    return chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800)


def build_automaton(items: list[tuple[object, str | None]], window: int = WINDOW):
    """(word -> code, automaton whose values are (length, item names))."""
    codes: dict[bytes, str] = {}
    patterns: dict[str, set[str]] = {}
    for item_id, text in items:
        words = fold_words(text)
        line = "".join(codes.setdefault(w, _code(len(codes))) for w in words)
        for i in range(max(1, len(line) - window + 1) if line else 0):
            patterns.setdefault(line[i : i + window], set()).add("" if item_id is None else str(item_id))
    automaton = ahocorasick.Automaton()
    for p, names in patterns.items():
        automaton.add_word(p, (len(p), tuple(sorted(names))))
    if patterns:
        automaton.make_automaton()
    return codes, automaton if patterns else None


def scan(words: list[bytes], codes: dict[bytes, str], automaton) -> tuple[list[list[int]], set[str]]:
    """Merged word ranges inside occurrences, and the names of the items that occur."""
    get = codes.get
    spans: list[list[int]] = []
    names: set[str] = set()
    for end, (length, found) in automaton.iter("".join([get(w, _OTHER) for w in words])):
        names.update(found)
        lo = end + 1 - length
        while spans and spans[-1][1] >= lo:  # a longer pattern that ends later may start earlier
            lo = min(lo, spans.pop()[0])
        spans.append([lo, end + 1])
    return spans, names


_OUT = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("item_ids", pa.list_(pa.string()))])


def _pass(shared, window: int, first: bool, last: bool, offsets: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shared.value[0]
        if key not in _built:
            _built.clear()
            _built[key] = build_automaton(shared.value[1], window)
        blocks.cache("decontaminate", _built.clear)
        codes, automaton = _built[key]
        for batch in blocks.chunks(batches, blocks.TEXT, limit=1 << 20, owner="decontaminate"):
            counts, all_spans, all_names = [], [], []
            old = None if first else (batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist())
            for i, text in enumerate(batch.column(blocks.TEXT).cast(pa.binary()).to_pylist()):
                words = fold_words(text)
                spans, names = scan(words, codes, automaton) if automaton and words else ([], set())
                if old:
                    spans = [*zip(old[0][i][::2], old[0][i][1::2]), *spans]
                    names |= set(old[1][i])
                    merged: list[list[int]] = []
                    for lo, hi in sorted(map(tuple, spans)):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(hi, merged[-1][1])
                        else:
                            merged.append([lo, hi])
                    spans = merged
                counts.append(len(words))
                all_spans.append([x for s in spans for x in s])
                all_names.append(sorted(names))
            keep = [c for c in batch.schema.names if c not in _OUT.names and (c != blocks.TEXT or not last)]
            made = [pa.array(x, t) for x, t in zip((counts, all_spans, all_names), _OUT.types)]
            if offsets:
                texts = batch.column(blocks.TEXT)
                places = [[{"start": a, "end": b} for a, b in byte_spans(texts[i].as_py(), s)] if s else [] for i, s in enumerate(all_spans)]
                made.append(pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, *_OUT.names, *(["byte_spans"] if offsets else [])])

    return run


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, keep_text: bool = False, offsets: bool = False) -> DataFrame:
    """`docs` without its text (unless it is kept), plus n_words, spans (flat list of word ranges hit) and item_ids.

    With `offsets`, byte_spans are the same ranges as byte offsets in the original text.  Results take the place of given
    columns of their names.
    """
    spark = docs.sparkSession
    benchmark = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total = benchmark.agg(F.sum(F.regexp_count(_lower("text"), F.lit(_PATTERN)))).first()[0] or 0
    shards = max(1, -(-2 * int(total) // shard_words)) if total > shard_words else 1  # dealt by a hash, a shard of half the size on average stays below it
    if shards > 1:
        benchmark = _pieces(benchmark, window, max(1, shard_words // 8))
    out, fields = blocks.result_fields(docs.withColumnRenamed(text, blocks.TEXT), *_OUT.names, *(["byte_spans"] if offsets else []))
    for k in range(shards):
        part = benchmark if shards == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        rows = [(r[0], r[1]) for r in part.select("item_id", "text").collect()]  # at most a shard
        shared = spark.sparkContext.broadcast((hashlib.sha256(repr((window, rows)).encode()).hexdigest(), rows))
        last = k == shards - 1
        ends = ", byte_spans array<struct<start:bigint,end:bigint>>" if last and offsets else ""
        schema = fields + ("" if last and not keep_text else f", `{blocks.TEXT}` string") + ", n_words bigint, spans array<bigint>, item_ids array<string>" + ends
        out = out.mapInArrow(_pass(shared, window, k == 0, last and not keep_text, last and offsets), schema.lstrip(", "))
        if k < shards - 1:
            out = blocks.materialize(out, "decontaminate")
    return out.withColumnRenamed(blocks.TEXT, text)


def _lower(text: str):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _pieces(benchmark: DataFrame, window: int, size: int) -> DataFrame:
    """Items of many words as pieces that overlap, so that every window lies in one piece."""
    words = F.regexp_extract_all(_lower("text"), F.lit(_PATTERN), F.lit(0))
    cut = benchmark.withColumn("__w", words).withColumn("__n", F.size("__w"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.col("__n") - window) / size).cast("int"), F.lit(0)))
    piece = F.transform(starts, lambda i: F.array_join(F.slice("__w", i * size + 1, F.lit(size + window - 1)), " "))
    return cut.where("__n > 0").select("item_id", F.explode(piece).alias("text"))


def byte_spans(text: str | None, spans: list[int]) -> list[tuple[int, int]]:
    """Byte offsets, in the original UTF-8 text, of word ranges from :func:`find_passages`."""
    data, bounds = blocks.text_buffer(pa.array([text or ""]))
    start, end, _ = blocks.word_bounds(data, bounds, _WORD)
    return [(int(start[a]), int(end[b - 1])) for a, b in zip(spans[::2], spans[1::2])]


def judge(found: DataFrame, share: int = 20) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated (hit words are at least 1/share of all words)."""
    hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), F.lit(0).cast("bigint"), lambda a, i: a + F.get("spans", i + 1) - F.get("spans", i))
    out = found.withColumn("n_hit", F.when(F.size("spans") > 0, hit).otherwise(F.lit(0).cast("bigint")))
    out = out.withColumn("n_items", F.size("item_ids").cast("bigint"))
    out = out.withColumn("items_sha256", F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    names = docs.columns
    found = judge(find_passages(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col("text").alias("__in")), benchmark, "__in", window), share)
    return found.where(~F.col("contaminated")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return judge(find_passages(docs, bench)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN win USING (k, p)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
