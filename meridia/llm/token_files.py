"""Token-ID output: flat unsigned integer files plus 64-bit document offsets, memory-mapped.

Documents are range-partitioned by id; every partition writes one file of token ids
(`width`-byte little-endian unsigned integers) and one of 64-bit offsets, both under a name that
only depends on the partition, put in place by an atomic rename: a retried or speculative task
writes the same bytes again.  A partition's base is the prefix sum of the token counts before it;
only those counts (a few numbers a partition) reach the driver, which keeps them in a manifest.

The encoder is the tokenizers library.  Byte-level BPE never merges across the pieces its own
pattern cuts, so a text's ids are its pieces' ids in a row: pieces are cut with an equal pattern and
each distinct piece is given to the library once a worker.  Texts with characters for which the two
patterns could differ, or with the name of an added token, go to the library whole.

Defined results: a null or empty text is the end id alone; rows are ordered by id (nulls first) and
equal ids by text; an empty table writes no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks

END_ID = 0
#: The pattern of the byte-level pre-tokenizer, for texts of the characters in _PLAIN.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters that are letter, decimal digit, space or other in both patterns alike.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ʯЀ-ҁҊ-ԯ‐-‧]")
#: Pieces kept in each of two generations; the older one goes when the newer is full.
_MAX_PIECES = 800_000
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids of texts as little-endian unsigned integers of one width."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self._code = "HI"[self.width == 4]
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(added)) if added else None
        state = json.loads(self.tokenizer.to_str())
        pre = state.get("pre_tokenizer") or {}
        self._by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not state.get("normalizer")
        self._ids: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self._by_piece or _UNUSUAL.search(text) or (self._added and self._added.search(text)):
            return self._whole(text)
        pieces = _PIECES.findall(text)
        try:
            return b"".join([self._ids[p] for p in pieces])
        except KeyError:
            if len(self._ids) > _MAX_PIECES:
                self._old, self._ids = self._ids, {}
            self._learn({p for p in pieces if p not in self._ids})
            return b"".join([self._ids[p] for p in pieces])

    def _learn(self, new: set[str]) -> None:
        ids, old = self._ids, self._old
        unseen = []
        for p in new:
            if p in old:
                ids[p] = old[p]
            else:
                unseen.append(p)
        for p, e in zip(unseen, self.tokenizer.encode_batch_fast(unseen, add_special_tokens=False)):
            ids[p] = array(self._code, e.ids).tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _read_map(uri: str, dtype: str) -> np.ndarray:
    """Memory-mapped where the file system is local, else read."""
    fs, path = _place(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    return np.frombuffer(fs.open_input_file(path).read(), dtype)


def _writer(out: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        blocks.cache("tokens", _encoders.clear)
        fs, root = _place(out)
        end = np.array([end_id], coder.dtype).tobytes()
        stem, mark = f"{root}/part-{part:06d}", uuid.uuid4().hex[:8]
        sizes: list[int] = []
        ids: list[pa.Array] = []
        sink = None
        for batch in blocks.chunks(batches, owner="tokens"):
            sink = sink or fs.open_output_stream(f"{stem}.{mark}.tmp")
            ids.append(batch.column("doc_id"))
            pieces = []
            for text in batch.column("text").to_pylist():
                coded = coder.encode(text or "")
                pieces += (coded, end)
                sizes.append(len(coded) // coder.width + 1)
            sink.write(b"".join(pieces))
        if sink is None:
            return
        sink.close()
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype("<u8")
        with fs.open_output_stream(f"{stem}.{mark}.off") as f:
            f.write(offsets.tobytes())
        keys = pa.table({"doc_id": pa.chunked_array(ids)})
        with fs.open_output_stream(f"{stem}.{mark}.ids") as f, pa.ipc.new_stream(f, keys.schema) as w:
            w.write_table(keys)
        for a, b in (("tmp", "bin"), ("off", "idx"), ("ids", "key")):
            fs.move(f"{stem}.{mark}.{a}", f"{stem}.{b}")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(sizes)], "n_tokens": [int(offsets[-1])], "width": [coder.width]}, schema=_STATS)

    return run


_STATS = pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())])


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None) -> list[dict]:
    """Write the files under `out`; returns the manifest, one entry a partition, also put in ``manifest.json``."""
    spark = blocks.small_batches(docs.sparkSession)
    fs, root = _place(out)
    fs.create_dir(root, recursive=True)
    size = F.octet_length("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(parts or blocks.partitions(spark), F.col("doc_id").asc_nulls_first(), size).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    stats = ordered.mapInArrow(_writer(out, tokenizer, end_id), "part int, n_docs bigint, n_tokens bigint, width int").collect()
    manifest, base = [], 0
    for r in sorted(stats, key=lambda r: r["part"]):
        manifest.append(r.asDict() | {"base": base})
        base += r["n_tokens"]
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _reader(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{out}/part-{row['part']:06d}"
                ids = _read_map(f"{stem}.bin", f"<u{row['width']}")
                at = _read_map(f"{stem}.idx", "<u8").astype(np.int64)
                fs, path = _place(f"{stem}.key")
                keys = pa.ipc.open_stream(fs.open_input_stream(path)).read_all().column("doc_id").combine_chunks()
                for lo in range(0, len(at) - 1, 10_000):
                    hi = min(lo + 10_000, len(at) - 1)
                    crcs = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays([keys[lo:hi], pa.array(at[lo:hi] + row["base"]), pa.array(np.diff(at[lo : hi + 1])), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, out: str, manifest: list[dict], id_type: str = "bigint") -> DataFrame:
    """Per document: where its ids start among all, how many there are, and their checksum as 32-bit integers."""
    rows = [(m["part"], m["width"], m["base"]) for m in manifest]
    tasks = max(1, min(len(rows), 10_000))
    table = spark.createDataFrame(rows, "part int, width int, base bigint").repartition(tasks) if rows else spark.createDataFrame([], "part int, width int, base bigint")
    return table.mapInArrow(_reader(out), f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame, tokenizer: str | None = None, out: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    out = out or blocks.table_path(spark, "tokens")
    return read_tokens(spark, out, write_tokens(docs, out, tokenizer), docs.schema["doc_id"].dataType.simpleString())


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
