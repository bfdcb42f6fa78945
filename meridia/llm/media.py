"""Media columns: AVI files of motion JPEG, written losslessly, indexed, decoded and cut into shots.

Writing.  A payload becomes grayscale baseline JPEG frames of 8 x 8 blocks.  The unit that keeps it
losslessly is the quantised DCT coefficient: every byte is one coefficient, the byte's bits being
the magnitude bits of a category-8 coefficient (-255..-128 and 128..255), with all quantisers 1,
64 coefficients a block in zigzag order.  The Huffman tables hold one symbol of eight zero bits
(zero run 0, category 8) and each block ends at a restart marker, so DC prediction starts afresh and every
code is byte-aligned: any baseline decoder can read the frames, and this module reads them as arrays.
The payload's length is in an INFO chunk, since the last frame is filled with zero bytes.

Reading.  RIFF chunks are walked, idx1 gives the frames, frames of our own layout are decoded as one array
and any other grayscale baseline frame by the general decoder.  Features are 16-bin histograms of the
decoded pixels; a cut is where the histogram difference exceeds the mean plus `k` standard deviations of
the differences before it in the current shot, and a floor.  Shots become timed clip rows.

Defined results: null and empty texts are 64 zero bytes; equal texts give equal files and features; a
media value that is null gives nulls and no clips; an empty table gives no rows; a result takes the place of a given
column of its name.  A file is held whole, with about ten bytes a byte of text; frames are decoded `RUN` at a time.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks

UNIT = 64
BLOCKS = 8  # of a frame, side by side
RATE = 25
RUN = 2048  # frames written or decoded at a time
FLOOR = 0.15
WIDTH, HEIGHT = 8 * BLOCKS, 8

#: Fixed values of the JPEG standard: the row-major place of each coefficient in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@functools.cache
def _header(width: int = WIDTH, height: int = HEIGHT) -> bytes:
    one_code = bytes([0, 0, 0, 0, 0, 0, 0, 1, *[0] * 8, 8])  # one code of 8 bits: symbol 8
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + b"\1" * 64)
        + _segment(0xC0, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + one_code)
        + _segment(0xC4, b"\x10" + one_code)
        + _segment(0xDD, b"\0\1")
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


_FRAME_DATA = BLOCKS * 130 - 2


@functools.cache
def _template() -> np.ndarray:
    """A frame whose coefficients are all the byte 0; markers end every block but the last."""
    scan = b"".join(b"\0" * 128 + (bytes([0xFF, 0xD0 + i % 8]) if i < BLOCKS - 1 else b"") for i in range(BLOCKS))
    return np.frombuffer(_header() + scan + b"\xff\xd9", np.uint8)


@functools.cache
def _coefficient_places() -> np.ndarray:
    return (len(_header()) + np.arange(BLOCKS)[:, None] * 130 + 2 * np.arange(64) + 1).ravel()


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def _frames(payload: bytes) -> tuple[bytes, np.ndarray]:
    """(chunks of the frames that hold a part of the payload, size of each frame)."""
    per = BLOCKS * UNIT
    count = max(1, -(-len(payload) // per))
    filled = np.zeros(count * per, np.uint8)
    filled[: len(payload)] = np.frombuffer(payload, np.uint8)
    size = len(_template())
    even = size + size % 2
    rows = np.zeros((count, 8 + even), np.uint8)
    rows[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", size), np.uint8)
    rows[:, 8 : 8 + size] = _template()
    rows[:, 8 + _coefficient_places()] = filled.reshape(count, per)
    sizes = np.full(count, size, np.int64)
    stuffed = (filled.reshape(count, per) == 0xFF).any(1)
    if not stuffed.any():
        return rows.tobytes(), sizes
    head, parts = len(_header()), []
    for i in range(count):  # a coefficient byte FF is followed by a stuffed 0
        if not stuffed[i]:
            parts.append(rows[i].tobytes())
            continue
        frame = rows[i, 8 : 8 + size].tobytes()
        frame = frame[:head] + b"".join(frame[a : a + 128].replace(b"\xff", b"\xff\0") + frame[a + 128 : a + 130] for a in range(head, head + _FRAME_DATA, 130))
        sizes[i] = len(frame)
        parts.append(_chunk(b"00dc", frame))
    return b"".join(parts), sizes


def write_avi(payload: bytes) -> bytes:
    """The payload, whose length is a multiple of 64, as an AVI file."""
    per = BLOCKS * UNIT
    count = max(1, -(-len(payload) // per))
    parts, sizes = [], []
    for i in range(0, count, RUN):
        made, size = _frames(payload[i * per : (i + RUN) * per])
        parts.append(made)
        sizes.append(size)
    movi, sizes = b"".join(parts), np.concatenate(sizes)
    del parts
    offsets = 4 + np.concatenate([[0], np.cumsum(8 + sizes + sizes % 2)[:-1]])
    index = np.zeros((count, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10
    index[:, 2], index[:, 3] = offsets, sizes
    avih = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, count, 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, count, 0, 0, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 24, b"MJPG", WIDTH * HEIGHT * 3, 0, 0, 0, 0)
    headers = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    return _chunk(b"RIFF", b"AVI " + headers + info + _list(b"movi", movi) + _chunk(b"idx1", index.tobytes()))


def _walk(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield bytes(data[at : at + 4]), at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def read_index(media: bytes) -> dict:
    """Frame places and sizes from idx1, seconds a frame, picture size and the INFO comment."""
    data = memoryview(media)
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"comment": b"", "seconds": 1 / RATE, "frames": np.zeros((0, 2), np.int64), "width": 0, "height": 0}
    index, movi = None, 0
    for name, a, b in _walk(data, 12, len(media)):
        kind = bytes(data[a : a + 4])
        if name == b"idx1":
            index = np.frombuffer(data[a:b], "<u4").reshape(-1, 4)
        elif name == b"LIST" and kind == b"movi":
            movi = a
        elif name == b"LIST" and kind in (b"hdrl", b"INFO"):
            for inner, c, d in _walk(data, a + 4, b):
                if inner == b"avih":
                    out["seconds"] = struct.unpack_from("<I", data, c)[0] / 1e6
                    out["width"], out["height"] = struct.unpack_from("<II", data, c + 32)
                elif inner == b"ICMT":
                    out["comment"] = bytes(data[c:d]).rstrip(b"\0")
    if index is not None and len(index):
        video = index[(index[:, 0] >> 16) == int.from_bytes(b"dc", "little")].astype(np.int64)
        absolute = movi + video[:, 2] + 8 if video[0, 2] < movi else video[:, 2] + 8
        out["frames"] = np.column_stack([absolute, video[:, 3]])
    return out


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    codes, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            codes[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def decode_frame(frame: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(coefficients in zigzag order by block, quantisers, width, height) of any grayscale baseline JPEG."""
    at, tables, quant, restart = 2, {}, {}, 0
    width = height = chosen = 0
    ids = (0, 0)
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            height, width, components = struct.unpack_from(">HHB", body, 1)
            if components != 1:
                raise ValueError("only grayscale frames are decoded")
            chosen = body[8]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        at += 2 + size
        if marker == 0xDA:
            ids = (body[2] >> 4, 0x10 | body[2] & 15)
            break
    total = -(-width // 8) * -(-height // 8)
    out = np.zeros((total, 64), np.int64)
    bits = have = 0

    def take(n: int) -> int:
        nonlocal bits, have, at
        while have < n:
            byte = frame[at]
            at += 1
            if byte == 0xFF:
                if frame[at] == 0:
                    at += 1
                else:
                    at, byte = at - 1, 0  # past the data: zeros
            bits, have = bits << 8 | byte, have + 8
        have -= n
        got = bits >> have
        bits &= (1 << have) - 1
        return got

    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("bad Huffman code")

    def value(category: int) -> int:
        got = take(category) if category else 0
        return got if not category or got >> (category - 1) else got - (1 << category) + 1

    dc = 0
    for i in range(total):
        if restart and i and i % restart == 0:
            bits = have = dc = 0
            at += 2
        dc += value(symbol(tables[ids[0]]))
        out[i, 0] = dc
        k = 1
        while k < 64:
            s = symbol(tables[ids[1]])
            if s == 0:
                break
            k += s >> 4
            if s != 0xF0:
                out[i, k] = value(s & 15)
            k += 1
    return out, quant[chosen], width, height


@functools.cache
def _inverse() -> np.ndarray:
    """Zigzag coefficients to row-major pixels."""
    x = np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1.0) / 2
    full = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


def pixels_of(coefficients: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(coefficients.astype(np.float32) @ _inverse() + 128), 0, 255).astype(np.uint8)


def decode(media: bytes) -> tuple[dict, np.ndarray, bytes]:
    """(index, histogram of each frame, payload)."""
    index = read_index(media)
    frames = index["frames"]
    raw = np.frombuffer(media, np.uint8)
    template, places = _template(), _coefficient_places()
    hist = np.zeros((len(frames), 16), np.int64)
    parts = []
    for lo in range(0, len(frames), RUN):
        some = frames[lo : lo + RUN]
        if (some[:, 1] == len(template)).all():
            view = raw[some[:, :1] + np.arange(len(template))]
            stored = view[:, places]
            view[:, places] = 0
            if (view == template).all():
                value = stored.astype(np.int16) - np.where(stored < 128, 255, 0).astype(np.int16)
                pixels = pixels_of(value.reshape(-1, 64)).reshape(len(some), -1)
                hist[lo : lo + RUN] = np.bincount((np.arange(len(some))[:, None] * 16 + (pixels >> 4)).ravel(), minlength=16 * len(some)).reshape(-1, 16)
                parts.append(stored.tobytes())
                continue
        for i, (a, n) in enumerate(some.tolist()):
            coefficients, quant, _, _ = decode_frame(media[a : a + n])
            hist[lo + i] = np.bincount((pixels_of(coefficients * quant) >> 4).ravel(), minlength=16)
            parts.append(np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8).tobytes())
    payload = b"".join(parts)
    if index["comment"].startswith(b"payload="):
        payload = payload[: int(index["comment"][8:])]
    return index, hist, payload


def shots(hist: np.ndarray, k: float = 2.0, floor: float = FLOOR, window: int = 8) -> list[tuple[int, int]]:
    """Frame ranges of shots, by adaptive differences of neighbouring histograms."""
    n = len(hist)
    if not n:
        return []
    share = hist / np.maximum(hist.sum(1, keepdims=True), 1)
    difference = np.abs(np.diff(share, axis=0)).sum(1) / 2
    out, first = [], 0
    for i, d in enumerate(difference.tolist()):
        before = difference[max(first, i - window) : i]
        if d > floor and (len(before) < 2 or d > before.mean() + k * before.std()) and i - first >= 2:
            out.append((first, i + 1))
            first = i + 1
    return [*out, (first, n)]


def describe(index: dict, hist: np.ndarray, found: list[tuple[int, int]]) -> str:
    cuts = ".".join(str(a) for a, _ in found[1:])
    digest = hashlib.md5(hist.astype("<u4").tobytes()).hexdigest()[:16]
    return f"avi-mjpeg {index['width']}x{index['height']} frames={len(hist)} shots={len(found)} cuts={cuts} hist={digest}"


def padded(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


def encode_media(docs: DataFrame, text: str = "text", name: str = "media") -> DataFrame:
    """`docs` with its text replaced by n_bytes and the media file, which take the place of given columns of these names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.chunks(batches, blocks.TEXT):
            rest = [c for c in batch.schema.names if c != blocks.TEXT]
            texts = batch.column(blocks.TEXT).cast(pa.binary()).to_pylist()
            made = [pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([write_avi(padded(t)) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], names=[*rest, "n_bytes", name])

    given, fields = blocks.result_fields(docs.withColumnRenamed(text, blocks.TEXT), "n_bytes", name)
    return given.mapInArrow(run, f"{fields}, n_bytes bigint, `{name}` binary".lstrip(", "))


_READ = pa.schema([
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ("clips", pa.list_(pa.struct([("shot", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())]))),
])


def read_media(df: DataFrame, name: str = "media") -> DataFrame:
    """`df` with its media replaced by what is read back from it: payload digests, a feature text and timed clips (of any given columns of their names too)."""

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * len(_READ)
        index, hist, payload = decode(media)
        found, s = shots(hist), index["seconds"]
        clips = [{"shot": i, "start_s": a * s, "end_s": b * s, "frames": b - a} for i, (a, b) in enumerate(found)]
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(index, hist, found), clips

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.chunks(batches, blocks.TEXT):
            rest = [c for c in batch.schema.names if c != blocks.TEXT]
            columns = zip(*map(one, batch.column(blocks.TEXT).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(c, f.type) for c, f in zip(columns, _READ))], names=[*rest, *_READ.names])

    given, fields = blocks.result_fields(df.withColumnRenamed(name, blocks.TEXT), *_READ.names)
    made = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, clips array<struct<shot:int,start_s:double,end_s:double,frames:int>>"
    return given.mapInArrow(run, f"{fields}, {made}".lstrip(", "))


def clips(read: DataFrame) -> DataFrame:
    """One timed row a shot; its columns take the place of given ones of their names."""
    rows = read.withColumn("clip", F.explode("clips"))
    own = ("clips", "clip", "shot", "start_s", "end_s", "frames")
    return rows.select(*[c for c in read.columns if c.lower() not in own], "clip.*")


def op5_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_media(encode_media(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("clips").alias("n_clips"), "clips")
