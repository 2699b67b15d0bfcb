"""Media columns: motion-JPEG in AVI, stored without loss, read back by RIFF index, and cut into shots.

The unit of storage is the quantised coefficient of baseline JPEG, since samples would be changed by rounding in the
cosine transform. A byte becomes the magnitude bits of a category-8 coefficient, 64 to a block and 1024 to a frame of
32 x 32; category 8 has the one-bit code 0 for DC and AC, and a restart marker behind each block resets the prediction. The
entropy-coded segment of a block is therefore 72 bytes before byte stuffing, so coding and decoding run over whole arrays.

Reading follows the index, parses a frame's segments, decodes its Huffman codes with the tables found there, dequantises and
inversely transforms. Where the tables leave nine bits to every coefficient, as the writer's do, all codes of a file are taken
apart as one array; other frames are decoded symbol by symbol.

Shots are found from histograms of the samples of neighbouring frames: a cut lies where their difference passes both a floor and the mean
plus three deviations of the differences just before it. Clips carry their times at 25 frames a second.

Defined cases: a null text is an empty payload; the payload is padded with zero bytes to a positive multiple of 64, so an
empty text has 64 of them; texts of any length are stored whole; equal texts have equal media, digests and clips; a column
that is named as the result is replaced, and other columns, whatever their names, pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded_batches

UNIT, FRAME, SIDE, FRAME_MS = 64, 1024, 32, 40
BINS, WINDOW, FLOOR, DEVIATIONS = 16, 8, 0.12, 3.0
_BLOCKS = FRAME // UNIT


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbol: int) -> bytes:
    """A Huffman table with one symbol, of one bit."""
    return _segment(0xC4, bytes([kind, 1] + [0] * 15 + [symbol]))


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0] + [1] * 64))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _table(0x00, 8)
    + _table(0x10, 0x08)
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def _coded(values: np.ndarray) -> np.ndarray:
    """Rows of 8 bytes as rows of 9: each byte behind a zero bit."""
    out = np.empty((len(values), 9), np.uint8)
    out[:, 0] = values[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = ((values[:, j - 1] & ((1 << j) - 1)) << (8 - j)) | (values[:, j] >> (j + 1))
    out[:, 8] = values[:, 7]
    return out


def _decoded(coded: np.ndarray) -> np.ndarray:
    out = np.empty((len(coded), 8), np.uint8)
    for j in range(8):
        if (coded[:, j] & (0x80 >> j)).any():
            raise ValueError("a coefficient's code is not that of category 8")
        out[:, j] = ((coded[:, j] & ((1 << (7 - j)) - 1)) << (j + 1)) | (coded[:, j + 1] >> (7 - j))
    return out


def _scans(payload: bytes) -> list[bytes]:
    """The entropy-coded segment of each frame."""
    frames = -(-len(payload) // FRAME)
    values = np.frombuffer(payload.ljust(frames * FRAME, b"\0"), np.uint8).reshape(-1, 8)
    blocks = np.empty((frames * _BLOCKS, 74), np.uint8)
    blocks[:, :72] = _coded(values).reshape(-1, 72)
    blocks[:, 72] = 0xFF
    blocks[:, 73] = 0xD0 + np.arange(len(blocks)) % _BLOCKS % 8
    stuffed = blocks == 0xFF
    stuffed[:, 72:] = False
    grown = stuffed.reshape(frames, -1).sum(axis=1)
    data = np.insert(blocks.ravel(), np.flatnonzero(stuffed) + 1, 0).tobytes()
    ends = np.cumsum(grown + _BLOCKS * 74)
    return [data[a : b - 2] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]  # no marker behind the last block


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode(payload: bytes) -> bytes:
    """An AVI file of motion-JPEG that holds the payload, whose length is a positive multiple of 64."""
    frames = [_HEAD + x + b"\xff\xd9" for x in _scans(payload)]
    largest = max(map(len, frames))
    avih = struct.pack("<14I", FRAME_MS * 1000, largest * 25, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, 25, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    index, at, movi = [], 4, [b"movi"]
    for x in frames:
        movi.append(_chunk(b"00dc", x))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += len(movi[-1])
    body = b"AVI " + hdrl + _chunk(b"plen", struct.pack("<Q", len(payload))) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


@dataclass(frozen=True)
class Frame:
    """What the segments of a baseline JPEG frame say."""

    start: int  # of the entropy-coded segment
    height: int
    width: int
    quantisers: np.ndarray  # 64, in zigzag order
    dc: dict[tuple[int, int], int]  # (bits, code) -> symbol
    ac: dict[tuple[int, int], int]
    restart: int

    @property
    def fixed(self) -> bool:
        """Whether every coefficient has a one-bit code and eight bits of magnitude, and every block a restart marker."""
        return self.dc == {(1, 0): 8} and self.ac == {(1, 0): 8} and self.restart == 1


def _codes(body: bytes) -> dict[tuple[int, int], int]:
    """A Huffman table's symbols by length and code, which counts on through the lengths."""
    out, code, at = {}, 0, 16
    for bits in range(1, 17):
        for symbol in body[at : at + body[bits - 1]]:
            out[bits, code] = symbol
            code += 1
        at += body[bits - 1]
        code <<= 1
    return out


@lru_cache(maxsize=64)
def _parsed(head: bytes) -> Frame:
    at, found = 2, {}
    while at < len(head):
        marker, length = struct.unpack(">xBH", head[at : at + 4])
        found.setdefault(marker, []).append(head[at + 4 : at + 2 + length])
        at += 2 + length
    if 0xC0 not in found or found[0xC0][0][5] != 1:
        raise ValueError("not a baseline frame of one component")
    _, height, width, _, _, _, table = struct.unpack(">BHHBBBB", found[0xC0][0])
    quantisers, codes = {}, {}
    for body in found.get(0xDB, []):
        while body:
            quantisers[body[0]], body = np.frombuffer(body[1:65], np.uint8).astype(np.int64), body[65:]
    for body in found.get(0xC4, []):
        while body:
            size = 17 + sum(body[1:17])
            codes[body[0]], body = _codes(body[1:size]), body[size:]
    scan = found[0xDA][0][2]
    restart = struct.unpack(">H", found[0xDD][0])[0] if 0xDD in found else 0
    return Frame(at, height, width, quantisers[table], codes[scan >> 4], codes[0x10 | scan & 15], restart)


def parse_frame(frame: bytes) -> Frame:
    """The segments of a frame, up to its entropy-coded one."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while True:
        marker, length = struct.unpack(">xBH", frame[at : at + 4])
        at += 2 + length
        if marker == 0xDA:
            return _parsed(frame[:at])


def coefficients(frame: bytes) -> np.ndarray:
    """Quantised coefficients of a frame's blocks in zigzag order, symbol by symbol, with any Huffman tables."""
    f = parse_frame(frame)
    blocks = -(-f.height // 8) * -(-f.width // 8)
    out = np.zeros((blocks, 64), np.int64)
    parts = re.split(rb"\xff[\xd0-\xd7]", frame[f.start : -2])
    each = f.restart or blocks
    for p, part in enumerate(parts):
        bits = "".join(f"{x:08b}" for x in part.replace(b"\xff\x00", b"\xff"))
        at = last = 0

        def symbol(codes: dict, at: int, bits: str = bits) -> tuple[int, int]:
            for n in range(1, 17):
                found = codes.get((n, int(bits[at : at + n], 2)))
                if found is not None:
                    return found, at + n
            raise ValueError("a code that no table has")

        def value(n: int, at: int, bits: str = bits) -> int:
            v = int(bits[at : at + n], 2) if n else 0
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for b in range(p * each, min((p + 1) * each, blocks)):
            n, at = symbol(f.dc, at)
            last += value(n, at)
            at += n
            out[b, 0], k = last, 1
            while k < 64:
                s, at = symbol(f.ac, at)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    out[b, k] = value(s & 15, at)
                    at += s & 15
                k += 1
    return out


_ZIGZAG = sorted(((v, u) for v in range(8) for u in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
_SHIFT = 11


def _basis() -> np.ndarray:
    """The inverse cosine transform from zigzag order to a block's 64 samples, in whole numbers of 2^-11.

    Sums of whole numbers are exact in floating point, so equal frames give equal samples wherever they are decoded.
    """
    scale, angle = np.where(np.arange(8) == 0, np.sqrt(0.5), 1.0), np.pi / 16
    wave = scale[:, None] * np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * angle)  # frequency, place
    return np.stack([np.rint(np.outer(wave[v], wave[u]).ravel() / 4 * (1 << _SHIFT)) for v, u in _ZIGZAG])


_BASIS = _basis()
_BASIS32 = _BASIS.astype(np.float32)


def samples(blocks: np.ndarray, quantisers: np.ndarray) -> np.ndarray:
    """Dequantised and inversely transformed blocks: rows of 64 samples from 0 to 255."""
    if (quantisers == 1).all() and np.abs(blocks).max(initial=0) <= 255:  # every sum stays below 2^24
        raw = blocks.astype(np.float32) @ _BASIS32
    else:
        raw = (blocks * quantisers).astype(np.float64) @ _BASIS
    return np.clip((raw.astype(np.int64) + (1 << (_SHIFT - 1)) >> _SHIFT) + 128, 0, 255).astype(np.uint8)


def chunks(data: bytes, at: int, end: int) -> dict[bytes, tuple[int, int]]:
    """Start and size of each chunk's body by name (lists by their type)."""
    out = {}
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"LIST":
            out[data[at + 8 : at + 12]] = (at + 12, size - 4)
        else:
            out[name] = (at + 8, size)
        at += 8 + size + size % 2
    return out


def frames_of(media: bytes) -> tuple[list[bytes], dict[bytes, tuple[int, int]]]:
    """The frames of an AVI file by its index, and its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    top = chunks(media, 12, 8 + struct.unpack_from("<I", media, 4)[0])
    start, size = top[b"idx1"]
    base = top[b"movi"][0] - 4
    return [media[base + at + 8 : base + at + 8 + n] for _, _, at, n in struct.iter_unpack("<4sIII", media[start : start + size])], top


def decode(media: bytes) -> tuple[bytes, np.ndarray]:
    """The payload that :func:`encode` put into an AVI file, and the samples of its blocks."""
    frames, top = frames_of(media)
    first = parse_frame(frames[0])
    head = frames[0][: first.start]
    if not first.fixed or any(not x.startswith(head) for x in frames):
        blocks = np.concatenate([coefficients(x) for x in frames])
        values = np.where(blocks < 0, blocks + 255, blocks).astype(np.uint8)
    else:  # all codes have nine bits: the frames' segments are decoded as one array
        data = np.frombuffer(b"".join(x[first.start : -2] for x in frames), np.uint8)
        behind = np.concatenate([[False], data[:-1] == 0xFF])
        marker = behind & (data >= 0xD0) & (data <= 0xD7)
        keep = ~(marker | (behind & (data == 0)))
        keep[:-1] &= ~marker[1:]
        values = _decoded(data[keep].reshape(-1, 9)).reshape(-1, UNIT)
        blocks = values.astype(np.int64) - 255 * (values < 128)
    payload = values.tobytes()[: struct.unpack_from("<Q", media, top[b"plen"][0])[0]]
    return payload, samples(blocks, first.quantisers)


def histograms(values: np.ndarray, frames: int) -> np.ndarray:
    """Counts of samples by brightness of each frame; ``values`` are the samples in order, of which the last may be missing."""
    at = np.arange(len(values)) // FRAME * BINS + (values >> 4)
    return np.bincount(at, minlength=frames * BINS).reshape(frames, BINS)


def shots(counts: np.ndarray) -> list[tuple[int, int]]:
    """First frame and end of each shot, from the frames' histograms. A last frame with less than a quarter of its samples
    stays in the shot before it."""
    n = len(counts)
    if n < 2:
        return [(0, n)]
    shares = counts / counts.sum(axis=1, keepdims=True)
    moved = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    if counts[-1].sum() * 4 < counts[0].sum():
        moved[-1] = 0
    first = np.maximum(np.arange(n - 1) - WINDOW, 0)
    seen = np.arange(n - 1) - first
    sums, squares = (np.concatenate([[0], np.cumsum(x)]) for x in (moved, moved**2))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(seen, (sums[:-1] - sums[first]) / seen, 0)
        spread = np.sqrt(np.maximum(np.where(seen, (squares[:-1] - squares[first]) / seen, 0) - mean**2, 0))
    cuts = (np.flatnonzero(moved > np.maximum(FLOOR, mean + DEVIATIONS * spread)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n], strict=True))


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), len(raw)


def _store(texts: pd.Series) -> pd.Series:
    return pd.Series([encode(padded(t)[0]) for t in texts], dtype=object)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, clips array<struct<start_ms:long,end_ms:long>>"


def _read(media: pd.Series) -> pd.DataFrame:
    out = []
    for m in media:
        payload, values = decode(m)
        frames = -(-len(payload) // FRAME)
        counts = histograms(values.ravel()[: len(payload)], frames)  # without the filling of the last frame
        clips = [{"start_ms": a * FRAME_MS, "end_ms": b * FRAME_MS} for a, b in shots(counts)]
        out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), frames, clips))
    return pd.DataFrame(out, columns=[x.split()[0] for x in READ.split(", ")])


def store_media(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """``docs`` with a column of AVI files that hold the texts."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, F.pandas_udf(_store, "binary")(docs[text]))


def read_media(df: DataFrame, media: str = "media", into: str = "read") -> DataFrame:
    """``df`` with what the files give back: digests of payload and file, and the timed clips."""
    bounded_batches(df.sparkSession)
    return df.withColumn(into, F.pandas_udf(_read, READ)(df[media]))


def clip_rows(df: DataFrame, key: str, read: str = "read") -> DataFrame:
    """A row for each clip: key, clip, start_ms, end_ms."""
    return df.select(key, F.posexplode(f"{read}.clips").alias("clip", "c")).select(key, "clip", "c.start_ms", "c.end_ms")
