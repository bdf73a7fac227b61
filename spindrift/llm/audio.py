"""Telephony audio: mu-law, A-law and IMA ADPCM to PCM, resampling, and WAV containers.

The companded codes are expanded by lookup tables made from the law's rule; ADPCM is decoded with numpy across
blocks, one step for the i-th sample of all blocks of many recordings; PCM is resampled by a windowed-sinc filter, piece by piece.
All arithmetic on samples is per piece of bounded length, so a long recording needs little more memory than its bytes and its PCM.

`store` keeps a text's bytes as recordings: a null text as an empty one, repeated rows as rows of their own, equal texts as equal recordings. The law (mu-law, A-law or ADPCM
in blocks of 64 bytes) follows from the payload's checksum. `decode_column` gives null for null and for what is no mono WAV file of a known
form. An empty table gives an empty result; other columns are ignored by `store`, carried by `decode_column`, whose `pcm` replaces a column of that name.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.arrow import lean, sliced
from spindrift.llm.scratch import Scratch

PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11
UNIT, PIECE = 64, 1 << 20
#: ADPCM blocks that are decoded at once.
IMA_BLOCKS = 1 << 12
#: Recordings that are decoded at once.
TOGETHER = 64


@cache
def mulaw_table() -> np.ndarray:
    """Linear 16-bit value of each mu-law code: sign, 3-bit exponent, 4-bit mantissa, all inverted, bias 132."""
    code = ~np.arange(256, dtype=np.int64) & 0xFF
    size = (((code & 0xF) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    """Linear 16-bit value of each A-law code: even bits inverted, linear in the lowest segment."""
    code = np.arange(256, dtype=np.int64) ^ 0x55
    step, low = code >> 4 & 7, ((code & 0xF) << 4) + 8
    size = np.where(step == 0, low, low + 256 << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


@cache
def ima_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM: 7, growing by a tenth, as the standard rounds them."""
    # Fixed values.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


#: Change of the step index by the low three bits of a code. Fixed values.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_ima(data: bytes, block_bytes: int) -> np.ndarray:
    """Mono IMA ADPCM blocks to PCM, all blocks at once. A last block that is cut short is padded with zeros."""
    whole = np.frombuffer(data + bytes(-len(data) % block_bytes), np.uint8).reshape(-1, block_bytes)
    out = np.empty((len(whole), 2 * (block_bytes - 4) + 1), np.int16)
    steps = ima_steps()
    for k in range(0, len(whole), IMA_BLOCKS):
        raw, to = whole[k : k + IMA_BLOCKS], out[k : k + IMA_BLOCKS]
        value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
        index = np.minimum(raw[:, 2], 88).astype(np.int32)
        to[:, 0] = value
        for i in range(to.shape[1] - 1):
            c, step = raw[:, 4 + i // 2] >> 4 * (i % 2) & 15, steps[index]
            d = (step >> 3) + (step >> 2) * (c & 1) + (step >> 1) * (c >> 1 & 1) + step * (c >> 2 & 1)
            value = np.clip(np.where(c & 8, value - d, value + d), -32768, 32767)
            index = np.clip(index + IMA_INDEX[c & 7], 0, 88)
            to[:, i + 1] = value
    return out.ravel()


@cache
def _taps(up: int, down: int, half: int = 8) -> np.ndarray:
    """Filter of each of the `up` phases, a row each, of 2 * half taps; every row sums to one."""
    cut = min(1.0, up / down)
    at = np.arange(up)[:, None] / up - (np.arange(2 * half) - half + 1)[None, :]
    taps = np.sinc(at * cut) * np.cos(np.clip(at / half, -1, 1) * math.pi / 2) ** 2
    return (taps / taps.sum(1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, rate: int, to: int) -> Iterator[np.ndarray]:
    """16-bit PCM at another rate, in pieces: ceil(n * to / rate) samples. Beyond its ends the signal is zero."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    half = 8 * max(1, math.ceil(down / up))
    taps = _taps(up, down, half)
    total = -(-len(pcm) * up // down)
    for first in range(0, total, PIECE):
        place = np.arange(first, min(total, first + PIECE), dtype=np.int64) * down
        at, phase = place // up, place % up
        low = int(at[0]) - half + 1
        window = np.zeros(int(at[-1]) + half + 1 - low, np.float32)
        have = pcm[max(0, low) : int(at[-1]) + half + 1]
        window[max(0, low) - low : max(0, low) - low + len(have)] = have
        out = np.zeros(len(at), np.float32)
        for p in range(up):
            own = phase == p
            base = at[own] - low - half + 1
            out[own] = sum(window[base + k] * taps[p, k] for k in range(2 * half))
        yield np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def wav(data: bytes, form: int, rate: int = 8000, block: int = 1, bits: int = 8) -> bytes:
    """A mono WAV file of already coded samples."""
    extra = b"" if form == PCM else struct.pack("<HH", 2, (block - 4) * 2 + 1) if form == IMA else struct.pack("<H", 0)
    speed = rate * bits // 8 if form != IMA else rate * block // ((block - 4) * 2 + 1)
    head = b"fmt " + struct.pack("<IHHIIHH", 16 + len(extra), form, 1, rate, speed, block, bits) + extra
    body = head + b"data" + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(blob: bytes) -> tuple[int, int, int, memoryview]:
    """Format, rate, block size and coded samples of a mono WAV file. Raises ValueError for anything else."""
    if len(blob) < 12 or blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, found = 12, None
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        if name == b"fmt " and size >= 16:
            form, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", blob, at + 8)
            if channels != 1:
                raise ValueError("not mono")
            found = form, rate, block
        elif name == b"data" and found:
            return *found, memoryview(blob)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def expand(form: int, block: int, data: bytes | memoryview) -> np.ndarray:
    """PCM of coded samples."""
    if form == MULAW:
        return mulaw_table()[np.frombuffer(data, np.uint8)]
    if form == ALAW:
        return alaw_table()[np.frombuffer(data, np.uint8)]
    if form == IMA:
        return decode_ima(bytes(data), block)
    if form == PCM:
        return np.frombuffer(data, "<i2")
    raise ValueError(f"format {form}")


def expand_all(coded: list[tuple[int, int, memoryview] | None]) -> list[np.ndarray | None]:
    """PCM of many recordings (form, block, samples). ADPCM blocks of equal size are decoded together; null for null and for unknown forms."""
    out: list[np.ndarray | None] = [None] * len(coded)
    together: dict[int, list[int]] = {}
    for i, x in enumerate(coded):
        if x and x[0] == IMA:
            if x[1] >= 4:  # a block has its head at least
                together.setdefault(x[1], []).append(i)
        elif x:
            try:
                out[i] = expand(*x)
            except ValueError:
                pass
    for block, rows in together.items():
        counts = [-(-len(coded[i][2]) // block) for i in rows]
        pcm = decode_ima(b"".join(bytes(coded[i][2]).ljust(n * block, b"\0") for i, n in zip(rows, counts, strict=True)), block)
        at = 0
        for i, n in zip(rows, counts, strict=True):
            out[i] = pcm[at : at + n * (2 * (block - 4) + 1)]
            at += len(out[i])
    return out


def to_pcm(blobs: list[bytes | None], rate: int = 16000) -> list[bytes | None]:
    """WAV files of resampled 16-bit PCM; null for what is no mono WAV file of a known form."""
    read: list[tuple | None] = []
    for blob in blobs:
        try:
            read.append(read_wav(blob or b""))
        except ValueError:
            read.append(None)
    pcm = expand_all([x and (x[0], x[2], x[3]) for x in read])
    return [None if p is None else wav(b"".join(y.astype("<i2").tobytes() for y in resample(p, x[1], rate)), PCM, rate, 2, 16) for x, p in zip(read, pcm, strict=True)]


def decode_column(media: DataFrame, column: str, rate: int = 16000) -> DataFrame:
    """`media` with pcm: the binary column's recordings as resampled PCM WAV. Null and broken recordings: null."""

    def decode(blobs: pa.Array) -> pa.Array:
        return pa.array([x for k in range(0, len(blobs), TOGETHER) for x in to_pcm(blobs[k : k + TOGETHER].to_pylist(), rate)], pa.binary())

    return media.withColumn("pcm", F.arrow_udf(decode, "binary")(F.col(column)))


def stored_pcm(media: DataFrame, column: str, scratch: Scratch, rate: int = 16000) -> DataFrame:
    """`media` with pcm in the place of the recordings, written as a table and read back. At 16 kHz it takes four times the bytes of mu-law or A-law, eight times those of ADPCM."""
    return scratch.save(decode_column(media, column, rate).drop(column))


def features(blob: bytes) -> str:
    """Length, peak, rounded RMS, sign changes and checksum of a recording of 16-bit PCM."""
    samples = np.frombuffer(read_wav(blob)[3], "<i2")
    peak = energy = changes = 0
    for k in range(0, len(samples), PIECE):
        wide = samples[k : k + PIECE].astype(np.int64)
        peak, energy = max(peak, int(np.abs(wide).max())), energy + int(wide @ wide)
        sign = samples[max(k - 1, 0) : k + PIECE] < 0
        changes += int((sign[1:] != sign[:-1]).sum())
    return f"n={len(samples)};peak={peak};rms={math.isqrt(energy // max(len(samples), 1))};cross={changes};crc={zlib.crc32(samples):08x}"


def recording(payload: bytes, forms: tuple = (MULAW, ALAW, IMA)) -> bytes:
    """A WAV file of 8000 samples a second whose coded samples are the payload, of a multiple of 64 bytes. The form follows from the payload's checksum."""
    form = forms[zlib.crc32(payload) % len(forms)]
    return wav(payload, form, 8000, *((UNIT, 4) if form == IMA else (1, 8)))


def store(texts: DataFrame, forms: tuple = (MULAW, ALAW, IMA)) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as coded samples of a WAV file. Null: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            media = [recording(x + bytes(max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x)), forms) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def digests(stored: DataFrame) -> DataFrame:
    """Digests of recordings (doc_id, n_bytes, media) from the stored bytes, and features read back from the PCM files that they are resampled to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for part in sliced([b], TOGETHER):
                blobs = part.column(2).to_pylist()
                rows = []
                for blob, pcm in zip(blobs, to_pcm(blobs), strict=True):
                    data = read_wav(blob)[3]
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(), features(pcm)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return stored.mapInArrow(lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
