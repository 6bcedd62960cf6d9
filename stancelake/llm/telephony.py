"""Media columns of telephony audio: mu-law, A-law and IMA ADPCM in RIFF/WAVE, to resampled PCM.

mu-law and A-law are expanded by 256-entry tables; ADPCM blocks of a whole batch are decoded side by side
with numpy, one nibble of every block at a time. The PCM is doubled in rate by a half-band interpolator in
integers, so equal media give equal samples everywhere. Rows are handled in map tasks; nothing shuffles.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancelake.llm import text

#: WAVE format tags.
CODECS = {"alaw": 6, "mulaw": 7, "adpcm": 17}

#: Samples a second before resampling, and bytes of nibbles in an ADPCM block behind its header of four bytes.
RATE, ADPCM_BYTES = 8000, 288

# The step sizes of IMA ADPCM and the index changes of a nibble's lower three bits.
STEPS = np.array(
    "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 "
    "1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767".split(),
    np.int32,
)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, exponent = ((code & 15) << 4) + 8, (code >> 4) & 7
    size = np.where(exponent == 0, low, (low + 256) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


#: PCM by code, from the rules of G.711.
MULAW, ALAW = _mulaw(), _alaw()

#: value added for (index, nibble)
_DIFFERENCES = np.array([[(s >> 3) + (s >> 2) * (n & 1) + (s >> 1) * (n >> 1 & 1) + s * (n >> 2 & 1) for n in range(8)] for s in STEPS.tolist()], np.int32)
_DIFFERENCES = np.concatenate([_DIFFERENCES, -_DIFFERENCES], axis=1)


def adpcm_blocks(nibbles: np.ndarray, predictor: np.ndarray, index: np.ndarray) -> np.ndarray:
    """int16 (blocks, 1 + 2 * bytes): the header's sample, then those of the nibble bytes (blocks, bytes), low nibble first, all blocks side by side."""
    codes = np.empty((2 * nibbles.shape[1], len(nibbles)), np.uint8)
    codes[0::2], codes[1::2] = nibbles.T & 15, nibbles.T >> 4
    value, at = predictor.astype(np.int32), np.clip(index.astype(np.int32), 0, 88)
    out = np.empty((len(codes) + 1, len(nibbles)), np.int16)
    out[0] = predictor
    flat, change = _DIFFERENCES.ravel(), np.concatenate([CHANGES, CHANGES])
    for k, code in enumerate(codes, 1):
        value = np.clip(value + flat[at * 16 + code], -32768, 32767)
        at = np.clip(at + change[code], 0, 88)
        out[k] = value
    return out.T


def wrap(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file that holds the payload's bytes as samples, or as nibbles of ADPCM blocks.

    An ADPCM payload is cut into blocks of ADPCM_BYTES behind a header that starts at sample zero; the last is filled
    with zero nibbles, and the fact chunk's sample count, headers' samples included, says how many belong to the payload.
    """
    tag = CODECS[codec]
    if codec == "adpcm":
        blocks = [payload[i : i + ADPCM_BYTES] for i in range(0, len(payload), ADPCM_BYTES)]
        data = b"".join(b"\0\0\0\0" + b.ljust(ADPCM_BYTES, b"\0") for b in blocks)
        align, samples = ADPCM_BYTES + 4, 2 * len(payload) + len(blocks)
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * align // (2 * ADPCM_BYTES + 1), align, 4, 2, 2 * ADPCM_BYTES + 1)
    else:
        data, samples = payload, len(payload)
        form = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    chunks = b"".join(name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1) for name, body in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwrap(media: bytes | None) -> tuple[str, int, int, int, memoryview] | None:
    """(codec, rate, block bytes, samples or -1, data) of a WAVE file; None if it is no such file, of another codec or cut short."""
    if not media or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form, samples, data = 12, None, -1, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        body = memoryview(media)[at + 8 : at + 8 + size]
        if len(body) < size:
            return None
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"fact" and len(body) >= 4:
            samples = struct.unpack_from("<I", body)[0]
        elif name == b"data":
            data = body
        at += 8 + size + (size & 1)
    codec = {tag: codec for codec, tag in CODECS.items()}.get(form[0] if form else None)
    if codec is None or data is None or form[1] != 1 or codec == "adpcm" and form[4] < 5:
        return None
    return codec, form[2], form[4], samples, data


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """Every sample, and between each two the half-band estimate (3, -25, 150, 150, -25, 3) / 256; edges repeat."""
    out = np.empty(2 * len(pcm), np.int16)
    if len(pcm):
        x = np.concatenate([pcm[[0, 0]], pcm, pcm[[-1, -1, -1]]]).astype(np.int32)
        n = len(pcm)
        near, mid, far = x[2 : n + 2] + x[3 : n + 3], x[1 : n + 1] + x[4 : n + 4], x[:n] + x[5 : n + 5]
        out[0::2] = pcm
        out[1::2] = np.clip((150 * near - 25 * mid + 3 * far + 128) >> 8, -32768, 32767)
    return out


def encode(rows: DataFrame, payload: str = "payload", codec: str = "codec", out: str = "media") -> DataFrame:
    """Adds the WAVE file of a payload in the codec that the row names; null for a null payload or unknown codec.

    An empty payload is a file without samples. Equal payloads in one codec are equal files; repeated rows are alike, an
    empty table stays empty. A column `out` that is there already stays, and the new one gets underscores behind its name.
    """

    @F.pandas_udf("binary")
    def files(payloads: pd.Series, codecs: pd.Series) -> pd.Series:
        return pd.Series([wrap(bytes(p), c) if p is not None and c in CODECS else None for p, c in zip(payloads, codecs)], dtype=object)

    return rows.withColumn(text.free_name(rows.columns, out), files(F.col(payload), F.col(codec)))


def decode(rows: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, and codec, rate, payload (the stored codes), pcm (int16, little-endian, twice the rate), peak, crossings, mean_size.

    Null, truncated or foreign media give nulls. peak and mean_size are of the resampled samples, crossings
    counts their sign changes. Repeated rows are alike; an empty table gives no rows. A new column whose name is among
    `keep` gets underscores behind it.
    """
    source, new = text.free_name(list(keep), "media"), {name: text.free_name(list(keep), name) for name in DECODED}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.steps(batch, source):
                found = _decoded(part.column(source))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *found.values()], [*keep, *(new[name] for name in found)])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"`{new[name]}` {kind}" for name, kind in DECODED.items()]
    return rows.select(*keep, F.col(media).alias(source)).mapInArrow(run, ", ".join(kinds))


#: What decode() adds.
DECODED = {"codec": "string", "rate": "int", "payload": "binary", "pcm": "binary", "peak": "int", "crossings": "bigint", "mean_size": "int"}


def store(decoded: DataFrame, path: str) -> DataFrame:
    """Writes what decode() gave as Parquet, by codec, and returns the stored table. PCM has four bytes for a byte of mu-law or A-law, eight of ADPCM."""
    decoded.write.partitionBy("codec").parquet(path)
    return decoded.sparkSession.read.schema(decoded.schema).parquet(path)


def _decoded(media: pa.Array) -> dict[str, pa.Array]:
    """The columns of DECODED for a column of files."""
    found = [unwrap(m.as_py()) for m in media]
    payloads: list = [None] * len(found)
    pcm: list = [None] * len(found)
    blocks: dict[int, list[tuple[int, np.ndarray, int]]] = {}
    for i, item in enumerate(found):
        if item is None:
            continue
        codec, _, align, samples, data = item
        codes = np.frombuffer(data, np.uint8)
        if codec == "adpcm":
            # a last block may be short: it is filled up here, and its samples end where its bytes do
            rest = len(codes) % align
            there = len(codes) // align * (2 * align - 7) + (2 * rest - 7 if rest > 3 else 0)
            whole = np.concatenate([codes, np.zeros(-len(codes) % align, np.uint8)]).reshape(-1, align)
            blocks.setdefault(align, []).append((i, whole, there if samples < 0 else min(samples, there)))
        else:
            payloads[i], pcm[i] = codes.tobytes(), (MULAW if codec == "mulaw" else ALAW)[codes]
    for align, mine in blocks.items():
        stacked = np.concatenate([whole for _, whole, _ in mine])
        heads = np.ascontiguousarray(stacked[:, :4])
        decoded = adpcm_blocks(stacked[:, 4:], heads[:, :2].copy().view("<i2")[:, 0], heads[:, 2])
        at = 0
        for i, whole, samples in mine:
            rows = slice(at, at + len(whole))
            at += len(whole)
            per = 2 * align - 7
            n_nibbles = samples - (samples + per - 1) // per  # each block begins with the sample of its header
            payloads[i] = whole[:, 4:].tobytes()[: n_nibbles // 2]
            pcm[i] = decoded[rows].reshape(-1)[:samples]
    peaks, crossings, sizes, out = [], [], [], []
    for x in pcm:
        if x is None:
            peaks.append(None), crossings.append(None), sizes.append(None), out.append(None)
            continue
        y = double_rate(x)
        wide = np.abs(y.astype(np.int32))
        peaks.append(int(wide.max()) if len(y) else 0)
        crossings.append(int(np.count_nonzero((y[1:] < 0) != (y[:-1] < 0))))
        sizes.append(int(wide.sum(dtype=np.int64) // max(1, len(y))))
        out.append(y.astype("<i2").tobytes())
    return {
        "codec": pa.array([f and f[0] for f in found], pa.string()),
        "rate": pa.array([f and 2 * f[1] for f in found], pa.int32()),
        "payload": pa.array(payloads, pa.binary()),
        "pcm": pa.array(out, pa.binary()),
        "peak": pa.array(peaks, pa.int32()),
        "crossings": pa.array(crossings, pa.int64()),
        "mean_size": pa.array(sizes, pa.int32()),
    }
