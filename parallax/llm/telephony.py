"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM, and resampled PCM.

A payload of bytes is the coded samples themselves, in a RIFF/WAVE file whose format tag names the codec: one byte a
sample for mu-law (7) and A-law (6), and for ADPCM (17) blocks of 64 bytes, each with its own predictor, step index and
120 nibbles. Decoding expands mu-law and A-law by look-up tables and runs ADPCM over all blocks of a batch at once, one
numpy step a nibble. PCM at 8 kHz is resampled to 16 kHz by linear interpolation in whole numbers. It is stored without
loss in two columns: every second sample, and how far those between are off the mean of their neighbours.

Defined results: a null payload is empty; the payload is padded by zeros to a positive multiple of 64; equal payloads
give equal files and features, as the codec follows from the payload; step indices above 88 count as 88; other columns
are ignored; repeated ids are stored row by row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, others, text_bytes

UNIT, RATE = 64, 8000
CODECS = ("mulaw", "alaw", "adpcm")
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}

# Fixed values of the IMA ADPCM format: quantiser step sizes, and what a nibble's low three bits add to the step index.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
     118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
     1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
     6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
     32767],
    np.int32,
)
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law byte: bits inverted, then sign, three bits of exponent, four of mantissa, bias 132."""
    code = ~np.arange(256) & 255
    value = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of each A-law byte: even bits inverted, then sign, three bits of exponent, four of mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, low = code >> 4 & 7, (code & 15) << 4
    value = np.where(exponent == 0, low + 8, (low + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, value, -value).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """121 samples from each row of 64 bytes: the header's predictor, then one for each nibble, low nibble first."""
    head = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8
    value = np.where(head > 32767, head - 65536, head).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (UNIT - 4), len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * (UNIT - 4)):
        byte = blocks[:, 4 + k // 2]
        nibble = (byte >> 4 if k & 1 else byte & 15).astype(np.int32)
        step = STEPS[index]
        change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_STEP[nibble & 7], 0, 88)
        out[k + 1] = value
    return out.T


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wave(payload: bytes, codec: str) -> bytes:
    """A RIFF/WAVE file whose data chunk is the payload."""
    if codec == "adpcm":
        samples = 1 + 2 * (UNIT - 4)
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * UNIT // samples, UNIT, 4, 2, samples)
        count = samples * (len(payload) // UNIT)
    else:
        fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0)
        count = len(payload)
    body = b"WAVE" + b"".join(
        name + struct.pack("<I", len(part)) + part
        for name, part in ((b"fmt ", fmt), (b"fact", struct.pack("<I", count)), (b"data", payload))
    )
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wave(media: bytes) -> tuple[str, bytes]:
    """Codec and payload of a file of ``to_wave``, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, codec = 12, ""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next(c for c, t in TAGS.items() if t == tag)
        if name == b"data":
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def between(even: np.ndarray, n: int) -> np.ndarray:
    """Means, rounded down, of each sample and the next, for the ``n`` samples between; the last is held."""
    wide = even.astype(np.int32)
    return ((wide + np.append(wide[1:], wide[-1:]))[:n] >> 1).astype(np.int16)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample and the mean, rounded down, of it and the next; the last is held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = between(pcm, len(pcm))
    return out


def pack(pcm: bytes) -> tuple[bytes, bytes]:
    """Samples of even number, and differences of the odd ones from the means of their neighbours, modulo 2^16.

    A lifting step as in lossless wavelets: any 16-bit samples come back from ``unpack`` as they were.
    """
    samples = np.frombuffer(pcm, "<i2")
    even, odd = samples[::2], samples[1::2]
    return even.tobytes(), (odd - between(even, len(odd))).astype("<i2").tobytes()


def unpack(even: bytes, odd: bytes) -> bytes:
    out = np.empty((len(even) + len(odd)) // 2, "<i2")
    out[::2] = np.frombuffer(even, "<i2")
    out[1::2] = np.frombuffer(odd, "<i2") + between(out[::2], len(odd) // 2)
    return out.tobytes()


def store(docs: DataFrame, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media): each text's bytes as the payload of a telephony file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "payload"):
            data, offsets = text_bytes(batch.column("payload"))
            raw = data.tobytes()
            media = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                payload = pad(raw[a:b])
                media.append(to_wave(payload, CODECS[zlib.crc32(payload) % 3]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=[id_column, "n_bytes", "media"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.selectExpr(f"`{id_column}` as id", f"cast(`{column}` as string) as payload").mapInArrow(
        run, f"`{id_column}` {kind}, n_bytes long, media binary"
    )


def read_back(stored: DataFrame, id_column: str = "doc_id", packed: bool = False) -> DataFrame:
    """What the stored files hold: payload digests, features of the decoded sound, and the resampled sound itself.

    The column pcm has 16-bit little-endian samples at 16 kHz, four bytes for each payload byte, or nearly eight for ADPCM.
    With ``packed`` the columns pcm_even and pcm_odd are there instead, from which ``with_pcm`` has it again. Rows of a
    codec are put together within a chunk, as they compress better side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media", 1 << 20):
            files = batch.column("media").to_pylist()
            parts = [from_wave(m) for m in files]
            order = sorted(range(len(parts)), key=lambda i: parts[i][0])
            batch, files, parts = batch.take(pa.array(order)), [files[i] for i in order], [parts[i] for i in order]
            blocks = [np.frombuffer(p, np.uint8).reshape(-1, UNIT) for c, p in parts if c == "adpcm"]
            sound = decode_adpcm(np.concatenate(blocks)) if blocks else None
            at, features, waves = 0, [], []
            for codec, payload in parts:
                if codec == "adpcm":
                    n = len(payload) // UNIT
                    pcm = sound[at : at + n].reshape(-1)
                    at += n
                else:
                    pcm = TABLES[codec][np.frombuffer(payload, np.uint8)]
                wide = np.abs(pcm.astype(np.int32))
                out = resample(pcm).astype("<i2").tobytes()
                sign = pcm < 0
                features.append(
                    f"{codec};samples={len(pcm)};peak={wide.max()};mean_abs={int(wide.sum(dtype=np.int64)) // len(pcm)}"
                    f";crossings={int(np.count_nonzero(sign[1:] != sign[:-1]))}"
                )
                waves.append(out)
            columns = {
                id_column: batch.column(id_column),
                "n_bytes": batch.column("n_bytes"),
                "payload_bytes": pa.array([len(p) for _, p in parts], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for _, p in parts], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(p[-UNIT:]) for _, p in parts], pa.int64()),
                "media_bytes": pa.array([len(m) for m in files], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in files], pa.string()),
                "feature": pa.array(features, pa.string()),
            }
            if packed:
                pairs = [pack(w) for w in waves]
                columns["pcm_even"] = pa.array([even for even, _ in pairs], pa.binary())
                columns["pcm_odd"] = pa.array([odd for _, odd in pairs], pa.binary())
            else:
                columns["pcm"] = pa.array(waves, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = stored.schema[id_column].dataType.simpleString()
    return stored.mapInArrow(
        run,
        f"`{id_column}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, feature string, " + ("pcm_even binary, pcm_odd binary" if packed else "pcm binary"),
    )


def with_pcm(stored: DataFrame) -> DataFrame:
    """The rows of stored packed ``read_back`` with the column pcm, rebuilt from the stored samples and differences."""
    kept = others(stored, ["pcm_even", "pcm_odd"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "pcm_even", 1 << 20):
            waves = [unpack(*p) for p in zip(batch.column("pcm_even").to_pylist(), batch.column("pcm_odd").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(waves, pa.binary())], names=[*kept, "pcm"])

    fields = [stored.schema[c] for c in kept]
    return stored.mapInArrow(run, T.StructType([*fields, T.StructField("pcm", T.BinaryType())]))


def with_pcm_digest(decoded: DataFrame) -> DataFrame:
    """The rows of stored ``read_back`` with size and CRC-32 of the stored samples in the feature, without the samples."""
    feature = F.concat("feature", F.lit(";pcm_bytes="), F.length("pcm"), F.lit(";pcm_crc32="), F.crc32("pcm"))
    return decoded.withColumn("feature", feature).drop("pcm")
