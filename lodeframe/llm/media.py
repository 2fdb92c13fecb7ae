"""Telephony audio columns: mu-law, A-law and ADPCM payloads, expanded, resampled and stored.

``store`` puts payloads into WAVE containers (one binary column); ``expand``
reads such a column back and returns 16-bit PCM at the asked sample rate.
Mu-law and A-law bytes expand by tables of 256 entries; ADPCM blocks decode
with numpy across all blocks of a batch, sample by sample within a block.

Cases: a null payload is empty; an empty payload gives a WAVE file without
samples and empty PCM; bytes that aren't a WAVE file of a known codec give null
PCM and a null codec; repeated rows stay repeated; other columns are kept.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import documents, tune, written
from .textops import arrow_bytes

RATE = 8000
#: Samples a second of the PCM that is stored for documents: the containers' samples and one between each two.
STORED_RATE = 2 * RATE
#: Samples on each side of a place that resampling reads, where the rate doesn't fall.
REACH = 16
#: How hard the two stored tables are compressed.
PACKED = {"parquet.compression.codec.zstd.level": "9"}
#: Bytes of an ADPCM block: a head of 4 and two samples in each other byte.
BLOCK = 64
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
# Fixed values of the IMA ADPCM format: what a nibble adds to the step's index.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
# Fixed values of the IMA ADPCM format: the 89 step sizes.
STEP = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law byte (G.711)."""
    x = ~np.arange(256) & 0xFF
    size = (((x & 0x0F) << 3) + 0x84 << ((x & 0x70) >> 4)) - 0x84
    return np.where(x & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law byte (G.711)."""
    x = np.arange(256) ^ 0x55
    size, exponent = (x & 0x0F) << 4, (x & 0x70) >> 4
    size = np.where(exponent == 0, size + 8, size + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(x & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) bytes -> (n, 121) samples of mono IMA ADPCM. A step index beyond the table counts as its last entry."""
    n = len(blocks)
    out = np.empty((1 + 2 * (BLOCK - 4), n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for j, byte in enumerate(columns):
        for k, nibble in enumerate((byte & 15, byte >> 4)):
            step = STEP[index]
            # The format's own rounding: (2 * size + 1) * step / 8, bit by bit.
            change = step >> 3
            change += (step >> 2) * (nibble & 1)
            change += (step >> 1) * (nibble >> 1 & 1)
            change += step * (nibble >> 2 & 1)
            value += np.where(nibble & 8, -change, change)
            np.clip(value, -32768, 32767, out=value)
            index += INDEX_STEP[nibble]
            np.clip(index, 0, 88, out=index)
            out[1 + 2 * j + k] = value
    return out.T


#: Resampling weights are whole numbers of this many bits after the point, so that every machine gets the same samples.
WEIGHT_BITS = 30


@lru_cache(64)
def sinc_weights(rate: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, weights): for each phase of the new rate the weights of the samples around a place, a windowed sinc that ends at the lower rate's half and adds up to 1, in units of ``WEIGHT_BITS``."""
    low = min(1.0, to / rate)
    reach = math.ceil(REACH / low)
    offsets = np.arange(1 - reach, reach + 1)
    phase = np.arange(to // math.gcd(rate, to)) * rate % to / to
    x = offsets[None] - phase[:, None]
    w = low * np.sinc(low * x) * np.cos(np.pi * np.clip(x / reach, -1, 1) / 2) ** 2
    return offsets, np.rint(w / w.sum(axis=1, keepdims=True) * (1 << WEIGHT_BITS)).astype(np.int64)


def _sample(total: np.ndarray) -> np.ndarray:
    """16-bit samples of weighted sums."""
    return np.clip(total + (1 << WEIGHT_BITS - 1) >> WEIGHT_BITS, -32768, 32767).astype(np.int16)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit PCM at another rate through a low-pass filter (a windowed sinc); the first and last samples are held beyond the ends."""
    if rate == to or not len(pcm):
        return pcm
    n, (offsets, weights) = len(pcm) * to // rate, sinc_weights(rate, to)
    x, out = pcm.astype(np.int64), np.empty(n, np.int16)
    if to % rate == 0:  # each phase is one filter, and the first one keeps the samples
        near = np.pad(x, (-offsets[0], offsets[-1]), "edge")
        out[:: len(weights)] = pcm
        for p in range(1, len(weights)):
            out[p :: len(weights)] = _sample(np.correlate(near, weights[p], "valid"))
        return out
    step = max(1, (1 << 20) // len(offsets))
    for a in range(0, n, step):
        at = np.arange(a, min(a + step, n), dtype=np.int64)
        near = np.clip((at * rate // to)[:, None] + offsets, 0, len(x) - 1)
        out[a : a + step] = _sample((x[near] * weights[at % len(weights)]).sum(axis=1))
    return out


def packed(pcm: np.ndarray, rate: int, to: int) -> tuple[bytes, bytes | None]:
    """PCM without loss, as it comes from ``rate``: the samples at the old places, and what all samples differ by from those resampled (null if by nothing). Where the new rate isn't a multiple, all samples are kept."""
    kept = pcm[:: to // rate] if to % rate == 0 else pcm
    rest = pcm - resample(kept, rate, to) if len(kept) < len(pcm) else np.zeros(0, np.int16)
    return kept.astype("<i2").tobytes(), rest.astype("<i2").tobytes() if rest.any() else None


def unpacked(kept: bytes, rest: bytes | None, rate: int, to: int) -> np.ndarray:
    """The PCM that was packed."""
    pcm = np.frombuffer(kept, "<i2").astype(np.int16)
    if to % rate:
        return pcm
    pcm = resample(pcm, rate, to)
    return pcm if rest is None else pcm + np.frombuffer(rest, "<i2").astype(np.int16)


def wave(payload: bytes, codec: str = "mulaw", rate: int = RATE) -> bytes:
    """A WAVE file around coded bytes, which stay as they are."""
    bits, align = (4, BLOCK) if codec == "adpcm" else (8, 1)
    per_second = rate * BLOCK // 121 if codec == "adpcm" else rate
    extra = struct.pack("<HH", 2, 121) if codec == "adpcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, per_second, align, bits) + extra
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(data: bytes | None) -> tuple[str, int, bytes] | None:
    """(codec, rate, payload) of a WAVE file of one of the three codecs, else None."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, codec, rate = 12, None, 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", data, at + 8)
            codec = {v: k for k, v in TAGS.items()}.get(tag)
        if kind == b"data":
            return (codec, rate, data[at + 8 : at + 8 + size]) if codec else None
        at += 8 + size + (size & 1)
    return None


def decode(payloads: list[bytes], codec: str) -> list[np.ndarray]:
    """16-bit PCM of each payload; all bytes of the batch expand in one step. Of ADPCM, a last part of a block doesn't count."""
    if codec != "adpcm":
        table = MULAW if codec == "mulaw" else ALAW
        pcm = table[np.frombuffer(b"".join(payloads), np.uint8)]
        return np.split(pcm, np.cumsum([len(p) for p in payloads])[:-1]) if payloads else []
    counts = [len(p) // BLOCK for p in payloads]
    blocks = np.frombuffer(b"".join(p[: c * BLOCK] for p, c in zip(payloads, counts, strict=True)), np.uint8).reshape(-1, BLOCK)
    pcm = adpcm_blocks(blocks)
    return [x.reshape(-1) for x in np.split(pcm, np.cumsum(counts)[:-1])] if payloads else []


def store(df: DataFrame, payload_col: str = "payload", codec: str = "mulaw", rate: int = RATE, media_col: str = "media") -> DataFrame:
    """``df`` with a WAVE file of the payload column's bytes in ``media_col``."""

    @F.pandas_udf("binary")
    def pack(p: pd.Series) -> pd.Series:
        return p.map(lambda x: wave(x or b"", codec, rate))

    return df.withColumn(media_col, pack(F.col(f"`{payload_col}`").cast("binary")))


def expand(df: DataFrame, media_col: str = "media", to_rate: int = 16000) -> DataFrame:
    """``df`` with codec, sample_rate and pcm: little-endian 16-bit samples of the WAVE files, resampled to ``to_rate``."""

    @F.pandas_udf("codec string, sample_rate int, pcm binary")
    def unpack(m: pd.Series) -> pd.DataFrame:
        found = [unwave(x) for x in m]
        pcm: list[bytes | None] = [None] * len(found)
        for codec in TAGS:
            rows = [i for i, f in enumerate(found) if f and f[0] == codec]
            for i, x in zip(rows, decode([found[i][2] for i in rows], codec), strict=True):
                pcm[i] = resample(x, found[i][1], to_rate).astype("<i2").tobytes()
        return pd.DataFrame({"codec": [f and f[0] for f in found], "sample_rate": pd.Series([to_rate if f else None for f in found], dtype="Int32"), "pcm": pcm})

    out = df.withColumn("__wave", unpack(F.col(f"`{media_col}`")))
    for c in ("codec", "sample_rate", "pcm"):
        out = out.withColumn(c, F.col(f"__wave.{c}"))
    return out.drop("__wave")


def features(payloads: list[bytes]) -> list[str]:
    """What the three readings of each payload sound like: mean level and zero crossings of the mu-law and A-law PCM, level, peak and last sample of the ADPCM."""
    out = []
    law = {c: decode(payloads, c) for c in TAGS}
    for i in range(len(payloads)):
        mu, al, ad = (law[c][i] for c in ("mulaw", "alaw", "adpcm"))
        part = []
        for name, x in (("mulaw", mu), ("alaw", al)):
            level = int(np.abs(x.astype(np.int32)).sum()) // max(1, len(x))
            part.append(f"{name}={level}/{int(np.count_nonzero(np.diff(x < 0)))}")
        ad32 = np.abs(ad.astype(np.int32))
        part.append(f"adpcm={int(ad32.sum()) // max(1, len(ad))}/{int(ad32.max(initial=0))}/{int(ad[-1]) if len(ad) else 0}")
        out.append(";".join(part))
    return out


def pcm_feature(pcm: bytes) -> str:
    """Mean level, peak and crc32 of stored PCM."""
    x = np.abs(np.frombuffer(pcm, "<i2").astype(np.int32))
    return f"pcm={int(x.sum()) // max(1, len(x))}/{int(x.max(initial=0))}/{zlib.crc32(pcm):08x}"


def text_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and payload: the text's UTF-8 (null: empty) with bytes 0 up to a positive multiple of 64. JVM only."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(raw)
    whole = F.greatest(F.lit(1), F.ceil(size / BLOCK)).cast("int") * BLOCK
    return documents(docs, id_col, text_col).select(
        "doc_id",
        size.cast("long").alias("n_bytes"),
        F.concat(raw, F.call_function("repeat", F.call_function("chr", F.lit(0)), whole - size).cast("binary")).alias("payload"),
    )


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(media: DataFrame, to_rate: int = STORED_RATE) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm and rest of an expanded table (doc_id, n_bytes, media, pcm): the payloads are read back from the stored files, and the PCM at ``to_rate`` is packed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column("media").to_pylist()
            payloads = [unwave(x)[2] for x in files]
            pcm = [packed(np.frombuffer(x, "<i2").astype(np.int16), RATE, to_rate) for x in b.column("pcm").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id").cast(pa.int64()),
                    "n_bytes": b.column("n_bytes"),
                    "payload_bytes": [len(p) for p in payloads],
                    "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
                    "tail_crc32": [zlib.crc32(p[-64:]) for p in payloads],
                    "media_bytes": [len(x) for x in files],
                    "media_sha256": [hashlib.sha256(x).hexdigest() for x in files],
                    "feature": features(payloads),
                    "pcm": pa.array([k for k, _ in pcm], pa.binary()),
                    "rest": pa.array([r for _, r in pcm], pa.binary()),
                }
            )

    return media.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(read, _DIGEST + ", pcm binary, rest binary")


def heard(stored: DataFrame, to_rate: int = STORED_RATE) -> DataFrame:
    """A digest whose PCM gives way to its feature, read from what is stored and unpacked to ``to_rate``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("feature", "pcm", "rest")], strict=True)
            own = [f"{f};{pcm_feature(unpacked(k, r, RATE, to_rate).astype('<i2').tobytes())}" for f, k, r in rows]
            yield pa.RecordBatch.from_pydict({n: own if n == "feature" else b.column(n) for n in b.schema.names if n not in ("pcm", "rest")})

    return stored.mapInArrow(read, _DIGEST)


def document_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", to_rate: int = STORED_RATE) -> DataFrame:
    """Texts stored as mu-law WAVE files in a table of the shared folder; these are read back, described and expanded, their resampled PCM is stored without loss in a second table, and its feature is read back from there."""
    tune(docs.sparkSession)
    stored = written(store(text_payloads(docs, id_col, text_col), "payload").drop("payload"), "media", **PACKED)
    return heard(written(digest(expand(stored, to_rate=to_rate), to_rate), "pcm", **PACKED), to_rate)
