"""Telephony audio in WAV containers: mu-law and A-law by lookup table, IMA ADPCM by numpy across blocks, resampling.

Null and empty texts or media have a defined form (64 zero bytes; null PCM); repeated rows are repeated, equal ones give
equal values; texts of any length are stored whole; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.docmap import map_documents, utf8_list

PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 0x11  # WAV format tags


def mu_law_table() -> np.ndarray:
    """16-bit sample of each mu-law code (G.711): inverted bits, sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit sample of each A-law code (G.711): every other bit inverted, sign, 3-bit exponent, 4-bit mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


EXPAND = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def compress(samples: np.ndarray, law: int) -> np.ndarray:
    """The code whose sample is nearest, the first of equals."""
    table = EXPAND[law].astype(np.int32)
    order = np.argsort(table, kind="stable")
    middle = (table[order][1:] + table[order][:-1]) / 2
    return order[np.searchsorted(middle, samples)].astype(np.uint8)


def adpcm_steps() -> np.ndarray:
    """The 89 IMA step sizes by their rule: from 7, each about 1.1 times the last; fixed values, in order."""
    return np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


STEPS = adpcm_steps()
#: Change of the step index by the code's lower three bits.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _adpcm_step(code: np.ndarray, sample: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = STEPS[index]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.clip(sample + np.where(code & 8, -change, change), -32768, 32767), np.clip(index + INDEX_CHANGE[code], 0, 88)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks (rows of bytes): all blocks advance together, one code at a time."""
    blocks = np.ascontiguousarray(blocks, np.uint8)
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    body = blocks[:, 4:]
    codes = np.stack([body & 0x0F, body >> 4], 2).reshape(len(blocks), -1).astype(np.int32)
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = sample
    for k in range(codes.shape[1]):
        sample, index = _adpcm_step(codes[:, k], sample, index)
        out[:, k + 1] = sample
    return out


def encode_adpcm(samples: np.ndarray, block_bytes: int = 256) -> np.ndarray:
    """Blocks of mono IMA ADPCM; the last is filled with its last sample.  For round trips and fixtures."""
    per = (block_bytes - 4) * 2 + 1
    n = max(1, -(-len(samples) // per))
    rows = np.pad(samples.astype(np.int32), (0, n * per - len(samples)), "edge" if len(samples) else "constant").reshape(n, per)
    blocks, index, sample = np.zeros((n, block_bytes), np.uint8), np.zeros(n, np.int32), rows[:, 0]
    blocks[:, :2] = sample.astype("<i2")[:, None].view(np.uint8)
    codes = np.zeros((n, per - 1), np.int32)
    for k in range(1, per):
        step, apart = STEPS[index], rows[:, k] - sample
        size, code = np.abs(apart), np.where(apart < 0, 8, 0)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            over = size >= part
            code, size = code | np.where(over, bit, 0), size - np.where(over, part, 0)
        codes[:, k - 1] = code
        sample, index = _adpcm_step(code, sample, index)
    blocks[:, 4:] = codes[:, 0::2] | codes[:, 1::2] << 4
    return blocks


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate, rounded to the nearest (halves to even); the samples' ends are held.

    Going down, frequencies that the new rate can't hold are taken out first, by a windowed sinc filter.
    """
    if rate <= 0 or to <= 0:
        raise ValueError("sample rates must be positive")
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    if to == 2 * rate:
        wide = samples.astype(np.int32)
        twice = wide[:-1] + wide[1:]
        out = np.empty(2 * len(wide), np.int16)
        out[0::2] = wide
        out[1:-1:2] = (twice + ((twice >> 1) & 1)) >> 1
        out[-1] = wide[-1]
        return out
    wide = samples.astype(np.float64)
    if to < rate:
        half = 16 * -(-rate // to)
        at = np.arange(-half, half + 1)
        kernel = np.sinc(at * to / rate) * np.hanning(2 * half + 3)[1:-1]
        wide = np.convolve(np.pad(wide, half, "edge"), kernel / kernel.sum(), "valid")
    at = np.arange(len(samples) * to // rate) * (rate / to)
    return np.clip(np.rint(np.interp(at, np.arange(len(samples)), wide)), -32768, 32767).astype(np.int16)


def wav(tag: int, data: bytes, rate: int = 8000, block: int = 1, bits: int = 8, samples: int | None = None) -> bytes:
    """A mono WAV file; formats other than PCM have the fact chunk."""
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if tag == IMA_ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    per_second = rate * bits // 8 if tag != IMA_ADPCM else rate * block // ((block - 4) * 2 + 1)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, block, bits) + extra
    chunks = [(b"fmt ", fmt)] + ([] if tag == PCM else [(b"fact", struct.pack("<I", (len(data) if samples is None else samples) & 0xFFFFFFFF))]) + [(b"data", data)]
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(data: bytes) -> dict:
    """tag, rate, block and data of a WAV file; ValueError for anything else."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, out = 12, {}
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            out["tag"], out["channels"], out["rate"], _, out["block"], out["bits"] = struct.unpack_from("<HHIIHH", data, at + 8)
        elif kind == b"data":
            out["data"] = data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    if "tag" not in out or "data" not in out:
        raise ValueError("a WAV file without format or data")
    return out


def samples_of(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples of a mono telephony WAV file, and their rate; ValueError for what is none."""
    x = read_wav(media)
    if x["channels"] != 1:
        raise ValueError("telephony audio has one channel")
    if x["tag"] in EXPAND:
        return EXPAND[x["tag"]][np.frombuffer(x["data"], np.uint8)], x["rate"]
    if x["tag"] == IMA_ADPCM:
        if x["block"] < 5:
            raise ValueError("an ADPCM block has a header and codes")
        whole = len(x["data"]) // x["block"] * x["block"]
        return decode_adpcm(np.frombuffer(x["data"][:whole], np.uint8).reshape(-1, x["block"])).ravel(), x["rate"]
    if x["tag"] == PCM and x["bits"] == 16:
        return np.frombuffer(x["data"][: len(x["data"]) // 2 * 2], "<i2"), x["rate"]
    raise ValueError(f"WAV format {x['tag']} is not telephony audio")


def to_pcm(media: bytes, rate: int = 16000) -> np.ndarray:
    """16-bit samples of a mono telephony WAV file at ``rate``."""
    return resample(*samples_of(media), rate)


def features(pcm: np.ndarray, rate: int) -> str:
    """Samples, level, peak, zero crossings and CRC-32 of PCM, as one string."""
    wide = pcm.astype(np.float64)
    level = float(np.sqrt(np.mean(wide * wide))) if len(pcm) else 0.0
    signs = pcm >= 0
    crossings = int(np.count_nonzero(signs[1:] != signs[:-1]))
    peak = int(np.abs(pcm.astype(np.int32)).max(initial=0))
    return f"rate={rate};n={len(pcm)};rms={level:.3f};peak={peak};zc={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def transcode(media: DataFrame, id_col: str = "media_id", media_col: str = "media", rate: int = 16000) -> DataFrame:
    """media_id, pcm (a 16-bit WAV file at ``rate``), feature: telephony WAV files decoded and resampled.

    Null or unreadable media give null pcm and feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, feats = [], []
            for m in batch.column(1).to_pylist():
                try:
                    pcm = to_pcm(m, rate) if m is not None else None
                except (ValueError, struct.error):
                    pcm = None
                out.append(None if pcm is None else wav(PCM, pcm.astype("<i2").tobytes(), rate, 2, 16))
                feats.append(None if pcm is None else features(pcm, rate))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(feats, pa.string())], names=["media_id", "pcm", "feature"])

    return media.selectExpr(f"cast({id_col} as bigint) media_id", f"cast({media_col} as binary) media").mapInArrow(run, "media_id long, pcm binary, feature string")


#: Bytes of payload in one ADPCM block, which has a header of 4 bytes before them.
ADPCM_BODY = 64


def pack_payload(payload: bytes) -> tuple[int, bytes]:
    """(format tag, WAV file) of a payload of a multiple of 64 bytes: by its CRC-32 as mu-law codes, A-law codes, or the
    4-bit codes of ADPCM blocks whose headers are zero."""
    tag = (MU_LAW, A_LAW, IMA_ADPCM)[zlib.crc32(payload) % 3]
    if tag != IMA_ADPCM:
        return tag, wav(tag, payload)
    blocks = np.zeros((len(payload) // ADPCM_BODY, ADPCM_BODY + 4), np.uint8)
    blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, ADPCM_BODY)
    return tag, wav(tag, blocks.tobytes(), block=ADPCM_BODY + 4, bits=4, samples=len(blocks) * (2 * ADPCM_BODY + 1))


def read_payload(media: bytes) -> bytes:
    """The payload of ``pack_payload``'s file."""
    x = read_wav(media)
    return x["data"] if x["tag"] != IMA_ADPCM else np.frombuffer(x["data"], np.uint8).reshape(-1, x["block"])[:, 4:].tobytes()


def store_payloads(docs: DataFrame, rate: int = 8000, to: int = 16000, with_media: bool = False, group: int = 1 << 20) -> DataFrame:
    """Texts' bytes as telephony WAV files, read back, and the stored PCM at ``to``: digests, and features of the PCM.

    The payload is the UTF-8 text (null: empty) and zero bytes up to a positive multiple of 64.  A byte is one sample
    code of mu-law or A-law, or two of ADPCM, by the payload's CRC-32; nothing is lost.  PCM is a 16-bit WAV file.
    ``with_media``: also the files themselves, as ``media`` and ``pcm``.  ADPCM files are decoded together, in groups of
    about ``group`` bytes.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256", *(["media", "pcm"] if with_media else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *([pa.binary(), pa.binary()] if with_media else [])]

    def decoded(files: list[tuple[int, bytes]]) -> list[np.ndarray]:
        """Samples of each file; the blocks of all ADPCM files advance together."""
        out = [samples_of(m)[0] if tag != IMA_ADPCM else None for tag, m in files]
        data = [np.frombuffer(read_wav(m)["data"], np.uint8).reshape(-1, ADPCM_BODY + 4) if tag == IMA_ADPCM else None for tag, m in files]
        if any(d is not None for d in data):
            rows, at = decode_adpcm(np.concatenate([d for d in data if d is not None])), 0
            for k, d in enumerate(data):
                if d is not None:
                    out[k] = rows[at : at + len(d)].ravel()
                    at += len(d)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, k = utf8_list(batch.column(1)), 0
            while k < len(texts):
                j, size = k, 0
                while j < len(texts) and (j == k or size + len(texts[j]) <= group):
                    size += len(texts[j])
                    j += 1
                files = [pack_payload(t + b"\0" * (-len(t) % 64 if t else 64)) for t in texts[k:j]]
                cols: list[list] = [[] for _ in kinds]
                for text, (_, media), samples in zip(texts[k:j], files, decoded(files), strict=True):
                    payload, pcm = read_payload(media), resample(samples, rate, to)
                    stored = wav(PCM, pcm.astype("<i2").tobytes(), to, 2, 16)
                    row = [len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(pcm, to), len(stored), hashlib.sha256(stored).hexdigest(), media, stored]
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, j - k), *(pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True))], names=names)
                k = j

    more = ", media binary, pcm binary" * with_media
    return map_documents(docs, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string" + more)
