"""SimHash fingerprints of whole texts over 3-word shingles."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from xxhash import xxh64_intdigest


def fingerprint(text: bytes, width: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """64-bit fingerprint of UTF-8 ``text``: a bit is 1 if set in over half of the shingles' hashes; no words: 0.

    Only A-Z are lower-cased; words are runs of bytes other than space and 0x09-0x0D; repeated shingles count again.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), seed)
    return majority(shingle_hashes(words, width, seed), block)


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """Hashes of the ``width``-word shingles of at least so many words, repeats included."""
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)), repeat(seed)), "<u8", len(words) - width + 1)


def majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[k : k + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])
