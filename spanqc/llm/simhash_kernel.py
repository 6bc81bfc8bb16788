"""SimHash fingerprints of texts, in NumPy over batches of UTF-8 bytes."""

from __future__ import annotations

import string
from collections.abc import Iterable

import numpy as np
import xxhash

#: A-Z to lower case, and every separator of words to a blank.
FOLD = bytes.maketrans(
    b"\t\n\x0b\x0c\r" + string.ascii_uppercase.encode(),
    b"     " + string.ascii_lowercase.encode(),
)
#: Row v holds the eight bits of byte v, lowest first.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
#: Shingles whose bits are counted at a time.
BLOCK = 400_000


def shingle_hashes(text: bytes | None, width: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of every run of ``width`` words, repeats included.

    A text of fewer words gives one hash, of all of them; one without words none.
    """
    words = (text or b"").translate(FOLD).split()
    if not words:
        return []
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - width] + 1).tolist()]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """For each run of ``sizes`` hashes, the 64 bits that over half of them set."""
    flat = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    size = np.array(sizes, np.int64)
    owner = np.repeat(np.arange(len(size), dtype=np.int64) * 256, size)
    out = np.zeros((len(size), 8), np.uint8)
    for byte in range(8):
        seen = np.bincount(owner + flat[:, byte], minlength=len(size) * 256).reshape(-1, 256)
        out[:, byte] = np.packbits(2 * (seen @ BITS) > size[:, None], axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)[:, 0]


def fingerprints(texts: Iterable[bytes | None], width: int = 4, seed: int = 42) -> np.ndarray:
    """One unsigned fingerprint for each text; zero where there are no words."""
    done: list[np.ndarray] = []
    hashes: list[int] = []
    sizes: list[int] = []
    for text in texts:
        own = shingle_hashes(text, width, seed)
        hashes += own
        sizes.append(len(own))
        if len(hashes) >= BLOCK:
            done.append(majority(hashes, sizes))
            hashes, sizes = [], []
    return np.concatenate([*done, majority(hashes, sizes)]) if sizes else np.concatenate([*done, np.empty(0, np.uint64)])
