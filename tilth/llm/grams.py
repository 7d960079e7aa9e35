"""Hashes of words and of word n-grams, and the counting of hashes over blocks of documents.

Words are hashed from the UTF-8 buffer of many texts at once: a running polynomial over random byte values gives every
word's hash as a difference, which a final mix spreads. Hashes have 64 bits; two of a billion different n-grams fall
together with a chance of a few per cent, two given ones never in practice.

Corpus counts move as packed arrays, not as rows: each block of documents sends a shard its sorted distinct hashes, the
shard adds up all blocks' counts and answers each block in the order of its hashes. A value that is in all documents
arrives once a block, so no value is hot. What travels is a hash's top `bits`, as many as keep the chance that two
n-grams of the corpus share them below a bound that does not depend on its size. Shards hold a set number of bytes, so
a message between a block and a shard shrinks as the corpus grows, and there are never more messages than hashes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18
_POWERS: list[np.ndarray] = []
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * _CHUNK)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b), np.uint64)])) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def _hash_few(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edge if space[0] else np.concatenate([[0], edge])
    starts, stops = starts[0::2], starts[1::2]
    starts = starts[: len(stops)]
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(_BASE))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lowered, text after text, and the number of words of each text."""
    held, size, hashes, counts = [], 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1]) + 1
        if size >= _CHUNK:
            h, n = _hash_few(held)
            hashes.append(h)
            counts.append(n)
            held, size = [], 0
    if held:
        h, n = _hash_few(held)
        hashes.append(h)
        counts.append(n)
    return np.concatenate(hashes), np.concatenate(counts).astype(np.int64)


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The hash of a sequence of words, given as arrays of the first words, the second words and so on."""
    total = np.full(len(parts[0]), np.uint64(len(parts)), np.uint64)
    for part in parts:
        total = mix(total * np.uint64(_BASE) + part)
    return total


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: runs of so many words, or all words where there are fewer."""
    words, counts = word_hashes(texts)
    if len(words) >= size:
        every = joined([words[k : len(words) - size + 1 + k] for k in range(size)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(every[at : at + n - size + 1]))
        elif n:
            out.append(joined([words[at + k : at + k + 1] for k in range(n)]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def bits_for(total: int, spare: int) -> int:
    """How many bits of a hash tell the n-grams of so many bytes of text apart but for a share of 2 ** -spare."""
    return min(64, max(1, total).bit_length() + spare)


def _planes(values: np.ndarray, random: int) -> bytes:
    """Byte plane by byte plane up to the highest in use; those from `random` on are compressed."""
    used = max(1, (int(values.max()).bit_length() + 7) // 8)
    random = min(random, used)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:used]
    return struct.pack("<IBB", len(values), used, random) + planes[:random].tobytes() + zlib.compress(planes[random:].tobytes(), 1)


def _from_planes(data: bytes) -> np.ndarray:
    n, used, random = struct.unpack_from("<IBB", data)
    raw = data[6 : 6 + n * random] + zlib.decompress(data[6 + n * random :])
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = np.frombuffer(raw, np.uint8).reshape(used, n).T
    return out.view("<u8").ravel()


def pack(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences. The low planes of differences are random and stay as they are."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    return _planes(steps, int(keys[-1] // np.uint64(len(keys))).bit_length() // 8)


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data), dtype=np.uint64) if data else np.zeros(0, np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return _planes(counts.astype(np.uint64), 0) if len(counts) else b""


def unpack_counts(data: bytes) -> np.ndarray:
    return _from_planes(data).astype(np.int64) if data else np.zeros(0, np.int64)


def shards_of(keys: np.ndarray, shards: int, bits: int = 64) -> Iterator[tuple[int, int, int]]:
    """(shard, start, end) of sorted hashes of so many bits: shards are equal ranges of the hash."""
    width = (1 << bits) // shards + 1
    cuts = np.searchsorted(keys, np.array([k * width for k in range(1, shards)], np.uint64)) if shards > 1 else np.zeros(0, int)
    bounds = [0, *cuts.tolist(), len(keys)]
    for k in range(shards):
        if bounds[k] < bounds[k + 1]:
            yield k, bounds[k], bounds[k + 1]


def dealt(df: DataFrame, column: str, parts: int) -> DataFrame:
    """df with a partition for each value 0 .. parts - 1 of the column, so that tasks grow in number, not in size."""
    return df.repartitionById(parts, F.col(column))


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of sorted distinct hashes, the counts of its hashes added over all arrays."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.cumsum(first) - 1
    totals = np.bincount(group, np.concatenate(counts)[order]).astype(np.int64)
    back = np.empty(len(every), np.int64)
    back[order] = totals[group]
    return np.split(back, np.cumsum([len(k) for k in keys])[:-1])
