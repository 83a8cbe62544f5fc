"""Vectorised hashing of bytes, words and word shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: An odd base for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are hashed together in chunks of about this many bytes, each of which takes some eighty bytes meanwhile; a
#: longer text is a chunk of its own.
CHUNK = 1 << 18
#: Rows of an Arrow batch that are Python strings at once.
SLICE = 1000
#: Bits of a shingle's number; the rest of 64 tells the texts of a chunk apart.
SHINGLE_BITS = 48
MOST_TEXTS = 1 << (64 - SHINGLE_BITS)

_powers = {BASE: np.ones(1, U), INVERSE: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept by the worker for the next chunk."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK + 1024), U(base))
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=U)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit over all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] == (hash of data[i:j]) * BASE**i."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], alike wherever the bytes stand."""
    return mixed((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start])


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.isalnum():
            table[b] = ord(c.lower()) if b < 128 else b
    return table


#: Letters and digits, A-Z lower-cased, and all of UTF-8 beyond ASCII; 0 for what stands between words.
WORD_BYTES = _word_bytes()


def chunks(texts) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, encoded texts) of chunks in order; null is empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if held and (size + len(data) > CHUNK or len(held) >= MOST_TEXTS - 1):
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield first, held


def slices(batch) -> Iterator:
    """An Arrow batch in parts of few rows, so that only those become Python objects together."""
    for i in range(0, batch.num_rows, SLICE):
        yield batch.slice(i, SLICE)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and at which word each text begins, with the end appended."""
    data = WORD_BYTES[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = data > 0
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edges[::2], edges[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return span_hashes(prefix_hashes(data), start, end), np.searchsorted(start, begins)


def shingled(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (number of the text, shingle, times), in that order.

    A text of fewer words, but not none, is one shingle.  Shingles have 48 bits."""
    hashes, at = word_hashes(texts)
    counts = np.diff(at)
    whole = np.zeros(0, U)
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        whole = np.zeros(n, U)
        for j, c in enumerate(powers(BASE, words + 1)[1:]):
            whole += hashes[j : j + n] * c
    owner = np.repeat(np.arange(len(texts)), np.maximum(counts - words + 1, 0))
    first = np.arange(len(owner)) + np.repeat(at[:-1] - np.cumsum(np.maximum(counts - words + 1, 0)) + np.maximum(counts - words + 1, 0), np.maximum(counts - words + 1, 0))
    found = mixed(whole[first]) if len(first) else np.zeros(0, U)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        some = np.array([int((hashes[at[i] : at[i + 1]] * powers(BASE, words + 1)[1 : counts[i] + 1]).sum(dtype=U)) + int(counts[i]) & (1 << 64) - 1 for i in short], U)
        owner, found = np.concatenate([owner, short]), np.concatenate([found, mixed(some)])
    key = np.sort((owner.astype(U) << U(SHINGLE_BITS)) | (found >> U(64 - SHINGLE_BITS)))
    new = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    times = np.diff(new, append=len(key))
    key = key[new]
    return (key >> U(SHINGLE_BITS)).astype(np.int64), (key & U((1 << SHINGLE_BITS) - 1)).astype(np.int64), times
