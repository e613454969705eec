"""Vectorised hashes of words and of runs of words.

A word is ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 bytes of a text. A word's hash chains a
bijective finaliser over its blocks of eight bytes (long words: XXH3); a window's hash is a
tree of such steps over its words' hashes. ``RunHashes``, for runs of any length, is a
polynomial: structured strings can share one, so it only proposes candidates. All depend on
the content alone, so every task gets the same hash for the same words. Where rows merge,
``digest128`` of the bytes decides, a cryptographic digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Bytes from which on a word is hashed by itself.
LONG_WORD = 64
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64's)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    got = _powers.get((base, inverse))
    if got is None or len(got) < n:
        size = 1 << max(16, (n - 1).bit_length())
        step = pow(base, -1, 1 << 64) if inverse else base
        got = np.full(size, step, _U)
        got[0] = 1
        got = np.cumprod(got, dtype=_U)
        if size <= 1 << 22:  # a very long text's table isn't kept
            _powers[base, inverse] = got
    return got[:n]


class RunHashes:
    """Hashes of runs of some values: of values[start:end] for each run asked for."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum(values * powers(base, n), out=self.prefix[1:])
        self.back = powers(base, n + 1, inverse=True)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[ends] - self.prefix[starts]) * self.back[starts])


class Words:
    """The words of some texts: for each word its hash; for each text its first word.

    ``start`` and ``end`` are byte places in ``data``, the texts joined by line feeds."""

    def __init__(self, texts: list[bytes], salt: int = 0):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        gap = _SPACE[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_end = np.cumsum(size)
        self.first = np.concatenate([[0], np.searchsorted(self.start, self.text_end)]).astype(np.int64)
        self.hash = self.hashes(salt)

    def hashes(self, salt: int) -> np.ndarray:
        size = self.end - self.start
        seed = mix64(np.array([salt + 1], _U))[0]
        h = mix64(size.astype(_U) * _U(_BASES[0]) ^ seed)
        eight = np.ndarray(len(self.data) + 1, "<u8", np.append(self.data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
        todo = np.flatnonzero(size <= LONG_WORD)
        at = 0
        while len(todo):
            rest = size[todo] - at
            block = eight[self.start[todo] + at]
            short = rest < 8
            block[short] &= (_U(1) << (rest[short].astype(_U) * _U(8))) - _U(1)
            h[todo] = mix64((h[todo] ^ block) + _U(_BASES[1]))
            at += 8
            todo = todo[rest > 8]
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), int(seed))
        return h

    def windows(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n words from each word on, which of them lie in one text)."""
        h = self.hash if hashes is None else hashes
        if len(h) < n:
            return np.zeros(0, _U), np.zeros(0, bool)
        at = np.arange(len(h) - n + 1)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return window_hashes(h, n), text[at] == text[at + n - 1]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * _U(_BASES[0]) + mix64(right + _U(_BASES[2])))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values, built from those of runs of 1, 2, 4, ... values."""
    span, power, done, out = 1, h, 0, None
    while True:
        if n & span:
            out = power if out is None else _joined(out[: len(power) - done], power[done:])
            done += span
        if done == n:
            return out[: len(h) - n + 1]
        power = _joined(power[:-span], power[span:])
        span *= 2


def digest128(parts) -> np.ndarray:
    """The 128-bit digests of byte strings, as two int64 each."""
    raw = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def text_chunks(ids, texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in chunks of about ``limit`` bytes; a longer text is a chunk of its own."""
    some, own, size = [], [], 0
    for i, t in zip(ids, texts):
        if own and size + len(t) > limit:
            yield some, own
            some, own, size = [], [], 0
        some.append(i)
        own.append(t)
        size += len(t)
    if own:
        yield some, own


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values (len(h) - width + 1 of them)."""
    span, out = 1, h
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
