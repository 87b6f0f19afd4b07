"""Numpy work on many texts at once: one byte buffer, word spans, rolling-hash values.

Used inside Arrow batches that Spark deals out; memory follows ``CHUNK`` or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one round of numpy calls.
CHUNK = 1 << 18
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits of ASCII, and every byte of a longer character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**61)) * 8 + 5
_tables: dict[str, np.ndarray] = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_tables["pow"]) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            full = np.full(size, np.uint64(base))
            full[0] = 1
            _tables[name] = np.multiply.accumulate(full)
    return _tables["pow"], _tables["inv"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """H with H[e] - H[s], times the inverse power of s, the hash of bytes s..e."""
    table = _BYTE[LOWER] if lower else _BYTE
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span stands; length is mixed in."""
    raw = (h[ends] - h[starts]) * _powers(len(h))[1][starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width`` consecutive values: a rolling polynomial (Rabin-Karp), finalised."""
    power, inverse = _powers(len(values) + 1)
    h = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=h[1:])
    n = max(0, len(values) - width + 1)
    return mixed((h[width : width + n] - h[:n]) * inverse[:n])


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``most`` bytes, at least one text each."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= most):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts after one space each, with one at the end; and the place of each text (n + 1 values)."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    at = np.ones(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    at[1:] += 1
    return data, at


def word_spans(data: np.ndarray, at: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and how many words each text has."""
    s, e = spans(~SPACES[data] if word is None else word[data])
    return s, e, np.diff(np.searchsorted(s, at))


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, which general compression makes small."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def rising(x: np.ndarray) -> bytes:
    """Planes of the steps between ascending 64-bit hashes."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def from_rising(blob: bytes) -> np.ndarray:
    return np.cumsum(from_planes(blob, np.uint64), dtype=np.uint64)
