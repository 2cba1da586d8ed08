"""Word hashes of texts by numpy, for work inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_values() -> np.ndarray:
    values = mix((np.arange(256, dtype=U64) + U64(1)) * BASE)
    values[65:91] = values[97:123]  # A-Z as a-z
    return values


VALUES = _byte_values()
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """The hash of every span of bytes: a polynomial in the bytes' values, from differences of prefix sums."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end) of every run without white space, A-Z as a-z.

    No step runs word by word.
    """
    space = np.concatenate([[True], SPACES[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    return span_hashes(data, starts, ends), starts, ends


def tokens(texts: list[bytes], block: int = 1 << 20, spans: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of the words of all texts, and where each text's begin (one bound more than texts).

    spans: also the first byte and the end of every word in the texts joined by line breaks.

    Works in blocks of bytes cut at white space; a longer word extends its block.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    hashes, starts, ends, at = [], [], [], 0
    while at < len(data):
        end = min(at + block, len(data))
        if end < len(data):
            inside = np.flatnonzero(SPACES[data[at:end]])
            if len(inside):
                end = at + int(inside[-1]) + 1
            else:
                while end < len(data) and not SPACES[data[end]]:
                    end += 1
        h, s, e = word_hashes(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = end
    found = np.concatenate(starts)
    out = np.concatenate(hashes), np.searchsorted(found, offsets)
    return (*out, found, np.concatenate(ends)) if spans else out


ZSTD = pa.Codec("zstd", compression_level=1)


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array, first bytes first, so that equal high bytes compress, and compressed. Of integers, which
    aren't negative, only as many bytes as the greatest needs; nine bytes in front tell how many, and the length.
    """
    size = a.itemsize
    if a.dtype.kind in "iu":
        size = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    each = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
    return bytes([size]) + len(a).to_bytes(8, "little") + ZSTD.compress(b"".join(each[:, i].tobytes() for i in range(size)), asbytes=True)


def unplanes(b: bytes, dtype) -> np.ndarray:
    size, n = b[0], int.from_bytes(b[1:9], "little")
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    if n:
        out[:, :size] = np.frombuffer(ZSTD.decompress(b[9:], size * n), np.uint8).reshape(size, n).T
    return out.view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=U64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, U64), dtype=U64)


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted keys pass from one of the parts' equal ranges of hash values to the next."""
    limits = np.array([(i << 64) // parts for i in range(1, parts)], U64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]]).astype(np.int64)


def distinct_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the place of every one among them.

    Sorts the leading bits with the positions in the rest, which is faster than to sort positions by hash; where two
    hashes agree in their leading bits only, the plain way is taken.
    """
    if not len(keys):
        return keys, np.empty(0, np.uint32)
    bits = U64(len(keys).bit_length())
    order = np.sort(keys >> bits << bits | np.arange(len(keys), dtype=U64)) & ((U64(1) << bits) - U64(1))
    ordered = keys[order.view(np.int64)]
    if (ordered[1:] < ordered[:-1]).any():
        distinct, place = np.unique(keys, return_inverse=True)
        return distinct, place.astype(np.uint32)
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.empty(len(keys), np.uint32)
    place[order.view(np.int64)] = np.cumsum(first, dtype=np.uint32) - np.uint32(1)
    return ordered[first], place
