"""Texts of an Arrow column as one byte array with offsets, and the hashes that are computed on it."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import zstandard

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_salts = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
#: For substrings over LONG bytes: two sums modulo a prime. Modulo 2 ** 64 some long strings agree for any base (Thue-Morse words of 1,024 bytes).
PRIME, LONG = (1 << 31) - 1, 128
PRIME_BASES = 371_892_269, 1_583_458_089
_prime_powers: list = [(np.ones(1, np.uint32), np.ones(1, np.uint32))] * 2
_prime_salts = np.random.default_rng(20240301).integers(0, PRIME, (2, 256), dtype=np.uint64)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int):
    """Ranges (i, j) of documents whose texts hold at most `most` bytes together, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to n."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo PRIME."""
    prime = np.uint64(PRIME)
    for _ in range(2):
        x = (x & prime) + (x >> np.uint64(31))
    return x - prime * (x >= prime)


def prime_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each of PRIME_BASES: its powers and their inverses modulo PRIME, for exponents up to n."""
    if len(_prime_powers[0][0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate(PRIME_BASES):
            both = []
            for x, table in zip((base, pow(base, -1, PRIME)), _prime_powers[k]):
                while len(table) < size:
                    table = np.concatenate((table, reduced(table * np.uint64(pow(x, len(table), PRIME))).astype(np.uint32)))
                both.append(table)
            _prime_powers[k] = tuple(both)
    return _prime_powers


class Sums:
    """Hash of any substring in constant time: sums of salted bytes times powers, moved to exponent zero.

    Sums are modulo 2 ** 64; substrings over LONG bytes have sums modulo PRIME mixed in, made when first asked for."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_salts[data] * up[: len(data)], out=self.sums[1:])
        self.data, self.prime = data, None

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = mixed((self.sums[end] - self.sums[start]) * self.down[start])
        long = np.flatnonzero(end - start > LONG)
        if len(long):
            found[long] = mixed(found[long] + self._by_prime(start[long], end[long]))
        return found

    def _by_prime(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.prime is None:
            self.prime = []
            for salts, (up, down) in zip(_prime_salts, prime_powers(len(self.data) + 1)):
                sums = np.zeros(len(self.data) + 1, np.uint64)
                np.cumsum(reduced(salts[self.data] * up[: len(self.data)]), out=sums[1:])
                self.prime.append((sums, down))
        high, low = (reduced(reduced(sums[end] - sums[start]) * down[start]) for sums, down in self.prime)
        return mixed(high << np.uint64(32) | low)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    return data


def spaces(data: np.ndarray) -> np.ndarray:
    """The bytes 0x20 and 0x09-0x0D, which part words."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, n + 1 offsets into these) of the words of each document."""
    inside = ~spaces(data)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the document and place in it, of each of the items that offsets part."""
    count = np.diff(offsets)
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(offsets[-1]) - np.repeat(offsets[:-1], count)


def packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def bundled(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, of each the bytes of equal weight side by side, compressed at once."""
    sizes = np.array([len(a) for a in arrays], np.uint32).tobytes()
    planes = (np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays if len(a))
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(planes))


def unbundled(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    out, at = [], 4 * len(kinds)
    for n, kind in zip(raw[:at].view(np.uint32).tolist(), kinds):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


_kept: dict = {}


def cached(name, make):
    """What make() gives, kept in the worker until a task of another operator begins."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    _kept.clear()


def release() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def hold(most: int) -> None:
    """Let up to `most` bytes of free memory stay with the process until release(): arrays that come and go are not given back and faulted in each time."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, most)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD, the largest that glibc comes to by itself
    except AttributeError:
        pass


def tidy(run):
    """run, an Arrow function over batches, in a worker that serves many: without what tasks of others keep, and leaving no free memory."""

    def tidied(batches):
        forget()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
