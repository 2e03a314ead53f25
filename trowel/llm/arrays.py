"""Vectorised text primitives: words, word hashes, windows, packed documents and packed hash lists.

All work on the UTF-8 bytes of whole Arrow batches. Words are runs of bytes other than
0x20 and 0x09-0x0D, which are single bytes in UTF-8, so byte runs equal code-point runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text hashed at a time; a longer document is hashed alone.
SLICE = 1 << 21

_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters and digits and the bytes of other characters.
PUNCTUATION = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection on 64 bits that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_codes(seed: int, lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_CODES: dict[tuple[int, bool], np.ndarray] = {}
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(256, 1 << int(n - 1).bit_length())
        a = np.full(size, base, U64)
        a[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(a)
    return have[:n]


@dataclass
class Words:
    """The words of a slice of documents, in order."""

    letters: np.ndarray  # bytes of all words, without separators
    at: np.ndarray  # start of each word in letters
    size: np.ndarray  # bytes of each word
    bounds: np.ndarray  # words before each document, and all: len(docs) + 1
    hashes: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, seed: int = 0, separators: np.ndarray = _IS_SEP) -> Words:
    """data: bytes; offsets: where each document starts, and the end; separators: for each byte, whether it is between words."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    letters = data[inside]
    at = np.flatnonzero(first[inside])
    size = np.diff(np.append(at, len(letters)))
    bounds = np.concatenate(([0], np.cumsum(first)))[offsets] if len(data) else np.zeros(len(offsets), np.int64)
    if not len(at):
        return Words(letters, at, size, bounds, np.zeros(0, U64))
    place = np.arange(len(letters)) - np.repeat(at, size)
    codes = _CODES.setdefault((seed, lower), _byte_codes(seed, lower))
    sums = np.add.reduceat(codes[letters] * powers(int(size.max()))[place], at)
    return Words(letters, at, size, bounds, mix(sums + size.astype(U64) * U64(0xA0761D6478BD642F)))


def second_hashes(words: Words) -> np.ndarray:
    """Another 64-bit hash of each word, by other codes and another base."""
    if not len(words.at):
        return np.zeros(0, U64)
    place = np.arange(len(words.letters)) - np.repeat(words.at, words.size)
    codes = _CODES.setdefault((1, False), _byte_codes(1, False))
    sums = np.add.reduceat(codes[words.letters] * powers(int(words.size.max()), 0xC2B2AE3D27D4EB4F)[place], words.at)
    return mix(sums + words.size.astype(U64) * U64(0x9E3779B97F4A7C15))


def windows(h: np.ndarray, width: int, base: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2 ** 64, of every run of width values of h, by doubling."""
    if len(h) < width:
        return np.zeros(0, U64)
    p, done, out = [pow(base, 1 << i, 1 << 64) for i in range(width.bit_length())], 0, None
    part = h
    for i in range(width.bit_length()):
        if width >> i & 1:
            tail = part[: len(part)]
            if out is None:
                out = tail
            else:
                n = min(len(out), len(tail) - done)
                out = out[:n] + U64(pow(base, done, 1 << 64)) * tail[done : done + n]
            done += 1 << i
        if done < width:
            step = 1 << i
            part = part[:-step] + U64(p[i]) * part[step:]
    return mix(out)


def window_owner(bounds: np.ndarray, width: int, total: int) -> np.ndarray:
    """For each window start: is the whole window within one document?"""
    n = max(0, total - width + 1)
    ok = np.ones(n, bool)
    ends = bounds[1:-1]  # a window that starts in the last width - 1 words before an inner end crosses it
    for back in range(1, width):
        at = ends - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (large or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, large = column.cast(pa.large_binary()), True
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, off, dat = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(dat, np.uint8) if dat is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of documents of about limit bytes; at least one document each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_ZSTD = None


def _codec() -> pa.Codec:
    global _ZSTD
    if _ZSTD is None:
        _ZSTD = pa.Codec("zstd", compression_level=1)
    return _ZSTD


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _codec().compress(raw, asbytes=True)


def unsqueeze(blob: bytes) -> bytes:
    return _codec().decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def give_back() -> None:
    """Returns memory that is free to the system: a worker waits for its next task with little of it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(rows: Callable) -> Callable:
    """A function over a task's batches that gives free memory back when they are done."""

    def tidied(batches):
        try:
            yield from rows(batches)
        finally:
            give_back()

    return tidied


def pack_docs(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, take: np.ndarray) -> bytes:
    """ids and texts of the documents at take, compressed."""
    sizes = (offsets[1:] - offsets[:-1])[take]
    text = b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in take)
    return squeeze(len(take).to_bytes(8, "little") + ids[take].astype("<i8").tobytes() + sizes.astype("<i8").tobytes() + text)


def unpack_docs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes, offsets of all blobs, ordered by id and then by text."""
    ids, texts = [], []
    for blob in blobs:
        raw = unsqueeze(blob)
        n = int.from_bytes(raw[:8], "little")
        ids.append(np.frombuffer(raw, "<i8", n, 8))
        ends = np.cumsum(np.frombuffer(raw, "<i8", n, 8 + 8 * n)) + 8 + 16 * n
        at = 8 + 16 * n
        for e in ends:
            texts.append(raw[at:e])
            at = e
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    order = sorted(range(len(every)), key=lambda i: (every[i], texts[i])) if len(np.unique(every)) < len(every) else np.argsort(every)
    texts = [texts[i] for i in order]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    return every[order] if len(every) else every, np.frombuffer(b"".join(texts), np.uint8), offsets


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted 64-bit values as the byte planes of their differences, compressed: about log2(2**64 / n) bits each."""
    gaps = np.diff(h, prepend=U64(0)).astype("<u8")
    return squeeze(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=U64)


def cut_by_top_bits(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2 ** bits buckets begins in the sorted h, and the end."""
    if bits == 0:
        return np.array([0, len(h)])
    tops = np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)
    return np.concatenate(([0], np.searchsorted(h, tops), [len(h)]))


def pair_order(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """A stable order by h, then check."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], check[order]
    return np.lexsort((check, h)) if bool(((a[1:] == a[:-1]) & (b[1:] < b[:-1])).any()) else order


def pairs_found(h: np.ndarray, check: np.ndarray, table: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Is each (h, check) among the pairs (table, checks), which are in order?"""
    out = np.zeros(len(h), bool)
    if not len(table):
        return out
    at = np.searchsorted(table, h)
    left = np.flatnonzero(at < len(table))
    while len(left):  # once, but where digests of different windows are alike
        left = left[table[at[left]] == h[left]]
        out[left] = checks[at[left]] == check[left]
        left = left[~out[left]]
        at[left] += 1
        left = left[at[left] < len(table)]
    return out


def found_in(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Is each of h in the sorted table?"""
    if not len(table):
        return np.zeros(len(h), bool)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return table[at] == h
