"""Words and word shingles of whole Arrow string columns, as 64-bit hashes, in numpy.

Texts are cut by bytes: every byte of a multi-byte UTF-8 character is at least 0x80, so a class of ASCII
separators cuts bytes where it cuts characters. Only A-Z are lower-cased. Hashes depend on nothing but the
word's bytes, so they agree between tasks, tables and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass takes; a longer text makes a pass of its own.
PASS_BYTES = 1 << 20  # of texts at a time: what is held of a pass is some 25 times its bytes

_U = np.uint64
_MUL = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 (two multiply-and-shift rounds)."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9FB21C651E98DF25)
    return x ^ (x >> _U(32))


def byte_class(separators: list[int]) -> bytes:
    """A translation table: separators to 0, A-Z to a-z, all else to itself (byte 0 as a word byte becomes 1)."""
    table = bytearray(range(256))
    table[0] = 1
    for c in range(65, 91):
        table[c] = c + 32
    for c in separators:
        table[c] = 0
    return bytes(table)


#: Words of ASCII letters, digits and everything beyond ASCII.
LETTERS = byte_class([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Words between ASCII white space.
BLANKS = byte_class([0x20, *range(0x09, 0x0E)])


def passes(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Cut a string column into runs of whole texts: (first row, offsets within the bytes, bytes). Null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, offsets[at : to + 1] - offsets[at], bytes(view[offsets[at] : offsets[to]])
        at = to


def cut(offsets: np.ndarray, data: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cleaned bytes padded by 8 zeros, word starts, word ends, first word of each text and the end)."""
    clean = np.frombuffer(data.translate(table) + bytes(8), dtype=np.uint8)
    inside = clean[: len(data)] != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = offsets[:-1], offsets[1:] - 1
    heads, tails = heads[heads < len(data)], tails[tails >= 0]
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return clean, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(clean: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a time."""
    eight = np.lib.stride_tricks.sliding_window_view(clean, 8)
    sizes = ends - starts
    take = lambda at, left: np.ascontiguousarray(eight[at]).view("<u8")[:, 0] & _MASKS[np.minimum(left, 8)]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    out = mix(take(starts, sizes) + sizes.astype(np.uint64) * _MUL[0])
    step, rest = 8, np.flatnonzero(sizes > 8)
    while len(rest):
        out[rest] = mix(out[rest] * _MUL[1] + take(starts[rest] + step, sizes[rest] - step))
        step += 8
        rest = rest[sizes[rest] > step]
    return out


def word_hashes(column: pa.Array, table: bytes, limit: int = PASS_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, first word of each text and the end, word hashes) for each pass over the column."""
    for at, offsets, data in passes(column, limit):
        clean, starts, ends, texts = cut(offsets, data, table)
        yield at, texts, hashes(clean, starts, ends)


def shingles(words: np.ndarray, texts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (62 bits, as int64) of all runs of ``size`` words, and where each text's begin.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    counts = np.diff(texts)
    if size > len(_MUL):
        raise ValueError(f"at most {len(_MUL)} words in a shingle")
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(size):
        total[: max(len(words) - k, 0)] += words[k:] * _MUL[k]
    full = np.ones(len(words), dtype=bool)
    for k in range(1, size):
        ends = texts[1:] - k
        full[ends[ends >= texts[:-1]]] = False
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:
        part = words[texts[i] : texts[i + 1]]
        total[texts[i]] = (part * np.array(_MUL[: len(part)], dtype=np.uint64)).sum(dtype=np.uint64) + _U(len(part))
        full[texts[i]] = True
    out = (mix(total[full]) >> _U(2)).astype(np.int64)
    kept = np.concatenate([[0], np.cumsum(np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64)))])
    return out, kept
