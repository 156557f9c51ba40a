"""Vectorised scanning of UTF-8 text in Arrow batches: tokens, 64-bit token hashes, word shingles.

Whole batches are handled as one byte array with document offsets, cut into pieces of bounded size; a document longer than a piece is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PIECE_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers, the same in every process."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * U(0x9E3779B97F4A7C15)) | U(1)


LETTER = stream(256, 1)
LOWER = np.arange(256)
LOWER[65:91] += 32
LETTER_LOWER = np.where(SPACE, U(0), LETTER[LOWER])
_place = stream(1 << 12, 2)


def place(n: int) -> np.ndarray:
    """Multipliers for the first n places in a token."""
    global _place
    if n > len(_place):
        _place = stream(1 << (n - 1).bit_length(), 2)
    return _place


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows that hold at most so many bytes, or one longer row."""
    data, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def tokens(data: np.ndarray, at: np.ndarray, letter: np.ndarray = LETTER_LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the maximal runs of bytes in tokens, their hashes, and the n + 1 token offsets of documents.

    letter: a value for each byte, 0 for those that are in no token; as it stands, tokens end at space, and A-Z count as a-z.
    """
    inside = letter[data] != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, U), np.zeros(len(at), np.int64)
    spans = np.diff(np.append(starts, len(data)))
    inner = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    value = letter[data[starts[0] :]]
    value *= place(int(spans.max()))[inner]
    return starts, mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of so many tokens within a document, and their n + 1 offsets.

    A document with fewer tokens, but some, has one shingle made of all of them.
    """
    n = np.diff(at)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(at[:-1], count) + np.arange(out[-1]) - np.repeat(out[:-1], count)
    last = np.repeat(at[1:], count)
    total = np.zeros(len(begin), U)
    factor = stream(words, 3)
    for k in range(words):
        here = begin + k
        ok = here < last
        total += np.where(ok, hashes[np.minimum(here, max(len(hashes) - 1, 0))], U(k + 1)) * factor[k]
    return mix(total), out
