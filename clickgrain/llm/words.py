"""Words of UTF-8 texts as numpy arrays: boundaries, hashes and hashes of word sequences.

Texts come as Arrow arrays from ``mapInArrow``. They are taken in blocks of about one megabyte, so
memory follows the block (or the longest single text), not the Arrow batch. A null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PIECE = 1 << 20


def splitmix(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=U) + U(seed) * U(0x10001)) * U(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they have been asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.up.size:
            size = max(n, 2 * self.up.size)
            for name, base in (("up", self.base), ("down", self.inverse)):
                row = np.full(size, base, U)
                row[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.multiply.accumulate(row))
        return self.up, self.down


BYTE_POWERS = Powers(0xD6E8FEB86659FD93)
SEQUENCE_POWERS = (Powers(0x9FB21C651E98DF25), Powers(0xA0761D6478BD642F))
BYTE_CODES = splitmix(11, 256)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Letters, digits and every byte of a non-ASCII character.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """The words of the texts ``rows`` of a batch. ``first[i]:first[i + 1]`` are those of text i."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return self.offsets.size - 1


def text_buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each begins."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(data: np.ndarray, at: np.ndarray, limit: int = PIECE) -> Iterator[slice]:
    """Consecutive texts that hold about ``limit`` bytes together."""
    row, rows = 0, at.size - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield slice(row, end)
        row = end


def words(texts: pa.Array | pa.ChunkedArray, lower: bool = False, inside: np.ndarray = NOT_SPACE) -> Iterator[Words]:
    """The words (runs of bytes that are ``inside``) of a batch, block by block."""
    data, at = text_buffers(texts)
    for rows in blocks(data, at):
        own = data[at[rows.start] : at[rows.stop]]
        own = LOWER[own] if lower else own
        offsets = at[rows.start : rows.stop + 1] - at[rows.start]
        yield Words(rows, own, offsets, *_runs(inside[own], offsets))


def _runs(hit: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    before, after = np.zeros(hit.size + 1, bool), np.zeros(hit.size + 1, bool)
    before[1:] = hit
    before[offsets] = False
    after[: hit.size] = hit
    after[offsets] = False
    starts = np.flatnonzero(hit & ~before[:-1])
    ends = np.flatnonzero(hit & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of the bytes of every word."""
    out = np.empty(w.starts.size, U)
    token = 0
    while token < w.starts.size:
        begin = w.starts[token]
        end = max(token + 1, int(np.searchsorted(w.starts, begin + PIECE)))
        piece = w.data[begin : w.ends[end - 1]]
        up, down = BYTE_POWERS(piece.size + 1)
        sums = np.zeros(piece.size + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE_CODES[piece] * up[: piece.size], out=sums[1:])
            s, e = w.starts[token:end] - begin, w.ends[token:end] - begin
            out[token:end] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xC2B2AE3D27D4EB4F))
        token = end
    return out


def sequence_sums(codes: np.ndarray, family: int = 0) -> np.ndarray:
    """Prefix sums from which ``sequence_hash`` takes the hash of any stretch of ``codes``."""
    up, _ = SEQUENCE_POWERS[family](codes.size + 1)
    sums = np.zeros(codes.size + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(codes * up[: codes.size], out=sums[1:])
    return sums


def sequence_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of the stretches [begin, end); equal sequences hash alike wherever they stand."""
    _, down = SEQUENCE_POWERS[family](sums.size)
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))


def window_hashes(codes: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Hashes of all stretches of ``width`` codes."""
    n = codes.size - width + 1
    if n <= 0:
        return np.zeros(0, U)
    at = np.arange(n)
    return sequence_hash(sequence_sums(codes, family), at, at + width, family)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """A list column: row i holds ``values[first[i]:first[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))
