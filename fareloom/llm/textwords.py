"""Columnar word arrays: every word of an Arrow batch as a code into a dictionary of distinct words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, i.e. ``[^\\x20\\x09-\\x0D]+``.
Splitting and dictionary encoding run in Arrow's C++ kernels; Python sees each distinct word of a
batch once.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a kernel handles at a time; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20


@dataclass
class WordBatch:
    """Words of some texts: text ``i`` has the codes ``codes[offsets[i]:offsets[i + 1]]``."""

    words: pa.Array
    codes: np.ndarray
    offsets: np.ndarray


def as_text(column: pa.Array) -> pa.Array:
    """Large-string array in which null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes of text, one row at least."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield at, end
        at, before = end, int(sizes[end - 1])


def split_words(texts: pa.Array, lower: bool = False) -> WordBatch:
    """Words of each text; ``lower`` lower-cases A-Z only."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    values, bounds = lists.values, lists.offsets.to_numpy().astype(np.int64)
    encoded = values.dictionary_encode()
    codes = encoded.indices.to_numpy()
    words = encoded.dictionary
    empty = pc.index_in(pa.scalar("", pa.large_string()), value_set=words).as_py()
    if empty is not None:  # white space at either end of a text leaves an empty piece
        keep = codes != empty
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    return WordBatch(words, codes, bounds - bounds[0])


def word_hashes(batch: WordBatch) -> np.ndarray:
    """A 64-bit hash of each word occurrence."""
    if not len(batch.words):
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    distinct = np.fromiter((digest(w) for w in batch.words.cast(pa.large_binary()).to_pylist()), np.uint64, len(batch.words))
    return distinct[batch.codes]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def window_hashes(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width`` consecutive words inside one text, and the texts' bounds in that array.

    Composed by doubling, so the cost is logarithmic in ``width``.
    """
    lengths = np.maximum(np.diff(offsets) - width + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    total = int(bounds[-1])
    if not total:
        return np.zeros(0, np.uint64), bounds
    # at[k] is the hash of `size` words from word k on, whatever text they belong to
    base = np.uint64(0x9E3779B97F4A7C15)
    result, covered = None, 0
    power, size = mix(hashes), 1
    rest = width
    while rest:
        if rest & 1:
            if result is None:
                result, covered = power, size
            else:
                n = len(hashes) - covered - size + 1
                result = mix(result[:n] * base + power[covered : covered + n] + np.uint64(size))
                covered += size
        rest >>= 1
        if rest:
            n = len(power) - size
            power = mix(power[:n] * base + power[size : size + n] + np.uint64(size)) if n > 0 else power[:0]
            size *= 2
    starts = np.repeat(offsets[:-1] - bounds[:-1], lengths) + np.arange(total)
    return result[starts], bounds
