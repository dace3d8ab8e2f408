"""Words of whole Arrow text columns, found with numpy."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass looks at; a longer text is one pass of its own.
PASS_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of the words [^\x20\x09-\x0D]+.
SOLID = ~SPACE

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C13)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the bounds of its rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if bounds[-1] else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def passes(bounds: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to limit bytes each, of one row at least."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def slices(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string column with up to limit bytes each, of one row at least; nothing of it is copied."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    yield from passes(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), limit)


def word_bounds(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of is_word bytes within a row), and each row's first word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | fresh))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | fresh))
    return starts, ends, np.searchsorted(starts, bounds)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd step and of its inverse modulo 2**64, n at least."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _STEP), np.full(size, np.uint64(pow(int(_STEP), -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[size]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of 64-bit values: equal spans hash alike wherever they stand."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return span_hashes(_BYTE[data], starts, ends)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Exact dictionary codes of the words, and the dictionary."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    packed = np.ascontiguousarray(data[is_word[data]])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
