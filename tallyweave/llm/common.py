"""What the operators of this subpackage share: text in Arrow buffers, 64-bit mixing, checkpoints, shared files."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tallyweave.sources.shared import SharedWriter, checkpoint, fresh_folder, make_folder, open_shared, release, released, remove, shared_dir  # noqa: F401

#: White space that separates words in every contract of this subpackage.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"

#: A slice of a batch holds about so many bytes of text, so that arrays of 8 bytes a byte stay small.
SLICE_BYTES = 1 << 20


def forget(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what no variable refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """What `make` gives, kept by this Python worker until another operator asks for something else.

    So a worker that serves many tasks makes dictionaries and vocabularies once, and holds those of one operator alone.
    """
    if _held.get("key") != key:
        _held.clear()
        release()
        _held["value"], _held["key"] = make(), key
    return _held["value"]


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `size` bytes each; a longer text is a range of its own."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


#: The multipliers of the splitmix64 finalizer and the golden ratio in 64 bits.
_GOLDEN, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x + _GOLDEN).astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


#: An odd base for polynomial hashes modulo 2**64, and its inverse there.
_BASE = np.uint64(0x5851F42D4C957F2D)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """1, b, b^2, ... for the base b, at least n of them."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 12)
        grown = np.full(size, _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def word_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each code[start:end], the same wherever those values stand.

    sum(code[i] * b^(end - 1 - i)) over each range by one running sum of code[i] * b^-i; b is odd, so it has an inverse.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(code) + 1
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    down = inverse_powers(n, inverse)
    run = np.empty(n, np.uint64)
    run[0] = 0
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * down[: n - 1], out=run[1:])
    return mix64((run[ends] - run[starts]) * powers(n)[ends] + (ends - starts).astype(np.uint64))


_down = np.ones(1, np.uint64)


def inverse_powers(n: int, inverse: np.uint64) -> np.ndarray:
    global _down
    if len(_down) < n:
        size = max(n, 2 * len(_down), 1 << 12)
        grown = np.full(size, inverse, np.uint64)
        grown[0] = 1
        _down = np.multiply.accumulate(grown)
    return _down[:n]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
