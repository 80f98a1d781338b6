"""Helpers for operators that read Arrow batches of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Word of the corpus contracts: a run of anything but ASCII white space. ``bytes.split()``
#: cuts at exactly these six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handled at a time by one Python worker, in bytes.
STEP_BYTES = 4 << 20


def id_first(df: DataFrame, id_col: str, name: str, rest: str) -> StructType:
    """A schema: a table's id column, of its own type, under a name, and other columns (DDL)."""
    return StructType([StructField(name, df.schema[id_col].dataType), *StructType.fromDDL(rest).fields])


def pieces(batch: pa.RecordBatch, column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``step`` bytes of text each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + step, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each row; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


_BLANKS = bytes(0x20 if 9 <= x <= 13 else x for x in range(256))


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts end to end as numbers: the distinct words, each word's number among
    them, and how many words each text has."""
    lists = pc.split_pattern(pa.array([x.translate(_BLANKS) for x in texts], pa.binary()), b" ")
    coded = lists.flatten().dictionary_encode()
    words, index = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy().astype(np.int64)
    ends = lists.offsets.to_numpy()
    blank = pc.index(coded.dictionary, pa.scalar(b"", coded.dictionary.type)).as_py()
    if blank >= 0:  # between two separators
        real = index != blank
        ends = np.append(0, np.cumsum(real))[ends]
        index = index[real]
        index[index > blank] -= 1
        words = np.delete(words, blank)
    return words, index, np.diff(ends).astype(np.int64)


_CACHES: dict[str, Callable[[], None]] = {}


def caches(owner: str, clear: Callable[[], None]) -> None:
    """Name what drops the words that an operator's tasks keep in a worker for its next task."""
    _CACHES[owner] = clear


def _give_back() -> None:
    """Return freed memory to the system, where the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def working(owner: str, run: Callable) -> Callable:
    """``run`` over a task's batches. Workers go from one operator to the next, so what others
    keep is dropped before, and memory that is free goes back to the system after."""

    def task(batches: Iterator) -> Iterator:
        for name, clear in _CACHES.items():
            if name != owner:
                clear()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place (uint64)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_words(text: Column, separator: str) -> Column:
    """The non-empty pieces between separators, with A-Z alone lower-cased.

    ``lower`` does just that to ASCII; ``translate`` does it to anything, but its time grows with
    the square of the length, so it only ever sees single words."""
    text = F.coalesce(text, F.lit(""))
    word = lambda w: F.when(F.lower(w) == w, w).when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    plain = F.octet_length(text) == F.char_length(text)
    return F.filter(F.when(plain, F.split(F.lower(text), separator)).otherwise(F.transform(F.split(text, separator), word)), lambda w: w != "")


def once(column: Column) -> Column:
    """The same values, computed at this step alone. The optimiser pushes filters (its own, too)
    below the steps that compute their columns, by substitution; an array that a lambda reads
    would then be computed again for each element. It leaves what isn't deterministic in place."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def constant(strings: list[str], separator: str) -> Column:
    """A constant array of strings, folded once when the query is planned."""
    return F.split(F.lit(separator.join(strings)), separator)


class Bitmap:
    """A constant bitmap over hashes (the low bits count), with ``spare`` bits for each or more:
    one membership test in ``spare`` is a false alarm."""

    def __init__(self, hashes: list[int], spare: int):
        self.n_bits = 1 << max(8, (spare * len(hashes)).bit_length())
        words = [0] * (self.n_bits // 64)
        for h in hashes:
            slot = h % self.n_bits
            words[slot // 64] |= 1 << (slot % 64)
        self.words = constant([str(x - (1 << 64) if x >> 63 else x) for x in words], ",").cast("array<bigint>")

    def holds(self, value: Column) -> Column:
        place = F.call_function("shiftright", value.bitwiseAND(F.lit(self.n_bits - 1).cast("bigint")), F.lit(6)).cast("int")
        return F.getbit(F.get(self.words, place), value.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1
