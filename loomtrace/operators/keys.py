"""Which files of a table may hold a key: per file its range of keys and a Bloom filter.

The filters are built in Spark from the key columns of what was just written, and kept as a Parquet
folder beside it. A task sets the bits of one file's filter as its keys pass by, and holds no keys. A
probe sends the hashes of a small batch to the filters, never the filters to the
driver, and gets back names of files."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits a key, and how many of them are set for it: one file in about 1,000 is read in vain a key.
BITS, PROBES = 16, 6
#: Rows of a file, so of a filter.
FILE_ROWS = 1_000_000
#: Keys of a batch that is worth probing for; a larger one meets all files.
MOST_KEYS = 100_000

FILTERS = "file string, n long, low string, high string, bits binary"


def key_hash(key: Sequence[str]) -> Column:
    return F.xxhash64(*key)


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each hash in a filter of ``size`` bits."""
    h = hashes.astype(np.uint64)
    step = ((h >> np.uint64(32)) | np.uint64(1))[:, None]
    with np.errstate(over="ignore"):
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed[:, None] + np.arange(PROBES, dtype=np.uint64) * step) % np.uint64(size)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    size = filter_bits(len(hashes))
    bits = np.zeros(size, bool)
    bits[_places(hashes, size).reshape(-1)] = True
    return np.packbits(bits).tobytes()


def filter_bits(n: int) -> int:
    """The bits of a filter of n keys."""
    return max(64, -(-BITS * n // 8) * 8)


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """For each hash, whether it may be in the filter."""
    held = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return held[_places(hashes, len(held))].all(axis=1)


def partial_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``at, n, h`` (file, its rows, a key's hash), a file's rows together: a filter of those of each
    file that a task sees. It holds the bits of one file."""
    at, held = None, np.zeros(0, bool)

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["at", "bits"])

    for batch in batches:
        files, n, hashes = (batch.column(c).to_numpy() for c in ("at", "n", "h"))
        cuts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if files[a] != at:
                if at is not None:
                    yield made()
                at, held = int(files[a]), np.zeros(filter_bits(int(n[a])), bool)
            held[_places(hashes[a:b], len(held)).reshape(-1)] = True
    if at is not None:
        yield made()


def either(table: pa.Table) -> pa.Table:
    """A file's filter from those of the tasks that read a part of it."""
    parts = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
    return pa.table({"at": table.column("at").slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})


def write_filters(spark: SparkSession, rows: str, wanted: Mapping[str, Sequence[str]]) -> int:
    """Filters of all files below ``rows``, for each folder those of its key; the number of rows. A file has
    at most FILE_ROWS. The ranges of all keys are found in one pass."""
    source, name = spark.read.parquet(rows), F.input_file_name().alias("file")
    of = lambda key: F.col(key[0]).cast("string")
    bounds = [x for i, key in enumerate(wanted.values()) for x in (F.min(of(key)).alias(f"low{i}"), F.max(of(key)).alias(f"high{i}"))]
    ranges = sorted(source.select(name, "*").groupBy("file").agg(F.count("*").alias("n"), *bounds).collect())  # a row a file
    for i, (path, key) in enumerate(wanted.items()):
        if not ranges:
            spark.createDataFrame([], FILTERS).write.parquet(path)
            continue
        files = F.broadcast(spark.createDataFrame([(at, r.file, r.n, r[f"low{i}"], r[f"high{i}"]) for at, r in enumerate(ranges)], "at long, file string, n long, low string, high string"))
        hashes = source.select(name, key_hash(key).alias("h"))
        parts = hashes.join(files.select("at", "file", "n"), "file").select("at", "n", "h").mapInArrow(partial_filters, "at long, bits binary")
        whole = parts.groupBy("at").applyInArrow(either, "at long, bits binary")
        whole.join(files, "at").select("file", "n", "low", "high", "bits").coalesce(4).write.parquet(path)
    return sum(r.n for r in ranges)


def many(batch: DataFrame) -> bool:
    """Whether a batch is too large to probe for."""
    return batch.limit(MOST_KEYS + 1).count() > MOST_KEYS


def candidates(spark: SparkSession, filters: Sequence[str], batch: DataFrame, key: Sequence[str]) -> list[str] | None:
    """The files that may hold a key of the batch; None if the batch is too large to ask for."""
    if not filters:
        return []
    some = batch.select(key_hash(key).alias("h"), F.col(key[0]).cast("string").alias("k")).limit(MOST_KEYS + 1)
    if many(some):
        return None
    some = some.toArrow()  # at most MOST_KEYS
    names = [x for x in some.column("k").to_pylist() if x is not None]
    if not names:
        return []
    hashes = some.column("h").to_numpy()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            hit = [may_hold(b, hashes).any() for b in part.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("file").filter(pa.array(hit, pa.bool_()))], names=["file"])

    near = spark.read.schema(FILTERS).parquet(*filters).where((F.col("low") <= max(names)) & (F.col("high") >= min(names)))
    return [r.file for r in near.select("file", "bits").mapInArrow(ask, "file string").collect()]  # a name a file
