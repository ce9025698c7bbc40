"""What several operators share: words as hashes, and arrays of ragged rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode defines it, as a Java character class.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | (F.regexp_replace(c, WHITE + "+", "") == "")


def white_words(c: Column) -> Column:
    """Hashes of the lower-case words between white space."""
    return F.transform(F.filter(F.split(F.lower(c), WHITE + "+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def letter_words(c: Column) -> Column:
    """Hashes of the longest runs of letters and digits, in lower case."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over unsigned integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ragged(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and borders of an Arrow list column; a null row counts as empty."""
    borders = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[borders[0] : borders[-1]]
    return values, borders - borders[0]


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


CHUNK = 1 << 14
#: Tables of partitions that one task adds up.
FAN_IN = 1000
_MOST = (1 << 31) - 1


def dense_counts(df: DataFrame, slots: int, count) -> np.ndarray:
    """A table of ``slots`` counters over all rows, summed where the rows are.

    ``count(batch)`` yields arrays of slots that occur in an Arrow batch. Each partition sends its
    table in chunks; chunks are added up on the executors, ``FAN_IN`` tables at a time and one chunk after
    another, so no task holds more than a chunk; 4 bytes a slot reach the driver, however much data there
    is. Counters stop at 2 ** 31 - 1.
    """

    def partition(batches):
        total = np.zeros(slots, dtype=np.int64)
        for b in batches:
            for at in count(b):
                total += np.bincount(at, minlength=slots)
        parts = [np.minimum(total[i : i + CHUNK], _MOST) for i in range(0, slots, CHUNK)]
        some = [i for i, p in enumerate(parts) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].astype(np.int32).tobytes() for i in some], pa.binary())], names=["chunk", "counts"])

    def add(batches):
        at, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.minimum(total, _MOST).astype(np.int32).tobytes()], pa.binary())], names=["chunk", "counts"])

        # sorted by chunk, so a sum is complete when the next chunk begins
        for b in batches:
            for k, x in zip(b.column("chunk").to_pylist(), b.column("counts")):
                part = np.frombuffer(x.as_buffer(), dtype=np.int32).astype(np.int64)
                if k == at:
                    total = total + part
                else:
                    if at is not None:
                        yield done()
                    at, total = k, part
        if at is not None:
            yield done()

    many = df.rdd.getNumPartitions()
    tables = df.mapInArrow(partition, "chunk int, counts binary")
    while many > FAN_IN:
        # the parts of a chunk are dealt to so many tasks that each adds about ``FAN_IN``
        many = -(-many // FAN_IN)
        lots = tables.withColumn("lot", (F.rand(7) * many).cast("int")).repartition("chunk", "lot").sortWithinPartitions("chunk", "lot")
        tables = lots.select("chunk", "counts").mapInArrow(add, "chunk int, counts binary")
    got = tables.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros(-(-slots // CHUNK) * CHUNK, dtype=np.int32)
    for r in got:
        part = np.frombuffer(r["counts"], dtype=np.int32)
        at = r["chunk"] * CHUNK
        out[at : at + len(part)] = np.minimum(out[at : at + len(part)].astype(np.int64) + part, _MOST)
    return out[:slots]


def batch(columns: dict[str, list], **types) -> pa.RecordBatch:
    """A record batch of plain lists; columns without a type are strings."""
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.string())) for k, v in columns.items()], names=list(columns))
