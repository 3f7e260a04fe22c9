"""Helpers shared by the training-data operators: scratch tables, Arrow chunks, 64-bit hashing of bytes."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow chunk of a kernel holds at most (a longer single text is a chunk of its own).
CHUNK_BYTES = 1 << 20


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the cluster's shared folder (``spark.checkpoint.dir``). A session without one gets a local folder where driver and executors are one process, as in tests; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            base = tempfile.mkdtemp(prefix="lattica-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


class Tables:
    """Scratch tables of one operator. ``stored`` cuts lineage: it writes a table in the shared folder and reads it back, so that a lost executor costs no
    recomputation; ``drop`` deletes those that no later step reads. What a lazy result still reads stays, below a folder named for the application."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, tag: str) -> DataFrame:
        path = scratch(self.spark, tag)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Deletes all tables but those in keep."""
        gone = [p for p, t in self.paths.items() if not any(t is k for k in keep)]
        for p in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            del self.paths[p]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """One scratch table that stays."""
    return Tables(df.sparkSession).stored(df, tag)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame):
    """All columns as one struct: beside it, names of an operator's own can't clash with the input's."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def partitions(spark: SparkSession, n_bytes: int, per: int = 32 << 20) -> int:
    """Shards for ``n_bytes``: each has about ``per`` bytes, so their size stays and their number grows with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // per), 1)


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(column).cast("string")).cast("long"))).first()[0] or 0


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and where each row starts and ends (n + 1 offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(batches, column: str, most: int = CHUNK_BYTES):
    """Splits Arrow batches so that each has about ``most`` bytes of ``column``: kernels' memory doesn't depend on the batch size."""
    for batch in batches:
        _, off = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


_MIX = np.random.RandomState(20_240_229).randint(1, 2**63 - 1, 256, np.int64).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: Slices longer than this are hashed one at a time.
LONG_SLICE = 512
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, wide: bool = False) -> list[np.ndarray]:
    """64-bit hashes of slices, by eight bytes at a time, each step mixed before the next, so that no pattern of bytes cancels out; with ``wide`` two unlike ones."""
    size = end - start
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    seeds = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)[: 1 + wide]
    out = [mixed(size.astype(np.uint64) * np.uint64(seed)) for seed in seeds]
    long = np.flatnonzero(size > LONG_SLICE)
    live = np.flatnonzero((size > 0) & (size <= LONG_SLICE))
    at = start[live]
    left = size[live]
    while len(live):
        value = eights[at] & _TAIL[np.minimum(left, 8)]
        for k, seed in enumerate(seeds):
            out[k][live] = mixed((out[k][live] ^ value) + np.uint64(seed))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in long.tolist():
        digest = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest(), np.uint64)
        for k in range(len(seeds)):
            out[k][i] = digest[k]
    return out


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """64-bit polynomial hashes of any slices of a byte string, all slices at once. Modulo 2**64, regular patterns of some 1,000 bytes and more can
    collide: fit for choosing and grouping, not for calling slices equal."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = powers(_INVERSE, n + 1)
        terms = _MIX[data]
        terms *= powers(_BASE, n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of every slice of k bytes, by its start."""
        return mixed((self.prefix[k:] - self.prefix[:-k]) * self.inverse[: len(self.prefix) - k])
