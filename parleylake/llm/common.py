"""What the training-data operators share: scratch tables, learning rows and the Arrow loop."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .hashing import mix

#: Bytes of text that a Python kernel holds at a time; a longer text is handled alone.
CHUNK_BYTES = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_parleylake_shared", None)
    if not folder:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        folder = context._parleylake_shared = "file://" + tempfile.mkdtemp(prefix="parleylake-")
    return folder.rstrip("/")


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


@lru_cache(maxsize=None)
def one_thread() -> None:
    """Matrix products on the calling thread alone: workers fill the cores already, and a library's idle threads spin."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


class Scratch:
    """Tables written into the shared folder to cut lineage; they survive a lost executor.

    The DataFrames that come back read those files lazily, so ``clear`` is for when the
    results built on them have been written out.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def table(self, df: DataFrame, label: str) -> DataFrame:
        where = self.path(label)
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, label: str) -> None:
        """Delete the tables of a label that nothing lazy reads any more."""
        self._delete(f"{self.root}/*-{label}")

    def release(self) -> None:
        """Let Spark delete the shuffle files that nothing refers to any more; it learns that from the driver's garbage collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, pattern: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        fs = jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(conf)
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)) or []:
            fs.delete(status.getPath(), True)


#: Bits of a filter over ids, and how many of them an id sets. With more ids it lets more through, never fewer.
FILTER_BITS, FILTER_PLACES = 25, 3


def _filter_places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each of the filter's places of the ids."""
    keys = ids.view(np.uint64)
    places = np.concatenate([mix(keys ^ np.uint64(c + 1)) & np.uint64((1 << FILTER_BITS) - 1) for c in range(FILTER_PLACES)])
    return (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63))


def passes(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids (long) may be in a filter."""
    word, bit = _filter_places(np.ascontiguousarray(ids))
    return (table[word] & bit != 0).reshape(FILTER_PLACES, -1).all(axis=0)


def bit_filter(rows: DataFrame, ids: Callable[[pa.Table], np.ndarray], columns: list[str]) -> np.ndarray:
    """A bit set of 2 ** FILTER_BITS bits of the rows' ids (long), whatever their number; ``ids`` finds them from ``columns``."""

    def work(batches):
        total = np.zeros(1 << FILTER_BITS - 6, np.uint64)
        for batch in batches:
            np.bitwise_or.at(total, *_filter_places(np.ascontiguousarray(ids(pa.Table.from_batches([batch])))))
        word = np.flatnonzero(total)
        if len(word):
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(total[word].view(np.int64))], names=["word", "bits"])

    found = map_arrow(rows.select(*columns), work, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the ids that no model learns from; a null id is never held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def each_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text"):
    """A mapInArrow function that applies ``work`` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return run
