"""Shared pieces of the corpus operators: tables, scratch space, bounded bit filters, skew-safe joins."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pandas as pd
import pyarrow
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A bit filter never grows beyond this, whatever the input: 2**28 bits are 32 MB.
MAX_FILTER_BITS = 1 << 28
#: Bits in one piece of a filter; fixed by Spark's bitmap functions.
PIECE_BITS = 32768
#: Hot keys number fewer than MAX_HOT: a key is hot when it holds more than one row in FEW, or, of many rows,
#: more than HOT_ROWS, or, of very many, more than one row in MAX_HOT.
FEW, HOT_ROWS, MAX_HOT = 1024, 2000, 65536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to Python and that are read at once, where the session leaves Spark's defaults: texts can be long.
BATCH_ROWS, READ_ROWS = 2000, 1024


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. One of our own only where the setting is unset and all runs on this machine."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or '/tmp/lucidgraph-scratch'}/lucidgraph"


def staged(df: DataFrame, name: str, *, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As staged, with the number of rows, counted while they are written."""
    seen = Observation()
    out = staged(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no result reads any more."""
    for t in tables:
        spark, path = t.sparkSession, t._staged_at
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds what readers and Python workers hold of long texts. Sizes that the session has set itself stay."""
    for name, usual, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", "4096", READ_ROWS)):
        if spark.conf.get(name) == usual:
            spark.conf.set(name, str(ours))


def text_udf(f: Callable, kind: str):
    """A pandas UDF that is evaluated once a row, whatever is filtered by its result afterwards."""
    return F.pandas_udf(f, kind).asNondeterministic()


def lean(f: Callable, keeps: str = "") -> Callable:
    """A function over batches whose worker drops what others have cached, but for the key that it keeps, and gives free
    memory back to the system at the end of each task."""

    @wraps(f)
    def run(batches: Iterator) -> Iterator:
        drop_cached(keeps)
        try:
            yield from f(batches)
        finally:
            release_memory()

    return run


def release_memory() -> None:
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


_CACHE: dict[str, object] = {}


def worker_cache(key: str, make: Callable[[], object]):
    """One cached object for each Python worker: asking for another drops the one before."""
    drop_cached(key)
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def drop_cached(keeps: str) -> None:
    """Drops the cached object of this worker unless it has the key."""
    if keeps not in _CACHE:
        _CACHE.clear()


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame, *without: str) -> Column:
    """All columns, without those named, as one struct, so that a column of ours can't clash with one of theirs."""
    return F.struct(*[column(c) for c in df.columns if c not in without])


def filter_bits(n: int, per_key: int = 16) -> int:
    """A power of two near per_key bits a key, within fixed bounds."""
    bits = PIECE_BITS
    while bits < min(n * per_key, MAX_FILTER_BITS):
        bits *= 2
    return bits


def bit_cell(key: Column, bits: int, seed: int) -> Column:
    """Cell of a key, from 0."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits).cast("long"))


def bit_pieces(cells: DataFrame) -> DataFrame:
    """One row for each piece of the filter that has bits: piece, bitmap. cells: one column, cell."""
    one = F.col("cell") + 1  # the bitmap functions count from 1
    return cells.groupBy(F.bitmap_bucket_number(one).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bitmap"))


def has_bit(bitmap: Column, cell: Column) -> Column:
    """Whether the bitmap of the cell's piece has its bit; null bitmaps have none."""
    at = F.pmod(cell, F.lit(PIECE_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.bit_get(byte, (at % 8).cast("int")) == 1, F.lit(False))


def piece_of(cell: Column) -> Column:
    return F.bitmap_bucket_number(cell + 1)


def collected_bits(cells: DataFrame, bits: int) -> np.ndarray:
    """The whole filter as bytes on the driver: at most MAX_FILTER_BITS / 8, however long the table is."""
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in bit_pieces(cells).toLocalIterator():
        at = (row["piece"] - 1) * (PIECE_BITS // 8)
        out[at : at + PIECE_BITS // 8] = np.frombuffer(row["bitmap"], dtype=np.uint8)
    return out


def bits_at(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


class BitFilter:
    """Tells rows whose key is not among given keys, or, with twice, is among them once at most.

    Two cells a key; a key's bits lie in pieces that are broadcast, MAX_FILTER_BITS in all at most. Beyond that
    the filter only lets more rows through. keys: one column, key.
    """

    SEEDS = (11, 23)

    def __init__(self, keys: DataFrame, n_keys: int, *, twice: bool = False):
        self.bits = filter_bits(n_keys)
        cells = keys.select(F.explode(F.array(*[bit_cell(F.col("key"), self.bits, s) for s in self.SEEDS])).alias("cell"))
        if twice:
            cells = cells.groupBy("cell").agg(F.count("*").alias("hits")).filter("hits > 1").select("cell")
        self.pieces = staged(bit_pieces(cells), "filter")

    def mark(self, rows: DataFrame, key: Column) -> DataFrame:
        """rows, which have no columns _p0 to _b1 of their own, with a column _maybe."""
        tests = []
        for i, seed in enumerate(self.SEEDS):
            cell = bit_cell(key, self.bits, seed)
            piece = F.broadcast(self.pieces.select(F.col("piece").alias(f"_p{i}"), F.col("bitmap").alias(f"_b{i}")))
            rows = rows.join(piece, piece_of(cell) == F.col(f"_p{i}"), "left")
            tests.append(has_bit(F.col(f"_b{i}"), cell))
        return rows.withColumn("_maybe", reduce(lambda a, b: a & b, tests)).drop("_p0", "_p1", "_b0", "_b1")


def hot_limit(n_rows: int) -> int:
    """Rows of a key above which it is hot; fewer than MAX_HOT keys can be."""
    return max(1, n_rows // MAX_HOT, min(n_rows // FEW, HOT_ROWS))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, *, how: str = "inner") -> DataFrame:
    """rows joined to groups (one row a key) without a hot shuffle partition.

    Keys with more than hot_limit(n_rows) rows number fewer than MAX_HOT, so these groups are broadcast; each
    other key holds too few rows to matter and is joined by a shuffle. groups must be a written table.
    """
    limit = hot_limit(n_rows)
    hot = groups.filter(F.col(size) > limit)
    extra = [c for c in groups.columns if c != key]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    first = marked.filter("_hot").drop("_hot")
    rest = marked.filter("_hot is null").drop("_hot", *extra)
    return first.unionByName(rest.join(groups.filter(F.col(size) <= limit).hint("merge"), key, how))


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, as frames that hold whole groups only."""
    waiting: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = b[key].iloc[-1]
        if waiting and waiting[0][key].iloc[0] == last:
            waiting.append(b)
            continue
        whole = (b[key] != last).to_numpy()
        ready = pd.concat([*waiting, b[whole]], ignore_index=True)
        if len(ready):
            yield ready
        waiting = [b[~whole]]
    if waiting:
        yield pd.concat(waiting, ignore_index=True)
