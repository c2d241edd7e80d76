"""What the operators of this folder share: reading tables, shared storage, text helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent on one machine (a test) a temporary
    folder takes its place, and is then remembered in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tideline-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class _Cleaning:
    """While any write runs, Spark removes a query's shuffle files as soon as it has ended; then the setting is as before."""

    name, lock, users, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", threading.Lock(), 0, "false"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        with self.lock:
            if not _Cleaning.users:
                _Cleaning.before = self.conf.get(self.name, "false")
                self.conf.set(self.name, "true")
            _Cleaning.users += 1

    def __exit__(self, *_) -> None:
        with self.lock:
            _Cleaning.users -= 1
            if not _Cleaning.users:
                self.conf.set(self.name, _Cleaning.before)


def _folder_of(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/tideline-{tag}-{uuid.uuid4().hex}"
    with _Cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    files, where = _folder_of(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    out.tideline_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete what materialize() wrote, once everything that reads it is written itself."""
    for df in tables:
        if path := getattr(df, "tideline_path", None):
            files, where = _folder_of(df.sparkSession, path)
            files.delete(where, True)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the task's Python memory goes back to the system: workers are kept for the next task, which may be another operator's."""

    @functools.wraps(run)
    def inner(frames: Iterator) -> Iterator:
        try:
            yield from run(frames)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return inner


def apart(docs: DataFrame, *keep: str) -> tuple[DataFrame, list]:
    """docs with all columns but `keep` under names that clash with no operator's, and the columns that lead back."""
    names = {c: c if c in keep else f"_own{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mod_of_id(column: str, modulus: int):
    """crc32 of the decimal id, modulo; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def prefiltered(rows: DataFrame, column: str, keys: DataFrame, n: int, most_bits: int = 27, how: str = "left_semi") -> DataFrame:
    """The rows whose column is among the n keys (a column of the same name), and a few others by chance; with left_anti all rows but these.

    A bitmap of the keys' hashes is broadcast, 16 bits a key up to 2**most_bits
    bits (16 MB) however many keys there are; beyond some ten million keys it
    fills and lets more rows pass. An exact join is to follow.
    """
    bits = min(1 << most_bits, max(1 << 15, 1 << (16 * n).bit_length()))
    hashed = F.pmod(F.xxhash64(column), F.lit(bits))
    place = F.col("_h") % 32768
    maps = keys.select(hashed.alias("_h")).groupBy((F.col("_h") / 32768).cast("long").alias("_part")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substr("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_h", hashed)
    hit = (marked["_h"] / 32768).cast("long") == maps["_part"]
    return marked.join(F.broadcast(maps), hit & (F.expr("1 << cast(_h % 8 as int)").bitwiseAND(byte) != 0), how).drop("_h")


def lowest(rows: DataFrame, group: str, mark: str, most: int) -> DataFrame:
    """Of the distinct rows of each group the `most` with the least marks (64-bit hashes), so copies count once.

    An approximate count only bounds what is ranked, at about twice of what is
    kept; which rows are kept does not hang on it, nor on how rows are dealt.
    """
    counts = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.approx_count_distinct(mark).alias("n")).collect() if r[group] is not None}
    if not counts:
        return rows.limit(0)
    share = {key: min(1.0, (2 * most + 50) / max(1, n)) for key, n in sorted(counts.items())}
    bounds = F.create_map(*(F.lit(x) for key, part in share.items() for x in (key, min(int(part * 2.0**64) - 2**63, 2**63 - 1))))
    near = F.col(mark) <= F.element_at(bounds, F.col(group))
    order = W.partitionBy(group).orderBy(mark, *(c for c in rows.columns if c not in (group, mark)))
    return rows.where(near).distinct().withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def batches_by_bytes(texts: list[bytes], most: int) -> Iterator[slice]:
    """Slices of consecutive texts of about `most` bytes; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))
