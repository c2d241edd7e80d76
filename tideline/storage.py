"""Tables that are read several times: written once to the folder that driver and executors share, and kept while what they were made of stays the same."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PREFIX = "tideline-"


@dataclass
class Entry:
    made: float
    state: str
    table: DataFrame


_known: dict[tuple, Entry] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only on one machine, where it is not set, a temporary folder, kept in the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix=PREFIX)}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet and read again: its lineage ends there, and lost executors cost a task. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{PREFIX}{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.tideline_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete what stored() wrote, once all that reads it is written itself."""
    for df in tables:
        if path := getattr(df, "tideline_path", None):
            files, where = _files(df.sparkSession, path)
            files.delete(where, True)


def state_of(spark: SparkSession, paths: Iterable[str], settings: object = None) -> str:
    """A digest of the files below the paths (names, sizes, times) and of settings: it changes when one of them does."""
    seen = []
    for path in paths:
        files, where = _files(spark, path)
        if not files.exists(where):
            seen.append((path, None))
            continue
        each = files.listFiles(where, True)
        while each.hasNext():
            f = each.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    text = json.dumps([sorted(seen, key=str), settings], sort_keys=True, default=str)
    return hashlib.md5(text.encode()).hexdigest()


def once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], inputs: Iterable[str] = (), settings: object = None, hours: float | None = None) -> DataFrame:
    """The stored table of a key, made at its first use in this application.

    It is made anew, and the old one deleted, when a file below `inputs` or a
    setting has changed since, or when it is older than `hours`.
    """
    full, now = (spark.sparkContext.applicationId, *key), time.time()
    state = state_of(spark, inputs, settings)
    old = _known.get(full)
    if old and old.state == state and (hours is None or now - old.made <= 3600 * hours):
        return old.table
    table = stored(make(), str(key[0]))
    _known[full] = Entry(now, state, table)
    if old:
        forget(old.table)
    return table


def sweep(spark: SparkSession, hours: float = 48) -> list[str]:
    """Delete tables that a driver which ended badly left in the shared folder: those not written to for so many hours, and not known here."""
    files, where = _files(spark, shared_folder(spark))
    kept = {getattr(e.table, "tideline_path", "").rpartition("/")[2] for e in _known.values()}
    gone = []
    for f in files.listStatus(where) if files.exists(where) else []:
        name = f.getPath().getName()
        if name.startswith(PREFIX) and name not in kept and time.time() - f.getModificationTime() / 1000 > 3600 * hours:
            files.delete(f.getPath(), True)
            gone.append(name)
    return sorted(gone)
