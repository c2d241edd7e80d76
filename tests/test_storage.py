"""Stored tables: made once, anew when files or settings change or age passes, swept when left behind."""

import os
import time

from pyspark.sql import functions as F

from tideline import storage


def test_a_rewritten_input_gives_a_new_table(spark, tmp_path):
    path, made = str(tmp_path / "bars.parquet"), []

    def get(**more):
        def make():
            made.append(1)
            return spark.read.parquet(path).agg(F.sum("id").alias("s"))

        return storage.once(spark, ("sum", path), make, [path], **more).first()["s"]

    spark.range(10).write.parquet(path)
    assert (get(), get(), len(made)) == (45, 45, 1)
    spark.range(20).write.mode("overwrite").parquet(path)
    assert (get(), get(), len(made)) == (190, 190, 2)
    assert get(settings={"weights": [1, 2]}) == 190 and len(made) == 3
    assert get(settings={"weights": [1, 2]}) == 190 and len(made) == 3
    assert get(settings={"weights": [2, 1]}) == 190 and len(made) == 4


def test_age(spark, monkeypatch):
    made = []

    def get():
        return storage.once(spark, ("aged",), lambda: made.append(1) or spark.range(3), hours=24).count()

    get(), get()
    assert len(made) == 1
    now = time.time()
    monkeypatch.setattr(storage.time, "time", lambda: now + 25 * 3600)
    get(), get()
    assert len(made) == 2


def test_old_tables_of_other_drivers_are_swept(spark):
    folder = storage.shared_folder(spark).removeprefix("file://")
    for name in ("tideline-left-1", "tideline-new-1", "other"):
        os.makedirs(f"{folder}/{name}")
    mine = storage.once(spark, ("mine",), lambda: spark.range(2))
    old = time.time() - 72 * 3600
    for name in ("tideline-left-1", "other", mine.tideline_path.rpartition("/")[2]):
        os.utime(f"{folder}/{name}", (old, old))
    assert storage.sweep(spark, 48) == ["tideline-left-1"]
    assert mine.count() == 2 and os.path.exists(f"{folder}/other") and os.path.exists(f"{folder}/tideline-new-1")


def test_forget(spark):
    t = storage.stored(spark.range(5), "gone")
    storage.forget(t, None)
    assert not os.path.exists(t.tideline_path.removeprefix("file://"))
