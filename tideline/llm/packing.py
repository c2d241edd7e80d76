"""Packing token sequences into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows; what is left
of each, and every shorter document, is a piece of 1 to `window` tokens. Best
fit decreasing takes pieces from the longest to the shortest and puts each into
the open window whose remaining room is the least that holds it. Equal lengths
are interchangeable, so the plan needs only the number of pieces of each
length: at most `window` numbers, whatever the corpus. The plan keeps groups of
windows of equal content, finds the tightest by a segment tree over remaining
room, and hands out ranks: "pieces 120 to 185 of length 300 go to windows 40 to
72 at offset 1500". Spark numbers the pieces of each length and looks their
ranks up in the plan, so neither texts nor pieces pass through the driver.

Defined cases: null text counts as empty and is one piece, the end id alone.
Repeated rows are packed as often as they occur. An empty table gives no rows.
Ties among equal lengths go by the order in which partitions were numbered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoded
from .common import frugal, materialize


class TightestFit:
    """A segment tree over remaining room 0..size: does any group of windows have this much left?"""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, first: int, count: int) -> None:
        self.groups[room].append((first, count))
        at = room + self.leaves
        while at and not self.any[at]:
            self.any[at] = True
            at //= 2

    def take(self, room: int) -> tuple[int, int]:
        got = self.groups[room].pop()
        if not self.groups[room]:
            at = room + self.leaves
            self.any[at] = False
            while at > 1:
                at //= 2
                self.any[at] = self.any[2 * at] or self.any[2 * at + 1]
        return got

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least `least` that some group has."""
        at = least + self.leaves
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(counts: dict[int, int], window: int) -> pd.DataFrame:
    """Placements (length, rank, count, each, seq, offset): from `rank` on, `count` pieces of a length
    go to windows seq, seq+1, ..., `each` to a window, one behind the other from `offset`."""
    tree, rows, windows = TightestFit(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(first: int, n: int, room: int) -> None:
            """Fill n windows of this room, as far as pieces are left; what stays open goes back."""
            nonlocal rank, left
            each = room // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, whole * each, each, first, window - room))
                rank, left = rank + whole * each, left - whole * each
                if room - each * length:
                    tree.put(room - each * length, first, whole)
            if whole < n and left:
                rows.append((length, rank, left, left, first + whole, window - room))
                if room - left * length:
                    tree.put(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            if whole < n:
                tree.put(room, first + whole, n - whole)

        while left and (room := tree.tightest(length)) is not None:
            fill(*tree.take(room), room)
        if left:
            n = -(-left // (window // length))
            fill(windows, n, window)
            windows += n
    return pd.DataFrame(rows, columns=["length", "rank", "count", "each", "seq", "offset"])


def pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_column: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row a piece, with its part (the task) and its rank among the task's pieces of its length."""
    kind = docs.schema[id_column].dataType.simpleString()

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ranks = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        end = np.array([end_id], "<u4")
        for frame, found in encoded(frames, tokenizer):
            rows = []
            for key, own in zip(frame[id_column], found):
                own = np.concatenate([own, end])
                for at in range(0, len(own), window):
                    piece = own[at : at + window]
                    rows.append((key, at, len(piece), zlib.crc32(piece.tobytes()), len(own), part, ranks[len(piece)], piece.astype("i4") if ids else None))
                    ranks[len(piece)] += 1
            yield pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids"])

    out = docs.select(id_column, "text").mapInPandas(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long, ids array<int>")
    return (out if ids else out.drop("ids")).withColumnRenamed("id", id_column)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_column: str = "doc_id", ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; with ids=True also the token ids, to write training files."""
    cut = materialize(pieces(docs, tokenizer, window, end_id, id_column, ids), "pieces")
    parts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(counts, window).sort_values(["length", "rank"])
    starts = (places["length"].to_numpy() << 48) + places["rank"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((starts, *(places[c].to_numpy() for c in ("rank", "each", "seq", "offset"))))  # a few rows for each of `window` lengths
    joined = cut.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, rank, each, seq, offset = shared.value
        for frame in frames:
            length, own = frame["length"].to_numpy(), frame.pop("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + own, "right") - 1
            nth = own - rank[at]
            yield frame.assign(sequence_id=seq[at] + nth // each[at], offset=offset[at] + nth % each[at] * length)

    order = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])]
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "rank"]
    return joined.mapInPandas(run, ", ".join([*schema, "sequence_id long, offset long"])).select(*order)
