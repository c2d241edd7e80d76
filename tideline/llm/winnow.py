"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash; of each window of w
consecutive k-grams the smallest hash is kept, the rightmost on ties, together
with its position. Two texts that share a passage of at least w+k-1 code points
share a fingerprint entry. A fingerprint is a string of 16 hexadecimal digits
an entry: 8 of the hash, 8 of the position. Likeness is the Jaccard index of
two fingerprints' sets of hashes.

Defined cases: null text counts as empty; an empty text has an empty
fingerprint, alike (1.0) to another empty one and unlike (0.0) to all else. A
text shorter than k has one entry, the hash of all of it. Texts follow each
other by ascending id, nulls first, equal ids by a hash of the text; the last is
followed by the first, a lone one by itself. Ids may be of any type that has an
order. Repeated rows are rows of their own. Texts of any length count whole;
other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, mix64

K, WINDOW = 16, 64
BASE = 0x9E3779B97F4A7C15


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> np.ndarray:
    """Entries hash << 32 | position, by position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes)
    if not n:
        return codes
    k = min(k, n)
    with np.errstate(over="ignore"):  # hashes of 1, 2, 4, ... code points, joined to k
        have, power, size = codes + np.uint64(1), np.uint64(BASE), 1
        acc, length = None, 0
        while True:
            if k & size:
                acc, length = (have, size) if acc is None else (acc[: n - length - size + 1] * power + have[length : n - size + 1], length + size)
            if 2 * size > k:
                break
            have, power, size = have[:-size] * power + have[size:], power * power, 2 * size
    hashes = mix64(acc + np.uint64(k)) >> np.uint64(32)
    m = len(hashes)
    at = np.arange(m, dtype=np.uint64)
    keys = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - at)  # the rightmost of equals is the least
    width = min(window, m)
    low, size = keys, 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if size < width:
        low = np.minimum(low[: m - width + 1], low[width - size :])
    picked = low[np.flatnonzero(np.diff(low, prepend=~low[:1]))]
    return picked ^ np.uint64(0xFFFFFFFF)


def as_string(entries: np.ndarray) -> str:
    return entries.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = np.unique(a >> np.uint64(32)), np.unique(b >> np.uint64(32))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


KEY = "_key"


def edges(keys: DataFrame, parts: int) -> DataFrame:
    """One row: the first keys of at most `parts` ranges of about equal size, in order, an array of one entry a range."""
    laid = keys.repartitionByRange(parts, KEY).groupBy(F.spark_partition_id()).agg(F.min(KEY).alias(KEY))
    return laid.agg(F.array_sort(F.collect_list(KEY)).alias("_edges"))


def span_of(key: Column, firsts: Column, parts: int) -> Column:
    """The last range that begins at or before a key: its number, by halving."""
    steps = F.array(*(F.lit(1 << k) for k in range(parts.bit_length(), -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < F.size(firsts)) & (F.get(firsts, at + step) <= key), at + step).otherwise(at))


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """docs in ranges of ascending id, a range a partition; each range ends with the next one's first rows.

    The key is the id and a hash of the text, so that rows of one id, or without one, fall into
    many ranges. Only the ranges' first keys are gathered, one for each partition. Columns added:
    span (the range) and guest (true for the rows that stand in both).
    """
    keyed = docs.withColumn(KEY, F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))))
    found = materialize(edges(keyed.select(KEY), parts), "edges")  # one row
    placed = keyed.join(F.broadcast(found), F.lit(True)).withColumn("span", span_of(F.col(KEY), F.col("_edges"), parts))
    last = F.size("_edges") - 1
    here, before = (F.struct(n.alias("span"), F.lit(g).alias("guest")) for n, g in ((F.col("span"), False), (F.when(F.col("span") == 0, last).otherwise(F.col("span") - 1), True)))
    copies = F.when(F.get("_edges", F.col("span")) == F.col(KEY), F.array(here, before)).otherwise(F.array(here))
    dealt = placed.select(*docs.columns, KEY, F.explode(copies).alias("at")).select(*docs.columns, KEY, "at.span", "at.guest")
    # of a range's guests one is enough: the first of the next range
    return dealt.repartitionByRange(parts, "span").sortWithinPartitions("span", "guest", KEY, "text")


def compare_neighbours(docs: DataFrame, parts: int, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and its likeness to that and to the next text's.

    The edited text has the last quarter of the code points replaced by the next text's first as many.
    """
    kind = docs.schema["doc_id"].dataType

    def row(own, after) -> tuple:
        key, text, prints = own
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[1][:quarter]
        other = fingerprint(edited, k, window)
        digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
        return key, len(text), digest, as_string(prints), as_string(other), likeness(prints, other), likeness(prints, after[2])

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, span, ended = None, None, False
        for frame in frames:
            rows = []
            for key, text, at, guest in zip(frame["id"], frame["text"], frame["span"], frame["guest"]):
                if at != span:
                    last, span, ended = None, at, False
                if ended:
                    continue
                text = text or ""
                own = (key, text, fingerprint(text, k, window))
                if last is not None:
                    rows.append(row(last, own))
                last, ended = own, guest
            for at in range(0, len(rows), 2000):
                yield pd.DataFrame(rows[at : at + 2000], columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = in_order(docs.select("doc_id", "text"), parts).select(F.col("doc_id").cast("string").alias("id"), "text", "span", "guest")
    out = dealt.mapInPandas(run, "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(F.col("id").cast(kind).alias("doc_id"), *out.columns[1:])
