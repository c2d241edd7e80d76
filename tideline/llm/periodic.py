"""Runs of periodic repetition in texts: stretches of words that repeat with a period.

A run of period q is a stretch of at least max(6, 4q) words in which words q
apart are identical, whose smallest period is q, and which no neighbouring word
extends. All runs of a text are found, whatever their period:

1. Lag counting. matches[q] is the number of words that equal the word q places
   on. A word that is frequent in its text (heavy) adds the autocorrelation of
   its places, by FFT, whose sums are rounded to whole numbers and so exact; a
   rare one (light) adds the differences of its pairs of places. A word is heavy
   where its pairs outnumber the steps of a transform.
2. A run of length l has l - q matches in a row at its lag, so only lags with
   max(6 - q, 3q) matches or more are looked at. Lags ascend, and a run of period
   p takes its own matches away from the multiples of p: two runs of periods
   p and q = kp share fewer than q words, so no other run loses a match by that.
3. Island scan. At such a lag, stretches of matches that are long enough are
   runs, unless they lie in a run whose period divides the lag.

Defined cases: words are parted by the bytes 0x09-0x0D and 0x20 and compared as
they stand; a null or empty text has no words and no runs. A null id counts as
the empty string. Every row is judged by itself, whole, so repeated rows and ids
give repeated results; other columns are not looked at. An empty table gives no
rows. The transform of one text takes some hundred bytes a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, frugal

FLUSH = 1 << 20
Run = tuple[int, int, int]  # start, length, period


def heavy_matches(codes: np.ndarray, heavy: np.ndarray, most: int) -> np.ndarray:
    """Matches of the heavy words at the lags 0 to most: their power spectra are summed, then transformed back once."""
    n = len(codes)
    size = 1 << int(n + most).bit_length()
    power = np.zeros(size // 2 + 1)
    for word in heavy:
        spectrum = np.fft.rfft(codes == word, size)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def lag_matches(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each text (codes of its words) the matches at the lags 0 to a quarter of its length; pairs of all texts are taken together."""
    lengths = np.array([len(t) for t in texts], np.int64)
    most = lengths // 4
    room = np.concatenate([[0], np.cumsum(most + 1)])
    total = np.zeros(room[-1], np.int64)
    if not lengths.sum():
        return np.split(total, room[1:-1])
    owner = np.repeat(np.arange(len(texts)), lengths)
    codes = np.concatenate(texts)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((place, codes, owner))
    owner, place, word = owner[order], place[order], codes[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1).astype(bool) | np.diff(word, prepend=-1).astype(bool))
    count = np.diff(np.append(first, len(word)))
    steps = np.maximum(lengths, 2) * 2 * np.log2(np.maximum(lengths, 2) * 2)
    heavy = count * (count - 1) / 2 > steps[owner[first]]
    for i in np.unique(owner[first[heavy]]):
        own = word[first[heavy & (owner[first] == i)]]
        total[room[i] : room[i + 1]] += heavy_matches(texts[i], own, int(most[i]))
    end = np.repeat(first + count, count)
    alive, k, found, size = np.flatnonzero(np.repeat(~heavy, count)), 0, [], 0
    while len(alive):  # pairs of the k-th next place of the same word
        k += 1
        alive = alive[alive + k < end[alive]]
        lag = place[alive + k] - place[alive]
        near = lag <= most[owner[alive]]
        alive = alive[near]
        found.append(room[owner[alive]] + lag[near])
        size += len(alive)
        if size > FLUSH or not len(alive):
            total += np.bincount(np.concatenate(found), minlength=len(total))
            found, size = [], 0
    return np.split(total, room[1:-1])


def least_matches(lags: np.ndarray) -> np.ndarray:
    """A run of period q has max(6, 4q) words or more, so this many matches at lag q."""
    return np.maximum(6 - lags, 3 * lags)


def runs_of(codes: np.ndarray, matches: np.ndarray) -> list[Run]:
    """All runs of one text, by start and period."""
    lags = np.arange(len(matches))
    left, found = matches - least_matches(lags), []
    for q in (np.flatnonzero(left[1:] >= 0) + 1).tolist():
        if left[q] < 0:  # its matches belong to runs whose period divides q
            continue
        same = np.zeros(len(codes) - q + 2, np.int8)
        same[1:-1] = codes[q:] == codes[:-q]
        edge = np.flatnonzero(np.diff(same))
        start, stretch = edge[::2], edge[1::2] - edge[::2]
        for s, more in zip(start[long := stretch >= max(6 - q, 3 * q)].tolist(), stretch[long].tolist()):
            length = more + q
            if any(q % p == 0 and t <= s and s + length <= t + size for t, size, p in found):
                continue
            found.append((s, length, q))
            again = np.arange(2 * q, min(len(matches), length), q)
            left[again] -= length - again
    return sorted((s, length, q) for s, length, q in found)


def looped(n: int, key: str) -> np.ndarray | None:
    """Word numbers of a text whose tail is made to repeat, for one id in ten; None where the text stays as it is."""
    h = zlib.crc32(key.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def runs(docs: DataFrame, loops: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: every run, and the text with each run cut to its first period.

    loops: the tails of one text in ten are made to repeat first, as `looped` says.
    """
    kind = docs.schema["doc_id"].dataType

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, keys = [(t or "").encode("utf-8", "replace") for t in frame["text"]], frame["key"].tolist()
            for part in batches_by_bytes(texts, 1_000_000):
                known, words, codes = {}, [], []
                for text, key in zip(texts[part], keys[part]):
                    own = text.split()
                    code = np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own))
                    if loops and (at := looped(len(own), key or "")) is not None:
                        own, code = [own[i] for i in at], code[at]
                    words.append(own)
                    codes.append(code)
                found = [runs_of(c, m) for c, m in zip(codes, lag_matches(codes))]
                kept = []
                for own, all_ in zip(words, found):
                    if all_:
                        stays = np.ones(len(own), bool)
                        for s, length, q in all_:
                            stays[s + q : s + length] = False
                        own = [own[i] for i in np.flatnonzero(stays)]
                    kept.append(b" ".join(own).decode())
                yield pd.DataFrame({"key": keys[part], "n_words": [len(w) for w in words], "runs": [[{"start": s, "length": n, "period": q} for s, n, q in all_] for all_ in found], "collapsed": kept})

    rows = docs.select(F.col("doc_id").cast("string").alias("key"), "text")
    out = rows.mapInPandas(run, "key string, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(F.col("key").cast(kind).alias("doc_id"), "n_words", "runs", "collapsed")


def summary(found: DataFrame) -> DataFrame:
    """What `runs` found, as numbers and digests: the longest run (then the first, then that of the least period) stands for the text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
