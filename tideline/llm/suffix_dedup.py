"""Removal of repeated passages: every byte covered by a string of `length` bytes that also starts elsewhere.

Texts are strings of symbols: bytes, or words (32 bits of a hash of each), for
which `words` states a second length. Both kinds go through the same steps.

Anchors. Of each stretch of `length` symbols the k-gram with the least hash (the
rightmost on ties) is its anchor; equal stretches have equal anchors at equal
places, so only anchors that occur twice can lie in repeated stretches. Those
are found by counting in Spark, and only their surroundings travel on: an
anchor's context spans the stretches that it anchors. So there is no suffix array
of the whole corpus; what is sorted is the suffixes (and reversed prefixes) that
begin at repeated anchors, which decides the same question.

Suffix sorting. Contexts with the same anchor meet in one task. Their right
sides, as suffixes from the anchor on, and their left sides, read backwards,
are put in order by deep-shallow sorting: multikey quicksort a word of 8 bytes at
a time (all groups of a depth in one pass) to a shallow depth, then a blind trie
for each group that still shares its prefix. Neighbours' common prefixes give
those of all pairs as range minima. A stretch with o symbols before the anchor is
repeated if another context shares o symbols to the left and length-o to the
right, so each context gets the widest and the narrowest such o, and
[anchor-widest, anchor-narrowest+length) goes.

Skew. Equal texts are worked on once and removed whole (from `length` bytes
on); equal contexts are sorted once. An anchor with more than `most` different
contexts is not sorted in one task: its stretches are hashed one by one and
counted in Spark, which gives the same answer. What joins look up is written
first, so that Spark may split a partition which one anchor or text fills.

Defined cases: null text counts as empty. Repeated rows are copies of each
other. Ids may be null or repeated. Texts are judged as UTF-8 bytes; texts of any
length are taken whole, in overlapping pieces. An empty table gives no rows. Two
runs of words count as equal if the hashes of all their words are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, forget, frugal, materialize, mix64, partitions
from .words import Chunk, powers

BYTE, WORD = 1, 4  # bytes a symbol
GRAM = {BYTE: 40, WORD: 10}
SHALLOW = 12  # words of 8 bytes
PIECE = 1 << 21  # symbols of a very long text that are looked at together
DTYPE = {BYTE: np.uint8, WORD: np.dtype("<u4")}


# -- anchors


def symbols(texts: list[bytes], unit: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols end to end, and how many each has."""
    if unit == BYTE:
        return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
    chunk = Chunk(texts)
    return (chunk.hashes() >> np.uint64(32)).astype(DTYPE[WORD]), chunk.n_words.astype(np.int64)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` symbols."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])])
        return mix64((total[size:] - total[: n - size + 1]) * down[: n - size + 1])


def anchors(data: np.ndarray, sizes: np.ndarray, length: int, gram: int = GRAM[BYTE]) -> tuple[np.ndarray, ...]:
    """(text, hash, place, low, high): each anchor with the first and last start of the stretches it anchors."""
    if len(sizes) == 1 and len(data) > PIECE:  # pieces overlap, so each stretch lies in one of them
        found = []
        for at in range(0, len(data) - length + 1, PIECE - length + 1):
            part = data[at : at + PIECE]
            own, h, place, low, high = anchors(part, np.array([len(part)]), length, gram)
            found.append((own, h, place + at, low + at, high + at))
        return tuple(np.concatenate(x) for x in zip(*found))
    starts = np.concatenate([[0], np.cumsum(sizes)])[: len(sizes)]
    grams = rolling(data, gram)
    width = length - gram + 1
    if len(grams) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.arange(len(grams), dtype=np.uint64)
    low = (grams & ~np.uint64((1 << 28) - 1)) | (np.uint64((1 << 28) - 1) - at)
    size = 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if size < width:
        low = np.minimum(low[: len(grams) - width + 1], low[width - size :])
    pick = (np.uint64((1 << 28) - 1) - (low & np.uint64((1 << 28) - 1))).astype(np.int64)  # anchor of the stretch that starts here
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.arange(len(pick))
    inside = owner[begin] == owner[begin + length - 1]
    begin, pick = begin[inside], pick[inside]
    if not len(begin):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    first = np.flatnonzero(np.diff(pick, prepend=-1) | (np.diff(begin, prepend=-2) != 1))
    last = np.append(first[1:], len(pick)) - 1
    place, own = pick[first], owner[begin[first]]
    shift = starts[own]
    return own, grams[place].view(np.int64), place - shift, begin[first] - shift, begin[last] - shift


# -- deep-shallow sorting


class BlindTrie:
    """Sorts byte strings with long common prefixes; inner nodes know a depth and first bytes only."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.numbers = [(int.from_bytes(s, "big"), len(s)) for s in strings]
        self.root = None
        for i in range(len(strings)):
            self._insert(i)

    def _common(self, i: int, j: int) -> int:
        (a, m), (b, n) = self.numbers[i], self.numbers[j]
        least = min(m, n)
        differ = (a >> 8 * (m - least)) ^ (b >> 8 * (n - least))
        return least - -(-differ.bit_length() // 8)

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        path, node = [], self.root
        while isinstance(node, tuple):  # down without looking at what was skipped
            depth, children = node
            key = s[depth] if depth < len(s) else -1
            if key not in children:
                key = next(iter(children))
            path.append((node, key))
            node = children[key]
        shared = self._common(i, node[0])
        if shared == len(s) == len(self.strings[node[0]]):
            node.append(i)
            return
        at = next((n for n, (inner, _) in enumerate(path) if inner[0] >= shared), len(path))
        mine = s[shared] if shared < len(s) else -1
        if at < len(path) and path[at][0][0] == shared:
            path[at][0][1][mine] = [i]
            return
        old = path[at][0] if at < len(path) else node
        other = self.strings[node[0]]
        new = (shared, {(other[shared] if shared < len(other) else -1): old, mine: [i]})
        if at:
            inner, key = path[at - 1]
            inner[1][key] = new
        else:
            self.root = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(group: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """The order of strings by group, then bytes."""
    n = len(strings)
    head = np.zeros((n, 8 * SHALLOW), np.uint8)
    for i, s in enumerate(strings):
        s = s[: 8 * SHALLOW]
        head[i, : len(s)] = np.frombuffer(s, np.uint8)
    words = head.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    run = np.cumsum(np.diff(group[order], prepend=group[order[:1]]) != 0)
    for depth in range(SHALLOW):  # only members of runs that are still tied are looked at
        tied = np.flatnonzero(np.bincount(run)[run] > 1)
        if not len(tied):
            break
        own = order[tied]
        new = np.lexsort((words[own, depth], run[tied]))
        order[tied] = own = own[new]
        split = np.zeros(n, bool)
        split[tied[1:]] = (run[tied[1:]] == run[tied[:-1]]) & (words[own[1:], depth] != words[own[:-1], depth])
        run = run + np.cumsum(split)
    counts = np.bincount(run)
    ends = np.cumsum(counts)
    for r in np.flatnonzero(counts > 1):
        own = order[ends[r] - counts[r] : ends[r]]
        order[ends[r] - counts[r] : ends[r]] = own[BlindTrie([strings[i] for i in own]).order()]
    return order


def neighbours(group: np.ndarray, strings: list[bytes], unit: int = BYTE) -> tuple[np.ndarray, np.ndarray]:
    """The order, and the symbols each shares at its start with the one before it (0 where a group begins)."""
    order, n = deep_shallow(group, strings), len(strings)
    common = np.zeros(n, np.int64)
    size = max(map(len, strings), default=0) + 1
    for at in range(1, n, 4096):
        own = order[at - 1 : at + 4096]
        grid = np.frombuffer(b"".join(strings[i].ljust(size, b"\0") for i in own), np.uint8).reshape(len(own), size)
        lengths = np.array([len(strings[i]) for i in own])
        least = np.minimum(lengths[1:], lengths[:-1])
        differ = grid[1:] != grid[:-1]
        common[at : at + len(own) - 1] = np.minimum(np.where(differ.any(1), differ.argmax(1), size), least)
    common[np.flatnonzero(np.diff(group[order], prepend=-1))] = 0
    return order, common // unit


def repeated_offsets(group: np.ndarray, left: list[bytes], right: list[bytes], length: int, unit: int = BYTE, pairwise: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """(widest, narrowest) symbols before the anchor of each context's repeated stretches; -1 where none.

    group numbers the anchors 0, 1, ... in ascending runs; left sides are read backwards.
    """
    n = len(group)
    widest, narrowest = np.full(n, -1), np.full(n, -1)
    if not n:
        return widest, narrowest
    by_right, common_right = neighbours(group, right, unit)
    by_left, common_left = neighbours(group, left, unit)
    counts = np.bincount(group)
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    for size in np.unique(counts[counts > 1]):
        own = np.flatnonzero(counts == size)
        if size > pairwise:
            for g in own:
                at = slice(firsts[g], firsts[g] + size)
                _each_offset(by_right[at], common_right[at], by_left[at], common_left[at], left, right, length, unit, widest, narrowest)
            continue
        step = max(1, 2_000_000 // (size * size))
        for some in np.array_split(own, -(-len(own) // step)):
            at = firsts[some][:, None] + np.arange(size)
            shared = []
            for order, common in ((by_right, common_right), (by_left, common_left)):
                least = np.zeros((len(some), size, size), np.int64)
                c = common[at]
                for gap in range(1, size):  # range minima, by the distance of two ranks
                    a = np.arange(size - gap)
                    low = c[:, a + gap] if gap == 1 else np.minimum(least[:, a, a + gap - 1], c[:, a + gap])
                    least[:, a, a + gap] = least[:, a + gap, a] = low
                rank = np.argsort(order[at], axis=1)
                shared.append(np.take_along_axis(np.take_along_axis(least, rank[:, :, None], 1), rank[:, None, :], 2))
            r, l = shared
            yes = l + r >= length
            yes[:, np.arange(size), np.arange(size)] = False
            any_ = yes.any(2)
            items = np.sort(by_right[at], axis=1)
            widest[items] = np.where(any_, np.where(yes, l, -1).max(2), -1)
            narrowest[items] = np.where(any_, np.where(yes, length - r, length + 1).min(2), -1)
    return widest, narrowest


def _each_offset(by_right, common_right, by_left, common_left, left, right, length, unit, widest, narrowest) -> None:
    """One large group: for each offset, contexts equal on both sides are counted."""
    base = by_right.min()
    n = len(by_right)
    size_left = np.array([len(left[base + i]) // unit for i in range(n)])
    size_right = np.array([len(right[base + i]) // unit for i in range(n)])
    for o in range(length - GRAM[unit] + 1):
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[by_right - base] = np.cumsum(common_right < length - o)
        b[by_left - base] = np.cumsum(common_left < o)
        has = np.flatnonzero((size_left >= o) & (size_right >= length - o))
        _, inverse, count = np.unique(a[has] * (n + 1) + b[has], return_inverse=True, return_counts=True)
        hit = base + has[count[inverse] > 1]
        widest[hit] = np.maximum(widest[hit], o)
        narrowest[hit] = np.where(narrowest[hit] < 0, o, narrowest[hit])


# -- the Spark job


def _with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("text", text).withColumn("ck", F.unhex(F.md5(text)))


def _once_a_task(docs: DataFrame) -> DataFrame:
    """(ck, text) without a task's own repetitions, so a text that fills a third of all rows does not travel as often."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for frame in frames:
            new = []
            for key in frame["ck"]:
                new.append(key not in seen)
                seen.add(key)
            yield frame[np.array(new, bool)]

    return docs.select("ck", "text").mapInPandas(run, "ck binary, text string")


def _encoded(frame: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in frame["text"]]


def _found_anchors(texts: DataFrame, lengths: dict[int, int]) -> DataFrame:
    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for frame in frames:
            new = []
            for key in frame["ck"]:
                new.append(key not in seen)
                seen.add(key)
            frame = frame[np.array(new, bool)]
            data, keys = _encoded(frame), frame["ck"].tolist()
            for part in batches_by_bytes(data, 1_000_000):
                for unit, length in lengths.items():
                    own, h, place, _, _ = anchors(*symbols(data[part], unit), length, GRAM[unit])
                    at = np.searchsorted(own, np.arange(len(data[part]) + 1))
                    has = np.flatnonzero(np.diff(at))
                    if len(has):
                        yield pd.DataFrame({"ck": [keys[part.start + i] for i in has], "unit": np.int32(unit), "h": [h[at[i] : at[i + 1]] for i in has], "place": [place[at[i] : at[i + 1]].astype("i4") for i in has]})

    out = texts.select("ck", "text").mapInPandas(run, "ck binary, unit int, h array<long>, place array<int>")
    return out.select("ck", "unit", F.explode(F.arrays_zip("h", "place")).alias("a")).select("ck", "unit", "a.h", "a.place", F.xxhash64("ck", "unit", "a.place").alias("x"))


def _contexts(wanted: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """A row for each repeated anchor: its context as bytes, the anchor `before` symbols into it."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data, keys = _encoded(frame), frame["ck"].tolist()
            places = {unit: frame[f"places{unit}"].tolist() for unit in lengths}
            for part in batches_by_bytes(data, 1_000_000):
                rows = []
                for unit, length in lengths.items():
                    own, sizes = symbols(data[part], unit)
                    starts = np.concatenate([[0], np.cumsum(sizes)])
                    for i, hash_, p, a, b in zip(*(x.tolist() for x in anchors(own, sizes, length, GRAM[unit]))):
                        if p in _as_set(places[unit], part.start + i):
                            rows.append((keys[part.start + i], unit, hash_, p, p - a, own[starts[i] + a : starts[i] + b + length].tobytes()))
                for at in range(0, len(rows), 20_000):
                    yield pd.DataFrame(rows[at : at + 20_000], columns=["ck", "unit", "h", "place", "before", "context"])

    return wanted.select("ck", "text", *(f"places{unit}" for unit in lengths)).mapInPandas(run, "ck binary, unit int, h long, place int, before int, context binary")


def _as_set(places: list, i: int) -> set:
    if not isinstance(places[i], set):
        places[i] = set() if places[i] is None else set(places[i].tolist())
    return places[i]


def _sorted_classes(rows: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """(unit, h, c, widest, narrowest) of contexts (unit, h, c, before, context), which stand in order of unit and h in each task."""

    def flush(pieces: list[pd.DataFrame], whole: bool) -> tuple[pd.DataFrame | None, list[pd.DataFrame]]:
        frame = pd.concat(pieces, ignore_index=True)
        unit, h = frame["unit"].to_numpy(), frame["h"].to_numpy()
        new = np.diff(h, prepend=h[:1]).astype(bool) | np.diff(unit, prepend=unit[:1]).astype(bool)
        cut = len(frame) if whole else int(np.flatnonzero(new)[-1]) if new.any() else 0
        done, rest = frame.iloc[:cut], frame.iloc[cut:]
        if not len(done):
            return None, [rest]
        widest, narrowest = np.full(cut, -1), np.full(cut, -1)
        for kind, length in lengths.items():
            own = np.flatnonzero(unit[:cut] == kind)
            if len(own):
                group = np.cumsum(new[own]) - new[own[0]]
                both = list(zip(done["context"].iloc[own], (kind * done["before"].to_numpy()[own]).tolist()))
                back = lambda side: np.frombuffer(side, DTYPE[kind])[::-1].tobytes()
                widest[own], narrowest[own] = repeated_offsets(group, [back(c[:b]) for c, b in both], [c[b:] for c, b in both], length, kind)
        found = pd.DataFrame({"unit": unit[:cut], "h": h[:cut], "c": done["c"].to_numpy(), "widest": widest, "narrowest": narrowest})
        return found[found["widest"] >= 0], [rest]

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces: list[pd.DataFrame] = []
        for frame in frames:
            for at in range(0, len(frame), 10_000):
                pieces.append(frame.iloc[at : at + 10_000])
                if sum(map(len, pieces)) >= 20_000:
                    found, pieces = flush(pieces, False)
                    if found is not None:
                        yield found
        if sum(map(len, pieces)):
            found, _ = flush(pieces, True)
            if found is not None:
                yield found

    return rows.mapInPandas(run, "unit int, h long, c long, widest long, narrowest long")


def _hashed_classes(rows: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """The same for anchors with very many contexts: every stretch is hashed and counted."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for unit, h, c, before, context in zip(frame["unit"], frame["h"], frame["c"], frame["before"], frame["context"]):
                hashes = rolling(np.frombuffer(context, DTYPE[unit]), lengths[unit])
                found.append((unit, h, c, hashes.view(np.int64), before - np.arange(len(hashes))))
            yield pd.DataFrame(found, columns=["unit", "h", "c", "stretch", "o"])

    each = rows.mapInPandas(run, "unit int, h long, c long, stretch array<long>, o array<long>").select("unit", "h", "c", F.explode(F.arrays_zip("stretch", "o")).alias("s")).select("unit", "h", "c", "s.stretch", "s.o")
    twice = each.groupBy("unit", "h", "stretch", "o").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("unit", "h", "stretch", "o")
    return each.join(twice, ["unit", "h", "stretch", "o"]).groupBy("unit", "h", "c").agg(F.max("o").alias("widest"), F.min("o").alias("narrowest"))


def _length(lengths: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in lengths.items() for x in pair)), F.col("unit"))


def removals(docs: DataFrame, length: int = 400, most: int = 20_000, words: int = 0) -> DataFrame:
    """(ck, text, spans) of the texts with repeated stretches: spans is an array of (unit, begin, end) in symbols.

    Stretches of `length` bytes (unit 1) and, where it is not 0, of `words` words
    (unit 4). Texts that occur several times are not marked as such here; see repeats().
    """
    spark = docs.sparkSession
    lengths = {BYTE: length} | ({WORD: words} if words else {})
    keyed = _with_key(docs.select("text"))
    found = materialize(_found_anchors(keyed, lengths), "anchors")
    twice = materialize(found.groupBy("unit", "h").agg(F.min("x").alias("low"), F.max("x").alias("high")).where("low <> high").select("unit", "h"), "twice")
    both = found.join(twice, ["unit", "h"]).groupBy("ck").agg(*(F.collect_set(F.when(F.col("unit") == unit, F.col("place"))).alias(f"places{unit}") for unit in lengths))
    places = materialize(both, "places")
    forget(found, twice)
    wanted = materialize(_once_a_task(keyed).join(places, "ck"), "wanted")
    forget(places)
    context = _contexts(wanted, lengths).withColumn("c", F.xxhash64("context", "before")).withColumn("x", F.xxhash64("ck", "unit", "place"))
    context = materialize(context, "contexts")
    each = context.groupBy("unit", "h", "c").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.first("before").alias("before"), F.first("context").alias("context"))
    each = materialize(each, "each")
    many = materialize(each.groupBy("unit", "h").agg(F.count("*").alias("n")).where("n > 1"), "many")
    body = each.select("unit", "h", "c", "before", "context")
    several, hot = many.where(F.col("n") <= most).select("unit", "h"), many.where(F.col("n") > most).select("unit", "h")
    sorted_ = _sorted_classes(body.join(several, ["unit", "h"]).repartition(4 * partitions(spark), "unit", "h").sortWithinPartitions("unit", "h"), lengths)
    classed = sorted_.unionByName(_hashed_classes(body.join(hot, ["unit", "h"], "left_semi"), lengths))
    # a context that occurs twice repeats in all its stretches
    narrow = F.col("before") - (F.octet_length("context") / F.col("unit") - _length(lengths))
    whole = each.where("low <> high").select("unit", "h", "c", F.col("before").cast("long").alias("widest"), narrow.cast("long").alias("narrowest"))
    sides = materialize(whole.unionByName(classed).groupBy("unit", "h", "c").agg(F.max("widest").alias("widest"), F.min("narrowest").alias("narrowest")), "sides")
    forget(each, many)
    spans = context.select("ck", "unit", "h", "c", "place").join(sides, ["unit", "h", "c"]).select("ck", "unit", (F.col("place") - F.col("widest")).alias("begin"), (F.col("place") - F.col("narrowest") + _length(lengths)).alias("end"))
    spans = materialize(spans.groupBy("ck").agg(F.collect_set(F.struct("unit", "begin", "end")).alias("spans")), "spans")
    forget(context, sides)
    return wanted.select("ck", "text").join(spans, "ck")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _runs(spans, unit: int) -> list[tuple[int, int]]:
    return merged([(s["begin"], s["end"]) for s in spans if s["unit"] == unit])


def cut_texts(marked: DataFrame) -> DataFrame:
    """(ck, n_removed, n_spans, kept_sha256, n_repeated_words): what goes by bytes, and how many words stand in repeated runs of words."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, data, spans in zip(frame["ck"], _encoded(frame), frame["spans"]):
                runs, words = _runs(spans, BYTE), _runs(spans, WORD)
                rows.append((key, sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(data, runs)).hexdigest(), sum(b - a for a, b in words)))
            yield pd.DataFrame(rows, columns=["ck", "n_removed", "n_spans", "kept_sha256", "n_repeated_words"])

    return marked.mapInPandas(run, "ck binary, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long")


def _left_texts(marked: DataFrame) -> DataFrame:
    """(ck, left_text): without the repeated stretches of both kinds."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            left = []
            for data, spans in zip(_encoded(frame), frame["spans"]):
                runs = _runs(spans, BYTE)
                if words := _runs(spans, WORD):
                    chunk = Chunk([data])
                    runs = merged([*runs, *((int(chunk.first[a]), int(chunk.end[b - 1])) for a, b in words)])
                left.append(without(data, runs).decode("utf-8", "ignore"))
            yield pd.DataFrame({"ck": frame["ck"], "left_text": left})

    return marked.mapInPandas(run, "ck binary, left_text string")


def _copies(keyed: DataFrame) -> DataFrame:
    """(ck, n_copies) of the texts that occur several times; written, so that a join may split a hot one."""
    return materialize(keyed.groupBy("ck").agg(F.count("*").alias("n_copies")).where("n_copies > 1"), "copies")


def _n_words() -> Column:
    return F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))


def repeats(docs: DataFrame, length: int = 400, most: int = 20_000, words: int = 0) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `words` also
    n_repeated_words, the words that stand in runs of so many words which occur elsewhere."""
    cut = materialize(cut_texts(removals(docs, length, most, words)).dropDuplicates(["ck"]), "cut")
    keyed = _with_key(docs.select("doc_id", "text"))
    joined = keyed.select("doc_id", "ck", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), *([_n_words().cast("long").alias("n_words")] if words else []))
    joined = joined.join(_copies(keyed.select("ck")), "ck", "left").join(cut, "ck", "left")
    copied = F.col("n_copies").isNotNull()
    all_gone = copied & (F.col("n_bytes") >= length)
    out = joined.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(copied & (F.col("n_words") >= words), F.col("n_words")).otherwise(F.coalesce("n_repeated_words", F.lit(0))).cast("long").alias("n_repeated_words")] if words else []),
    )
    return out


def without_repeats(docs: DataFrame, length: int = 400, most: int = 20_000, words: int = 0) -> DataFrame:
    """docs with repeated passages taken out of text, wherever they stand (a character cut in two goes whole).

    A text that occurs several times is left empty if it has `length` bytes or
    `words` words. Other columns stay, whatever their names.
    """
    cut = materialize(_left_texts(removals(docs, length, most, words)).dropDuplicates(["ck"]), "cut")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    keyed = own.withColumn("ck", F.unhex(F.md5(F.coalesce(text, F.lit("")))))
    joined = keyed.withColumn("text", F.col(text)).join(_copies(keyed.select("ck")), "ck", "left").join(cut, "ck", "left")
    long_ = F.octet_length("text") >= length
    gone = F.col("n_copies").isNotNull() & (long_ | (_n_words() >= words) if words else long_)
    left = F.when(gone, F.lit("")).otherwise(F.coalesce("left_text", "text"))
    return joined.select(*(left.alias(c) if n == text else F.col(n).alias(c) for n, c in zip(names, docs.columns)))
