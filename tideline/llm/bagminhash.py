"""Near-duplicate documents by BagMinHash over multisets of word shingles.

Signature. The weight axis of each shingle is cut into the dyadic intervals
[0,1), [1,2), [2,4), [4,8), ...; each interval of each shingle has its own
Poisson process, whose points carry a time, a place on the interval and one of
m components. A shingle of weight w owns the points below w: whole intervals
count entirely, the last one is thinned by place. Component k of a text's
signature is the earliest time among the points it owns. As all texts share the
processes, two texts agree in a component with the probability of their
weighted Jaccard index. Points come in order of time, so a process is followed
only until it is later than the latest component found so far.

Candidates share a band of `rows` components. Links are verified by exact
multiset overlap, so signatures only decide which pairs are looked at. Within a
bucket, members are compared with leaders, not each with each: those that link
to a leader join its class, and further leaders (more each round) are compared
only with members of other classes, until no bucket holds two members of
different classes that were not compared. The first round takes a few bands
only, as most copies find their class there. Classes are connected components.

Before that, shingles that only one member has bound what it can share: of two
texts with sizes x, y and such own weight u, v the overlap is at most
m = min(x-u, y-v), the index at most m / (x+y-m). Pairs below the threshold by
this bound are no links, members that can have no partner leave their buckets,
and those with the least own weight lead: in a family of copies that differ
each in its own way, that is the one closest to the original. From the third
round on, where buckets are left whose members resemble each other without
being links, a bitmap of each member's shingles sharpens the bound: a bit that
only one of two members has is a shingle that they do not share.

Defined cases: null text counts as empty. Texts with the same multiset of
shingles (repeated rows, texts without any words) are one class. Rows with a
null id take part; a class's id is its least id that is not null. Texts of any
length count whole; other columns are not looked at. An empty table gives no rows.
The processes of a shingle start from a flat cut of the weight axis into dyadic
intervals, thinned by place in the last; deeper splitting of processes would only
save points.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_by_bytes, forget, frugal, materialize, mix64, prefiltered
from .words import Chunk, shingles

GOLD = np.uint64(0x9E3779B97F4A7C15)
BITS = 2048


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int = 128) -> np.ndarray:
    """n x m earliest times (infinite for a text without shingles); m is a power of two."""
    parts, level, low = [], 0, 0
    while True:
        own = np.flatnonzero(weight > low)
        if not len(own):
            break
        span = max(1, low)
        parts.append((text[own], mix64(value[own] ^ mix64(np.full(1, level + 1, np.uint64))), np.full(len(own), low), np.full(len(own), span), weight[own]))
        level, low = level + 1, low + span
    sig = np.full(n * m, np.inf)
    if not parts:
        return sig.reshape(n, m)
    owner, seed, low, span, top = (np.concatenate(x) for x in zip(*parts))
    time, step = np.zeros(len(owner)), np.uint64(0)
    with np.errstate(over="ignore"):
        while len(owner):
            step += np.uint64(1)
            bits = mix64(seed + step * GOLD)
            time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * span)
            other = mix64(bits)
            component = (other & np.uint64(m - 1)).astype(np.int64)
            place = low + np.floor((other >> np.uint64(11)).astype(np.float64) * 2.0**-53 * span)
            mine = place < top
            np.minimum.at(sig, owner[mine] * m + component[mine], time[mine])
            go = time <= sig.reshape(n, m).max(1)[owner]
            owner, seed, low, span, top, time = (x[go] for x in (owner, seed, low, span, top, time))
    return sig.reshape(n, m)


def bag_keys(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> list[bytes]:
    """16 bytes that name each text's multiset of shingles."""
    packed = np.stack([value, weight.astype(np.uint64)], 1)
    at = np.searchsorted(text, np.arange(n + 1))
    return [hashlib.blake2b(packed[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(n)]


def signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(id, node, bands): node names the multiset; bands is empty for a text without words. A band's number stands in the lowest bits of its hash."""
    low = np.int64((1 << (bands - 1).bit_length()) - 1)
    m = 1 << (bands * rows - 1).bit_length()
    kind = docs.schema["doc_id"].dataType.simpleString()

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [(t or "").encode("utf-8", "replace") for t in frame["text"]]
            for part in batches_by_bytes(texts, 1_000_000):
                own = texts[part]
                text, value, weight = shingles(Chunk(own), size)
                sig = signatures(text, value, weight, len(own), m)[:, : bands * rows].copy().view(np.uint64).reshape(len(own), bands, rows)
                band = np.zeros((len(own), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        band = mix64(band + sig[:, :, r] + GOLD)
                    band = (mix64(band + np.arange(bands, dtype=np.uint64) * GOLD).view(np.int64) & ~low) | np.arange(bands)
                has = np.bincount(text, minlength=len(own)) > 0
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[part], "node": bag_keys(text, value, weight, len(own)), "bands": [b if h else b[:0] for b, h in zip(band, has)]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, node binary, bands array<long>")


def bags(docs: DataFrame, size: int) -> DataFrame:
    """(node, bag, bits) of each row: the multiset itself, packed, and a bitmap of its shingles."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [(t or "").encode("utf-8", "replace") for t in frame["text"]]
            for part in batches_by_bytes(texts, 1_000_000):
                own = texts[part]
                text, value, weight = shingles(Chunk(own), size)
                at = np.searchsorted(text, np.arange(len(own) + 1))
                packed = [packed_bag(value[i:j], weight[i:j]) for i, j in zip(at, at[1:])]
                bits = np.zeros((len(own), BITS), np.uint8)
                bits[text, (value % np.uint64(BITS)).astype(np.int64)] = 1
                yield pd.DataFrame({"node": bag_keys(text, value, weight, len(own)), "bag": packed, "bits": list(np.packbits(bits, axis=1).view(np.int64))})

    return docs.select("text").mapInPandas(run, "node binary, bag binary, bits array<long>")


def packed_bag(value: np.ndarray, weight: np.ndarray) -> bytes:
    """The shingles, ascending, behind their number; then place and weight of those that occur more than once."""
    more = np.flatnonzero(weight > 1)
    return np.uint32(len(value)).tobytes() + value.tobytes() + more.astype("<u4").tobytes() + weight[more].astype("<u4").tobytes()


def unpacked_bag(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(bag, "<u4", 1)[0])
    weight, more = np.ones(n, np.int64), np.frombuffer(bag, "<u4", offset=4 + 8 * n)
    weight[more[: len(more) // 2]] = more[len(more) // 2 :]
    return np.frombuffer(bag, "<u8", n, 4), weight


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard index of two packed multisets."""
    (u, p), (v, q) = unpacked_bag(a), unpacked_bag(b)
    at = np.searchsorted(v, u)
    i = np.flatnonzero(v[np.minimum(at, len(v) - 1)] == u) if len(v) else np.zeros(0, np.int64)
    both = int(np.minimum(p[i], q[at[i]]).sum())
    return both / max(1, int(p.sum()) + int(q.sum()) - both)


def verified(pairs: DataFrame, contents: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose overlap is at least `least`; of contents only what pairs name is shuffled."""
    n = pairs.count()

    def side(name: str) -> DataFrame:
        return prefiltered(contents.select(F.col("node").alias(name), F.col("bag").alias(f"bag_{name}")), name, pairs.select(name), n)

    both = pairs.join(side("b"), "b").join(side("a"), "a")

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yes = [overlap(a, b) >= least for a, b in zip(frame["bag_a"], frame["bag_b"])]
            yield frame.loc[yes, ["a", "b"]]

    return both.select("a", "b", "bag_a", "bag_b").mapInPandas(run, "a binary, b binary")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after joining the components that links (a, b) connect.

    Every round a component takes the least label among its neighbours', then
    labels follow labels, so the rounds grow as the logarithm of the longest chain.
    """
    while True:
        by = labels.select(F.col("node").alias("a"), F.col("comp").alias("comp_a"))
        other = labels.select(F.col("node").alias("b"), F.col("comp").alias("comp_b"))
        apart = links.join(by, "a").join(other, "b").where("comp_a <> comp_b").select("comp_a", "comp_b").distinct()
        moves = first_moves = materialize(apart.select(F.greatest("comp_a", "comp_b").alias("comp"), F.least("comp_a", "comp_b").alias("to")).groupBy("comp").agg(F.min("to").alias("to")), "moves")
        if moves.isEmpty():
            forget(moves)
            return labels
        for _ in range(2):  # a move to a component that moves itself goes on to where that goes
            onward = moves.select(F.col("comp").alias("to"), F.col("to").alias("further"))
            moves = moves.join(onward, "to", "left").select("comp", F.coalesce("further", "to").alias("to"))
        labels, before = materialize(labels.join(moves, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels"), labels
        forget(first_moves, before)


def own_weight(contents: DataFrame) -> DataFrame:
    """(node, size, own): total weight, and the weight of the shingles that no other member has."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [unpacked_bag(b) for b in frame["bag"]]
            yield pd.DataFrame({"node": frame["node"], "shingle": [u.view(np.int64) for u, _ in found], "weight": [w.astype("i4") for _, w in found]})

    lists = contents.mapInPandas(run, "node binary, shingle array<long>, weight array<int>")
    each = lists.select(F.xxhash64("node").alias("id"), F.explode(F.arrays_zip("shingle", "weight")).alias("s")).select("id", "s.shingle", "s.weight")
    alone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("weight").alias("weight")).where("n = 1").groupBy("id").agg(F.sum("weight").alias("own"))
    total = lists.select("node", F.xxhash64("node").alias("id"), F.aggregate("weight", F.lit(0).cast("long"), lambda a, w: a + w).alias("size"))
    return total.join(alone, "id", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own"))


def _reaches(alone: Column, alone_a: Column, least: float) -> Column:
    """Can two multisets (size, size_a) be as alike as `least`, if so much of each is not shared?"""
    most = F.least(F.col("size") - alone, F.col("size_a") - alone_a)
    return most >= least * (F.col("size") + F.col("size_a") - most) - 1e-6


def classes(docs: DataFrame, least: float = 0.8, size: int = 5, bands: int = 32, rows: int = 4, early: int = 6) -> DataFrame:
    """(doc_id, class_id, class_size), a row for each row of docs."""
    own = materialize(signed(docs, size, bands, rows), "signed")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = materialize(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared")
    buckets = materialize(spread.join(shared, "bucket"), "buckets")
    forget(shared)
    members = materialize(nodes.select("node", "rep").join(buckets.select("node").distinct(), "node", "left_semi"), "members")
    forget(nodes)
    ids = members.select(F.col("rep").alias("doc_id")).where("doc_id is not null")
    wanted = prefiltered(docs, "doc_id", ids, members.count()).join(ids, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
    contents = materialize(bags(wanted, size).dropDuplicates(["node"]).join(members.select("node"), "node", "left_semi"), "bags")
    weights = own_weight(contents).where(F.col("size") - F.col("own") >= least * F.col("size"))
    buckets, all_ = materialize(buckets.join(weights, "node"), "able"), buckets
    forget(all_, members)
    labels = materialize(buckets.select("node", F.col("node").alias("comp")).distinct(), "labels")
    led, ones = None, F.aggregate("bits", F.lit(0), lambda n, x: n + F.bit_count(x))
    band = F.col("bucket").bitwiseAND(F.lit((1 << (bands - 1).bit_length()) - 1))
    for leaders in itertools.chain([0, 1], (32**i for i in itertools.count(1))):
        open_ = buckets.join(labels, "node")
        if led is not None:
            open_ = open_.join(led, ["bucket", "node"], "left_anti")
        if not leaders:
            open_ = open_.where(band < early)
        mixed = materialize(open_.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket"), "mixed")
        open_ = open_.join(mixed, "bucket")
        if leaders > 1:
            open_ = open_.join(contents.select("node", "bits", ones.alias("ones")), "node")
        open_ = materialize(open_, "open")
        forget(mixed)
        if open_.isEmpty() and leaders:
            forget(open_)
            break
        order = W.partitionBy("bucket").orderBy(F.col("own") / F.col("size"), "node")
        first = open_.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(1, leaders))
        first = materialize(first.select("bucket", *(F.col(c).alias(f"{c}_a") for c in open_.columns if c != "bucket")), "leaders")
        may = (F.col("comp") != F.col("comp_a")) & _reaches(F.col("own"), F.col("own_a"), least)
        if leaders > 1:
            both = F.aggregate(F.zip_with("bits", "bits_a", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)
            may &= _reaches(F.col("ones") - both, F.col("ones_a") - both, least)
        pairs = open_.withColumnRenamed("bucket", "k").join(first, (F.col("k") == F.col("bucket")) & may).select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct()
        pairs = materialize(pairs, "pairs")
        links = materialize(verified(pairs, contents, least), "links")
        forget(open_, pairs)
        labels = components(labels, links)
        forget(links)
        now = first.select("bucket", F.col("node_a").alias("node"))
        led = now if led is None else led.unionByName(now)
    forget(contents)
    named = own.select("doc_id", "node").join(labels, "node", "left").select("doc_id", F.coalesce("comp", "node").alias("comp"))
    ids = materialize(named.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "ids")
    return named.join(ids, "comp").select("doc_id", "class_id", "class_size")
