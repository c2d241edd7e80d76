"""Exact Jaccard join of documents as sets of word shingles, and the components its links make.

Two sets link when 100 * |both| >= percent * |either|. No link between different
texts is lost: candidates come from prefixes, not from sketches.

Index. The shingles of a set stand in one order for all sets, rare ones first (by
counts of 2**18 buckets of hashes over all documents; any order is right, this one
keeps common passages out of the prefixes). Linked sets share a shingle among the
first n - ceil(percent * n / 100) + 1 of each. The list of a shingle is cut into
blocks of sizes that may link: a set stands in two neighbouring blocks, so that a
pair whose sizes are in reach meets in one. By position: the shingles behind a
place bound what two sets share from there on, so a block's least size tells which
of its members are skipped before any pair is made, and a pair of places bounds
the pair. What has no partner left in a block never leaves the index.

Answers by relation. In each block leaders are compared with the members of other
components, not members with each other. The shared shingles of a member y with
its best leader x are kept as its answer. Two sets y, z of the same leader share
between |xy| + |xz| - |x| and min(|xy|, |xz|) + min(|y| - |xy|, |z| - |xz|)
shingles, so most pairs of a family are linked, or ruled out, by what x's answers
say, others by bitmaps of both (whose bound is an answer too); only the rest read
texts. Rounds go on, with more leaders each, until no
block holds two members of different components that were not compared.

Defined cases: a text of fewer words than a shingle is one shingle; a text without
words (or null) has the empty set, which links with nothing, so its component is
its own id. Equal sets link, however many rows have them. A component's id is the
least that is not null; rows with equal ids are rows of their own. Shingles count
as equal by 64 bits of a hash. Other columns are not looked at, an empty table
gives no rows, texts of any length count whole.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bagminhash import components
from .common import batches_by_bytes, forget, frugal, materialize, prefiltered
from .words import Chunk, shingles

BUCKETS, BITS = 1 << 18, 2048


def _sets(texts: list[str | None], size: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """Batches of texts: (rows, text, shingle) by text and shingle, 16 bytes that name each set, and the set sizes."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    for part in batches_by_bytes(raw, 1_000_000):
        own = raw[part]
        text, value, _ = shingles(Chunk(own), size)
        n = np.bincount(text, minlength=len(own))
        at = np.concatenate([[0], np.cumsum(n)])
        yield part, text, value, [hashlib.blake2b(value[i:j].tobytes(), digest_size=16).digest() for i, j in zip(at, at[1:])], n


def keyed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, node, n) of each row, node naming its set; and a row a task without node: how many sets hold a shingle of each bucket."""
    kind = docs.schema["doc_id"].dataType

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS, np.int64)
        for frame in frames:
            for part, _, value, nodes, n in _sets(frame["text"].tolist(), size):
                counts += np.bincount((value % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                yield pd.DataFrame({"key": frame["key"].iloc[part], "node": nodes, "n": n, "bucket": None, "seen": None})
        if len(has := np.flatnonzero(counts)):
            yield pd.DataFrame({"key": [None], "node": [None], "n": [0], "bucket": [has.astype("i4")], "seen": [counts[has]]})

    out = docs.select(F.col("doc_id").cast("string").alias("key"), "text").mapInPandas(run, "key string, node binary, n long, bucket array<int>, seen array<long>")
    return out.select(F.col("key").cast(kind).alias("doc_id"), "node", "n", "bucket", "seen")


def bucket_counts(own: DataFrame) -> np.ndarray:
    """The counts of all tasks, summed: BUCKETS numbers, whatever the size of the table."""
    each = own.where("node is null").select(F.explode(F.arrays_zip("bucket", "seen")).alias("s")).groupBy(F.col("s.bucket").alias("bucket")).agg(F.sum("s.seen").alias("seen")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[each["bucket"].to_numpy(np.int64)] = each["seen"].to_numpy(np.int64)
    return counts


def prefixes(docs: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(node, n, prefix, bits) of each row: its set's first shingles, rare ones first, and a bitmap of all."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, text, value, nodes, n in _sets(frame["text"].tolist(), size):
                bits = np.zeros((len(n), BITS), np.uint8)
                bits[text, (value >> np.uint64(40)).astype(np.int64) % BITS] = 1
                value = value[np.lexsort((value, counts[(value % np.uint64(BUCKETS)).astype(np.int64)], text))].view(np.int64)
                at = np.concatenate([[0], np.cumsum(n)])[:-1]
                most = n - -(-percent * n // 100) + 1
                yield pd.DataFrame({"node": nodes, "n": n, "prefix": [value[i : i + m] for i, m in zip(at, np.minimum(most, n))], "bits": list(np.packbits(bits, axis=1).view(np.int64))})

    return docs.select("text").mapInPandas(run, "node binary, n long, prefix array<long>, bits array<long>").where("n > 0")


def each_once(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with each node once; only those of nodes that occur more than once are shuffled."""
    many = nodes.groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1").select("node")
    n = many.count()
    lone, copies = (prefiltered(rows, "node", many, n, how=how) for how in ("left_anti", "left_semi"))
    return lone.unionByName(copies.groupBy("node").agg(*(F.first(c).alias(c) for c in rows.columns if c != "node")).select(*rows.columns))


def contents(docs: DataFrame, size: int) -> DataFrame:
    """(node, text) of each row: a text compresses, the numbers of its shingles don't, so texts travel and are cut up again where they are compared."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, _, _, nodes, n in _sets(frame["text"].tolist(), size):
                yield pd.DataFrame({"node": nodes, "text": frame["text"].iloc[part].array})[n > 0]

    return docs.select("text").mapInPandas(run, "node binary, text string")


def _enough(both: Column, n: Column, m: Column, percent: int) -> Column:
    """Do sets of n and m shingles link if they share so many? In whole numbers: (100 + p) * both >= p * (n + m)."""
    return (100 + percent) * both >= percent * (n + m)


def blocks(postings: DataFrame, percent: int) -> DataFrame:
    """(block, node, n, pos, node_a, n_a, pos_a): each list cut by sizes, beside the block's first leader, without what cannot have a partner in its block."""
    band = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(100 / percent))) if percent < 100 else F.col("n")
    near = F.explode(F.array(band - 1, band) if percent < 100 else F.array(band))
    spread = postings.withColumn("band", near).select(F.xxhash64("token", "band").alias("block"), "node", "n", "pos")
    first = F.min(F.struct((F.col("pos") / F.col("n")).alias("share"), "node", "n", "pos"))
    heads = spread.groupBy("block").agg(F.count("*").alias("members"), F.min("n").alias("least"), first.alias("a")).where("members > 1")
    smallest = F.greatest("least", F.ceil(percent * F.col("n") / 100))
    both = spread.join(heads, "block").where(_enough(F.col("n") - F.col("pos"), F.col("n"), smallest, percent))
    return both.select("block", "node", "n", "pos", F.col("a.node").alias("node_a"), F.col("a.n").alias("n_a"), F.col("a.pos").alias("pos_a"))


def _near(percent: int) -> Column:
    """Do sizes and places leave a leader (n_a, pos_a) and a member (n, pos) so many shingles to share?"""
    n, m = F.col("n"), F.col("n_a")
    rest = F.least(n - F.col("pos"), m - F.col("pos_a"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & _enough(rest, n, m, percent)


def bounded(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) with both sizes and `high`, the most that they can share by their bitmaps: a bit of one set alone is a shingle that the other lacks."""
    side = lambda name: marks.select(F.col("node").alias(name), F.col("size").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    alone = lambda x, y: F.aggregate(F.zip_with(f"bits_{x}", f"bits_{y}", lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda n, k: n + k)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "n_b", F.least(F.col("n_a") - alone("a", "b"), F.col("n_b") - alone("b", "a")).alias("high"))


def compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) with the number of shingles that both have, and both sizes; of the texts only what pairs name is shuffled."""
    count = pairs.count()

    def side(name: str) -> DataFrame:
        return prefiltered(texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}")), name, pairs.select(name), count)

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sides = [len(x) + len(y) for x, y in zip(frame["text_a"], frame["text_b"])]
            for part in batches_by_bytes([range(n) for n in sides], 4_000_000):
                rows, sets, out = frame.iloc[part], {}, []
                own = dict(zip(rows["a"], rows["text_a"])) | dict(zip(rows["b"], rows["text_b"]))
                names = list(own)
                for which, text, value, _, n in _sets(list(own.values()), size):
                    at = np.concatenate([[0], np.cumsum(n)])
                    sets.update(zip(names[which], (value[i:j] for i, j in zip(at, at[1:]))))
                for a, b in zip(rows["a"], rows["b"]):
                    u, v = sets[a], sets[b]
                    at = np.searchsorted(v, u)
                    out.append((int((v[np.minimum(at, len(v) - 1)] == u).sum()), len(u), len(v)))
                yield rows[["a", "b"]].assign(**{c: [r[i] for r in out] for i, c in enumerate(("both", "n_a", "n_b"))})

    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInPandas(run, "a binary, b binary, both long, n_a long, n_b long")


def texts_of(rows: DataFrame, nodes: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(node, text) of each member, once, and of some other rows by chance: found by the id that stands for it, without a shuffle but of copies."""
    ids, n = members.select("doc_id").where("doc_id is not null"), members.count()
    wanted = prefiltered(rows, "doc_id", ids, n).unionByName(rows.where("doc_id is null"))
    return each_once(prefiltered(contents(wanted, size), "node", members.select("node"), n), nodes)


def linked(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs."""
    rows = docs.select("doc_id", "text")
    own = materialize(keyed(rows, size), "keyed")
    nodes = own.where("node is not null")
    drawn = materialize(prefixes(rows, size, percent, bucket_counts(own)), "prefixes")
    heads = each_once(drawn.select("node", "n", "prefix"), nodes)
    shared = materialize(heads.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1").select("token"), "shared")
    each = heads.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    postings = materialize(prefiltered(each, "token", shared, shared.count()).join(shared, "token").select("token", "node", "n", "pos"), "postings")
    forget(shared)
    entries = materialize(blocks(postings, percent), "blocks")
    forget(postings)
    members = materialize(nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(entries.select("node").distinct(), "node", "left_semi"), "members")
    marks = prefiltered(drawn.select("node", F.col("n").alias("size"), "bits"), "node", members.select("node"), members.count())
    marks = materialize(marks.dropDuplicates(["node"]), "marks")
    forget(drawn)
    texts = materialize(texts_of(rows, nodes, members, size), "texts")
    labels = materialize(members.select("node", F.col("node").alias("comp")), "labels")
    forget(members)
    found = entries.where((F.col("node") != F.col("node_a")) & _near(percent)).select(F.col("node_a").alias("a"), F.col("node").alias("b"), F.lit(False).alias("sure"))
    open_, held, answers = entries.where("node <> node_a").select("block", "node", "n", "pos"), [entries], None
    for leaders in (32**i for i in itertools.count(1)):
        pairs = materialize(found.distinct(), "pairs")
        looked = materialize(bounded(pairs.where("not sure").select("a", "b"), marks), "looked")
        may = _enough(F.col("high"), F.col("n_a"), F.col("n_b"), percent)
        checked = materialize(compared(looked.where(may).select("a", "b"), texts, size), "checked")
        links = checked.where(_enough(F.col("both"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b").unionByName(pairs.where("sure").select("a", "b"))
        labels = components(labels, links)
        # a member's answer: what it shares with a leader, exactly or, where bitmaps rule the pair out, at most; exact ones go first
        exact = checked.select(F.col("b").alias("node"), F.struct((F.col("both") / F.col("n_b")).alias("share"), F.col("a").alias("base"), F.col("both").alias("low"), F.col("both").alias("high"), F.col("n_a").alias("size")).alias("answer"))
        bound = looked.where(~may).select(F.col("b").alias("node"), F.struct((F.col("high") / F.col("n_b") - 1).alias("share"), F.col("a").alias("base"), F.lit(0).cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.col("n_a").alias("size")).alias("answer"))
        old, best = answers, exact.unionByName(bound)
        answers = materialize((best if old is None else best.unionByName(old)).groupBy("node").agg(F.max("answer").alias("answer")), "answers")
        forget(pairs, looked, checked, old)
        # blocks whose members are of one component stay so; only the others go on
        named = open_.join(labels, "node")
        mixed = materialize(named.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("block"), "mixed")
        open_ = materialize(named.join(mixed, "block").join(answers, "node", "left"), "open")
        forget(mixed, *held)
        if open_.isEmpty():
            break
        order = W.partitionBy("block").orderBy(F.col("pos") / F.col("n"), "node")
        first = open_.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= leaders)
        first = materialize(first.select("block", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos", "comp", "answer"))), "leaders")
        n, m, x, y = F.col("n"), F.col("n_a"), F.col("answer"), F.col("answer_a")
        same = F.coalesce(x["base"] == y["base"], F.lit(False))
        most = F.least(x["high"], y["high"]) + F.least(n - x["low"], m - y["low"])
        known = F.coalesce(x["base"] == F.col("node_a"), F.lit(False)) | F.coalesce(y["base"] == F.col("node"), F.lit(False))
        may = (F.col("comp") != F.col("comp_a")) & _near(percent) & ~known & (~same | _enough(most, n, m, percent))
        sure = same & _enough(x["low"] + y["low"] - x["size"], n, m, percent)
        found = open_.withColumnRenamed("block", "k").join(first, (F.col("k") == F.col("block")) & may).select(F.col("node_a").alias("a"), F.col("node").alias("b"), sure.alias("sure"))
        held, led = [open_, first], first.select("block", F.col("node_a").alias("node"))
        open_ = open_.select("block", "node", "n", "pos").join(led, ["block", "node"], "left_anti")
    forget(texts, marks, open_, answers)
    named = nodes.join(labels, "node", "left").select("doc_id", "n", F.coalesce("comp", "node").alias("comp"))
    least = materialize(named.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    out = named.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
