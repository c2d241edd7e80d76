"""Nearest neighbours by vantage-point trees, one a shard, searched for batches of queries.

Largest inner product becomes smallest Euclidean distance by one more
coordinate: sqrt(M^2 - |x|^2) for a candidate, 0 for a query, M being the
largest norm. Each shard's tree splits at the median distance from a vantage
point. A query descends first into its own side; the other side is skipped when
the triangle inequality shows that nothing there can be nearer than its
k-th best so far: |d - median| * factor > k-th distance. Factor one is exact;
a larger one skips more.

Distances are rounded, so whatever may be as near as the k-th within a margin is
weighed by its inner product itself, in double precision on the vectors as given,
and equal products go by the smaller id before anything is cut.

Equal vectors are indexed once with their k+1 least ids, as no more can appear
among a query's k nearest; equal queries are searched once. A shard's tree is
built once and written; queries in blocks meet trees in cells of bounded size, so
that neither side is held whole.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part. Vectors of different length
never meet. Repeated rows (same id and vector) count once. Fewer candidates
than k: all of them. Ties go to the smaller id. Other columns are not looked at;
an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import frugal, materialize

LEAF = 256


class Tree:
    """Vectors x (n x d) with ids, lifted by a coordinate. Nodes are (vantage, median, inside, outside); leaves are index arrays."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, top: float, leaf: int = LEAF):
        self.x, self.ids, self.top, self.leaf = x, ids, top, leaf
        self.lift = np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", x, x), 0))
        self.root = self._build(np.arange(len(x)))

    def _build(self, own: np.ndarray):
        if len(own) <= self.leaf:
            return own
        vantage = own[len(own) // 2]  # order is by hash, so this is as good as a random one
        d = np.sqrt(np.maximum(2 * self.top**2 - 2 * (self.x[own] @ self.x[vantage] + self.lift[own] * self.lift[vantage]), 0))
        half = len(own) // 2
        order = np.argpartition(d, half)
        median = float(d[order[half]])
        return vantage, median, self._build(own[order[:half]]), self._build(own[order[half:]])

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(inner products, indices), q x k, nearest first, equal ones by id; index -1 where there are fewer points."""
        q = len(queries)
        self.q, self.k, self.factor = queries, k, factor
        self.far = np.einsum("ij,ij->i", queries, queries) + self.top**2  # squared distance is this less twice the product
        self.slack = 1e-11 * self.far
        self.score, self.at, self.id = np.full((q, k), -np.inf), np.full((q, k), -1), np.full((q, k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(q))
        return self.score, self.at

    def _weigh(self, query: np.ndarray, at: np.ndarray) -> None:
        """Candidates (query, at) join the best ones of their queries."""
        score = np.concatenate([(self.x[at[i : i + 65536]] * self.q[query[i : i + 65536]]).sum(1) for i in range(0, len(at), 65536)])
        some = np.unique(query)
        old = np.repeat(some, self.k)
        query, score, at, ids = (np.concatenate(p) for p in ((old, query), (self.score[some].ravel(), score), (self.at[some].ravel(), at), (self.id[some].ravel(), self.ids[at])))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep, order = place < self.k, order[place < self.k]
        rows, places = query[keep], place[keep]
        self.score[rows, places], self.at[rows, places], self.id[rows, places] = score[order], at[order], ids[order]

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            rough = self.q[active] @ self.x[node].T
            rows, columns = np.nonzero(rough >= (self.score[active, -1] - self.slack[active])[:, None])
            if len(rows):
                self._weigh(active[rows], node[columns])
            return
        vantage, median, inside, outside = node
        d = np.sqrt(np.maximum(self.far[active] - 2 * (self.q[active] @ self.x[vantage]), 0))
        near = d < median
        for first, second, mine in ((inside, outside, near), (outside, inside, ~near)):
            own = active[mine]
            self._visit(first, own)
            bound = np.sqrt(np.maximum(self.far[own] - 2 * self.score[own, -1], 0) + self.slack[own]) + np.sqrt(self.slack[own])
            self._visit(second, own[~(np.abs(d[mine] - median) * self.factor > bound)])


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, key): key packs the components as doubles, for rows that take part."""
    v = F.col(vector).cast("array<double>")
    big = F.lit(float("inf"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < big)) & F.exists(v, lambda c: c != 0)
    good = rows.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)))

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "key": [(np.asarray(x, np.float64) + 0.0).tobytes() for x in frame["v"]]})

    return good.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).mapInPandas(run, "id long, key binary")


def distinct_vectors(own: DataFrame, keep: int) -> DataFrame:
    """(key, ids): each distinct vector with its `keep` least ids; tasks reduce their own rows first."""

    @frugal
    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame.drop_duplicates().sort_values("id").groupby("key", sort=False)["id"]
            found = [(key, own.to_numpy()[:keep]) for key, own in ids]
            yield pd.DataFrame(found, columns=["key", "ids"])

    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return own.mapInPandas(reduce, "key binary, ids array<long>").groupBy("key").agg(least.alias("ids"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_column: str = "vec_id", vector: str = "embedding", shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest other rows by inner product."""
    own = usable(vectors, id_column, vector)
    index = materialize(distinct_vectors(own, k + 1), "vectors")
    asked = materialize(usable(queries, id_column, vector).dropDuplicates(), "asked")
    probes = materialize(asked.groupBy("key").agg(F.min("id").alias("probe")), "probes")

    @frugal
    def norms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"norm": [np.linalg.norm(np.frombuffer(x)) for x in frame["key"]]})

    total = index.mapInPandas(norms, "norm double").agg(F.count("*").alias("n"), F.max("norm").alias("top")).first()
    shards, blocks = -(-total["n"] // shard_rows) or 1, -(-probes.count() // block_rows) or 1
    top = (total["top"] or 0.0) * (1 + 1e-9)
    place = F.pmod(F.xxhash64("key"), F.lit(2**40))
    sized = lambda rows, count, name: rows.withColumn("size", F.octet_length("key")).withColumn(name, F.pmod(place, F.lit(count)))

    def planted(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["ids"].tolist()
        tree = Tree(np.stack([np.frombuffer(b) for b in frame["key"]]), np.array([i[0] for i in ids]), top)
        return pd.DataFrame({"size": frame["size"].iloc[:1], "shard": frame["shard"].iloc[:1], "tree": [pickle.dumps((tree, ids), 5)]})

    def gathered(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"size": frame["size"].iloc[:1], "block": frame["block"].iloc[:1], "queries": [b"".join(frame["key"])], "probes": [frame["probe"].to_numpy()]})

    trees = materialize(sized(index, shards, "shard").groupBy("size", "shard").applyInPandas(planted, "size int, shard long, tree binary"), "trees")
    asking = materialize(sized(probes, blocks, "block").groupBy("size", "block").applyInPandas(gathered, "size int, block long, queries binary, probes array<long>"), "blocks")
    left = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = asking.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def cell(planted: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if planted.empty or asked.empty:
            return pd.DataFrame({"probe": [], "vec_id": [], "score": []})
        tree, ids = pickle.loads(planted["tree"].iloc[0])
        probe = asked["probes"].iloc[0]
        score, at = tree.search(np.frombuffer(asked["queries"].iloc[0]).reshape(len(probe), -1), min(k + 1, len(ids)), factor)
        rows = []
        for i in range(len(probe)):
            n = int((at[i] >= 0).sum())
            many = [ids[j] for j in at[i, :n]]
            own, scores = np.concatenate(many), np.repeat(score[i, :n], [len(m) for m in many])
            best = np.lexsort((own, -scores))[: k + 1]
            rows.append((np.full(len(best), probe[i]), own[best], scores[best]))
        return pd.DataFrame(dict(zip(("probe", "vec_id", "score"), (np.concatenate(x) for x in zip(*rows)))))

    keys = ["size", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "probe long, vec_id long, score double")
    best = W.partitionBy("probe").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).groupBy("probe").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near"))
    answers = asked.join(probes, "key").select(F.col("id").alias("query_id"), "probe").join(found, "probe")
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "near")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), (-F.col("near.minus")).alias("score"))
