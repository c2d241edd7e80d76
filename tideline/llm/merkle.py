"""A Merkle manifest of a dataset: a tree of digests a language, one over their roots, a proof a row.

Every row is a leaf: the SHA-256 of its fields, each `-` if null, else its number
of UTF-8 bytes, `:` and its value. The leaves of a language stand in order of id;
every `fanout` consecutive nodes (the last run may be shorter, even one) become
the digest of their digests, until one is left, the language's root. These, in
order of language (null first, by bytes), become the root in the same way.

Levels are tables. Places come from a sort over ranges: a language that holds
most rows is cut into many ranges, each numbered on its own and moved by what
stands before it. A parent is the sorted array of at most `fanout` children of
the same place divided by fanout. Levels of nodes are written, each half as long
as the one below (fanout 2); proofs then come down from the root, a join a level:
what a child needs is its run's other children and what its parent needs, so a
row travels with its siblings once, at the last join, and not at each level.

Defined cases: null ids come first; equal ids go by their leaf, so repeated rows
get neighbouring places. An id's crc32 is that of its decimal text, a null id's
that of the empty string. A null count stays null under tampering, so such a row
verifies. Texts of any length count whole. Columns beside the five are not read;
where one of the five is absent, it counts as null. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:binary,after:binary>"


def digest_of(fields: dict[str, Column]) -> Column:
    """The digest of named fields, in the order of FIELDS."""
    parts = []
    for name in FIELDS:
        value = fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaves(docs: DataFrame, tampered: int | None = 7) -> DataFrame:
    """(doc_id, tree, digest, altered): tree names the language, and sorts as it; altered is the digest with one more character where the id's crc32 is a multiple of `tampered`."""
    own = {f: F.col(f"`{f}`") if f in docs.columns else F.lit(None).cast("string") for f in FIELDS}
    digest = digest_of(own)
    altered = digest
    if tampered:
        more = own | {"n_chars": own["n_chars"].cast("decimal(38,0)") + 1}
        key = F.crc32(F.coalesce(own["doc_id"].cast("string"), F.lit("")).cast("binary"))
        altered = F.when((key % tampered == 0) & own["n_chars"].isNotNull(), digest_of(more)).otherwise(digest)
    tree = F.coalesce(F.concat(F.lit("="), own["lang"].cast("string")), F.lit("-"))
    return docs.select(own["doc_id"].alias("doc_id"), tree.alias("tree"), digest.alias("digest"), altered.alias("altered"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `place`, from 0, in each tree by `order`, and `left`, the tree's number of rows. No task holds more than a range of rows."""
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    laid = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    laid = materialize(laid.withColumns({"_part": F.spark_partition_id(), "_at": local}), "laid")
    counts = laid.groupBy("tree", "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    tree = W.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part")) - F.col("_n")
    offsets = materialize(counts.select("tree", "_part", (before - F.col("_from")).alias("_move"), F.sum("_n").over(tree).alias("left")), "offsets")
    out = materialize(laid.join(offsets, ["tree", "_part"]).withColumn("place", F.col("_at") + F.col("_move")).drop("_part", "_at", "_move"), "numbered")
    forget(laid, offsets)
    return out


def levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Tables (tree, place, left, digest, children) from the given nodes upwards; left is the number of nodes of the tree in that level."""
    most = nodes.agg(F.max("left")).first()[0] or 0
    found = [nodes.select("tree", "place", "left", "digest")]
    while most > 1:
        below = found[-1].where("left > 1").withColumn("up", F.floor(F.col("place") / fanout))
        runs = below.groupBy("tree", "up").agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("run"), F.first("left").alias("left"))
        children = F.transform("run", lambda c: c["digest"])
        text = F.array_join(F.transform("run", lambda c: hexed(c["digest"])), "")
        parents = runs.select("tree", F.col("up").alias("place"), F.ceil(F.col("left") / fanout).alias("left"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), children.alias("children"))
        found.append(materialize(parents, "level"))
        most = -(-most // fanout)
    return found


def tops(tables: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the one node that each tree ends in."""
    last = [t.where("left = 1").select("tree", "digest") for t in tables]
    out = last[0]
    for more in last[1:]:
        out = out.unionByName(more)
    return out


def paths(tables: list[DataFrame], fanout: int, above: DataFrame | None = None) -> DataFrame:
    """(tree, place, path) of the lowest level: a step a level, with the run's digests before and after the node; above (tree, path) continues the paths of whole trees."""
    empty = F.expr(f"cast(array() as array<{STEP}>)")
    found = None
    for level in range(len(tables) - 1, -1, -1):
        own = tables[level].where("left = 1").select("tree", "place")
        own = own.withColumn("path", empty) if above is None else own.join(above, "tree").select("tree", "place", "path")
        if found is not None:
            both = tables[level + 1].join(found, ["tree", "place"])
            child = both.select("tree", (F.col("place") * fanout).alias("first"), "children", "path", F.posexplode("children").alias("nth", "_digest"))
            joined = lambda part: F.aggregate(part, F.lit(b""), lambda a, x: F.concat(a, x))
            step = F.struct(joined(F.slice("children", 1, F.col("nth"))).alias("before"), joined(F.slice("children", F.col("nth") + 2, fanout)).alias("after"))
            down = child.select("tree", (F.col("first") + F.col("nth")).alias("place"), F.concat(F.array(step), "path").alias("path"))
            own = own.unionByName(down)
        found, last = (materialize(own, "paths") if level else own), found
        if level:
            forget(last)
    return found


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest leads to along a path."""
    return F.aggregate(path, hexed(digest), lambda now, s: F.sha2(F.concat(hexed(s["before"]), now, hexed(s["after"])).cast("binary"), 256))


def manifest(docs: DataFrame, fanout: int = 2, tampered: int | None = 7) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified), a row for each of docs; the altered leaf is what is folded."""
    read = materialize(leaves(docs, tampered), "leaves")
    rows = numbered(read, "doc_id", "digest")
    forget(read)
    tables = levels(rows, fanout)
    languages = numbered(tops(tables).select(F.lit("").alias("tree"), F.col("tree").alias("language"), "digest"), "language")
    over = levels(languages, fanout)
    root = tops(over).select(hexed(F.col("digest")).alias("root"))  # one row, or none
    upper = languages.select("tree", "place", "language", F.col("digest").alias("subroot")).join(paths(over, fanout), ["tree", "place"])
    upper = materialize(upper.select(F.col("language").alias("tree"), hexed(F.col("subroot")).alias("subroot"), "path").join(F.broadcast(root), F.lit(True)), "upper")
    down = paths(tables, fanout, upper.select("tree", "path"))
    text = F.array_join(F.transform("path", lambda s: F.concat(hexed(s["before"]), hexed(s["after"]))), "")
    out = rows.join(down, ["tree", "place"]).join(upper.drop("path"), "tree")
    out = out.select("doc_id", hexed(F.col("digest")).alias("leaf"), "subroot", "root", "path", F.sha2(text.cast("binary"), 256).alias("proof_sha256"), folded(F.col("altered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
