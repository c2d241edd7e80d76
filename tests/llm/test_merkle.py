"""The manifest against a plain tree in Python, over nulls, ties, repeated rows and further columns."""

import zlib
from hashlib import sha256

import pytest

from tideline.llm import merkle


def H(x: str) -> str:
    return sha256(x.encode()).hexdigest()


def leaf(row: dict, more: int = 0) -> str:
    def put(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    n = row["n_chars"]
    return H("".join(put(x) for x in (row["doc_id"], row["source"], row["lang"], None if n is None else n + more, row["text"])))


def climb(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root, and of each node its steps (siblings before, after)."""
    steps, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            for j in range(len(run)):
                for o in owners[i + j]:
                    steps[o].append((run[:j], run[j + 1 :]))
            up.append(H("".join(run)))
            above.append([o for own in owners[i : i + fanout] for o in own])
        nodes, owners = up, above
    return nodes[0], steps


def plain(rows: list[dict], fanout: int) -> list[tuple]:
    key = lambda lang: (lang is not None, (lang or "").encode())
    trees = []
    for lang in sorted({r["lang"] for r in rows}, key=key):
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own], fanout)))
    root, over = climb([t[1] for t in trees], fanout) if trees else (None, [])
    out = []
    for (own, subroot, steps), upper in zip(trees, over):
        for r, low in zip(own, steps):
            path = low + upper
            now = leaf(r, 1 if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 0 and r["n_chars"] is not None else 0)
            for before, after in path:
                now = H("".join(before) + now + "".join(after))
            out.append((r["doc_id"], leaf(r), subroot, root, H("".join("".join(b + a) for b, a in path)), now, now == root))
    return sorted(out, key=str)


def rows_of(n: int) -> list[dict]:
    out = [{"doc_id": i * 3, "source": None if i % 5 == 0 else f"s{i % 4}", "lang": [None, "", "en", "en", "en", "ü", "de"][i % 7], "n_chars": None if i % 6 == 0 else i, "text": [None, "", "a b", "é" * 40, "x" * 20_000][i % 5]} for i in range(n)]
    return out + out[:3] + [dict(out[4], text="other"), dict(out[4], doc_id=None), dict(out[5], doc_id=None, n_chars=2**63 - 1)]


@pytest.mark.parametrize("fanout", [2, 3])
def test_equals_a_plain_tree(spark, fanout):
    rows = rows_of(90)
    docs = spark.createDataFrame([(r["text"], r["doc_id"], r["lang"], 1, r["n_chars"], r["source"], "x") for r in rows], "text string, doc_id long, lang string, place int, n_chars long, source string, tree string").repartition(5)
    found = merkle.manifest(docs, fanout=fanout)
    got = sorted((tuple(r) for r in found.drop("path").collect()), key=str)
    assert got == plain(rows, fanout)
    assert {r["verified"] for r in found.select("verified").collect()} == {True, False}


def test_one_row_and_none(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    one = merkle.manifest(spark.createDataFrame([(5, "s", "en", 1, "a")], kind)).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof_sha256"] == H("") and one[0]["verified"]
    assert merkle.manifest(spark.createDataFrame([], kind)).count() == 0


def test_a_large_tree_is_numbered_over_ranges(spark):
    """Every place once, although one tree holds nearly all rows and they lie in several ranges."""
    rows = spark.range(20_000).selectExpr("if(id % 100 = 0, 'b', 'a') as tree", "id * 7919 % 20011 as k")
    got = merkle.numbered(rows, "k").toPandas()
    for _, own in got.groupby("tree"):
        own = own.sort_values("k")
        assert own["place"].tolist() == list(range(len(own))) and set(own["left"]) == {len(own)}
