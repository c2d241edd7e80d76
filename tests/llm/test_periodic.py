"""Runs against a search of all periods and starts, and the digests derived from them."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tideline.llm import periodic


def brute(words: list) -> list[tuple[int, int, int]]:
    """Every maximal stretch of each period, kept where no smaller period holds in it."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(6, 4 * q) and not any(all(words[i] == words[i + p] for i in range(s, s + length - p)) for p in range(1, q)):
                found.append((s, length, q))
            s = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(rng: random.Random) -> list[str]:
    words = []
    while len(words) < rng.choice([0, 3, 30, 120, 300]):
        if rng.random() < 0.5:
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 20))]
        else:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
            words += (unit * rng.randint(2, 9))[: -rng.randint(0, len(unit) - 1) or None]
    return words


def coded(words: list) -> np.ndarray:
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [planted(rng) for _ in range(40)]
    texts += [["a"] * 200, ["a", "b"] * 90 + ["a"], list("aab" * 40 + "b" + "aab" * 30), [], ["a"] * 5, ["a"] * 6]
    codes = [coded(t) for t in texts]
    for words, code, matches in zip(texts, codes, periodic.lag_matches(codes)):
        assert periodic.runs_of(code, matches) == brute(words)


def test_lag_matches_are_exact_for_heavy_and_light_words():
    rng = np.random.default_rng(1)
    texts = [rng.choice(40, 3000, p=[0.6, *[0.4 / 39] * 39]), rng.integers(0, 900, 2000), np.zeros(0, np.int64), np.zeros(4000, np.int64)]
    for code, got in zip(texts, periodic.lag_matches(texts)):
        want = [len(code), *((code[q:] == code[:-q]).sum() for q in range(1, len(code) // 4 + 1))]
        assert got[1:].tolist() == want[1:]


def test_long_periodic_text_ends_soon():
    code = np.tile(np.arange(3), 40_000)
    assert periodic.runs_of(code, periodic.lag_matches([code])[0]) == [(0, 120_000, 3)]


def expected(doc_id, text) -> tuple:
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


def test_query_columns_over_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(planted(rng))) for i in range(60)]
    rows += [(None, "x y " * 30), (7, None), (8, ""), (8, " \t\n"), (9, "é " * 40), (10, "A a " * 20), (11, "a b " * 9), rows[3], rows[3], (2**60 + 1, "p q r " * 12 + "long " * 3000)]
    docs = spark.createDataFrame([(t, d, 1, "z") for d, t in rows], "text string, doc_id long, runs int, key string").repartition(3)
    got = periodic.summary(periodic.runs(docs, loops=True))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(d, t) for d, t in rows), key=str)
    assert periodic.summary(periodic.runs(docs.where("false"))).count() == 0


def test_string_ids(spark):
    got = periodic.summary(periodic.runs(spark.createDataFrame([("a1", "u v " * 8)], "doc_id string, text string"))).first()
    assert (got["doc_id"], got["start"], got["length"], got["period"], got["exponent_milli"]) == ("a1", 0, 16, 2, 8000)
