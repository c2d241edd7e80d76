"""The exact join against all pairs, over families of near copies, sizes at the bound and odd rows."""

import random
import re

import pytest

from tideline.llm import set_join


def shingles(text, size=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), d if not s else least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def prose(rng, n):
    return [f"w{rng.randint(0, 400)}" for _ in range(n)]


def families(seed):
    """Families whose members differ by a few words, chains that drift away, sets of sizes at the bound, one common passage in all."""
    rng = random.Random(seed)
    common, rows = prose(rng, 30), []
    for f in range(6):
        base = prose(rng, rng.choice([12, 60, 150]))
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(["x", "y", "z"])
            rows.append(" ".join(own + (common if f % 2 else [])))
            if rng.random() < 0.3:
                base[rng.randrange(len(base))] = "drift"
    whole = prose(rng, 104)  # 100 shingles; cut to 84 words it has 80, to 83 it has 79
    rows += [" ".join(whole), " ".join(whole[:84]), " ".join(whole[:83])]
    rows += [" ".join(prose(rng, rng.randint(1, 40)) + common) for _ in range(20)]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = families(seed)
    got = set_join.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    long = " ".join(prose(rng, 20_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a\nB"), (6, "a b c"), (None, "a b"), (None, None), (7, long), (8, long + " tail"), (9, "é 漢 a b c d"), (9, "other words stand here now ok"), (4, "a b"), (None, "q r s t u v"), (None, "q r s t u v")]
    docs = spark.createDataFrame([(t, d, 3, b"x") for d, t in rows], "text string, doc_id long, n int, node binary")
    assert sorted(map(tuple, set_join.linked(docs).collect()), key=str) == brute(rows)
    assert set_join.linked(docs.limit(0)).count() == 0


def test_answers_of_a_leader_decide_pairs(spark):
    """A family in one block, no two of whose second half link with the leader: later rounds use the leader's answers, results stay whole."""
    rng = random.Random(3)
    base = prose(rng, 100)
    rows = []
    for i in range(30):
        own = list(base)
        at = 3 * (i % 6)
        own[at : at + 12 + i // 6] = [f"v{i % 6}_{j}" for j in range(12 + i // 6)]
        rows.append((i, " ".join(own)))
    got = set_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
