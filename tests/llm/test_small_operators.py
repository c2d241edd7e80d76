"""Operators on small tables with the odd cases: nulls, empty texts, ties, repeated rows, empty tables, clashing names."""

import functools
import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import bagminhash, bpe, chat_hmm, langid_cnn, packing, pst, secrets_forest, suffix_dedup, vptree, winnow

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


BASE = prose(120, 1)
TEXTS = [None, "", "  ", "a", BASE, BASE, BASE.replace("1", "2", 1), prose(100, 2) + " " + BASE, "x" * 3000, "<|endoftext|> é漢🙂\n\n  b", prose(40, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", "mine") for i, t in enumerate(TEXTS)] + [(4, BASE, "en", "mine"), (None, BASE, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_codec_equals_library():
    library, codec = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "<|endoftext|>", "é", "漢", "🙂", "'s", "123", "\x1c", "\x85", "...", "_", "　", "٣", "\x00"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = codec.encode(text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False) == text
    long = "abcdefghij" * 20000
    assert codec.decode(codec.encode(long)) == long
    assert any(len(codec.fragments(p)) > 1 for p in ("漢字é".encode(), b"zqxjzq"))


def test_real_texts_are_cut_at_byte_pairs():
    """On the given documents cuts give more fragments than the pre-tokenizer gives pieces, every word of the corpus goes that way, and ids equal the library's."""
    from tokenizers.pre_tokenizers import ByteLevel

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    library, codec = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    calls, ways = Counter(), {name: getattr(codec, name) for name in ("cut_up", "cut_plain")}

    def counted(name, text):
        found = ways[name](text)
        assert found[0] == ways["cut_up"](text)[0]  # both ways cut alike
        calls.update(pieces=len(ByteLevel(add_prefix_space=False).pre_tokenize_str(text)), fragments=len(found[0]), words=len(text.split()))
        return found

    codec.cut_up, codec.cut_plain = (functools.partial(counted, name) for name in ways)
    got = codec.encode_all(texts)
    assert [i.tolist() for i in got] == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert calls["fragments"] > calls["pieces"] > 0
    assert calls["words"] >= len({w for t in texts for w in (t or "").split()}) / 2


def test_plain_texts_are_cut_in_one_pass():
    """Line ends, white space in runs and contractions need no pre-tokenizer, and a batch of texts is cut at once."""
    library, codec = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    rng, calls = random.Random(9), Counter()
    cut, pieces = codec.cut_plain, codec.pieces
    codec.cut_plain = lambda text: calls.update(cut=1) or cut(text)
    codec.pieces = lambda text: calls.update(pieces=1) or pieces(text)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\n \n", "é", "'s", "'S", "'re", "'ll", "'v", "'", "1", "23", "...", ",", "_", "Ab"]
    texts = ["x" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) + "." for _ in range(400)] + ["'s", "x'd", "a\n's it's't"]
    got = codec.encode_all(texts)
    assert [i.tolist() for i in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert calls == {"cut": 1}


def test_fragments_merge_by_the_ranks_of_the_file():
    """Pair of least rank, leftmost first, one at a time; and a text's fragments give the ids of the text."""
    spec = json.load(open(PATH, encoding="utf-8"))["model"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["merges"])}
    codec = bpe.Codec(PATH)
    rng = random.Random(8)
    for text in ["aaaaaaaaaaa", "abababab", "zqxjzq", " the", "é" * 20, *("".join(rng.choice("aeinrst e") for _ in range(rng.randint(1, 30))) for _ in range(200))]:
        back = {b: c for c, b in codec.letters.items()}
        parts = [back[b] for b in text.encode()]
        while (best := min(((rank.get(p, len(rank)), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(len(rank), 0)))[0] < len(rank):
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert np.frombuffer(codec.merged(text.encode()), "<u4").tolist() == [spec["vocab"][p] for p in parts]
        cut = codec.fragments(text.encode())
        assert b"".join(cut) == text.encode() and b"".join(map(codec.merged, cut)) == codec.merged(text.encode())


def test_round_trip(docs, none):
    rows = bpe.round_trip(docs, PATH).collect()
    assert len(rows) == 13 and {r["decoded_sha256"] for r in rows if r["doc_id"] in (0, 1)} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.round_trip(none, PATH).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs.where("doc_id > 3"), PATH), PATH)
    assert {r["text"] for r in back.collect()} == {t for t in TEXTS[4:]}


def test_packing(docs, none):
    rows = packing.pack(docs, PATH, window=64).toPandas()
    filled = rows.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 64 and rows["length"].sum() == rows[rows["start"] == 0]["doc_tokens"].sum()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
    assert packing.pack(none, PATH).count() == 0
    ids = np.append(np.array(Tokenizer.from_file(PATH).encode("a", add_special_tokens=False).ids), 1).astype("<u4")
    assert rows[rows["doc_id"] == 3]["ids_crc32"].tolist() == [zlib.crc32(ids.tobytes())]


def test_plan_is_best_fit_decreasing():
    import bisect

    rng = random.Random(1)
    for _ in range(20):
        counts = Counter(rng.randint(1, 50) for _ in range(rng.randint(0, 200)))
        places, rooms, windows = packing.plan(counts, 50), [], 0
        for length in sorted(counts.elements(), reverse=True):
            k = bisect.bisect_left(rooms, length)
            windows += k == len(rooms)
            room = rooms.pop(k) if k < len(rooms) else 50
            if room > length:
                bisect.insort(rooms, room - length)
        used = set()
        for r in places.itertuples():
            used |= set(range(r.seq, r.seq + -(-r.count // r.each)))
        assert len(used) == windows and places.groupby("length")["count"].sum().to_dict() == dict(counts)


def test_winnowing_matches_brute_force():
    text = prose(60, 9) + prose(60, 9)
    got = winnow.fingerprint(text, 5, 8)
    codes = [ord(c) for c in text]
    value = {}
    for at in range(len(codes) - 4):
        value[at] = int(winnow.fingerprint(text[at : at + 5], 5, 1)[0] >> np.uint64(32))
    want = sorted({max((p for p in range(i, i + 8) if value[p] == min(value[q] for q in range(i, i + 8)))) for i in range(len(value) - 7)})
    assert [int(e & np.uint64(0xFFFFFFFF)) for e in got] == want
    assert [int(e >> np.uint64(32)) for e in got] == [value[p] for p in want]


def test_winnow_order(docs, none):
    rows = winnow.compare_neighbours(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), 4).toPandas().set_index("doc_id")
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[(i + 1) % len(texts)][:q]
        assert rows.loc[i, "edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows.loc[i, "n_chars"] == len(t)
    assert rows.loc[4, "near_next"] == 1.0 and rows.loc[0, "near_next"] == 1.0 and rows.loc[2, "near_next"] == 0.0
    assert winnow.compare_neighbours(docs, 4).count() == 13 and winnow.compare_neighbours(none, 4).count() == 0


def test_winnow_order_of_any_ids(spark):
    """String ids, ids and texts that repeat, rows without an id, one row: each text meets the next of the stated order."""
    rng = random.Random(4)
    rows = [(f"k{i % 17:02d}" if i % 5 else None, prose(rng.randint(0, 30), i)) for i in range(60)] + [("k01", "same text here")] * 5 + [(None, None), ("k99", "x " * 5000)]
    docs = spark.createDataFrame([(t, d, 1, "e") for d, t in rows], "text string, doc_id string, span int, guest string").repartition(5)
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted(keyed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or "", r["h"]))
    want = []
    for row, after in zip(order, order[1:] + order[:1]):
        text, more = row["text"] or "", after["text"] or ""
        q = len(text) // 4
        want.append((row["doc_id"], len(text), hashlib.sha256((text[: len(text) - q] + more[:q]).encode()).hexdigest()))
    for parts in (1, 6):
        got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in winnow.compare_neighbours(docs, parts).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    one = winnow.compare_neighbours(docs.where("doc_id = 'k99'"), 4).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(3)
    value = np.arange(1, 61, dtype=np.uint64)
    a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    found = []
    for k in range(40):
        own = value + np.uint64(1000 * k)
        s = [bagminhash.signatures(np.zeros((w > 0).sum(), int), own[w > 0], w[w > 0], 1, 128) for w in (a, b)]
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - truth) < 0.02


def test_near_duplicates(docs, none):
    rows = bagminhash.classes(docs, 0.8, 5).toPandas()
    by = {i: g["class_id"].tolist() for i, g in rows.groupby("doc_id", dropna=False)}
    assert len(rows) == 13 and by[4] == [4, 4] and by[5] == [4] and by[6] == [4] and by[0] == by[1] == by[2] == [0] and by[7] == [7]
    assert bagminhash.classes(none).count() == 0


def test_near_duplicate_classes_match_brute_force(spark):
    """Families whose members lie on both sides of the threshold, and share buckets without being links."""
    rng, texts = random.Random(11), []
    for family in range(3):
        own = prose(150, 50 + family).split()
        for _ in range(40):
            copy = list(own)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 9)}"
            texts.append(" ".join(copy))
    texts.append(texts[0])
    bags = []
    for t in texts:
        w = t.split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    comp = list(range(len(texts)))
    for i, a in enumerate(bags):
        for j in range(i):
            both = sum((a & bags[j]).values())
            if both >= 0.8 * (sum(a.values()) + sum(bags[j].values()) - both) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    got = bagminhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().sort_values("doc_id")
    assert 3 < len(set(comp)) < len(texts) and got["class_id"].tolist() == comp


def covered(symbols: list, length: int) -> list[bytearray]:
    """Marks on every symbol of a run of `length` that starts twice."""
    count = Counter(tuple(b[i : i + length]) for b in symbols for i in range(len(b) - length + 1))
    out = []
    for b in symbols:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[tuple(b[i : i + length])] > 1:
                mark[i : i + length] = b"\1" * length
        out.append(mark)
    return out


@pytest.mark.parametrize("most", [20_000, 1])
def test_repeated_passages(docs, none, most):
    shared = prose(25, 8).split()
    more = [" ".join([*prose(12, 30).split(), *shared, "x"]), "\n".join(["y", *(w.upper() for w in shared), *prose(40, 31).split()])]
    own = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(50 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    rows = suffix_dedup.repeats(own, 100, most, words=20).toPandas()
    texts = [*((t or "") for t in TEXTS), BASE, BASE, *more]
    data = [t.encode() for t in texts]
    words = [re.findall(r"[^\x20\x09-\x0d]+", t.lower()) for t in texts]
    want = [(len(b), sum(m), len(re.findall(b"\1+", m)), hashlib.sha256(bytes(x for x, k in zip(b, m) if not k)).hexdigest(), sum(n)) for b, m, n in zip(data, covered(data, 100), covered(words, 20))]
    assert sorted(want) == sorted(zip(rows["n_bytes"], rows["n_removed"], rows["n_spans"], rows["kept_sha256"], rows["n_repeated_words"]))
    assert sum(w[1] == 0 < w[4] for w in want) == 2  # the same words in other letters and spaces
    assert suffix_dedup.repeats(none, words=20).count() == 0


def test_anchors_of_very_long_texts(monkeypatch):
    """Looked at in pieces, a text has the anchors that it has as a whole."""
    data, sizes = suffix_dedup.symbols([prose(900, 12).encode()], suffix_dedup.BYTE)
    whole = list(zip(*suffix_dedup.anchors(data, sizes, 100)))
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    pieces = list(zip(*suffix_dedup.anchors(data, sizes, 100)))
    starts = lambda found: {(p, s, h) for _, h, p, a, b in found for s in range(a, b + 1)}
    assert len(pieces) > len(whole) and starts(pieces) == starts(whole)


def test_texts_without_repeats(docs):
    """Other columns stay, also those with names that the operator uses itself."""
    clash = docs.select("doc_id", "text", F.lit(1).alias("ck"), F.lit("a").alias("left_text"), F.lit(2).alias("n_copies"), F.lit(3).alias("spans"))
    rows = suffix_dedup.without_repeats(clash, 100, words=20)
    assert rows.columns == clash.columns and {(r["ck"], r["left_text"], r["n_copies"], r["spans"]) for r in rows.collect()} == {(1, "a", 2, 3)}
    data = [t.encode() if t is not None else None for t in [*TEXTS, BASE, BASE]]
    marks = covered([d or b"" for d in data], 100)
    want = [None if d is None else bytes(x for x, k in zip(d, m) if not k).decode("utf-8", "ignore") for d, m in zip(data, marks)]
    assert sorted(map(str, want)) == sorted(str(r["text"]) for r in rows.collect())


def test_deep_shallow_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) + b"z" * rng.choice([0, 90, 130]) + bytes([rng.randint(0, 3)]) * rng.randint(0, 2) for _ in range(300)]
    group = np.sort(np.array([rng.randint(0, 3) for _ in strings]))
    order, common = suffix_dedup.neighbours(group, strings)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings))
    for a, b, c in zip(order, order[1:], common[1:]):
        x, y = strings[a], strings[b]
        same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert c == (same if group[a] == group[b] else 0)


def test_suffix_tree_scores(docs, none):
    rows = pst.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) != 7, chunk_bytes=1500).toPandas()
    assert len(rows) == 13 and (rows["score"] < 0).all() and rows[rows["doc_id"] == 7]["held_out"].tolist() == [True]
    assert rows[rows["doc_id"] == 0]["n_tokens"].tolist() == [1]
    again = pst.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) != 7).toPandas()  # other chunks, the same model
    assert np.allclose(np.sort(rows["score"]), np.sort(again["score"]), rtol=1e-5)
    assert pst.score(none, F.lit(True)).count() == 0


def test_scores_equal_brute_force(docs):
    """The tree of contexts as tuples, one dictionary a length, on every text; and the base model."""
    rows = pst.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) != 7, chunk_bytes=1500).toPandas()
    texts = [*((t or "").encode().lower() for t in TEXTS), BASE.lower().encode(), BASE.lower().encode()]
    train = [i != 7 for i in range(len(texts))]
    words = [re.findall(rb"[^\x20\x09-\x0d]+", t) for t in texts]
    seqs = [[pst.PAD] * 6 + list(b"".join(w + b" " for w in ws)) + [pst.END] for ws in words]
    counts: dict[tuple, Counter] = {}
    for seq, learn in zip(seqs, train):
        for i in range(6, len(seq)):
            for k in range(7):
                counts.setdefault(tuple(seq[i - k : i]), Counter())[seq[i]] += learn
    share = lambda c, s: counts[c][s] / max(1, sum(counts[c].values()))
    states = {c for c in counts if len(c) > 1 and sum(n * np.log(share(c, s) / share(c[1:], s)) for s, n in counts[c].items() if n) >= 3.0}
    states |= {c[i:] for c in states for i in range(len(c))}

    def prob(context: tuple, symbol: int) -> float:
        after = prob(context[1:], symbol) if context else 1 / 256
        total, kinds = sum(counts[context].values()), sum(n > 0 for n in counts[context].values())
        if (len(context) > 1 and context not in states) or not total:
            return after
        return (counts[context][symbol] + kinds * after) / (total + kinds)

    scores = [sum(np.log10(prob(tuple(seq[i - 6 : i]), seq[i])) for i in range(6, len(seq))) for seq in seqs]
    tokens = Counter(t for ws, learn in zip(words, train) if learn for t in [*ws, None])
    whole = np.log10(tokens.total() + 0.1 * (len(tokens) + 1))
    base = [sum(np.log10(tokens[t] + 0.1) - whole for t in [*ws, None]) for ws in words]
    known = [sum(tokens[t] > 0 for t in [*ws, None]) for ws in words]
    assert states and np.allclose(np.sort(scores), np.sort(rows["score"]), rtol=1e-4)
    assert np.allclose(np.sort(base), np.sort(rows["base_score"])) and sorted(known) == sorted(rows["n_known"]) and set(rows["train_tokens"]) == {tokens.total()}


def test_tree_is_a_distribution():
    """Over all 256 next symbols of a context the probabilities sum to one."""
    strings, _ = pst.symbol_strings([prose(300, 4).encode(), b"abc abd abe"])
    keys, counts = pst.counted(strings, np.ones(len(strings), bool))
    own = keys[(keys >> np.uint64(32)) == (keys[100] >> np.uint64(32))]
    context = own[0] >> np.uint64(8)
    every = np.unique(np.concatenate([own, (context << np.uint64(8)) + np.arange(256, dtype=np.uint64)]))
    count = np.where(np.isin(every, own), counts[np.searchsorted(keys, np.minimum(every, keys[-1]))], 0)
    pairs = np.bincount(pst.symbol_strings([prose(300, 4).encode(), b"abc abd abe"], 1)[0].astype(int), minlength=65536).reshape(256, 256)
    logs = pst.tree(every, count, pairs)
    assert abs((10.0 ** logs[(every >> np.uint64(8)) == context].astype(float)).sum() - 1) < 1e-4


def test_language_network(docs, none, spark):
    rows = [(i, " ".join(random.Random(i).choices(["der", "die", "und", "nicht"] if i % 2 else ["the", "and", "of", "with"], k=60)), "de" if i % 2 else "en") for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid_cnn.fit(table, F.col("doc_id") < 60)
    got = langid_cnn.identify(table.where("doc_id >= 60"), net).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    odd = langid_cnn.identify(docs, net).toPandas()
    assert odd[odd["doc_id"].isin([0, 1, 2])]["lang_pred"].tolist() == ["und"] * 3 and len(odd) == 13
    assert langid_cnn.identify(none, langid_cnn.fit(none, F.lit(True))).count() == 0
    assert {r["lang_pred"] for r in langid_cnn.identify(docs, langid_cnn.fit(none, F.lit(True))).collect()} == {"und"}


def test_secrets(spark, none):
    rng = random.Random(0)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    rows = []
    for i in range(200):
        text = prose(30, i) + " Donaudampfschiffahrtsgesellschaft " + " 4041894974608795 "
        if i % 3 == 0:
            text += ' token = "' + key(40, "0123456789abcdef") + '" ' + prose(5, i) + " AKIA" + key(16, "ABCDEFGHIJ0123456789")
        rows.append((i, text))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    found = secrets_forest.findings(docs).persist()
    kept = secrets_forest.secrets(found)
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got == {i: 2 for i in range(0, 200, 3)}
    clean = {r["doc_id"]: r["text"] for r in secrets_forest.redact(docs, kept).collect()}
    assert len(clean) == 202 and clean[0].count("[SECRET]") == 2 and clean[1] == rows[1][1] and clean[900] is None
    assert secrets_forest.secrets(secrets_forest.findings(none)).count() == 0


def test_secrets_of_one_word(spark):
    rng = random.Random(1)
    key = lambda n, a="abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789": "".join(rng.choice(a) for _ in range(n - 1)) + "7a"
    rows, truth, codes = [], {}, {}
    for i in range(240):
        a, b, aws, plain = key(24), key(39), "AKIA" + key(15).upper()[:16], key(20)
        shape = [
            f"client_secret={a} and AWS_SECRET_ACCESS_KEY={b} access_token:'{plain}'",
            f'{{"api_key":"sk_live_{a}","id":"{aws}","order_reference_number":"{plain}"}}',
            f"https://example.org/get/list?access_token={a}&private_token={a}x&page_of_result={plain}",
            f"parcel_reference_number={plain} came",
        ][i % 4]
        truth[i] = [{a, b, plain}, {"sk_live_" + a, aws}, {a, a + "x"}, set()][i % 4]
        codes[i] = [set(), {plain}, {plain}, {plain}][i % 4]
        rows.append((i, prose(20, i) + " " + shape + " " + prose(5, i)))
    found = secrets_forest.findings(spark.createDataFrame(rows, "doc_id long, text string")).persist()
    every = {(r["doc_id"], r["value"]) for r in found.collect()}
    assert all((i, v) in every for i in truth for v in truth[i] | codes[i])
    assert {(r["doc_id"], r["value"]) for r in found.where(secrets_forest.rule(found)).collect()} == {(i, v) for i in truth for v in truth[i]}
    kept = {(r["doc_id"], r["value"]) for r in secrets_forest.secrets(found).collect()}
    wanted = {(i, v) for i in truth for v in truth[i]}
    assert len(kept & wanted) >= 0.95 * len(wanted) and len(kept - wanted) <= 0.05 * len(wanted)


def test_copies_do_not_fill_samples(spark):
    rng = random.Random(4)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    hot = "token = " + key(40)
    rows = [(i, hot) for i in range(3000)] + [(5000 + i, f"{prose(3, i)} secret: {key(38)}7a") for i in range(5)] + [(6000 + i, f"{prose(5, i)} {rng.randint(10**15, 10**16)} and so on") for i in range(300)]
    found = secrets_forest.findings(spark.createDataFrame(rows, "doc_id long, text string")).persist()
    model, *seen = secrets_forest.fit(found, per_label=20)
    judged = secrets_forest.judged(found, model, *seen).where("probability >= 0.5")
    assert model is not None and judged.count() == 3005
    assert secrets_forest.fit(found.repartition(7, "at"), per_label=20)[1:] == tuple(seen)
    texts = [("en", BASE)] * 900 + [("en", prose(20, i)) for i in range(40)] + [("de", prose(20, 100 + i)) for i in range(7)] + [(None, "a")]
    docs = spark.createDataFrame(texts, "lang string, text string")
    got, langs = langid_cnn.training_sample(docs, F.lit(True), per_lang=15)
    assert Counter(langs) == {"en": 15, "de": 7} and len(set(got)) == 22
    assert (got, langs) == langid_cnn.training_sample(docs.repartition(9), F.lit(True), per_lang=15)


def test_forest_learns_from_all_findings(spark, monkeypatch):
    """Beyond some thousand findings a label too: each counts in the dictionary, trains the forest and sets its thresholds."""
    n = 12000
    word = F.translate(F.format_string("%05d", "id"), "0123456789", "abcdefghij")
    value = F.substr(F.sha1(F.col("id").cast("string")), F.lit(1), F.lit(20))
    found = spark.range(n).select(value.alias("value"), word.alias("before"), value.alias("word"), F.lit("").alias("prefix"), (F.col("id") % 2 == 0).alias("label"))
    learnt = []
    monkeypatch.setattr(secrets_forest.Pipeline, "fit", lambda self, rows: learnt.append((rows.count(), self.getStages()[-1].getMaxBins())))
    _, words, _ = secrets_forest.fit(found.union(found), dictionary=n)
    assert len(words) == n // 2 and learnt[0][0] == n and learnt[0][1] ** 2 >= n
    secrets_forest.fit(found.limit(50), labelled=found)
    assert learnt[1][0] == n


def test_forest_of_many_rows_hangs_on_no_dealing(spark):
    """Over 10000 findings train in several tasks, alike however they are dealt."""
    every = secrets_forest.examples(spark, 11000).persist()
    (model, *seen), (again, *same) = (secrets_forest.fit(rows, labelled=rows, trees=3) for rows in (every, every.repartition(9)))
    assert seen == same and model.stages[-1].toDebugString.split("\n")[1:] == again.stages[-1].toDebugString.split("\n")[1:]
    said = secrets_forest.judged(every, model, *seen).select("label", (F.col("probability") >= 0.5).alias("said"))
    assert said.where("label = said").count() >= 0.9 * every.count() > 9000


def test_redaction_without_ids(spark):
    rng = random.Random(6)
    secret = ["".join(rng.choice("0123456789abcdef") for _ in range(38)) + "7a" for _ in range(60)]
    ids = [None] * 20 + [7] * 20 + list(range(100, 120))
    rows = [(i, prose(10, k) + f" token = {s} end") for k, (i, s) in enumerate(zip(ids, secret))] * 2 + [(None, prose(10, 1) + f" {k}041894974608795 ") for k in range(30)] + [(None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = secrets_forest.secrets(secrets_forest.findings(docs).persist())
    out = secrets_forest.redact(docs, kept).collect()
    wanted = [(i, t and re.sub("token = [0-9a-f]+", "token = [SECRET]", t)) for i, t in rows]
    assert Counter(map(tuple, out)) == Counter(wanted)
    lists = secrets_forest.findings(docs).groupBy("text_key").agg(F.collect_set("value").alias("v")).agg(F.max(F.size("v"))).first()[0]
    assert lists == 1


def test_runs_equal_brute_force(spark):
    rng = random.Random(3)
    part = lambda: "".join(rng.choice("ab7_") for _ in range(rng.choice([1, 5, 11, 12, 12, 13, 40]))) + rng.choice(["=", '":"', "é", "🙂.", "", "abababababab="])
    words = ["7." + "".join(part() for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["漢" * 3000 + "7" + "x" * 12]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    value = "(?<=[:=])[A-Za-z0-9_+/-]{8,}|(?<=[:=][\"'])[A-Za-z0-9_+/-]{8,}|[A-Za-z0-9_+/-]{12,}"
    want = {(i, k, m[0], w[: m.start()][-256:], w[m.end() :][:256]) for i, w in enumerate(words) for k, m in enumerate(re.finditer(value, w))}
    got = {(r["doc_id"], r["run"], r["value"], r["prefix"], r["word"][len(r["prefix"]) + len(r["value"]) :]) for r in secrets_forest.findings(docs).collect()}
    assert got == want and len(want) > 500


def test_chat_blocks_equal_one_pass(spark):
    rng = random.Random(7)
    rows = []
    for c in range(6):
        for t in range(40 if c else 90):
            role = "user" if t % 2 == 0 else "assistant"
            text = "\n".join(prose(rng.randint(1, 25), 100 * c + t + k) + rng.choice(["?", ".", "."]) for k in range(rng.randint(1, 3)))
            rows.append((c, t, role, text if role == "assistant" else text[:60] + "?"))
    own = spark.createDataFrame(rows + [rows[0], (99, 0, None, None)], "conv_id long, turn long, role string, text string")
    log = chat_hmm.as_log(own)
    model = chat_hmm.fit(log)
    one, many = (chat_hmm.recover(log, model, block).orderBy("conv_id", "turn", "part").collect() for block in (1000, 8))
    assert one == many and len(one) >= len(rows)
    truth = {(c, t): r for c, t, r, _ in rows}
    right = [truth[r["conv_id"], r["turn"]] == r["role"] for r in one if (r["conv_id"], r["turn"]) in truth]
    assert sum(right) / len(right) > 0.9
    assert chat_hmm.recover(log.limit(0), model).count() == 0
    assert chat_hmm.rendered(chat_hmm.recover(log, model)).where("rendered not like '<|%|>%<|end|>'").count() == 0


@pytest.mark.parametrize("factor", [1.0, 1.5])
def test_vantage_points(spark, factor):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    x[50:90] = x[7]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 6), (1002, [float("nan")] * 6), (1003, [None] * 6), (None, [1.0] * 6), (5, [float(c) for c in x[5]])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vptree.nearest(table, table.where("vec_id % 20 = 0"), k=5, factor=factor, shard_rows=80, block_rows=7).toPandas()
    y, hit, n = x.astype(float), 0, 0
    for q in range(0, 300, 20):
        score = (y * y[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:5]
        own = got[got["query_id"] == q].sort_values("rank")
        if factor == 1.0:
            assert own["vec_id"].tolist() == want and np.array_equal(own["score"], score[want])
        hit, n = hit + len(set(own["vec_id"]) & set(want)), n + 5
    assert hit / n >= 0.9 and len(got) == 75
    assert vptree.nearest(table.limit(0), table.limit(0)).count() == 0


def test_vantage_points_with_ties(spark):
    """Integer vectors have many equal products: the smaller id goes first, wherever the cut falls."""
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, size=(900, 8)).astype(float)
    x = x[np.abs(x).sum(1) > 0]
    ids = rng.permutation(len(x) * 3)[: len(x)]
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("shard", F.lit(2))
    got = vptree.nearest(table, table.where("vec_id % 20 = 0"), k=20, shard_rows=400, block_rows=30).toPandas()
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        own = got[got["query_id"] == ids[q]].sort_values("rank")
        assert own["vec_id"].tolist() == ids[want].tolist() and np.array_equal(own["score"], score[want])


def test_language_windows_equal_a_direct_convolution():
    rng = np.random.default_rng(2)
    net = langid_cnn.train([bytes(rng.integers(97, 123, 300).astype(np.uint8)) for _ in range(12)], ["a", "b", "c"] * 4, epochs=1)
    x = rng.integers(0, 256, (5, langid_cnn.WINDOW)).astype(np.uint8)
    e, pooled = net.embed[x], []
    for w in langid_cnn.WIDTHS:
        z = np.stack([sum(e[:, i + j] @ net.conv[w][j] for j in range(w)) + net.bias[w] for i in range(langid_cnn.WINDOW - w + 1)], 1)
        pooled.append(np.maximum(z.max(1), 0))
    assert np.allclose(langid_cnn.Tables(net).logits(x), np.concatenate(pooled, 1) @ net.out + net.out_bias, atol=1e-4)
    assert langid_cnn.predict(langid_cnn.Tables(net), ["²½①_7", None, ""])[0] == ["und"] * 3


def test_forest_on_held_out_examples(spark):
    """Labels are what was planted, so they hang on no feature; a quarter of the planted strings is held out."""
    every = secrets_forest.examples(spark, 4000).persist()
    learn, held = every.where("id % 64 >= 16"), every.where("id % 64 < 16")
    model, *seen = secrets_forest.fit(learn, labelled=learn)
    rows = secrets_forest.judged(held, model, *seen).select("label", (F.col("probability") >= 0.5).alias("said")).toPandas()
    hit = int((rows["label"] & rows["said"]).sum())
    assert len(rows) > 800 and hit >= 0.9 * rows["label"].sum() and hit >= 0.9 * rows["said"].sum()


def test_web_tokens_and_short_values(spark):
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    docs = spark.createDataFrame([(1, f"a jwt: {token}, b"), (2, "db_password=hunter22! and on")], "doc_id long, text string")
    got = {(r["doc_id"], r["value"]) for r in secrets_forest.findings(docs).collect()}
    assert got == {(1, token), (2, "hunter22")}
