"""Language-model scoring by a probabilistic suffix tree.

Symbols are the bytes of a text's lower-cased words, each word closed by a
blank, and one end symbol. A state of the tree is a context of up to `depth`
preceding symbols. Contexts of no and of one symbol are always states; a longer
one is kept if its next-symbol distribution diverges from that of its suffix:
count times Kullback-Leibler divergence of at least `gain` nats; the suffixes of a
state are states too. Distributions are smoothed by Witten-Bell interpolation
with the suffix's, that of no symbol with the uniform one. A text's score sums
log10 P(symbol | longest state that is a suffix of what precedes).

The base model beside it is a smoothed unigram model over words and text ends.

At scale. Texts are dealt into chunks; a chunk names its distinct strings of
depth+1 symbols with their training counts, sorted. Those go to shards by the
last two context symbols, so that a shard has every count it needs for its part
of the tree; what lies above, the counts of pairs of symbols (65 536 numbers
whatever the corpus), every task has. The shard sends back the log-probability of each chunk's
strings, in the chunk's order, and the chunk adds them up along its texts.
Neither counts nor tree are ever whole in one place; both grow with the corpus.

Defined cases: null text counts as empty and scores its end symbol alone. A
null id counts as an empty string for the split. Without training text every
distribution is uniform. Repeated rows are scored (and learned) as often as
they occur. Texts of any length are taken whole. Other columns are not looked at;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, frugal, materialize, mix64
from .words import LOWER, SPACE, Chunk

DEPTH, ROOT = 6, 2
END, PAD, BLANK = 10, 11, 32  # the first two are white space, so no word holds them
TABLE = LOWER.copy()
TABLE[SPACE] = BLANK
END_WORD = np.uint64(0x0E4D0E4D0E4D0E4D)


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    data = np.diff(values, prepend=values.dtype.type(0)) if ascending else values
    # byte planes: high bytes are alike
    planes = np.ascontiguousarray(data).view(np.uint8).reshape(-1, data.itemsize).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, dtype: str, ascending: bool = False) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(dtype).itemsize
    values = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)
    with np.errstate(over="ignore"):
        return np.cumsum(values, dtype=dtype) if ascending else values


def symbol_strings(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(strings, sizes): for each symbol of each text the last `depth` symbols and itself, as one number
    with the nearest context symbol in the highest place and the symbol in the lowest; symbols a text."""
    lead = bytes([PAD]) * depth
    raw = np.frombuffer(b"".join(lead + t + b"  " for t in texts), np.uint8)
    sizes = np.array([depth + len(t) + 2 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    s = TABLE[raw]
    begin = (ends - sizes)[:, None] + np.arange(depth)
    s[begin] = PAD
    s[ends - 1] = END
    keep = s != BLANK
    keep[1:] |= (s[:-1] != BLANK) & (s[:-1] != PAD)
    owner = np.repeat(np.arange(len(texts)), sizes)[keep]
    s = s[keep].astype(np.uint64)
    strings = s.copy()
    for j in range(1, depth + 1):
        strings[depth:] |= s[depth - j : len(s) - j] << np.uint64(8 * (depth + 1 - j))
    real = s != PAD
    return strings[real], np.bincount(owner[real], minlength=len(texts))


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below 2**63), ascending, with how often they occur in training."""
    both = np.sort((keys << np.uint64(1)) | train.astype(np.uint64))
    own = both >> np.uint64(1)
    first = np.flatnonzero(np.diff(own, prepend=~own[:1]))
    return own[first], np.add.reduceat((both & np.uint64(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


class Lookup:
    """Index of each of many keys in an array of distinct ones: open addressing, all keys at once."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.mask = keys, np.uint64((1 << max(4, (3 * len(keys)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        own, home, step = np.arange(len(keys), dtype=np.int32), mix64(keys), np.uint64(0)
        while len(own):
            at = (home[own] + step) & self.mask
            free = self.slots[at] < 0
            self.slots[at[free]] = own[free]
            own, step = own[self.slots[at] != own], step + np.uint64(1)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        out = np.empty(len(wanted), np.int32)
        for begin in range(0, len(wanted), 1 << 20):
            some = wanted[begin : begin + (1 << 20)]
            home, left, step = mix64(some), np.arange(len(some)), np.uint64(0)
            found = np.empty(len(some), np.int32)
            while len(left):
                got = self.slots[(home[left] + step) & self.mask]
                hit = self.keys[got] == some[left]
                found[left[hit]] = got[hit]
                left, step = left[~hit], step + np.uint64(1)
            out[begin : begin + len(some)] = found
        return out


def trunk(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From counts [context symbol, symbol]: the smoothed P(symbol | one symbol), and the plain shares."""
    single = pairs.sum(0)
    kinds, total = np.count_nonzero(single), single.sum()
    none = (single + kinds / 256) / (total + kinds) if total else np.full(256, 1 / 256)
    kinds, total = np.count_nonzero(pairs, axis=1)[:, None], pairs.sum(1, keepdims=True)
    one = (pairs + kinds * none) / np.maximum(total + kinds, 1)
    return np.where(total > 0, one, none), pairs / np.maximum(total, 1)


def pair_counts(docs: DataFrame, train: Column) -> np.ndarray:
    """How often each symbol follows each, over training rows."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            count = np.zeros(65536, np.int64)
            texts = [(t or "").encode("utf-8", "replace") for t in frame["text"]]
            for part in batches_by_bytes(texts, 1_000_000):
                count += np.bincount(symbol_strings(texts[part], 1)[0].astype(np.int64), minlength=65536)
            at = np.flatnonzero(count)
            yield pd.DataFrame({"pair": at, "n": count[at]})

    rows = docs.where(train).select("text").mapInPandas(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most 65 536
    out = np.zeros(65536, np.int64)
    for r in rows:
        out[r["pair"]] = r["n"]
    return out.reshape(256, 256)


def tree(strings: np.ndarray, count: np.ndarray, pairs: np.ndarray, depth: int = DEPTH, gain: float = 3.0) -> np.ndarray:
    """log10 P of the last symbol of each string (ascending; all strings that share their last ROOT context symbols)."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.float32)
    symbol = strings & np.uint64(255)
    top = (strings >> np.uint64(8 * depth)).astype(np.int64), symbol.astype(np.int64)
    smooth, plain = trunk(pairs)
    levels, parent = [], plain[top]
    for k in range(ROOT, depth + 1):
        context = strings >> np.uint64(8 * (depth - k) + 8)
        first = np.flatnonzero(np.diff(context, prepend=~context[:1]))
        group = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, n)))
        if n >> 26:  # more than fits beside group and symbol in one number
            index = np.lexsort((symbol, group))
            pair = ((group << np.uint64(8)) | symbol)[index]
        else:
            order = np.sort((((group << np.uint64(8)) | symbol) << np.uint64(26)) | np.arange(n, dtype=np.uint64))
            index, pair = (order & np.uint64((1 << 26) - 1)).astype(np.int64), order >> np.uint64(26)
        begin = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
        together = np.add.reduceat(count[index], begin)
        own = np.empty(n, np.int64)
        own[index] = np.repeat(together, np.diff(np.append(begin, n)))  # N(context, symbol)
        total = np.add.reduceat(count, first)
        at = (pair[begin] >> np.uint64(8)).astype(np.int64)
        kinds = np.bincount(at, together > 0, len(first))
        size, kind = total[group.astype(np.int64)], kinds[group.astype(np.int64)]
        share = own / np.maximum(size, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(count > 0, count * np.log(share / parent), 0.0)
        keep = np.add.reduceat(part, first) >= gain
        levels.append((first, keep, own, size, kind))
        parent = share
    state = np.zeros(n, bool)
    kept = []
    for first, keep, *_ in reversed(levels):  # suffixes of states are states
        longer = np.maximum.reduceat(state, first)
        state = np.repeat(keep | longer, np.diff(np.append(first, n)))
        kept.append(state)
    prob = smooth[top]
    for (_, _, own, size, kind), is_state in zip(levels, reversed(kept)):
        prob = np.where(is_state & (size > 0), (own + kind * prob) / np.maximum(size + kind, 1), prob)
    return np.log10(prob).astype(np.float32)


def _shard_of(keys: np.ndarray, shards: int, shift: int) -> np.ndarray:
    return (mix64(keys >> np.uint64(shift)) % np.uint64(shards)).astype(np.int64)


class Sheet:
    """A chunk's distinct strings and words, in the order in which they travel."""

    def __init__(self, texts: list[bytes], train: np.ndarray, shards: int, depth: int):
        self.strings, self.sizes = symbol_strings(texts, depth)
        self.keys, self.counts = counted(self.strings, np.repeat(train, self.sizes))
        words = Chunk(texts)
        self.words = np.concatenate([words.hashes() >> np.uint64(1), np.full(len(texts), END_WORD >> np.uint64(1), np.uint64)])
        self.word_owner = np.concatenate([words.owner, np.arange(len(texts))])
        self.word_keys, self.word_counts = counted(self.words, train[self.word_owner])
        self.shard = _shard_of(self.keys, shards, 8 * (depth + 1 - ROOT))
        self.word_shard = _shard_of(self.word_keys, shards, 0)


def score(docs: DataFrame, train: Column, depth: int = DEPTH, gain: float = 3.0, chunk_bytes: int = 6_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs; `train` marks rows to learn from."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 1 + total // chunk_bytes
    shards = 1 + chunks // 2
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text", train.alias("train")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    shared = docs.sparkSession.sparkContext.broadcast(pair_counts(docs, train))  # half a megabyte

    def sheet(frame: pd.DataFrame) -> Sheet:
        return Sheet([(t or "").encode("utf-8", "replace") for t in frame["text"]], frame["train"].to_numpy(bool), shards, depth)

    def ordered(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values(["doc_id", "text"], kind="stable")

    def ask(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = sheet(ordered(frame))
        rows = []
        by, by_word = (np.argsort(s, kind="stable") for s in (own.shard, own.word_shard))
        cut, cut_word = (np.searchsorted(s[o], np.arange(shards + 1)) for s, o in ((own.shard, by), (own.word_shard, by_word)))
        for s in range(shards):
            a, b = by[cut[s] : cut[s + 1]], by_word[cut_word[s] : cut_word[s + 1]]
            if len(a) or len(b):
                rows.append((key[0], s, packed(own.keys[a], True), packed(own.counts[a]), packed(own.word_keys[b], True), packed(own.word_counts[b])))
        return pd.DataFrame(rows, columns=["chunk", "shard", "keys", "counts", "words", "word_counts"])

    def gathered(keys: pd.Series, counts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of all messages with their sums, a few messages at a time."""
        k, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for at in range(0, len(keys), 8):
            k, c = (np.concatenate([own, *(unpacked(x, kind, kind == "u8") for x in new.iloc[at : at + 8])]) for own, new, kind in ((k, keys, "u8"), (c, counts, "i8")))
            order = np.argsort(k)
            k, c = k[order], c[order]
            first = np.flatnonzero(np.diff(k, prepend=~k[:1]))
            k, c = k[first], np.add.reduceat(c, first) if len(first) else c
        return k, c

    def answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        strings, count = gathered(frame["keys"], frame["counts"])
        logs = tree(strings, count, shared.value, depth, gain)
        values = [packed(logs[np.searchsorted(strings, unpacked(k, "u8", True))]) for k in frame["keys"]]
        strings, count = gathered(frame["words"], frame["word_counts"])
        known = [packed(count[np.searchsorted(strings, unpacked(k, "u8", True))]) for k in frame["words"]]
        stats = np.zeros((2, len(frame)), np.int64)
        stats[:, 0] = (count > 0).sum(), count.sum()
        return pd.DataFrame({"chunk": frame["chunk"], "shard": frame["shard"], "logs": values, "known": known, "kinds": stats[0], "tokens": stats[1]})

    asked = dealt.groupBy("chunk").applyInPandas(ask, "chunk long, shard long, keys binary, counts binary, words binary, word_counts binary")
    replies = materialize(asked.groupBy("shard").applyInPandas(answer, "chunk long, shard long, logs binary, known binary, kinds long, tokens long"), "replies")
    stats = replies.agg(F.sum("kinds").alias("v"), F.sum("tokens").alias("n")).first()
    tokens, whole = stats["n"] or 0, np.log10((stats["n"] or 0) + 0.1 * ((stats["v"] or 0) + 1))

    def add_up(key: tuple, frame: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        frame = ordered(frame)
        if frame.empty:
            return pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
        own, n = sheet(frame), len(frame)
        logs, known = np.empty(len(own.keys), np.float32), np.empty(len(own.word_keys), np.int64)
        by, by_word = (np.argsort(s, kind="stable") for s in (own.shard, own.word_shard))
        cut, cut_word = (np.searchsorted(s[o], np.arange(shards + 1)) for s, o in ((own.shard, by), (own.word_shard, by_word)))
        for s, a, b in zip(got["shard"], got["logs"], got["known"]):
            logs[by[cut[s] : cut[s + 1]]] = unpacked(a, "f4")
            known[by_word[cut_word[s] : cut_word[s + 1]]] = unpacked(b, "i8")
        each = logs[Lookup(own.keys)(own.strings)].astype(np.float64)
        scores = np.add.reduceat(each, np.concatenate([[0], np.cumsum(own.sizes)[:-1]]))
        c = known[Lookup(own.word_keys)(own.words)]
        n_tokens = np.bincount(own.word_owner, minlength=n)
        base = np.bincount(own.word_owner, np.log10(c + 0.1), n) - n_tokens * whole
        return pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "held_out": ~frame["train"].to_numpy(bool), "n_tokens": n_tokens, "n_known": np.bincount(own.word_owner, c > 0, n).astype(np.int64), "train_tokens": tokens, "base_score": base, "score": scores})

    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(add_up, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
