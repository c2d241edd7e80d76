"""Language identification by a byte-level convolutional network.

The network embeds each byte, convolves filters of widths 2, 3 and 4, takes
each filter's maximum over a window of fixed length, and ends in a softmax. It
is trained in numpy on a bounded sample of labelled texts and then runs inside
Spark tasks over all windows of all texts. Because a byte has 256 values, the
embedding and the filters fold into lookup tables over one or two bytes, so
inference is table reads and additions.

Defined cases: a null text, an empty one and one without any letter get `und`
with score 0 (letters are what Unicode calls so, as str.isalpha has it). Rows
with null ids are predicted like others, repeated rows alike, texts of any length
by all their windows. Equal chances go to the first language by name. An empty
table gives an empty result; where no labelled text exists every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, lowest

WINDOW = 256
WIDTHS = (2, 3, 4)


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray  # 256 x E
    conv: dict[int, np.ndarray]  # width -> width x E x F
    bias: dict[int, np.ndarray]
    out: np.ndarray  # 3F x K
    out_bias: np.ndarray


def windows_of(text: bytes) -> np.ndarray:
    """All of a text as rows of WINDOW bytes, the last one filled up with blanks."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b" "), np.uint8).reshape(n, WINDOW)


def train(texts: list[bytes], langs: list[str], filters: int = 8, dims: int = 8, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on cross entropy; each text gives up to three windows spread over it."""
    names = sorted(set(langs))
    rows, goal = [], []
    for text, lang in zip(texts, langs, strict=True):
        w = windows_of(text)
        for i in sorted({0, len(w) // 2, len(w) - 1}):
            if any(map(str.isalpha, w[i].tobytes().decode("utf-8", "ignore"))):
                rows.append(w[i])
                goal.append(names.index(lang))
    x, y = np.array(rows, np.uint8).reshape(-1, WINDOW), np.array(goal, np.int64)
    names = names if len(x) else []
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (256, dims))}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * dims), (w, dims, filters))
        p[f"b{w}"] = np.zeros(filters)
    p["out"] = rng.normal(0, 0.2, (len(WIDTHS) * filters, len(names)))
    p["out_bias"] = np.zeros(len(names))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            g = _gradients(p, x[take], y[take], dims, filters)
            step += 1
            for k, d in g.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return Net(names, p["embed"], {w: p[f"w{w}"] for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["out"], p["out_bias"])


def _gradients(p: dict, x: np.ndarray, y: np.ndarray, dims: int, filters: int) -> dict:
    n = len(x)
    e = p["embed"][x]  # n x L x E
    pooled, where, stacks = [], [], []
    for w in WIDTHS:
        span = WINDOW - w + 1
        stack = np.concatenate([e[:, j : j + span] for j in range(w)], axis=2)  # n x span x wE
        z = stack @ p[f"w{w}"].reshape(w * dims, filters) + p[f"b{w}"]
        at = z.argmax(1)  # n x F
        pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        where.append(at)
        stacks.append(stack)
    h = np.concatenate(pooled, 1)
    a = np.maximum(h, 0)
    logits = a @ p["out"] + p["out_bias"]
    q = np.exp(logits - logits.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    q[np.arange(n), y] -= 1
    q /= n
    g = {"out": a.T @ q, "out_bias": q.sum(0), "embed": np.zeros_like(p["embed"])}
    da = (q @ p["out"].T) * (h > 0)
    for i, w in enumerate(WIDTHS):
        d, at = da[:, i * filters : (i + 1) * filters], where[i]
        best = np.take_along_axis(stacks[i], at[:, :, None], 1)  # n x F x wE
        g[f"w{w}"] = np.einsum("nf,nfk->kf", d, best).reshape(w, dims, filters)
        g[f"b{w}"] = d.sum(0)
        back = np.einsum("nf,kf->nfk", d, p[f"w{w}"].reshape(w * dims, filters)).reshape(n, filters, w, dims)
        for j in range(w):
            np.add.at(g["embed"], np.take_along_axis(x, at + j, 1), back[:, :, j])
    return g


class Tables:
    """The trained network as lookup tables over byte pairs and single bytes."""

    def __init__(self, net: Net):
        one = {(w, j): net.embed @ net.conv[w][j] for w in WIDTHS for j in range(w)}

        def pair(w: int, j: int) -> np.ndarray:
            return (one[w, j][:, None] + one[w, j + 1][None]).reshape(65536, -1).astype(np.float32)

        # pair 0: width 2 | first two of width 3 | first two of width 4, read together; then what follows
        self.first = np.concatenate([pair(2, 0) + net.bias[2], pair(3, 0) + net.bias[3], pair(4, 0) + net.bias[4]], 1)
        self.third, self.last = one[3, 2].astype(np.float32), pair(4, 2)
        self.f = self.third.shape[1]
        self.net = net

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Logits of windows (n x WINDOW bytes), some hundred at a time to stay in cache."""
        f, found = self.f, []
        for at in range(0, len(x), 16):
            b = x[at : at + 16]
            pairs = (b[:, :-1].astype(np.intp) << 8) | b[:, 1:]
            z = self.first.take(pairs, 0)
            z[:, :-1, f : 2 * f] += self.third.take(b[:, 2:], 0)
            z[:, -1:, f : 2 * f] = -np.inf  # a filter that would reach past the window
            z[:, :-2, 2 * f :] += self.last.take(pairs[:, 2:], 0)
            z[:, -2:, 2 * f :] = -np.inf
            found.append(np.maximum(z.max(1), 0) @ self.net.out + self.net.out_bias)
        return np.concatenate(found)


def predict(tables: Tables, texts: list[str | None], piece: int = 4096) -> tuple[list[str], list[float]]:
    """A text's logits are the mean over its windows; blank filling counts little as windows are many."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not tables.net.langs:
        return langs, scores
    for i, text in enumerate(texts):
        if text is None or not any(map(str.isalpha, text)):
            continue
        w = windows_of(text.encode("utf-8", "replace"))
        total = sum(tables.logits(w[at : at + piece]).astype(np.float64).sum(0) for at in range(0, len(w), piece)) / len(w)
        q = np.exp(total - total.max())
        q /= q.sum()
        langs[i], scores[i] = tables.net.langs[int(q.argmax())], float(q.max())
    return langs, scores


def training_sample(docs: DataFrame, eligible: Column, per_lang: int = 600, chars: int = 2048, most_langs: int = 200) -> tuple[list[bytes], list[str]]:
    """A bounded sample: the per_lang distinct texts of each language with the lowest hashes, a stretch of each.

    The parameters bound what the driver holds: most_langs x per_lang x chars.
    Where lang has more values, those of the most rows are learned (ties by name).
    The stretch starts at a place that the text's hash picks, so it is not
    always the opening.
    """
    rows = docs.where(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    known = [r["lang"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()]
    rows = rows.where(F.col("lang").isin(known))
    h = F.xxhash64("text")
    place = F.lit(1) + F.pmod(F.shiftright(h, 7), F.greatest(F.char_length("text") - F.lit(chars), F.lit(1)))
    stretches = rows.select("lang", F.substr("text", place.cast("int"), F.lit(chars)).alias("text"), h.alias("h"))
    got = sorted((r["h"], r["lang"], r["text"]) for r in lowest(stretches, "lang", "h", per_lang).collect())
    return [t.encode("utf-8", "replace") for _, _, t in got], [lang for _, lang, _ in got]


def identify(docs: DataFrame, net: Net) -> DataFrame:
    """docs with lang_pred and score; its other columns stay (clashing ones are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers, whatever the corpus
    docs = docs.drop("lang_pred", "score")
    holder: list[Tables] = []

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not holder:
            holder.append(Tables(shared.value))
        for frame in frames:
            langs, scores = predict(holder[0], frame["text"].tolist())
            yield frame.assign(lang_pred=langs, score=scores)

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInPandas(run, schema)


def fit(docs: DataFrame, eligible: Column) -> Net:
    texts, langs = training_sample(docs, eligible)
    return train(texts, langs)
