"""Chat formatting: who speaks in a log, by a hidden Markov model, then canonical turns.

A log is rows of raw text in order; each line gives one symbol made of its
speaker marker (a name of one of three roles, or none), whether it begins a
row, whether it is long, and whether it ends as a question. Hidden states are
role and whether the line begins a turn. Transitions and emissions are counted
over labelled logs, smoothed, and Viterbi finds the best path. Turns are then
rendered in one form with markers removed.

A conversation of any length is decoded in blocks: blocks first give the best
score from each state before them to each state at their end (a matrix), these
are chained along the conversation, and each block is then decoded between the
states that the chain fixes. The path equals that of one pass.

Defined cases: null text counts as an empty line. Rows without conv_id form one
conversation. Exactly repeated rows count once; equal turn numbers are ordered
by text. Without labelled logs all paths are equally likely and ties go to the
first role.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ["user", "assistant", "system"]
# Names by which logs call the roles.
NAMES = {"user": "user|human|customer|me|q", "assistant": "assistant|bot|ai|agent|a", "system": "system|sys|instructions"}
MARKER = re.compile(r"^\s*(?:#+\s*|\[|<\|?|\*\*)?(?:" + "|".join(f"(?P<{r}>{n})" for r, n in NAMES.items()) + r")(?:\]|\|?>|\*\*)?\s*(?:[:>]|-\s)\s*", re.IGNORECASE)
SYMBOLS, STATES = 32, 6  # state: 2 * role + (0 begins a turn, 1 goes on)


def lines_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(bare lines, symbols, row of each line)."""
    bare, symbols, rows = [], [], []
    for i, text in enumerate(texts):
        for j, line in enumerate((text or "").split("\n")):
            m = MARKER.match(line)
            role = 1 + ROLES.index(m.lastgroup) if m else 0
            rest = line[m.end() :] if m else line
            bare.append(rest)
            symbols.append(8 * role + 4 * (j == 0) + 2 * (len(rest) > 80) + rest.rstrip().endswith("?"))
            rows.append(i)
    return bare, np.array(symbols, np.int64), np.array(rows, np.int64)


class Model:
    def __init__(self, first: np.ndarray, moves: np.ndarray, emits: np.ndarray, smooth: float = 0.5):
        log = lambda c: np.log((c + smooth) / (c + smooth).sum(-1, keepdims=True))
        self.first, self.moves, self.emits = log(first.astype(float)), log(moves.astype(float)), log(emits.astype(float))

    def matrix(self, symbols: np.ndarray) -> np.ndarray:
        """Best score from each state before the block to each state at its end."""
        best = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
        for s in symbols:
            best = (best[:, :, None] + self.moves[None]).max(1) + self.emits[:, s]
        return best

    def path(self, symbols: np.ndarray, before: int = -1, last: int = -1) -> np.ndarray:
        """The best states; `before` is the state ahead of the block (-1: a log begins), `last` that at its end (-1: free)."""
        score = (self.first if before < 0 else self.moves[before]) + self.emits[:, symbols[0]]
        back = np.zeros((len(symbols), STATES), np.int64)
        for t in range(1, len(symbols)):
            all_ = score[:, None] + self.moves
            back[t] = all_.argmax(0)
            score = all_.max(0) + self.emits[:, symbols[t]]
        out = np.empty(len(symbols), np.int64)
        out[-1] = last if last >= 0 else int(score.argmax())
        for t in range(len(symbols) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def _clean(log: DataFrame, block: int, *more: str) -> DataFrame:
    rows = log.select("conv_id", F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("turn"), "text", *more).dropDuplicates()
    return rows.withColumn("block", F.floor(F.col("turn") / block).cast("long"))


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["turn", "text"], kind="stable", na_position="first")


def fit(log: DataFrame, block: int = 256) -> Model:
    """Counts over labelled rows (column role); sequences are counted within blocks of turns."""

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = _ordered(frame)
        frame = frame[frame["role"].isin(ROLES)]
        if frame.empty:
            return pd.DataFrame({"kind": [], "a": [], "b": []})
        _, symbols, row = lines_of(frame["text"].tolist())
        role = np.array([ROLES.index(r) for r in frame["role"]])[row]
        states = 2 * role + (np.diff(row, prepend=-1) == 0)
        kind = np.concatenate([np.full(len(states), 2), np.full(len(states) - 1, 1), [0] if key[1] == 0 else []])
        a = np.concatenate([states, states[:-1], states[:1] if key[1] == 0 else []])
        b = np.concatenate([symbols, states[1:], [0] if key[1] == 0 else []])
        return pd.DataFrame({"kind": kind.astype(int), "a": a.astype(int), "b": b.astype(int)})

    rows = _clean(log, block, "role").groupBy("conv_id", "block").applyInPandas(count, "kind int, a int, b int")
    tables = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))]
    for r in rows.groupBy("kind", "a", "b").agg(F.count("*").alias("n")).collect():  # at most 6 + 36 + 192 rows
        if r["kind"]:
            tables[r["kind"]][r["a"], r["b"]] = r["n"]
        else:
            tables[0][r["a"]] = r["n"]
    return Model(*tables)


def recover(log: DataFrame, model: Model, block: int = 256) -> DataFrame:
    """(conv_id, turn, part, role, text): what each row holds, cut where a turn begins; markers are gone."""
    rows = _clean(log, block)
    kind = log.schema["conv_id"].dataType.simpleString()

    def chain(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        many = [np.array(m).reshape(STATES, STATES) for m in frame["m"]]
        score, back = None, []
        for i, m in enumerate(many):
            if i == 0:
                score = np.array(frame["start"].iloc[0])
                back.append(np.full(STATES, -1))
            else:
                all_ = score[:, None] + m
                back.append(all_.argmax(0))
                score = all_.max(0)
        ends = [int(score.argmax())]
        for b in reversed(back[1:]):
            ends.append(int(b[ends[-1]]))
        ends.reverse()
        return pd.DataFrame({"conv_id": [key[0]] * len(ends), "block": frame["block"].to_numpy(), "before": [-1, *ends[:-1]], "last": ends})

    def decode(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = _ordered(frame)
        before, last = (int(frame[c].iloc[0]) for c in ("before", "last"))
        bare, symbols, row = lines_of(frame["text"].tolist())
        states = model.path(symbols, before, last)
        turns, out, part = frame["turn"].to_numpy(), [], 0
        for i, line in enumerate(bare):
            fresh = i == 0 or row[i] != row[i - 1]
            if fresh or states[i] % 2 == 0 or states[i] // 2 != states[i - 1] // 2:
                part = 0 if fresh else part + 1
                out.append([key[0], turns[row[i]], part, ROLES[states[i] // 2], []])
            out[-1][4].append(line)
        return pd.DataFrame([(*o[:4], "\n".join(o[4])) for o in out], columns=["conv_id", "turn", "part", "role", "text"])

    def starts(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, symbols, _ = lines_of(_ordered(frame)["text"].tolist())
        rest = model.matrix(symbols[1:])
        score = (model.first + model.emits[:, symbols[0]])[:, None] + rest
        whole = model.matrix(symbols)
        return pd.DataFrame({"conv_id": [key[0]], "block": [key[1]], "m": [whole.ravel()], "start": [score.max(0)]})

    spans = rows.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
    long_ = rows.join(spans.select(F.col("conv_id").alias("key")), F.col("conv_id").eqNullSafe(F.col("key")), "left_semi")
    ends = long_.groupBy("conv_id", "block").applyInPandas(starts, f"conv_id {kind}, block long, m array<double>, start array<double>").groupBy("conv_id").applyInPandas(chain, f"conv_id {kind}, block long, before int, last int")
    ends = ends.withColumnRenamed("conv_id", "c").withColumnRenamed("block", "k")
    joined = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")), "left").select("conv_id", "turn", "text", "block", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("last", F.lit(-1)).alias("last"))
    return joined.groupBy("conv_id", "block").applyInPandas(decode, f"conv_id {kind}, turn long, part int, role string, text string")


def rendered(turns: DataFrame) -> DataFrame:
    """Each recovered turn in one form: a role line, the text, an end line."""
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.trim("text"), F.lit("\n<|end|>")))


def as_log(conversations: DataFrame) -> DataFrame:
    """Conversations as raw logs: each in one of four marker styles, every seventh marker missing."""
    pick = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    name: Column = F.coalesce("role", F.lit(""))
    plain = F.initcap(name)
    other = F.when(name == "user", "Human").when(name == "assistant", "Bot").otherwise(F.initcap(name))
    marker = F.when(pick == 0, F.concat(plain, F.lit(": "))).when(pick == 1, F.concat(F.lit("### "), plain, F.lit(":\n"))).when(pick == 2, F.concat(F.lit("["), other, F.lit("]: "))).otherwise(F.concat(F.lit("<"), other, F.lit("> - ")))
    gone = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(7)) == 0
    return conversations.withColumn("text", F.concat(F.when(gone, "").otherwise(marker), F.coalesce("text", F.lit(""))))
