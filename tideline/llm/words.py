"""Words of many texts at once, as numbers.

Words are runs of bytes other than the ASCII white space 0x09-0x0D and 0x20;
A-Z count as lower case. Hashes are 64-bit polynomials over bytes, mixed; all
work is on arrays over a whole chunk of texts.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
KEPT = 1 << 21
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n; a worker keeps tables of at most KEPT powers."""
    found = _powers
    if len(_powers[0]) < n:
        found = []
        with np.errstate(over="ignore"):
            for base in (BASE, INVERSE):
                step = np.full(n, base, np.uint64)
                step[0] = 1
                found.append(np.cumprod(step))
        if n <= KEPT:
            _powers[:] = found
    return [p[:n] for p in found]


class Chunk:
    """Texts laid end to end, each followed by one blank, and their words."""

    def __init__(self, texts: list[bytes]):
        self.bytes = LOWER[np.frombuffer(b" ".join([*texts, b""]) if texts else b"", np.uint8)]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[: len(texts)]
        space = SPACE[self.bytes]
        edge = np.diff(space.astype(np.int8), prepend=1, append=1)
        self.first, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.owner = np.searchsorted(self.starts, self.first, "right") - 1  # the text of each word
        self.n_words = np.bincount(self.owner, minlength=len(texts))

    def hashes(self) -> np.ndarray:
        """Of each word; worked out for stretches of about KEPT / 2 bytes that begin with a word."""
        out = np.empty(len(self.first), np.uint64)
        at = 0
        while at < len(self.first):
            base = self.first[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + KEPT // 2, "right")))
            first, end = self.first[at:to] - base, self.end[at:to] - base
            n = int(end[-1])
            up, down = powers(n + 1)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.bytes[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n])])
                own = (total[end] - total[first]) * down[first]
                out[at:to] = mix64(own ^ mix64((end - first).astype(np.uint64)))
            at = to
        return out


def shingles(chunk: Chunk, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct runs of `size` words, by text and hash.

    A text of fewer words has one run, all of its words; one without words has none.
    """
    h, owner, n = chunk.hashes(), chunk.owner, len(chunk.lengths)
    firsts = np.concatenate([[0], np.cumsum(chunk.n_words)])[:n]
    with np.errstate(over="ignore"):
        pad = np.concatenate([h, np.zeros(size, np.uint64)])
        acc = np.zeros(len(h), np.uint64)
        for j in range(size):
            acc = mix64(acc * np.uint64(BASE) + pad[j : j + len(h)] + np.uint64(j + 1))
        whole = np.arange(len(h)) - firsts[owner] + size <= chunk.n_words[owner]
        short = np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < size))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for j in range(size):
                has = chunk.n_words[short] > j
                extra = np.where(has, mix64(extra * np.uint64(BASE) + pad[np.minimum(firsts[short] + j, len(pad) - 1)] + np.uint64(j + 101)), extra)
    text = np.concatenate([owner[whole], short]) if len(short) else owner[whole]
    value = np.concatenate([acc[whole], extra]) if len(short) else acc[whole]
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.flatnonzero(np.diff(value, prepend=~value[:1]).astype(bool) | np.diff(text, prepend=-1).astype(bool))
    return text[new], value[new], np.diff(np.append(new, len(text)))
