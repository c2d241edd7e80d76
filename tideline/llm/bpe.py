"""Byte-pair encoding and decoding with forced-boundary splitting.

A pair of bytes that stands inside no token of the vocabulary can never be
merged across, so wherever such a pair occurs in a text the cut between its
bytes is certain. The bytes of many new pieces of text are laid end to end and
looked up in the table of such pairs at once; with the pre-tokenizer's own
boundaries this gives the fragments, which are encoded independently (equal ones
once, as a worker keeps a bounded table of those it has seen) and whose ids are
concatenated. The result equals that of encoding the whole text, since every
merge joins bytes of one fragment only.

Texts of printable ASCII, blanks, line ends and Latin letters are cut as they are,
all texts of a batch at once: there the pre-tokenizer's boundaries are known from a
table of byte pairs too, but for runs of white space and contractions, which are mended.

In other texts the end of a character that is no white space, followed by a blank, is
a certain boundary too (checked when a vocabulary is loaded); where the blank is
followed by a character that is no white space either, the pre-tokenizer starts a new
piece there. These texts are parted at such blanks first, so that a word seen before is
not cut up again; a word that is not in the table goes the way above.

Both need the byte-level pre-tokenizer and plain merges that a vocabulary file
states; a file that states anything else (a normalizer, another pattern,
stripped or single-word added tokens) is encoded by the library text by text.

Merges inside a fragment are those of the vocabulary's model, which the tokenizers
library applies to one fragment at a time.

Defined cases: null text counts as empty and gives no ids. A special token's
literal string is one id, as the tokenizers library has it. Texts of any length
are encoded whole. Repeated rows give equal rows; an empty table gives none;
other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import frugal

#: A blank between two characters that are no white space; white space other than blanks and line ends.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
OTHER_SPACE = [*(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"), "  ", " \n", "\n "]
#: Texts that need no pre-tokenizer: printable ASCII and Latin letters, blanks and line ends between them; the kinds of their bytes: blank, letter, digit, sign, line end.
SOLID = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN = re.compile(f"[{SOLID}](?:[ \n{SOLID}]*[{SOLID}])?")
KINDS = np.array([0 if b == 32 else 4 if b == 10 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(128)] + [1] * 128, np.uint8)
#: What the pre-tokenizer cuts off where a piece begins with an apostrophe: behind a letter, a digit or a line end.
CONTRACTION = re.compile(rb"(?:\A|(?<=[A-Za-z0-9\n\x80-\xff]))'(?:[stmd]|re|ve|ll)")
#: Longest word that a worker keeps in its table of seen ones; longer ones are cut up anew.
SHORT = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Seen:
    """Packed ids by unit, in two generations of at most `most` entries: what is used again moves to the new one."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def ids(self, units: list[str], learn: Callable[[list[str]], None]) -> list[bytes]:
        """Packed ids of each unit; learn puts those that are not kept into `new`, from where long ones go again."""
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        got = list(map(new.get, units))
        holes = [i for i, ids in enumerate(got) if ids is None]
        absent = {units[i] for i in holes}
        unknown = list(absent.difference(old))
        kept = absent.difference(unknown)
        new.update(zip(kept, map(old.__getitem__, kept)))
        if unknown:
            learn(unknown)
        for i in holes:
            got[i] = new[units[i]]
        for u in unknown:
            if len(u) > SHORT:
                del new[u]
        return got


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, keep: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.letters = path, byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.certain = self._is_byte_level(spec) and self._load(spec)
        self.seen, self.parts = _Seen(keep), _Seen(2 * keep)

    @functools.cached_property
    def library(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    def _load(self, spec: dict) -> bool:
        """Tables of a byte-level vocabulary; False if its tokens or merges are not in the order that cuts and ranks need."""
        raw = lambda token: bytes(self.letters[c] for c in token)
        ids = {raw(token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [ids[raw(a + b)] for a, b in pairs]
        inner = [token for token in ids if re.search(rb"[^ ] ", token)]
        if len(ids) != 256 + len(made) or any(a >= b for a, b in zip(made, made[1:])) or not all(t.decode("utf-8", "replace").isspace() for t in inner):
            return False
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in [*ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes_of[i] = token
        self.decimal = [str(i) for i in range(size)]
        self.cut = np.ones((256, 256), bool)
        for token in ids:
            for a, b in zip(token, token[1:]):
                self.cut[a, b] = False
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.ends = (self.cut | (KINDS[:, None] != KINDS) & (KINDS[:, None] != 0)).ravel()
        self.printed, self.byte = np.zeros(256, "<u2"), np.zeros(1 + max(map(ord, self.letters)), np.uint8)
        for c, b in self.letters.items():
            self.printed[b], self.byte[ord(c)] = ord(c), b
        from tokenizers.pre_tokenizers import ByteLevel

        self.pieces, self.merge = ByteLevel(add_prefix_space=False).pre_tokenize_str, self.library.model.tokenize
        return True

    @staticmethod
    def _is_byte_level(spec: dict) -> bool:
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = [before.get("type") == "ByteLevel", not before.get("add_prefix_space"), before.get("use_regex", True), not spec.get("normalizer"), (spec.get("decoder") or {}).get("type") == "ByteLevel", model.get("type") == "BPE"]
        plain += [not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        return all(plain) and not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))

    # -- encoding

    def fragments(self, piece: bytes) -> list[bytes]:
        """A pre-tokenized piece, cut at every byte pair that no token holds."""
        b = np.frombuffer(piece, np.uint8)
        at = (np.flatnonzero(self.cut[b[:-1], b[1:]]) + 1).tolist()
        return [piece[i:j] for i, j in zip([0, *at], [*at, len(piece)])] if at else [piece]

    def cut_up(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Fragments, in printed letters, of a text that begins and ends at certain boundaries, all its pieces at once; where each begins and its first byte."""
        words = [w for w, _ in self.pieces(text)]
        b = self.byte[np.frombuffer("".join(words).encode("utf-16-le"), "<u2")]
        cut = _of_pairs(self.cut.ravel(), b)
        cut[np.cumsum([len(w) for w in words[:-1]], dtype=np.int64) - 1] = True
        return self._parted(b, cut)

    def cut_plain(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """cut_up() of a PLAIN text, or of one with a blank or a line end before it."""
        data = text.encode()
        b = np.frombuffer(data, np.uint8)
        cut = _of_pairs(self.ends, b)  # a piece ends where letters, digits, signs and white space change
        space = (b == 32) | (b == 10)
        both = np.flatnonzero(space[:-1] & space[1:])
        cut[both] = ~space[both + 2]  # of a run of white space only the last stands apart, or before the word
        if "'" in text:
            for m in CONTRACTION.finditer(data):
                cut[m.start()] = False
                cut[m.end() - 1 : m.end()] = True
        return self._parted(b, cut)

    def _parted(self, b: np.ndarray, cut: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.flatnonzero(cut) + 1])
        places, letters = at.tolist(), self._letters(b)
        return [letters[i:j] for i, j in zip(places, [*places[1:], len(letters)])], at, b[at]

    def _letters(self, b: np.ndarray) -> str:
        return self.printed[b].tobytes().decode("utf-16-le")

    def merged(self, fragment: bytes) -> bytes:
        """Ids, packed, of one fragment by the vocabulary's merges."""
        return self._merged(self._letters(np.frombuffer(fragment, np.uint8)))

    def _merged(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _packed(self, found: list[str]) -> list[bytes]:
        """Packed ids of each fragment."""
        return self.parts.ids(found, lambda new: self.parts.new.update(zip(new, map(self._merged, new))))

    def _learn(self, units: list[str]) -> None:
        """Ids of new words, each led by its blank, many at a time; the blanks begin the words."""
        table, plain, other = self.seen.new, [], []
        for u in units:
            if " " in u or u[-1].isspace():
                table[u] = b"".join(self._packed(self.cut_up(" " + u)[0]))
            else:
                (plain if PLAIN.fullmatch(u) else other).append(u)
        for cut, own in ((self.cut_plain, plain), (self.cut_up, other)):
            for at in range(0, len(own), 4096):
                some = own[at : at + 4096]
                found, _, first = cut(" " + " ".join(some))
                ids, begin = self._packed(found), np.flatnonzero(first == 32).tolist()
                assert len(begin) == len(some)
                table.update(zip(some, [ids[i] if j - i == 1 else b"".join(ids[i:j]) for i, j in zip(begin, [*begin[1:], len(ids)])]))

    def _plain_ids(self, runs: list[str]) -> Iterator[bytes]:
        """Packed ids of PLAIN texts, laid end to end with a line end, which is a piece of its own, between them."""
        if runs:
            found, at, _ = self.cut_plain("\n".join(runs))
            ids = self._packed(found)
            sizes = np.array([len(r) if r.isascii() else len(r.encode()) for r in runs])
            begin = np.searchsorted(at, np.cumsum(sizes + 1) - sizes - 1).tolist()
            for i, j in zip(begin, [*(k - 1 for k in begin[1:]), len(ids)]):
                yield b"".join(ids[i:j])

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts as unsigned 32-bit numbers."""
        if not self.certain:
            return [np.array(self.library.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts]
        runs = [self.marks.split(text) if text and self.marks else [text or ""] for text in texts]  # every second one is a special token
        plain = [[bool(PLAIN.fullmatch(run)) for run in own[::2]] for own in runs]
        plain_ids = self._plain_ids([run for own, known in zip(runs, plain) for run, is_plain in zip(own[::2], known) if is_plain])
        words = [BETWEEN.split(run) for own, known in zip(runs, plain) for run, is_plain in zip(own[::2], known) if run and not is_plain]
        units = [u for _, *rest in words for u in rest]
        word_ids, first = iter(self.seen.ids(units, self._learn)), iter(words)
        out = []
        for own, known in zip(runs, plain):
            parts: list[bytes] = []
            for k, run in enumerate(own):
                if k % 2:
                    parts.append(np.array([self.special[run]], "<u4").tobytes())
                elif known[k // 2]:
                    parts.append(next(plain_ids))
                elif run:
                    lead, *rest = next(first)
                    parts += self._packed(self.cut_up(lead)[0])
                    parts += islice(word_ids, len(rest))
            out.append(np.frombuffer(b"".join(parts), "<u4"))
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    # -- decoding

    def decode(self, ids: np.ndarray) -> str:
        if not self.certain:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def joined(self, ids: np.ndarray) -> str:
        return ",".join(map(self.decimal.__getitem__, ids.tolist())) if self.certain else ",".join(map(str, ids.tolist()))


def _of_pairs(table: np.ndarray, b: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """The table's entry for each two neighbouring bytes, some MB of indices at a time."""
    out = np.empty(max(0, len(b) - 1), bool)
    for i in range(0, len(out), block):
        part = b[i : i + block + 1].astype(np.intp)
        out[i : i + block] = table[part[:-1] * 256 + part[1:]]
    return out


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """A worker's codec for a vocabulary file; the file is read where the task runs."""
    return Codec(path)


def encoded(frames: Iterator, path: str) -> Iterator:
    """(frame, ids of each text) for each 256 rows or some MB of a task, so that few ids are held at once."""
    c = codec(path)
    for frame in frames:
        for part in slices(frame["text"].tolist()):
            yield frame.iloc[part], c.encode_all(frame["text"].iloc[part].tolist())


def slices(texts: list[str | None], rows: int = 256, chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of at most so many rows, or of so many characters; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and (i - start >= rows or size + n > chars):
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """The token ids of each whole text: id, ids."""
    kind = docs.schema[id_column].dataType.simpleString()

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, ids in encoded(frames, path):
            yield pd.DataFrame({id_column: frame[id_column].to_numpy(), "ids": [i.astype("i4") for i in ids]})

    return docs.select(id_column, "text").mapInPandas(run, f"{id_column} {kind}, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """The text of each row of ids (null ids: null text)."""
    kind = tokens.schema[id_column].dataType.simpleString()

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for frame in frames:
            yield pd.DataFrame({id_column: frame[id_column], "text": [None if i is None else c.decode(np.asarray(i)) for i in frame["ids"]]})

    return tokens.select(id_column, "ids").mapInPandas(run, f"{id_column} {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each document's ids and of the text that decoding them gives."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for frame, ids in encoded(frames, path):
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "n_tokens": [len(i) for i in ids], "ids_sha256": [sha(c.joined(i)) for i in ids], "decoded_sha256": [sha(c.decode(i)) for i in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
