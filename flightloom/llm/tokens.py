"""Token ids of whole texts by the tokenizers library, with each distinct piece of text encoded once per worker.

Both supported vocabularies split a text at white space before any merge, so a text's ids are those of its pieces in
turn. Pieces are found and hashed in numpy; only pieces that the worker has not met go to the library. Texts with
unusual white space, for which the split is not that simple, go to the library whole.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from flightloom.llm.common import ranges, runs, span_hashes, text_bytes

#: White space other than blank, tab, line feed and carriage return, and controls that some libraries count as such.
UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]|<\\|")
PLAIN_SPACE = np.zeros(256, bool)
PLAIN_SPACE[[9, 10, 13, 32]] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
#: ASCII marks but for the apostrophe, which can begin a contraction.
MARK = np.zeros(256, bool)
MARK[33:48] = MARK[58:65] = MARK[91:97] = MARK[123:127] = True
MARK[39] = False
SIMPLE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+)")


def byte_names() -> dict[int, int]:
    """The public byte-level convention: printable bytes stand for themselves, the rest for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_NAMES = byte_names()
#: Distinct pieces that a worker remembers; beyond it starts afresh.
REMEMBERED = 600_000
#: Bytes of text encoded at a time: long enough that few pieces are new to a slice.
ENCODED = 1 << 20

_encoders: dict[str, "Encoder"] = {}


def encoder(name: str) -> "Encoder":
    """One per vocabulary and Python worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


class Encoder:
    """``leading``: white space belongs to the piece that follows it (byte-level); else it is dropped."""

    def __init__(self, name: str) -> None:
        self.tokenizer = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.leading = self.tokenizer.encode("a b", add_special_tokens=False).ids != self.tokenizer.encode("a  b", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Pieces that are one run of letters or of marks need no further split and go to the merges directly."""
        model, found = self.tokenizer.model, [None] * len(texts)
        rest = []
        for i, x in enumerate(texts):
            if SIMPLE.fullmatch(x):
                found[i] = [y.id for y in model.tokenize((x if self.leading else x.lower()).encode().decode("latin-1").translate(BYTE_NAMES))]
            else:
                rest.append(i)
        for i, x in zip(rest, self.library([texts[i] for i in rest])):
            found[i] = x
        count = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))
        place = len(self.ids) + np.cumsum(count) - count
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, place)
        self.count, self.ids = np.insert(self.count, at, count), np.concatenate([self.ids, ids])

    def pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, in order."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        space = PLAIN_SPACE[data]
        starts, ends = runs(~space, at)
        cut = np.zeros(n + 1, bool)
        cut[at] = cut[starts] = cut[ends] = True
        letter = ASCII_LETTER[data]
        wide = np.flatnonzero(data[:-1] == 0xC3)
        wide = wide[(data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7)]
        letter[wide] = letter[wide + 1] = True
        mark = MARK[data]
        cut[1:n] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        if self.leading and len(starts):
            # one blank goes with the run after it; of longer white space that ends otherwise, all of it does
            gap = starts - np.maximum(np.concatenate([[0], ends[:-1]]), at[np.searchsorted(at, starts, side="right") - 1])
            blank = (gap > 0) & (data[starts - 1] == 32)
            cut[starts[blank | (gap > 1)]] = False
            cut[starts[blank] - 1] = True
        edges = np.flatnonzero(cut)
        begin, end = edges[:-1], edges[1:]
        if not self.leading:
            keep = ~space[begin]
            begin, end = begin[keep], end[keep]
        return begin, end

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        data, at = text_bytes(column)
        n = len(at) - 1
        starts, ends = self.pieces(data, at)
        first = np.searchsorted(starts, at)
        hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        keys, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.forget()
        spot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inner = spot < len(self.keys)
        known[inner] = self.keys[spot[inner]] == keys[inner]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self.learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist())])
            spot = np.searchsorted(self.keys, keys)
        counts, places = self.count[spot][inverse], self.place[spot][inverse]
        sums = np.concatenate([[0], np.cumsum(counts)])
        ids, sizes = self.ids[ranges(places, counts)], sums[first[1:]] - sums[first[:-1]]
        odd = [i for i, x in enumerate(column.to_pylist()) if x and UNUSUAL.search(x)] if n and self.may_be_odd(data) else []
        if odd:
            whole = dict(zip(odd, self.library([column[i].as_py() for i in odd])))
            edges = np.concatenate([[0], np.cumsum(sizes)])
            parts = [np.asarray(whole[i], np.int32) if i in whole else ids[edges[i] : edges[i + 1]] for i in range(n)]
            ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, sizes

    @staticmethod
    def may_be_odd(data: np.ndarray) -> bool:
        """Whether any byte can begin unusual white space or a special token's string."""
        seen = np.bincount(data, minlength=256)
        return bool(seen[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF, 0x3C]].any())
