"""Cutting a text where byte-level pre-tokens always end, and a bounded memory of encoded pieces.

No match of the pre-token pattern reaches over a place between a character that is not white space and a single white
space followed by another such character: a match takes a space only as its first character or inside a run of white
space. Nor does one reach from a letter into punctuation other than the apostrophe. Pieces cut there are encoded on
their own with the same ids as inside the whole text, and most of them repeat.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import filterfalse

import numpy as np

# two white-space characters in a row, in the widest sense of white space; rare in prose
_RUN = re.compile(r"\s\s")
_EDGE = re.compile(r"(?<=\S)(?= \S)")
_PUNCTUATION = ",.;:!?*#$%&|)]}\""


def pieces(text: str) -> tuple[str, list[str]]:
    """The first piece, and the later ones without the space in front of each; one that begins with a new line has none."""
    if _RUN.search(text) is None:
        head, *rest = (text.replace("\n", " \n") if "\n" in text[1:-1] and "\n" not in (text[0], text[-1]) else text).split(" ")
    else:
        head, *rest = _EDGE.split(text)
        rest = [x[1:] for x in rest]
    return head, rest


def _spaced(piece: str) -> str:
    return piece if piece[:1] == "\n" else " " + piece


class Memory:
    """Encoded pieces by piece, at most about twice ``most`` of them.

    ``encode`` turns a text into ids and the number of bytes of each id. The unknown pieces of a batch are encoded as
    one text, which is cut by bytes: put one after the other, pieces meet at places where pre-tokens end.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[tuple[np.ndarray, np.ndarray]]], most: int = 700_000, longest: int = 64, joined: int = 4_000_000):
        self.encode, self.most, self.longest, self.joined = encode, most, longest, joined
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def batch(self, texts: list[str]) -> Iterable[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers, in order."""
        if len(self.known) > self.most:  # two generations: what is met again moves to the new one
            self.known, self.old = {}, self.known
        get, unknown, heads, found = self.known.get, set(), [], []
        for text in texts:
            head, rest = pieces(text)
            heads.append(head)
            coded = list(map(get, rest))
            missing = [i for i, x in enumerate(coded) if x is None] if None in coded else []
            names = [rest[i] for i in missing]
            unknown.update(names)
            found.append((coded, missing, names))
        fresh = self._fresh(unknown)
        first = dict.fromkeys(heads)
        first = dict(zip(first, self._each(list(first)), strict=True))
        # long pieces are not kept beyond the batch
        self.known.update((x, ids) for x, ids in fresh.items() if len(x) <= self.longest)
        for head, (coded, missing, names) in zip(heads, found, strict=True):
            for i, x in zip(missing, names, strict=True):
                coded[i] = fresh[x]
            yield first[head] + b"".join(coded)

    def _fresh(self, unknown: set[str]) -> dict[str, bytes]:
        """The ids of pieces: words without the punctuation after them, then both together."""
        again = {x: ids for x in unknown if (ids := self.old.get(x)) is not None}
        unknown.difference_update(again)
        words, tails, alone = [], [], []
        for x in unknown:
            word = x.rstrip(_PUNCTUATION)
            if word != x and word and word[-1].isalpha():
                words.append(word)
                tails.append(x[len(word) :])
            else:
                alone.append(x)
        whole = {x: ids for x in words if (ids := self.known.get(x)) is not None}
        new = set(filterfalse(whole.__contains__, words))
        new.update(alone)
        # what begins or ends with white space does not stand beside another piece
        apart = [x for x in new if not x or x[-1].isspace() or x[0].isspace() and (x[0] != "\n" or x[1].isspace())]
        new.difference_update(apart)
        self._together(list(new), whole)
        whole.update(zip(apart, self._each(list(map(_spaced, apart))), strict=True))
        ends = dict.fromkeys(tails)
        ends = dict(zip(ends, self._each(list(ends)), strict=True))
        whole.update((word + tail, whole[word] + ends[tail]) for word, tail in zip(words, tails, strict=True))
        return whole | again

    def _each(self, texts: list[str]) -> list[bytes]:
        return [ids.astype("<u4").tobytes() for ids, _ in self.encode(texts)]

    def _together(self, rest: list[str], to: dict[str, bytes]) -> None:
        at = 0
        while at < len(rest):
            end, size = at, 0
            while end < len(rest) and size < self.joined:
                size += len(rest[end]) + 1
                end += 1
            part, at = rest[at:end], end
            spaced = list(map(_spaced, part))
            [(ids, lengths)] = self.encode(["".join(spaced)])
            coded = ids.astype("<u4").tobytes()
            ends = np.cumsum([len(x.encode()) for x in spaced])
            cuts = (4 * (np.searchsorted(np.cumsum(lengths), ends) + 1)).tolist()
            to.update((x, coded[a:b]) for x, a, b in zip(part, [0, *cuts], cuts, strict=False))
