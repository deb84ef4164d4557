"""Token ids by the tokenizers library, each distinct piece of text encoded once."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from groundq.llm.texts import BASE, INVERSE, mixed, powers

#: Classes of code points that the byte-level pattern tells apart.
LETTER, NUMBER, OTHER, SPACE, END = range(5)
#: Texts longer than this are encoded part by part; a part ends before white space that follows something else.
PART_CHARS = 1 << 19
#: Pieces whose ids are remembered, about; when there are more, those stay that came again, up to half as many.
REMEMBERED = 1 << 18
#: Pieces that the library encodes at once: what it returns for each is far larger than its ids.
AT_ONCE = 1 << 12

_BORDER = re.compile(r"(?<=\S)[ \n\t\r]")


def _growing(a: np.ndarray, need: int) -> np.ndarray:
    return a if need <= len(a) else np.concatenate([a, np.zeros(max(need, len(a) + len(a) // 4) - len(a), a.dtype)])


class Encoder:
    """ids of texts, the same as Tokenizer.encode(text, add_special_tokens=False).ids.

    Byte-level vocabularies split text by a fixed pattern before anything else, and each piece has its ids whatever stands around it. So the
    pieces of a block of texts are found at once with numpy, and the library encodes each distinct one; repeated ones are looked up by a
    64-bit hash. The library itself says which class a code point belongs to. Special tokens of the vocabulary split a text first, as they
    do in the library. Vocabularies of another kind are encoded by the library text by text.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        spec = json.loads(vocabulary)
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        first = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        self.split = plain and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not spec.get("normalizer")
        self.special = {t["content"]: t["id"] for t in added}
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.largest = max([*spec["model"]["vocab"].values(), *self.special.values()]) if isinstance(spec["model"]["vocab"], dict) else 1 << 31
        self.table = np.full(0x110001, 255, "u1")
        self.table[0x110000] = END
        self._forget()

    def _forget(self) -> None:
        #: hashes of remembered pieces in order, with the number of each; those of the last blocks are still in a dict
        self.names, self.numbers, self.recent = np.zeros(0, "u8"), np.zeros(0, "i4"), {}
        self.count, self.used = 0, 0
        self.at, self.size, self.pool = np.zeros(1 << 12, "i8"), np.zeros(1 << 12, "i4"), np.zeros(1 << 14, "u4")
        self.again = np.zeros(1 << 12, bool)  # pieces that were looked up since

    def _sort_recent(self) -> None:
        fresh = np.fromiter(self.recent.keys(), "u8", len(self.recent))
        order = np.argsort(fresh)
        names = np.concatenate([self.names, fresh[order]])
        numbers = np.concatenate([self.numbers, np.fromiter(self.recent.values(), "i4", len(self.recent))[order]])
        order = np.argsort(names, kind="stable")  # merges the two sorted runs
        self.names, self.numbers, self.recent = names[order], numbers[order], {}

    def _thin(self) -> None:
        """Forgets the pieces that did not come again since the last time, and of the others all but the oldest, up to half of REMEMBERED."""
        self._sort_recent()
        keep = np.flatnonzero(self.again[: self.count])[: REMEMBERED // 2]
        size = self.size[keep]
        place, total = np.cumsum(size) - size, int(size.sum())
        if total > 4 * REMEMBERED:
            return self._forget()
        number = np.full(self.count, -1, "i4")
        number[keep] = np.arange(len(keep))
        numbers = number[self.numbers]
        self.names, self.numbers = self.names[numbers >= 0], numbers[numbers >= 0]
        self.pool = self.pool[np.repeat(self.at[keep] - place, size) + np.arange(total)]
        self.at, self.size, self.again = place.astype("i8"), size, np.zeros(len(keep), bool)
        self.count, self.used = len(keep), total
        return None

    def _class(self, point: int) -> int:
        """Whether the pattern joins a code point to a letter, a number or a mark before it."""
        pieces = lambda before: len(self.library.pre_tokenizer.pre_tokenize_str(before + chr(point)))
        return next((kind for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if pieces(before) == 1), SPACE)

    def _pieces(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of every piece. code: code points, 0x110000 after each text."""
        kind = self.table[code]
        if (kind == 255).any():
            for point in np.unique(code[kind == 255]).tolist():
                self.table[point] = self._class(point)
            kind = self.table[code]
        start = np.ones(len(code), bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == END
        # the last of some white space before something else stands alone, or goes with what follows if it is a blank
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
        start[last] = True
        start[last[code[last] == 32] + 1] = False
        # an apostrophe that begins a piece takes one of seven endings with it
        at = np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
        one, two = code[at + 1], code[np.minimum(at + 2, len(code) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        at, width = at[short | long], np.where(short, 2, 3)[short | long]
        start[at + 1] = False
        after = at + width
        start[after[kind[after] == LETTER]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(code))
        own = kind[begin] != END
        return begin[own], end[own]

    def _slots(self, whole: str, code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each piece its number among the remembered ones. whole: the texts, where a code point has the place that it has in code."""
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum((code.astype("u8") + np.uint64(1)) * powers(BASE, len(code)))])
        names = mixed((sums[end] - sums[begin]) * powers(INVERSE, len(code) + 1)[begin] + (end - begin).astype("u8"))
        order = np.argsort(names)
        ordered = names[order]
        new = np.ones(len(order), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        distinct, first = ordered[new], order[new]
        found = np.full(len(distinct), -1, "i4")
        if len(self.names):
            near = np.minimum(np.searchsorted(self.names, distinct), len(self.names) - 1)
            found = np.where(self.names[near] == distinct, self.numbers[near], found)
        rest = np.flatnonzero(found < 0)
        if len(rest):
            found[rest] = [self.recent.get(h, -1) for h in distinct[rest].tolist()]
            rest = rest[found[rest] < 0]
        self.again[found[found >= 0]] = True
        if len(rest):
            found[rest] = self._learn([whole[a:b] for a, b in zip(begin[first[rest]].tolist(), end[first[rest]].tolist(), strict=True)])
            self.recent.update(zip(distinct[rest].tolist(), found[rest].tolist(), strict=True))
        out = np.empty(len(order), "i4")
        out[order] = found[np.cumsum(new) - 1]
        if len(self.recent) > 1 << 15:
            self._sort_recent()
        return out

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """The numbers of pieces that are encoded for the first time."""
        numbers = np.arange(self.count, self.count + len(pieces))
        for lo in range(0, len(pieces), AT_ONCE):
            each = [e.ids for e in self.library.encode_batch_fast(pieces[lo : lo + AT_ONCE], add_special_tokens=False)]
            sizes = np.fromiter(map(len, each), "i4", len(each))
            total, stop = int(sizes.sum()), self.count + len(each)
            self.at, self.size, self.again = _growing(self.at, stop), _growing(self.size, stop), _growing(self.again, stop)
            self.pool = _growing(self.pool, self.used + total)
            self.at[self.count : stop], self.size[self.count : stop] = self.used + np.cumsum(sizes) - sizes, sizes
            self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(each), "u4", total)
            self.count, self.used = stop, self.used + total
        return numbers

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        if self.count > REMEMBERED or self.used > 8 * REMEMBERED:
            self._thin()
        whole = "\n".join([*texts, ""])
        code = np.frombuffer(whole.encode("utf-32-le"), "u4").copy()
        code[np.cumsum([len(t) + 1 for t in texts]) - 1] = 0x110000
        begin, end = self._pieces(code)
        if not len(begin):
            return [np.zeros(0, "u4") for _ in texts]
        slot = self._slots(whole, code, begin, end)
        size = self.size[slot]
        place = np.cumsum(size) - size
        total = int(size.sum())
        ids = self.pool[np.repeat(self.at[slot] - place, size) + np.arange(total)]
        stops = np.append(place, total)[np.searchsorted(begin, np.flatnonzero(code == 0x110000))]
        return np.split(ids, stops[:-1])

    def _long(self, text: str) -> np.ndarray:
        out, at = [], 0
        while at < len(text):
            border = _BORDER.search(text, at + PART_CHARS)
            end = border.start() if border else len(text)
            out += self._encoded([text[at:end]])
            at = end
        return np.concatenate([*out, np.zeros(0, "u4")])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers. A block of texts is held in memory at once, a long text in parts."""
        if not self.split:
            return [np.array(self.library.encode(t, add_special_tokens=False).ids, "u4") for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        short = []
        for i, text in enumerate(texts):
            if self.specials and self.specials.search(text):
                parts = [np.array([self.special[p]], "u4") if p in self.special else self._long(p) for p in self.specials.split(text) if p]
                out[i] = np.concatenate([*parts, np.zeros(0, "u4")])
            elif len(text) > PART_CHARS:
                out[i] = self._long(text)
            else:
                short.append(i)
        if short:
            for i, ids in zip(short, self._encoded([texts[i] for i in short]), strict=True):
                out[i] = ids
        return out


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """The encoder of a vocabulary file's text, kept for the next task of this process."""
    return Encoder(vocabulary)
