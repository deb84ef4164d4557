"""Words of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from groundq.llm.shared import written

#: Fixed odd multiplier of the polynomial hashes, modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are joined up to so many bytes.
BLOCK_BYTES = 1 << 19

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library than glibc
    _trim = None

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_powers = {BASE: np.ones(1, "u8"), INVERSE: np.ones(1, "u8")}
#: Powers of more places than this are forgotten once their block is done.
POWERS_KEPT = 1 << 20


def give_back() -> None:
    """Returns freed memory to the system, which a worker that lives on for the next stage would otherwise hold beside the JVM."""
    for base, table in _powers.items():
        if len(table) > POWERS_KEPT:
            _powers[base] = np.ones(1, "u8")
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        out = np.full(max(n, 1 << 16), base, "u8")
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hash(word: str) -> int:
    """The hash that `Words` gives this word (lower-cased A-Z)."""
    return int(Words([word]).hashes[0])


@dataclass
class Words:
    """Words of a block of texts: runs of ASCII letters and digits and of all non-ASCII bytes, with A-Z lower-cased for the hash.

    raw: the bytes, a line feed after each text; starts, ends: of each word; hashes: 64-bit, of the lower-cased bytes; doc: the text's
    number; first: the number of each text's first word, and the end; bounds: of each text in raw, without its line feed.
    """

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(p) for p in parts], "i8")
        self.raw = np.frombuffer(b"\n".join(parts) + b"\n", "u1")
        stops = np.cumsum(sizes + 1) - 1
        self.bounds = np.stack([stops - sizes, stops], axis=1)
        is_word = _WORD[self.raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], is_word.view("i1"), [0]])))
        self.starts, self.ends = edges[0::2], edges[1::2]
        low = np.where(is_word, _LOWER[self.raw], 0).astype("u8") + np.uint64(1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(low * powers(BASE, len(low)))])
        self.hashes = mixed((sums[self.ends] - sums[self.starts]) * powers(INVERSE, len(low) + 1)[self.starts] + (self.ends - self.starts).astype("u8"))
        self.first = np.searchsorted(self.starts, np.concatenate([self.bounds[:, 0], [len(self.raw)]]))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.sums = sums

    def prefix_hashes(self, length: int) -> np.ndarray:
        """Hashes of the first `length` bytes of each word, or of the whole word if it is shorter."""
        ends = np.minimum(self.starts + length, self.ends)
        return mixed((self.sums[ends] - self.sums[self.starts]) * powers(INVERSE, len(self.raw) + 1)[self.starts] + np.uint64(length) * np.uint64(1 << 32))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of word values over each text."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.first])

    def bytes_per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of byte values over each text."""
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[self.bounds[:, 1]] - sums[self.bounds[:, 0]]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each run of `width` words; a text with fewer words has one, of all its words."""
        n = len(self.hashes)
        out = np.zeros(max(n - width + 1, 0), "u8")
        for k in range(width):
            out = out * np.uint64(BASE) + self.hashes[k : k + len(out)]
        whole = self.doc[: len(out)] == self.doc[width - 1 : width - 1 + len(out)] if len(out) else np.zeros(0, bool)
        doc, hashes = self.doc[: len(out)][whole], mixed(out[whole])
        counts = np.diff(self.first)
        few = np.flatnonzero((counts > 0) & (counts < width))
        if len(few):
            own = []
            for d in few:
                h = np.uint64(len(self.hashes[self.first[d] : self.first[d + 1]]))
                for w in self.hashes[self.first[d] : self.first[d + 1]]:
                    h = np.uint64((int(h) * BASE + int(w)) & 0xFFFFFFFFFFFFFFFF)
                own.append(h)
            doc = np.concatenate([doc, few])
            hashes = np.concatenate([hashes, mixed(np.array(own, "u8"))])
            order = np.argsort(doc, kind="stable")
            doc, hashes = doc[order], hashes[order]
        return doc, hashes


def text_blocks(column: pa.Array):
    """(first, end, texts) of runs of an Arrow column, about BLOCK_BYTES each or one long text; null as empty. Only a run is unpacked."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("i8"))
    start = 0
    while start < len(column):
        before = sizes[start - 1] if start else 0
        end = min(max(int(np.searchsorted(sizes, before + BLOCK_BYTES)) + 1, start + 1), len(column))
        yield start, end, [t or "" for t in column.slice(start, end - start).to_pylist()]
        start = end
    give_back()


def bounded_texts(rows, most: int) -> list:
    """The rows (id, text, ...; one an id) in order of the hash of their ids, on the driver, as far as their texts have `most` bytes together."""
    first = written(rows, "training-texts").withColumn("_order", F.xxhash64("id"))
    sizes = first.select("_order", "id", F.octet_length("text").alias("n")).orderBy("_order", "id").collect()  # as many as the caller chose ids
    total, last = 0, -1
    for at, r in enumerate(sizes):
        total += r.n
        if total > most and at:
            break
        last = at
    if last < 0:
        return []
    end = sizes[last]
    upto = (F.col("_order") < end._order) | (F.col("_order") == end._order) & (F.col("id") <= F.lit(end.id))
    return first.where(upto).orderBy("_order", "id").drop("_order").collect()


def text_within(text: str, kept: dict[str, str]) -> tuple[str, str]:
    """(column, field) to read a text from: the column "text", or, for the name "key.field", that field of a key that is sent anyway."""
    key, _, field = text.partition(".")
    return (kept[key], field) if field and key in kept else ("text", "")


def blocks(texts: list[str | None]):
    """(first, end) of runs of texts that together have about BLOCK_BYTES bytes, or are one long text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BLOCK_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
