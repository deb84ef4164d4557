"""Packing of token sequences into windows: non-negative least squares over length combinations."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter, defaultdict, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundq.llm.shared import written
from groundq.llm.texts import give_back, text_blocks
from groundq.llm.tokens import encoder
from groundq.shipping import ship

#: Lengths that triples are built on: the most frequent ones.
TRIPLE_LENGTHS = 48
#: Whole windows are numbered from here on, by the task that read them; planned sequences from 0.
WINDOWS = 1 << 40
#: Rows (task, length) of the table of ranks that may be broadcast, at most: some 20 MB.
RANKS = 1 << 19


def combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) of lengths in use that fill the window: pairs (c = 0), and triples whose first two are among the most frequent."""
    used = counts > 0
    a = np.flatnonzero(used[: window // 2 + 1])
    a = a[a > 0]
    pairs = a[used[window - a]]
    rows = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], axis=1)]
    top = np.argsort(-counts, kind="stable")[:TRIPLE_LENGTHS]
    top = top[(counts[top] > 0) & (top > 0)]
    x, y = np.meshgrid(top, np.flatnonzero(used)[np.flatnonzero(used) > 0], indexing="ij")
    z = window - x - y
    good = (z >= 1) & used[np.clip(z, 0, window)]
    triples = np.unique(np.sort(np.stack([x[good], y[good], z[good]], axis=1), axis=1), axis=0)
    return np.concatenate([*rows, triples]).astype(int)


def solve_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: repeats whose lengths come closest to the counts."""
    size, x = len(counts), np.zeros(len(patterns))
    if not len(patterns):
        return x
    real = (patterns > 0).astype(float)
    use = lambda v: np.bincount(patterns.ravel(), (real * v[:, None]).ravel(), size)
    target = counts.astype(float)
    v = np.ones(len(patterns))
    for _ in range(12):  # the largest eigenvalue, for the step
        u = use(v)
        v = (u[patterns] * real).sum(axis=1)
        norm = np.linalg.norm(v)
        v /= norm
    y, t = x, 1.0
    for _ in range(rounds):
        rest = use(y) - target
        new = np.maximum(0, y - (rest[patterns] * real).sum(axis=1) / (1.1 * norm))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


@dataclass
class Plan:
    """Where each piece goes. Pieces of one length are told apart by their rank, from 0 on.

    runs: for (length, begin) runs of ranks as (first rank, end, sequence, offset), ordered by rank: of the piece of rank r the tokens from
    begin to end stand at the offset of the sequence + r - first rank. patterned: how many sequences, the first ones, come from patterns.
    """

    window: int
    runs: dict[tuple[int, int], list[tuple[int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    sequences: int = 0
    patterned: int = 0

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(begin, end, sequence, offset) of the parts of one piece."""
        out, begin = [], 0
        while begin < length:
            runs = self.runs[length, begin]
            first, end, sequence, offset = runs[bisect_right(runs, (rank, 1 << 62)) - 1]
            out.append((begin, end, sequence + rank - first, offset))
            begin = end
        return out


def plan(counts: np.ndarray, window: int) -> Plan:
    """Sequences for a histogram of piece lengths, each below the window: all but the last few are exactly full.

    Repeats of the patterns that fill a window are rounded down, then up by falling fraction as far as pieces are left. What is left is
    packed greedily: the longest that fits, and where none fits the shortest is cut; a sequence that can be repeated is planned once. The
    last sequences have lengths that are powers of two. The work depends on the number of lengths, hardly on the number of pieces.
    """
    out, left = Plan(window), np.array(counts, "i8")
    left[0] = 0
    # what is left of each length, as runs of ranks of an original length with what was cut off before: (length, first, end, begin)
    pools: dict[int, deque] = {int(n): deque([(int(n), 0, int(left[n]), 0)]) for n in np.flatnonzero(left)}

    def place(members: list[tuple[int, int]], times: int) -> None:
        """Takes `times` sequences of the members (length, how much of it)."""
        offset = 0
        for length, used in members:
            need, sequence = times, out.sequences
            while need:
                own, first, end, begin = pools[length][0]
                taken = min(need, end - first)
                out.runs[own, begin].append((first, begin + used, sequence, offset))
                if used < length:
                    pools.setdefault(length - used, deque()).append((own, first, first + taken, begin + used))
                    left[length - used] += taken
                if first + taken < end:
                    pools[length][0] = (own, first + taken, end, begin)
                else:
                    pools[length].popleft()
                need, sequence = need - taken, sequence + taken
            left[length] -= times
            offset += used
        out.sequences += times

    patterns = combinations(left, window)
    repeats = solve_repeats(patterns, left)
    whole = np.floor(repeats + 1e-6).astype("i8")
    fraction = repeats - whole
    for order, most in ((np.argsort(-whole, kind="stable"), whole), (np.argsort(-fraction, kind="stable"), (fraction > 1e-3).astype("i8"))):
        for p in order:
            if not most[p]:
                break
            lengths = [int(n) for n in patterns[p] if n]
            times = min(int(most[p]), *(int(left[n]) // lengths.count(n) for n in lengths))
            if times:
                place([(n, n) for n in lengths], times)
    out.patterned = out.sequences

    available = [int(n) for n in np.flatnonzero(left)]  # ascending

    def fill(size: int, least: int) -> None:
        """A sequence of this size as often as its lengths allow, `least` times or more: lengths with fewer pieces wait."""
        space, members, used = size, [], Counter()
        top = bisect_right(available, space) - 1
        while space:
            while top >= 0 and (available[top] > space or left[available[top]] // least <= used[available[top]]):
                top -= 1
            if top >= 0:
                n = available[top]
                k = min(space // n, int(left[n]) // least - used[n])
                members += [(n, n)] * k
                used[n] += k
                space -= n * k
            else:  # the shortest that is left is longer than the space
                n = next(n for n in available if left[n] // least > used[n])
                members.append((n, space))
                used[n] += 1
                space = 0
        place(members, min(int(left[n]) // m for n, m in used.items()) if size == window else 1)
        for n in {length for length, _ in members} | {length - part for length, part in members if part < length}:
            at = bisect_right(available, n) - 1
            listed = at >= 0 and available[at] == n
            if left[n] and not listed:
                insort(available, n)
            elif not left[n] and listed:
                available.pop(at)

    total = int((left * np.arange(len(left))).sum())
    while total >= window:
        before = out.sequences
        # so many times that the rest halves within some hundred steps, and few enough that the pieces at hand always fill a window
        fill(window, max(1, total // window // window))
        total -= (out.sequences - before) * window
    bit = 1 << window.bit_length()
    while total:
        bit //= 2
        if total >= bit:
            fill(bit, 1)
            total -= bit
    for runs in out.runs.values():
        runs.sort()
    return out


def _encoded(docs: DataFrame, id: str, text: str, vocabulary: str, window: int, end: int) -> DataFrame:
    """Ids of every document, with the length of what is left after whole windows (tail) and its number among those of the task (place)."""
    with open(vocabulary, encoding="utf-8") as f:  # on the driver; executors get the content
        content = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # the vocabulary file, a few MB
    schema = f"key {dict(docs.dtypes)[id]}, n long, tail int, part int, place long, windows long, ids binary, wide boolean"

    def encode(batches):
        encode_texts = encoder(shared.value)
        part, seen, windows = TaskContext.get().partitionId(), np.zeros(window, "i8"), 0
        for batch in batches:
            for lo, hi, texts in text_blocks(batch.column("text")):
                rows = []
                for ids in encode_texts.encode(texts):
                    n, wide = len(ids) + 1, bool(len(ids) and ids.max() > 65535 or end > 65535)
                    tail = n % window
                    rows.append((n, tail, part, int(seen[tail]), windows, np.append(ids, end).astype("<u4" if wide else "<u2").tobytes(), wide))
                    seen[tail] += 1
                    windows += n // window
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), *arrays], ["key", "n", "tail", "part", "place", "windows", "ids", "wide"])

    return docs.select(F.col(id).alias("key"), F.col(text).alias("text")).mapInArrow(encode, schema)


def pack_documents(docs: DataFrame, *, id: str, text: str, vocabulary: str, window: int = 1024, end: int = 0) -> DataFrame:
    """Every token of every document, in pieces of sequences of at most `window` tokens without padding.

    A document's ids are those of its whole text (null: empty) by the vocabulary file and the tokenizers library, then `end`. Whole windows
    of long documents are sequences of their own. The remainders of all documents are planned at once, against the histogram of their
    lengths, which is all that reaches the driver (fewer than `window` counts): `combinations` enumerates pairs and triples that fill the
    window, `solve_repeats` finds how often to use each by non-negative least squares, `plan` rounds and packs what is left greedily,
    cutting where nothing fits. The very last sequences of the table have lengths that are powers of two.

    A remainder finds its place in the plan by its length and its rank among those of that length. Ranks are numbers within the task that
    encoded it, plus what earlier tasks have of that length: a small table (task, length) which is broadcast up to RANKS rows and, where it is larger,
    joined by a shuffle. Ids are written once to the shared folder; nothing else is shuffled, whatever the number of tasks.

    Rows that repeat are packed as often as they come; null ids are kept. Other columns are dropped, so clashing names do no harm. An
    empty table gives an empty result. Memory is bounded by a block of texts or one document. Result: id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset, kind (window, pattern or greedy: what made the sequence).
    """
    ship(docs.sparkSession)
    encoded = written(_encoded(docs, id, text, vocabulary, window, end), "token-ids")
    counts = np.zeros(window, "i8")
    tails = encoded.where("tail > 0").select("part", "tail")  # two small columns of what was written
    for r in tails.groupBy("tail").agg(F.count("*").alias("n")).collect():
        counts[r.tail] = r.n
    planned = plan(counts, window)
    shared = docs.sparkSession.sparkContext.broadcast(planned)  # bounded by the number of lengths, not by that of documents
    earlier = F.sum("n").over(W.partitionBy("tail").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = tails.groupBy("part", "tail").agg(F.count("*").alias("n")).select("part", "tail", F.coalesce(earlier, F.lit(0)).alias("before"))
    if np.count_nonzero(counts) * tails.agg(F.countDistinct("part")).first()[0] <= RANKS:
        offsets = F.broadcast(offsets)

    def cut(batches):
        own = shared.value
        encoder.cache_clear()  # this process may have encoded before; pieces need no vocabulary
        give_back()
        for batch in batches:
            out, keys = [], []
            for i in range(batch.num_rows):
                n, tail, part, place, windows, wide, before = (batch.column(c)[i].as_py() for c in ("n", "tail", "part", "place", "windows", "wide", "before"))
                ids = np.frombuffer(batch.column("ids")[i].as_py(), "<u4" if wide else "<u2").astype("<u4")
                whole = n - tail
                rows = [(at, at + window, WINDOWS * (part + 1) + windows + k, 0, "window") for k, at in enumerate(range(0, whole, window))]
                if tail:
                    rows += [(whole + a, whole + b, s, o, "pattern" if s < own.patterned else "greedy") for a, b, s, o in own.pieces(tail, place + before)]
                keys += [i] * len(rows)
                out += [(a, b - a, ids[a:b].tobytes(), n, s, o, kind) for a, b, s, o, kind in rows]
                if len(out) >= 4096:
                    yield piece_batch(batch, keys, out)
                    out, keys = [], []
            if out:
                yield piece_batch(batch, keys, out)
            give_back()

    def piece_batch(batch, keys, out):
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys)), *arrays], ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "kind"])

    schema = f"key {dict(docs.dtypes)[id]}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, kind string"
    ranked = encoded.join(offsets, ["part", "tail"], "left").select("key", "n", "tail", "part", "place", "windows", "ids", "wide", F.coalesce("before", F.lit(0)).alias("before"))
    return ranked.mapInArrow(cut, schema).withColumnRenamed("key", id)
