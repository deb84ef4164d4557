"""Candidate links: who may be linked with whom, found by group and compared exactly later, without a row for each pair.

A group (the members of a bucket or a filter) is dealt into chunks, and every two chunks meet in one task. A task that finds candidates
returns a row for each member that has any: its place among them and, as bits, the places after it that it may be linked with. Parts of a
task are bounded by bytes. The exact comparison joins the members' data to these rows, each member once a part, and looks at nothing but
the marked pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundq.llm.components import roots
from groundq.llm.streams import runs
from groundq.llm.texts import give_back

ROWS = "key long, lo int, hi int, part int, place int, rep long, mates binary"
STARS = "rep long, links long, root long"
#: Data that the members of one part bring along, at most, but for two members that are larger.
PART_BYTES = 1 << 25


def chunked(members: DataFrame, chunk: int) -> DataFrame:
    """Each member (rep) once for every pair of chunks of its group (of n members) that its own belongs to: columns chunk, lo and hi."""
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    dealt = members.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return dealt.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("n", "other")


def meetings(same: np.ndarray, meets: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i before j, that meet: within the one chunk, or across the two. meets(rows, columns) gives their matrix."""
    if same.all():
        out = []
        for lo in range(0, len(same), 1024):
            i, j = np.nonzero(meets(slice(lo, lo + 1024), slice(lo, None)))
            out.append((i[i < j] + lo, j[i < j] + lo))
        return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])
    left, right = np.flatnonzero(~same), np.flatnonzero(same)
    i, j = np.nonzero(meets(left, right))
    return np.minimum(left[i], right[j]), np.maximum(left[i], right[j])


def seen_before(lists: list[np.ndarray], this: int) -> np.ndarray:
    """(member, member): whether the two share a name before `this`. Each list of names ascends."""
    early = [names[: np.searchsorted(names, this)] for names in lists]
    distinct, at = np.unique(np.concatenate(early), return_inverse=True)
    owner = np.repeat(np.arange(len(early)), [len(e) for e in early])
    seen = np.zeros((len(early), len(early)), bool)
    for lo in range(0, len(distinct), 4096):
        some = (at >= lo) & (at < lo + 4096)
        holds = np.zeros((len(early), min(4096, len(distinct) - lo)), "f4")
        holds[owner[some], at[some] - lo] = 1
        seen |= holds @ holds.T > 0
    return seen


def _parts(i: np.ndarray, j: np.ndarray, size: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(members, i, j among them): all at once if their data are small, else block against block of members of like size."""
    members, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    if size is None or size[members].sum() <= PART_BYTES:
        yield members, i, j
        return
    order = np.argsort(size[members], kind="stable")
    block = np.empty(len(members), "i8")
    block[order] = (np.cumsum(size[members][order]) - 1) // (PART_BYTES // 2)
    pair = np.stack([np.minimum(block[i], block[j]), np.maximum(block[i], block[j])], axis=1)
    for low, high in np.unique(pair, axis=0):
        some = (pair[:, 0] == low) & (pair[:, 1] == high)
        own, at = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
        yield members[own], at[: some.sum()], at[some.sum() :]


def candidate_rows(block: pa.RecordBatch, starts: np.ndarray, key: str, pairs_of: Callable, size: np.ndarray | None = None) -> pa.RecordBatch | None:
    """Rows of ROWS for the groups of a block. pairs_of(a, b, same): places (i, j), i before j, of the candidates among rows a to b."""
    keys, los, highs, reps, chunks = (block.column(c).to_numpy() for c in (key, "lo", "hi", "rep", "chunk"))
    out = [[] for _ in range(7)]
    for a, b in zip(starts, starts[1:], strict=False):
        if b - a < 2:
            continue
        i, j = pairs_of(a, b, chunks[a:b] == highs[a])
        other = reps[a + i] != reps[a + j]
        i, j = i[other], j[other]
        if not len(i):
            continue
        for part, (members, x, y) in enumerate(_parts(i, j, None if size is None else size[a:b])):
            m = len(members)
            bits = np.zeros((m, m), bool)
            bits[np.minimum(x, y), np.maximum(x, y)] = True
            row = (np.full(m, keys[a]), np.full(m, los[a]), np.full(m, highs[a]), np.full(m, part), np.arange(m), reps[a + members])
            for column, values in zip(out, row, strict=False):
                column.append(values)
            out[6] += [mates.tobytes() for mates in np.packbits(bits, axis=1)]
    if not out[6]:
        return None
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    arrays = [pa.array(np.concatenate(c), t) for c, t in zip(out, types, strict=False)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(out[6], pa.binary())], ["key", "lo", "hi", "part", "place", "rep", "mates"])


def gathered(candidates: DataFrame, data: DataFrame) -> DataFrame:
    """Candidates with their members' data (rep, weight, ...), the rows of a part together and in order."""
    return candidates.join(data, "rep").repartition("key", "lo", "hi", "part").sortWithinPartitions("key", "lo", "hi", "part", "place")


def stars(batches: Iterator[pa.RecordBatch], linked: Callable) -> Iterator[pa.RecordBatch]:
    """For each part: members with links, the sum of their partners' weights, and the first member that links lead to.

    linked(rows, i, j): whether the marked pairs (i, j) of the part's rows, a RecordBatch, are links that count here.
    """
    for block, starts in runs(batches, ("key", "lo", "hi", "part")):
        reps, weights, mates = block.column("rep").to_numpy(), block.column("weight").to_numpy(), block.column("mates")
        out = []
        for a, b in zip(starts, starts[1:], strict=False):
            bits = np.frombuffer(b"".join(mates.slice(a, b - a).to_pylist()), "u1").reshape(b - a, -1)
            i, j = np.nonzero(np.unpackbits(bits, axis=1)[:, : b - a])
            good = linked(block.slice(a, b - a), i, j)
            i, j = i[good], j[good]
            if len(i):
                touched, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                i, j = at[: len(i)], at[len(i) :]
                weight, links = weights[a:b][touched], np.zeros(len(touched), "i8")
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                rep = reps[a:b][touched]
                out.append((rep, links, rep[roots(len(touched), i, j)]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["rep", "links", "root"])
    give_back()
