"""N-gram Jaccard join of texts: chosen-path splits of sets on sampled shared tokens."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundq.llm.candidates import ROWS, STARS, candidate_rows, chunked, gathered, meetings, seen_before, stars
from groundq.llm.components import connected_components, named_by_least
from groundq.llm.shared import dropped, joined, written
from groundq.llm.streams import runs
from groundq.llm.texts import BASE, Words, give_back, mixed, text_blocks
from groundq.shipping import ship

#: MinHash tokens of a set; the paths choose among them.
TOKENS = 64
#: Tokens that a set chooses at each split, on average.
BRANCHES = 2.5
#: Buckets of so many sets are compared without another split.
SMALL = 256
#: Splits of one run; what is still together then, or did not shrink, is compared.
DEPTH = 6
#: Rows that a task compares with each other; larger buckets are compared chunk by chunk.
CHUNK = 512

_MULTIPLIERS = mixed(np.arange(1, TOKENS + 1, dtype="u8") * np.uint64(BASE)) | np.uint64(1)


def sketches(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """(n, TOKENS) MinHash values of the shingles of n texts, in the order of the texts; each text has a shingle."""
    starts = np.searchsorted(doc, np.arange(n))
    out = np.empty((n, TOKENS), "u4")
    for k, m in enumerate(_MULTIPLIERS):
        out[:, k] = np.minimum.reduceat((hashes * m) >> np.uint64(32), starts)
    return out


def chosen(sketch: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path): the tokens of each row that its path chooses, by a hash of path and token."""
    token = mixed(sketch.astype("u8") + (np.arange(TOKENS, dtype="u8") << np.uint64(32)))
    least = np.uint64(int(min(1.0, BRANCHES / TOKENS) * (2**64 - 1)))
    row, at = np.nonzero(mixed(token ^ mixed(path)[:, None]) < least)
    return row, mixed(path[row] * np.uint64(BASE) + token[row, at])


def runs_for(recall: float, jaccard: float) -> int:
    """How many runs find a pair of this similarity with the given probability, each choosing anew down to the last split."""
    alive = 1.0
    for _ in range(DEPTH):
        alive = 1 - math.exp(-BRANCHES * jaccard * alive)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


def _unpacked(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def common_sizes(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements the sets i and j, each ascending, share. Many pairs are counted by products, few of them one by one."""
    if len(i) * 16 < len(sets) ** 2:
        out = np.empty(len(i), "i8")
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            both = np.sort(np.concatenate([sets[a], sets[b]]))
            out[k] = np.count_nonzero(both[1:] == both[:-1])
        return out
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, held = np.unique(values, return_inverse=True, return_counts=True)
    shared = held[place] > 1
    order = np.argsort(place[shared], kind="stable")
    owner, place = owner[shared][order], place[shared][order]
    common, lo = np.zeros((len(sets), len(sets))), 0
    while lo < len(place):  # some thousand elements at a time, those of one value together
        hi = np.searchsorted(place, place[lo] + 4096)
        names, column_at = np.unique(place[lo:hi], return_inverse=True)
        holds = np.zeros((len(sets), len(names)), "f4")
        holds[owner[lo:hi], column_at] = 1
        common += holds @ holds.T
        lo = hi
    return common[i, j].round().astype("i8")


def _sketched(texts: DataFrame, width: int) -> DataFrame:
    """(id, key, size, sketch) of every text with words: a digest of its shingle set, how many shingles it has, and their MinHash values."""

    def sketched(batches):
        for batch in batches:
            for lo, _, content in text_blocks(batch.column("text")):
                doc, hashes = Words(content).shingles(width)
                has, doc = np.unique(doc, return_inverse=True)
                if not len(has):
                    continue
                ends = np.searchsorted(doc, np.arange(len(has) + 1))
                sets = [np.unique(hashes[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                packed = [s.tobytes() for s in sketches(doc, hashes, len(has))]
                ids = batch.column("id").take(pa.array(has + lo))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), sizes, pa.array(packed, pa.binary())], ["id", "key", "size", "sketch"])

    return texts.mapInArrow(sketched, "id long, key binary, size long, sketch binary")


def _buckets(sets: DataFrame, times: int) -> DataFrame:
    """(path, rep, n) of the buckets that are to be compared, n their size: split on chosen tokens until they are small or do not shrink."""

    def first_paths(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = _unpacked(batch.column("sketch"), "u4")
            for run in range(times):
                row, path = chosen(sketch, np.full(len(sketch), run + 1, "u8"))
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(row)), pa.array(path.view("i8")), pa.array(np.full(len(row), -1, "i8"))], ["rep", "path", "above"])

    def next_paths(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row, path = chosen(_unpacked(batch.column("sketch"), "u4"), batch.column("path").to_numpy().view("u8"))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(at), pa.array(path.view("i8")), batch.column("n").take(at)], ["rep", "path", "above"])

    level = "rep long, path long, above long"
    at, ready, tables = sets.select("rep", "sketch").mapInArrow(first_paths, level), [], []
    for depth in range(1, DEPTH + 1):
        at = written(at, "paths")
        sizes = at.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        met = written(joined(at, sizes, "path", "n", at.count(), SMALL), "buckets")
        dropped(at)
        tables.append(met)
        done = (F.col("n") <= SMALL) | ((F.col("above") > 0) & (F.col("n") * 2 > F.col("above"))) | F.lit(depth == DEPTH)
        ready.append(met.where(done).select("path", "rep", "n"))
        going = met.where(~done)
        if going.isEmpty():
            break
        at = going.select("path", "rep", "n").join(sets.select("rep", "sketch"), "rep").mapInArrow(next_paths, level)
    together = ready[0]
    for more in ready[1:]:
        together = together.union(more)
    out = written(together, "ready-buckets")
    dropped(*tables)
    return out


def candidates_of(sets: DataFrame, jaccard: float, recall: float) -> DataFrame:
    """Rows of candidates.ROWS for sets (rep, size, sketch) that share a bucket, whose sketches agree and whose sizes allow the similarity.

    A pair is a candidate only in the smallest bucket that it shares, so it is compared exactly once.
    """
    ready = _buckets(sets, runs_for(recall, jaccard))
    own = ready.groupBy("rep").agg(F.collect_list(F.struct("path", "n")).alias("own"))  # a few dozen buckets a set
    # half of each token's bits tell tokens apart well enough: what agrees by chance is found out later
    short = F.unhex(F.regexp_replace(F.hex("sketch"), "(....)....", "$1"))
    placed = own.join(sets.select("rep", "size", short.alias("sketch")), "rep")
    placed = placed.select("rep", "size", "sketch", F.sort_array("own.path").alias("paths"), F.inline("own"))
    tasks = chunked(placed, CHUNK).repartition("path", "lo", "hi").sortWithinPartitions("path", "lo", "hi", "rep")
    agree = math.floor(TOKENS * jaccard - 5 * math.sqrt(TOKENS * jaccard * (1 - jaccard)))

    def alike(batches):
        for block, starts in runs(batches, ("path", "lo", "hi")):
            sketch, size = _unpacked(block.column("sketch"), "u2"), block.column("size").to_numpy()
            paths, counts = block.column("paths").flatten().to_numpy(), block.column("paths").value_lengths().to_numpy()
            ends, names = np.cumsum(counts), block.column("path").to_numpy()

            def pairs_of(a, b, same, sketch=sketch, size=size, paths=paths, counts=counts, ends=ends, names=names):
                s, n = sketch[a:b], size[a:b].astype("f8")

                def meets(rows, columns):
                    equal = np.zeros((len(n[rows]), len(n[columns])), "u1")
                    for k in range(TOKENS):
                        equal += s[rows, k][:, None] == s[columns, k]
                    low, high = np.minimum(n[rows][:, None], n[columns]), np.maximum(n[rows][:, None], n[columns])
                    return (equal >= agree) & (low >= jaccard * high - 1e-9)

                i, j = meetings(same, meets)
                if len(i):
                    touched, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                    seen = seen_before([paths[ends[a + t] - counts[a + t] : ends[a + t]] for t in touched], names[a])
                    new = ~seen[at[: len(i)], at[len(i) :]]
                    i, j = i[new], j[new]
                return i, j

            if (out := candidate_rows(block, starts, "path", pairs_of, size * 8)) is not None:
                yield out
        give_back()

    out = written(tasks.mapInArrow(alike, ROWS), "text-candidates")
    dropped(ready)
    return out


def near_duplicate_texts(docs: DataFrame, *, id: str, text: str, width: int = 5, jaccard: float = 0.8, recall: float = 0.995) -> DataFrame:
    """Texts whose sets of `width`-word shingles have a Jaccard similarity of `jaccard` or more: links counted, and components.

    Words are those of texts.Words; a text of fewer words has one shingle of them all, a text without words has none and links with
    nothing, as does a null text. Texts of one shingle set form a class, which its smallest id represents with a weight.

    Candidates: each set is embedded as TOKENS MinHash tokens. In each run a bucket of sets is split on tokens that a hash of the path and
    the token chooses, about BRANCHES of each set's, so that sets that share a chosen token go on together. Buckets of at most SMALL
    sets, those that a split left over half as large as they were, and those at DEPTH are compared by their sketches, chunk against chunk; the
    runs are as many as the recall asks (runs_for). Pairs whose sketches agree to `jaccard` less five standard deviations, and whose
    sizes allow it, are candidates, each in the smallest bucket that it shares. Then the whole shingle sets of a bucket's candidates come
    in and every candidate pair is compared exactly, once: no pairs are written, a task returns each set's links and one edge. No
    bucket, group or partner is capped, and texts that are linked only through others are never compared with each other.

    Rows that repeat an id and a set count as one text; an id with several texts gets the sum of their links and the smallest component.
    Rows with a null id come back with no links and a null component. Other columns are dropped, so clashing names do no harm. An empty
    table gives an empty result. Result: id, n_links (other texts linked, copies included), component_id (the smallest id that links lead
    to), kept (the id is its component's), class_id (the smallest id of the same set; its own for a text that links with nothing).
    """
    ship(docs.sparkSession)
    given = docs.select(F.col(id).cast("long").alias("id"))
    texts = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    units = written(_sketched(texts, width), "shingle-sketches")
    known = units.select("id", "key").distinct()
    classes = known.groupBy("key").agg(F.min("id").alias("least_id"), F.count("*").alias("weight"))
    # one row of each set's equal sketches, with a number of its own that is kept with the table
    sets = units.groupBy("key").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch")).join(classes, "key")
    sets = written(sets.withColumn("rep", F.monotonically_increasing_id()), "shingle-sets")
    candidates = candidates_of(sets, jaccard, recall)

    def whole(batches):
        for batch in batches:
            for lo, hi, content in text_blocks(batch.column("text")):
                doc, hashes = Words(content).shingles(width)
                ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                packed = [np.unique(hashes[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in packed]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in packed], pa.binary())], ["key", "shingles"])

    members = written(candidates.select("rep").distinct().join(sets.select("rep", "least_id", "key", "weight"), "rep"), "candidate-sets")
    own = members.select(F.col("least_id").alias("id")).distinct()
    found = texts.join(own, "id", "left_semi").mapInArrow(whole, "key binary, shingles binary").dropDuplicates(["key"])
    found = written(found.join(members, "key").select("rep", "weight", "shingles"), "whole-sets")

    def exact(batches):
        def linked(part, i, j):
            sets = [np.frombuffer(s, "u8") for s in part.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            common = common_sizes(sets, i, j)
            return common >= jaccard * (size[i] + size[j] - common) - 1e-9

        yield from stars(batches, linked)

    links = written(gathered(candidates, found).mapInArrow(exact, STARS), "set-links")
    dropped(found, members, candidates)
    named = named_by_least(connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))), sets)
    sums = links.groupBy("rep").agg(F.sum("links").alias("links"))
    per_set = sets.select("key", "rep", "least_id", "weight").join(sums, "rep", "left").join(named, "rep", "left")
    per_set = per_set.select("key", "weight", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("c", "least_id").alias("c"))
    each = joined(known, per_set, "key", "weight", units.count())
    per_id = each.groupBy("id").agg(F.sum("n").alias("n"), F.min("c").alias("c"), F.min("least_id").alias("k"))
    kept = F.coalesce("c", "id").eqNullSafe(F.col("id")) & F.col("id").isNotNull()
    return given.join(per_id, "id", "left").select(
        F.col("id").alias(id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"), kept.alias("kept"), F.coalesce("k", "id").alias("class_id")
    )


def keep_one(docs: DataFrame, *, id: str, text: str, **how) -> DataFrame:
    """The rows of docs, all columns, without those whose near-duplicate group keeps another id, and without repeated (id, text) rows.

    Rows with a null id, a null text or no words link with nothing and stay; of repeated ones with an id, one stays: that whose other
    columns come first as JSON. Columns may have any names: each row travels under a single one.
    """
    found = near_duplicate_texts(docs, id=id, text=text, **how)
    decided = found.groupBy(F.col(id).alias("id")).agg(F.bool_or("kept").alias("kept"), (F.count("*") > 1).alias("again")).where("id IS NOT NULL AND (NOT kept OR again)")
    rows = docs.select(F.struct("*").alias("row"))
    joined_rows = rows.join(written(decided, "decisions"), rows["row"][id] == F.col("id"), "left").where(F.coalesce("kept", F.lit(True)))
    again = F.coalesce("again", F.lit(False))
    once = joined_rows.where(again).groupBy("id", F.col("row")[text].alias("text")).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return joined_rows.where(~again).select("row.*").unionByName(once.select("row.*"))
