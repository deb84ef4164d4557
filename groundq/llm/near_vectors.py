"""Near-duplicate embeddings: spherical-cap filters from random product codes."""

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
from groundq.llm.vectors import common_length, usable
from groundq.shipping import ship

#: Rows of a filter that one task compares with each other; larger filters are compared chunk by chunk.
CHUNK = 1024
#: Random pairs of the least cosine that a code's recall is measured on, and the codes beyond which the recall counts as out of reach.
PAIRS, MOST_CODES = 4000, 256
#: Signs of random projections that stand for a vector until it is compared exactly.
SIGNS = 128


def cap_height(dims: int, rate: float) -> float:
    """The height of the cap that holds this share of the unit sphere."""
    t = np.linspace(-1, 1, 200_001)
    density = np.exp((dims - 3) / 2 * np.log1p(-np.clip(t * t, 0, 1 - 1e-15))) if dims > 2 else np.ones_like(t)
    above = np.cumsum(density[::-1])[::-1]
    return float(t[np.searchsorted(-above, -rate * above[0])])


def _pairs(dims: int, cosine: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors of this cosine; of one dimension, where there are none, equal ones."""
    x = rng.standard_normal((PAIRS, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dims == 1:
        return x, x
    y = rng.standard_normal((PAIRS, dims))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * y / np.linalg.norm(y, axis=1, keepdims=True)


class CapCode:
    """Filter directions of a few codes: in each, all concatenations of one code word for each block of a randomly rotated space.

    A vector passes a filter if its inner product with the unit direction exceeds the height of a cap. Of vectors in general position each
    passes about `passes` filters of each code, and each filter is passed by about `bucket` of n vectors; that sets the height and the
    number of words. The higher the caps, the fewer pairs meet in one code: from `codes` on, codes are added until of random pairs of the
    given cosine a share of `recall` meets.
    """

    def __init__(self, dims: int, n: int, *, cosine: float = 0.9, recall: float = 0.96, codes: int = 4, passes: float = 1.0, bucket: float = 256.0, seed: int = 7):
        rng = np.random.default_rng(seed)
        rate = min(0.2, bucket / max(n, 1))
        self.threshold = cap_height(dims, rate)
        # two blocks meet more often than three at equal passes, for words that grow as the root of n (20,000 at two thousand million vectors)
        blocks = min(dims, 2 if passes / rate < 4e8 else 3)
        words = max(2, math.ceil((passes / rate) ** (1 / blocks)))
        self.cuts = np.linspace(0, dims, blocks + 1).round().astype(int)
        self.codes = []
        left, right = _pairs(dims, cosine, np.random.default_rng(seed + 1))
        apart = np.arange(len(left))
        while len(self.codes) < codes or len(apart) > (1 - recall) * len(left):
            if len(self.codes) >= max(codes, MOST_CODES):
                raise ValueError(f"{MOST_CODES} codes do not reach a recall of {recall} at cosine {cosine}, {dims} dimensions and {n} vectors")
            rotation, each = np.linalg.qr(rng.standard_normal((dims, dims)))[0], []
            for a, b in zip(self.cuts, self.cuts[1:], strict=False):
                code = rng.standard_normal((words, b - a))
                each.append(code / np.linalg.norm(code, axis=1, keepdims=True) * math.sqrt((b - a) / dims))
            self.codes.append((rotation, each))
            met = [self._meet(left[part], right[part]) for part in np.split(apart, range(512, len(apart), 512))]
            apart = apart[~np.concatenate(met)]

    def _meet(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each row of x shares a filter of the last code with that of y."""
        (i, f), (j, g) = self.decode(x, len(self.codes) - 1), self.decode(y, len(self.codes) - 1)
        both = np.intersect1d(np.rec.fromarrays([i, f]), np.rec.fromarrays([j, g]))
        return np.isin(np.arange(len(x)), both["f0"])

    def decode(self, x: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters, of the first code or a later one on, that each row exceeds: partial sums that the best remaining words cannot lift are given up."""
        out = []
        for number, (rotation, words) in list(enumerate(self.codes))[first:]:
            turned = x @ rotation
            scores = [turned[:, a:b] @ w.T for a, b, w in zip(self.cuts, self.cuts[1:], words, strict=False)]
            best = [s.max(axis=1) for s in scores]
            rows, filters, sums = np.arange(len(x)), np.full(len(x), number, "i8"), np.zeros(len(x))
            for k, s in enumerate(scores):
                rest = sum((b[rows] for b in best[k + 1 :]), np.zeros(len(rows)))
                alive, word = np.nonzero(s[rows] + (sums + rest)[:, None] >= self.threshold)
                filters, sums = filters[alive] * s.shape[1] + word, sums[alive] + s[rows[alive], word]
                rows = rows[alive]
            out.append((rows, filters))
        return np.concatenate([r for r, _ in out]), np.concatenate([f for _, f in out])


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square is lost or overflows."""
    x = x.astype("f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unpacked(column, kind: str) -> np.ndarray:
    return _units(np.stack([np.frombuffer(v, kind) for v in column]))


def sign_limit(cosine: float) -> int:
    """How many signs may differ in a pair of this cosine: the mean and four and a half standard deviations more."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(SIGNS * p + 4.5 * math.sqrt(SIGNS * p * (1 - p)))


def near_duplicate_vectors(rows: DataFrame, *, id: str, vector: str, cosine: float = 0.9, recall: float = 0.96, seed: int = 7, **code) -> DataFrame:
    """Links of cosine or more, as counts and components.

    Equal unit vectors become one representative with a weight. Each representative is list-decoded to all cap filters that it exceeds
    (CapCode, sized by the number of representatives, the cosine and the recall); filters are the join key. What joins is a
    representative's number and 128 signs of random projections. Within a filter, chunk against chunk of at most CHUNK rows, pairs whose
    signs differ in no more places than sign_limit are candidates; then the vectors of the members that have any come in, once a task, and exact
    cosines in double precision decide. A pair counts only in the smallest filter that it shares, so no pair counts twice, and
    no pairs are written: a task returns for each representative its links and one edge to its component within the task.

    A pair of the given cosine is found with a probability of about `recall`, whatever the number of vectors: codes are added until so many
    random pairs meet. Pairs of a higher cosine are found more often; none below it is linked.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: no links, their own component. So do vectors
    of another length than the table's most frequent one (of equally frequent ones the shortest). id must be a long. Rows with a null id come
    back as they are, with no links and a null component; rows that repeat an id and a vector count as one vector of that id, and each
    comes back. Rows with one id and different vectors share the sums of their links. Other columns are dropped, so clashing names do no
    harm. An empty table gives an empty result. Result: id, n_links, component_id, kept (the id is its component's).
    """
    spark = rows.sparkSession
    ship(spark)
    kind = "f4" if "float" in dict(rows.dtypes)[vector] else "f8"

    def unit_rows(packed: bool):
        def unit(batches):
            for batch in batches:
                for at, x in usable(batch.column("v")):
                    some = np.abs(x).max(axis=1) > 0
                    at, x = at[some], x[some]
                    keys = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in _units(x)] if len(x) else []
                    last = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()) if packed else pa.array(np.full(len(x), x.shape[1]), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(keys, pa.binary()), last], ["id", "key", "packed" if packed else "dims"])

        return unit

    given = rows.select(F.col(id).cast("long").alias("id"))
    some = rows.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    units = written(some.mapInArrow(unit_rows(False), "id long, key binary, dims int"), "unit-keys")
    dims = common_length(units, "dims")
    known = units.where(F.col("dims") == dims).select("id", "key").distinct()
    # the vector of copies, any of which has their unit vector; the sums combine before the shuffle
    vectors = some.where(F.size("v") == dims).mapInArrow(unit_rows(True), "id long, key binary, packed binary").groupBy("key").agg(F.min("packed").alias("packed"))
    groups = known.groupBy("key").agg(F.min("id").alias("least_id"), F.count("*").alias("weight")).join(vectors, "key")
    groups = written(groups.withColumn("rep", F.monotonically_increasing_id()), "vector-groups")  # a number of its own for each, kept with the table
    n = groups.count()
    if not n:
        return given.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    caps = CapCode(dims, n, cosine=cosine, recall=recall, seed=seed, **code)
    shared = spark.sparkContext.broadcast(caps)  # codes x words x dimensions; words grow as the root of n
    projections, differ = np.random.default_rng(seed + 2).standard_normal((dims, SIGNS)), sign_limit(cosine)

    def decoded(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpacked(batch.column("packed").to_pylist(), kind)
            for lo in range(0, len(x), 512):
                part = x[lo : lo + 512]
                row, filters = shared.value.decode(part)
                signs = np.packbits(part @ projections > 0, axis=1).view("<i8")
                order = np.lexsort((filters, row))
                row, filters = row[order], filters[order]
                rep = batch.column("rep").to_numpy()[lo : lo + 512]
                yield pa.RecordBatch.from_arrays([pa.array(filters), pa.array(rep[row]), pa.array(signs[row, 0]), pa.array(signs[row, 1])], ["filter", "rep", "s", "t"])

    members = written(groups.select("rep", "packed").mapInArrow(decoded, "filter long, rep long, s long, t long"), "filters")
    # only filters of more than a chunk need their size; a million of them (16 bytes each) is the most that there can be
    sizes = members.groupBy("filter").agg(F.count("*").alias("n")).where(F.col("n") > max(CHUNK, members.count() // 1_000_000))
    met = chunked(members.join(F.broadcast(sizes), "filter", "left").withColumn("n", F.coalesce("n", F.lit(1))), CHUNK)
    tasks = met.repartition("filter", "lo", "hi").sortWithinPartitions("filter", "lo", "hi", "rep")

    def alike(batches):
        for block, starts in runs(batches, ("filter", "lo", "hi")):
            signs = [block.column(c).to_numpy().view("u8") for c in ("s", "t")]

            def pairs_of(a, b, same, signs=signs):
                own = [s[a:b] for s in signs]
                return meetings(same, lambda rows, columns: sum(np.bitwise_count(s[rows][:, None] ^ s[columns]) for s in own) <= differ)

            if (out := candidate_rows(block, starts, "filter", pairs_of)) is not None:
                yield out

    candidates = written(tasks.mapInArrow(alike, ROWS), "vector-candidates")
    dropped(members)

    def exact(batches):
        def linked(part, i, j):
            x, good = _unpacked(part.column("packed").to_pylist(), kind), np.zeros(len(i), bool)
            for lo in range(0, len(x), 256):  # the marked pairs of 256 members at a time
                a, b = np.searchsorted(i, (lo, lo + 256))
                if (b - a) * 8 > 256 * len(x):
                    good[a:b] = (x[lo : lo + 256] @ x.T)[i[a:b] - lo, j[a:b]] >= cosine
                else:
                    for at in range(a, b, 4096):
                        to = min(at + 4096, b)
                        good[at:to] = np.einsum("ij,ij->i", x[i[at:to]], x[j[at:to]]) >= cosine
            if good.any():
                touched = np.unique(np.concatenate([i[good], j[good]]))
                row, filters = shared.value.decode(x[touched])
                order = np.lexsort((filters, row))
                lists = np.split(filters[order], np.searchsorted(row[order], np.arange(1, len(touched))))
                place = np.searchsorted(touched, np.arange(len(x)))
                seen = seen_before(lists, part.column("key")[0].as_py())
                good[good] = ~seen[place[i[good]], place[j[good]]]
            return good

        yield from stars(batches, linked)

    found = written(gathered(candidates, groups.select("rep", "weight", "packed")).mapInArrow(exact, STARS), "vector-links")
    dropped(candidates)
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # components so far are named by numbers of representatives; their smallest id names them from here on
    named = named_by_least(parts, groups)
    sums = groups.select("key", "rep", "least_id", "weight").join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(named, "rep", "left")
    sums = sums.select("key", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("c", "least_id").alias("c"))
    per_id = joined(known, sums, "key", "weight", units.count()).groupBy("id").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    out = given.join(per_id, "id", "left").select(
        F.col("id").alias(id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id")
    )
    return out.withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")) & F.col(id).isNotNull())
