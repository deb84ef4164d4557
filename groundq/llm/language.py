"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundq.llm.texts import BASE, bounded_texts, text_blocks, text_within
from groundq.shipping import ship

#: Hashed n-grams; collisions share a weight.
BITS = 18
ORDERS = (1, 2, 3)
#: The classifier is fitted on at most so many labelled texts, dealt fairly to the languages. Document frequencies come from all.
TRAIN_ROWS = 4000
#: And on texts of so many bytes together.
TRAIN_BYTES = 1 << 26


#: Whether a code point of the first 65,536 is a letter.
_ALPHA = np.array([chr(c).isalpha() for c in range(1 << 16)])


def _letters(code: np.ndarray) -> np.ndarray:
    out = _ALPHA[np.minimum(code, (1 << 16) - 1)]
    high = np.flatnonzero(code >= 1 << 16)
    if len(high):
        distinct, at = np.unique(code[high], return_inverse=True)
        out[high] = np.array([chr(c).isalpha() for c in distinct])[at]
    return out


def grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the features of the texts' n-grams, with where each text's begin and end, and whether each text has a letter.

    A-Z and a-z count alike, a run of what is no letter counts as one space.
    """
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "u4") for t in texts]
    raw = np.concatenate([*parts, np.zeros(0, "u4")])
    ends = np.cumsum([0, *map(len, parts)])
    letter = _letters(raw)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first place after a letter stands for the gap
    kept = np.concatenate([[0], np.cumsum(keep)])
    has = np.diff(np.concatenate([[0], np.cumsum(letter)])[ends]) > 0
    code = np.where(letter, np.where((raw >= 65) & (raw <= 90), raw + 32, raw), 32)[keep].astype("u8")
    bounds = kept[ends]
    out, h = [], np.zeros(len(code), "u8")
    for n in range(1, max(ORDERS) + 1):
        h = h[: max(len(code) - n + 1, 0)] * np.uint64(BASE) + code[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            feature = (((h + np.uint64(n)) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - BITS)).astype("i4")
            # n-grams that reach into the next text are left out by the ends
            ends_n = np.stack([bounds[:-1], np.maximum(bounds[1:] - n + 1, bounds[:-1])], axis=1)
            out.append((feature, np.minimum(ends_n, len(feature))))
    return out, has


@dataclass
class Model:
    """weights: for each feature and class, idf included; temperature divides the scores before the softmax."""

    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def __post_init__(self):
        self.table = np.ascontiguousarray((self.weights * self.idf[:, None]).T, "f4")

    def __getstate__(self) -> dict:
        """What predictions need, which is all that is sent to executors."""
        return {**vars(self), "weights": None, "idf": None}

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, class) logits and whether each text has a letter. A text is its n-grams' mean, each times its idf."""
        found, has = grams(texts)
        total, count = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts), "i8")
        for feature, ends in found:
            sums = np.zeros(len(feature) + 1)
            for c, weights in enumerate(self.table):
                np.cumsum(weights[feature], out=sums[1:])
                total[:, c] += sums[ends[:, 1]] - sums[ends[:, 0]]
            count += ends[:, 1] - ends[:, 0]
        return total / np.maximum(count, 1)[:, None] + self.bias, has

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _rows(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, values) of each text: term frequency times idf."""
    out = []
    for text in texts:
        feature, n = np.unique(np.concatenate([f[a:b] for f, ((a, b),) in grams([text])[0]]), return_counts=True)
        out.append((feature, n / max(n.sum(), 1) * idf[feature]))
    return out


def fit(texts: list[str], labels: list[str], idf: np.ndarray, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.1, l2: float = 1e-3, epochs: int = 3, seed: int = 3) -> Model:
    """Follow-the-regularised-leader, per coordinate, with elastic-net penalties; every tenth text is left for the temperature."""
    classes = sorted(set(labels))
    order = np.random.default_rng(seed).permutation(len(texts))
    held = set(order[::10].tolist()) if len(texts) >= 50 else set()
    rows, y = _rows(texts, idf), np.array([classes.index(x) for x in labels])
    k = len(classes)
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def leader(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in order:
            at, v = rows[i]
            if i in held or not len(at):
                continue
            w, wb = leader(z[at], n[at]), leader(zb, nb)
            s = v @ w + wb
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * wb
            nb += p * p
    model = Model(classes, idf, leader(z, n), leader(zb, nb), 1.0)
    check = sorted(held) or list(range(len(texts)))
    if check:
        model.temperature = fit_temperature(model.scores([texts[i] for i in check])[0], y[check])
    return model


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of the least log loss. The truth counts as one part in two more than there are rows unsure, so that it is finite even if all are right."""
    n, k = logits.shape
    aim = np.full((n, k), 1 / ((n + 2) * k))
    aim[np.arange(n), truth] += (n + 1) / (n + 2)

    def slope(sharp: float) -> float:  # of the loss, convex in 1 / temperature
        z = logits * sharp
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return float(((p / p.sum(axis=1, keepdims=True) - aim) * logits).sum())

    low, high = 1e-6, 1.0
    while slope(high) < 0 and high < 1e9:
        high *= 2
    for _ in range(100):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if slope(middle) < 0 else (low, middle)
    return 1 / high


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many rows of each label to take, `rows` at most: as even as the counts allow. With more labels than rows the most frequent get one each."""
    out, left = {}, rows
    order = sorted(counts, key=lambda c: (-counts[c], c))[:rows]
    for at, label in enumerate(sorted(order, key=lambda c: (counts[c], c))):
        out[label] = min(counts[label], left // (len(order) - at))
        left -= out[label]
    return out


def train(labelled: DataFrame, texts: DataFrame, *, id: str, text: str, label: str, rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES) -> Model | None:
    """A model of the labelled rows' languages; None without any. Document frequencies are counted over all of texts.

    Fitted on at most `rows` labelled ids: of each language those of the smallest hashes, by `quotas`, and as far as their texts have
    `text_bytes` together. An id with several texts or labels counts with the first of them in alphabetical order.
    """
    ship(texts.sparkSession)

    def frequencies(batches):
        df, seen, n = np.zeros(1 << BITS, "i8"), np.zeros(1 << BITS, bool), 0
        for batch in batches:
            for lo, hi, content in text_blocks(batch.column("text")):
                found, _ = grams(content)
                for i in range(hi - lo):
                    for feature, ends in found:
                        seen[feature[ends[i, 0] : ends[i, 1]]] = True
                    some = np.flatnonzero(seen)
                    df[some] += 1
                    seen[some] = False
                n += hi - lo
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["feature", "df"])

    # at most 2^BITS sums reach the driver, whatever the texts
    sums = texts.select(F.col(text).alias("text")).mapInArrow(frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    feature, df = sums.column("feature").to_numpy(), sums.column("df").to_numpy()
    having, n = np.zeros(1 << BITS), float(df[feature == -1].sum())
    having[feature[feature >= 0]] = df[feature >= 0]
    idf = np.log((1 + n) / (1 + having)) + 1

    known = labelled.where(F.col(id).isNotNull() & F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(label).alias("label"))
    # the bound holds before the texts are looked up: only the chosen ids' texts move
    named = known.groupBy("id").agg(F.min("label").alias("label"))
    counts = {r.label: r["count"] for r in named.groupBy("label").count().collect()}  # as many as there are languages
    share = quotas(counts, rows)
    if not share:
        return None
    # hashes are even, so the smallest ones of a language lie below a bound that a few more do: only those, about `rows`, are ranked
    near = {c: min(1.0, (q + 8 * math.sqrt(q) + 32) / counts[c]) for c, q in share.items()}
    most, bound = (F.create_map(*(F.lit(x) for pair in of.items() for x in pair)) for of in (share, near))
    low = named.where(F.xxhash64("id") / float(1 << 64) + 0.5 <= F.coalesce(F.try_element_at(bound, "label"), F.lit(-1.0)))
    place = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    chosen = low.withColumn("place", place).where(F.col("place") <= F.try_element_at(most, "label")).select("id")
    found = known.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    found = bounded_texts(found, text_bytes)
    return fit([r.text for r in found], [r.label for r in found], idf)


def crc_fold(id: Column, modulus: int) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % modulus


def identify(docs: DataFrame, model: Model | None, *, keys: list[str], text: str) -> DataFrame:
    """The likeliest language of each whole text, with its calibrated probability.

    A null text, one without a letter, and any text where nothing was learned, is "und" with the score 0. Rows that repeat come back as
    often. Other columns are dropped, so clashing names do no harm. An empty table gives an empty result. Result: keys, lang_pred, score.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^BITS weights a class
    kept = {k: f"key_{i}" for i, k in enumerate(keys)}
    column, field = text_within(text, kept)

    def predict(batches):
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for lo, hi, content in text_blocks(batch.column(column).field(field) if field else batch.column(column)):
                if model is None:
                    names += ["und"] * (hi - lo)
                    scores.append(np.zeros(hi - lo))
                    continue
                logits, has = model.scores(content)
                p = model.probabilities(logits)
                best = p.argmax(axis=1)
                names += [model.classes[b] if h else "und" for b, h in zip(best, has, strict=True)]
                scores.append(np.where(has, p[np.arange(hi - lo), best], 0.0))
            columns = [batch.column(c) for c in kept.values()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], [*kept.values(), "lang_pred", "score"])

    schema = T.StructType([T.StructField(i, docs.schema[k].dataType) for k, i in kept.items()]).add("lang_pred", "string").add("score", "double")
    sent = [F.col(k).alias(i) for k, i in kept.items()] + ([] if field else [F.col(text).alias("text")])
    rows = docs.select(*sent).mapInArrow(predict, schema)
    return rows.select(*(F.col(i).alias(k) for k, i in kept.items()), "lang_pred", "score")
