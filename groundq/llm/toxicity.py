"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundq.llm.boosting import Trees, calibrated, fit_isotonic, fit_trees
from groundq.llm.texts import Words, blocks, bounded_texts, text_blocks, text_within, word_hash
from groundq.shipping import ship

#: The classifier is fitted on at most so many labelled texts: those of the smallest hashes of id.
TRAIN_ROWS = 8000
#: And on texts of so many bytes together.
TRAIN_BYTES = 1 << 26
#: Insults to start from; the labelled texts add words and word beginnings.
INSULTS = "idiot idiots stupid moron morons trash scum loser losers clown worthless pathetic disgusting dumb fool ugly garbage filth".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tus vos".split()
#: Words that lie so near to a second-person word count as aimed at someone.
NEAR = 5
PREFIXES = (3, 4, 5, 6)
#: A learned word's likelihood ratio must be so large, which chance reaches for one word in millions.
GAIN = 28.0
FEATURES = (
    "log words", "insults a word", "insults", "learned words a word", "learned words", "learned beginnings a word", "learned beginnings", "strongest", "sum of log odds a word",
    "aimed share", "second person a word", "capitals", "words in capitals", "exclamations", "questions", "other punctuation", "digits", "mixed words", "masked letters", "bytes a word",
)


def _lookup(hashes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each hash, 0 if it is no key. keys ascend."""
    if not len(keys):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, values[at], 0.0)


def _table(words: list[str]) -> np.ndarray:
    return np.unique(np.array([word_hash(w) for w in words], "u8"))


_INSULTS, _SECOND = _table(INSULTS), _table(SECOND_PERSON)


@dataclass
class Lexicon:
    """Log odds of learned words and of learned beginnings, by ascending hash."""

    words: tuple[np.ndarray, np.ndarray]
    starts: tuple[np.ndarray, np.ndarray]


def _distinct(texts: list[str], of):
    """Blocks of (text, hash), each distinct pair once. of: a block's words to lists of hashes."""
    for lo, hi in blocks(texts):
        w = Words(texts[lo:hi])
        for h in of(w):
            order = np.lexsort((h, w.doc))
            d, h = w.doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            yield d[new] + lo, h[new]


def _log_odds(texts: list[str], y: np.ndarray, of, least: float = 1.6, support: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that speak for toxic texts, and their log odds.

    Two passes: counts by a part of the hash say which hashes can have the support, and only those are counted one by one.
    """
    shift = np.uint64(64 - 20)
    rough = np.zeros(1 << 20, "i4")
    for _, h in _distinct([t if v else "" for t, v in zip(texts, y, strict=True)], of):
        rough += np.bincount((h >> shift).astype("i4"), minlength=len(rough)).astype("i4")
    hashes = [np.zeros(0, "u8")]
    for _, h in _distinct([t if v else "" for t, v in zip(texts, y, strict=True)], of):
        hashes.append(h[rough[(h >> shift).astype("i4")] >= support])
    keys, toxic = np.unique(np.concatenate(hashes), return_counts=True)
    keys, toxic = keys[toxic >= support], toxic[toxic >= support]
    clean = np.zeros(len(keys), "i8")
    for _, h in _distinct([t if not v else "" for t, v in zip(texts, y, strict=True)], of) if len(keys) else ():
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        clean += np.bincount(at[keys[at] == h], minlength=len(keys))
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / (len(y) - y.sum() + 1))
    expected = (toxic + clean) * (y.sum() / max(len(y), 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (toxic * np.log(toxic / expected) + np.where(clean > 0, clean * np.log(clean / (toxic + clean - expected)), 0))
    good = (odds >= least) & (g >= GAIN)
    return keys[good], odds[good]


def learn_lexicon(texts: list[str], y: np.ndarray) -> Lexicon:
    words = _log_odds(texts, y, lambda w: [w.hashes])
    starts = _log_odds(texts, y, lambda w: [w.prefix_hashes(n) for n in PREFIXES])
    return Lexicon(words, starts)


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """(text, feature), in the order of FEATURES, of whole texts."""
    rows = []
    for lo, hi in blocks(texts):
        w = Words(texts[lo:hi])
        raw, n = w.raw, np.diff(w.first)
        size = w.bounds[:, 1] - w.bounds[:, 0]
        words, size1 = np.maximum(n, 1), np.maximum(size, 1)
        insult = _lookup(w.hashes, _INSULTS, np.ones(len(_INSULTS)))
        learned = _lookup(w.hashes, *lexicon.words)
        starts = np.max([_lookup(w.prefix_hashes(k), *lexicon.starts) for k in PREFIXES], axis=0)
        odds = np.maximum(np.maximum(learned, starts), 3 * insult)
        hit = odds > 0
        second = _lookup(w.hashes, _SECOND, np.ones(len(_SECOND))) > 0
        where = np.flatnonzero(second)
        aimed = np.zeros(len(hit), bool)
        if len(where):
            at = np.flatnonzero(hit)
            for side in (np.searchsorted(where, at) - 1, np.searchsorted(where, at)):
                near = where[np.clip(side, 0, len(where) - 1)]
                aimed[at] |= (np.abs(near - at) <= NEAR) & (w.doc[near] == w.doc[at])
        strongest = np.zeros(len(n))
        np.maximum.at(strongest, w.doc[hit], odds[hit])
        upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
        digit, wide = (raw >= 48) & (raw <= 57), raw >= 128
        mark = (raw > 32) & (raw < 128) & ~upper & ~lower & ~digit
        uppers, digits = (np.concatenate([[0], np.cumsum(x)]) for x in (upper, digit))
        lowers = np.concatenate([[0], np.cumsum(lower | wide)])
        up, low, dig = ((c[w.ends] - c[w.starts]) for c in (uppers, lowers, digits))
        letter = upper | lower | wide
        masked = np.zeros(len(raw), bool)  # a mark between two letters, but for apostrophes and hyphens
        masked[1:-1] = mark[1:-1] & letter[:-2] & letter[2:] & (raw[1:-1] != 39) & (raw[1:-1] != 45)
        count = w.per_text
        hits = count(hit)
        columns = [
            np.log1p(n), count(insult) / words, count(insult), count(learned > 0) / words, count(learned > 0), count(starts > 0) / words, count(starts > 0), strongest, count(odds) / words,
            count(aimed) / np.maximum(hits, 1), count(second) / words, w.bytes_per_text(upper) / size1, count((up > 1) & (low == 0)) / words, w.bytes_per_text(raw == 33) / size1,
            w.bytes_per_text(raw == 63) / size1, w.bytes_per_text(mark & (raw != 33) & (raw != 63)) / size1, w.bytes_per_text(digit) / size1, count((dig > 0) & (up + low > 0)) / words,
            w.bytes_per_text(masked) / size1, count(w.ends - w.starts) / words,
        ]
        rows.append(np.stack(columns, axis=1))
    return np.concatenate([*rows, np.zeros((0, len(FEATURES)))])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    value: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        return calibrated(self.trees.margin(features(texts, self.lexicon)), self.at, self.value)


def fit(texts: list[str], y: np.ndarray, folds: int = 4, seed: int = 5) -> Model:
    """Lexicon features of each training text come from the other folds' lexicon, the margins that calibrate from the other folds' trees."""
    fold = np.random.default_rng(seed).permutation(len(texts)) % folds
    x = np.zeros((len(texts), len(FEATURES)))
    for k in range(folds):
        rest = np.flatnonzero(fold != k)
        own = np.flatnonzero(fold == k)
        x[own] = features([texts[i] for i in own], learn_lexicon([texts[i] for i in rest], y[rest]))
    margin = np.zeros(len(texts))
    for k in range(folds):
        margin[fold == k] = fit_trees(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(learn_lexicon(texts, y), fit_trees(x, y), *fit_isotonic(margin, y))


def train(docs: DataFrame, labels: DataFrame, *, id: str, text: str, label: str, rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES) -> Model:
    """A model of labels (id, label 0 or 1) of docs. Rows with a null id, text or label do not count; an id with both labels counts as 1.

    Fitted on at most `rows` labelled ids, those of the smallest hashes, as far as their texts have `text_bytes` together. An id with several
    texts counts with the first of them in alphabetical order, so that a rerun fits the same model.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(id).agg(F.max(F.col(label).cast("int")).alias("label"))
    # the bound holds before the texts are looked up: only the chosen ids' texts move
    chosen = known.orderBy(F.xxhash64(id), id).limit(rows)
    found = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen.withColumnRenamed(id, "id")), "id")
    found = bounded_texts(found.groupBy("id").agg(F.min(F.struct("text", "label")).alias("first")).select("id", "first.text", "first.label"), text_bytes)
    return fit([r.text for r in found], np.array([r.label for r in found], "f8"))


def score_texts(docs: DataFrame, model: Model, *, keys: list[str], text: str) -> DataFrame:
    """The calibrated probability that each whole text is toxic.

    A null or empty text has features of zero words and the score that the trees give it. Without any labelled row all scores are 0.
    Rows that repeat come back as often. Other columns are dropped, so clashing names do no harm. An empty table gives an empty result.
    Result: keys, score.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training rows
    kept = {k: f"key_{i}" for i, k in enumerate(keys)}
    column, field = text_within(text, kept)

    def predict(batches):
        for batch in batches:
            scores = [shared.value.scores(content) for _, _, content in text_blocks(batch.column(column).field(field) if field else batch.column(column))]
            columns = [*(batch.column(c) for c in kept.values()), pa.array(np.concatenate([*scores, np.zeros(0)]))]
            yield pa.RecordBatch.from_arrays(columns, [*kept.values(), "score"])

    schema = T.StructType([T.StructField(i, docs.schema[k].dataType) for k, i in kept.items()]).add("score", "double")
    sent = [F.col(k).alias(i) for k, i in kept.items()] + ([] if field else [F.col(text).alias("text")])
    rows = docs.select(*sent).mapInArrow(predict, schema)
    return rows.select(*(F.col(i).alias(k) for k, i in kept.items()), "score")
