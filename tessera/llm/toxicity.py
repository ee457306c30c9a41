"""Toxicity: two class-conditional Kneser-Ney models with shared backoff counts.

Each class has continuation counts at two levels, words and pairs of words: the number of different neighbours on the left or on the right,
whichever is less. So copies of a text count once, and the words of a passage that stands in many texts have one place, its first and
last ones, too. A pair leaves its discounted mass to the class's words, and
these leave theirs to one continuation distribution over both classes: an expression seen in fewer different places than the
DISCOUNT is smoothed by counts that both share, so it speaks for neither class, and nothing is taken out of the models.

A text is compared by its length-normalised log-likelihoods: x is the log-likelihood under the toxic model less that under the ordinary one.

* ``mean``: x per token;
* ``peak``: the logarithm of the mean, over all WINDOW neighbouring tokens, of exp(SHARP * x of the window). The mean of a likelihood
  ratio is carried by the toxic expressions, however few; the mean of its logarithm by the mix of languages and subjects, in which
  every common word differs a little.

The score is a logistic curve of the two. It is fitted on labelled documents that the counts don't hold: the sample is cut into FOLDS by
a hash of the ids, each scored by models of the others. The same evidence chooses the discount, from DISCOUNTS, by its
log loss. The final models count the whole sample.

A token is the beginning of STEM bytes of a lower-case run of letters and digits (ASCII punctuation separates as white space
does), so inflected forms share their counts. What isn't smoothed is a table of words, contexts and pairs seen more often than the
discount; everything else has one and the same ratio, so the tables are small and scoring with them is exact.

Training sample (the documented bound): at most SAMPLE_DOCS labelled documents of each class, by the order of
a hash of their id, and of these as many as fit into SAMPLE_CHARS characters of text: one that doesn't fit is passed over, and the
next in order is tried; of a class in which none fits, the smallest is taken by its first SAMPLE_CHARS characters. What goes to the executors is bounded by the sample; scoring covers every document and the whole text.

Defined cases: labels other than 0 and 1 are ignored; without labelled documents of both classes every score
is 0; a text without tokens has no evidence and scores 0.49 at most; rows that repeat a doc_id are scored each on its
own text; further columns, whatever their names, pass unchanged, but for score and predicted, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import free_name, given_back, stored
from .text import _SPACE, Slots, Words, chunks, mix

SAMPLE_DOCS, SAMPLE_CHARS = 4000, 4_000_000
STEM, FOLDS, WINDOW, SHARP = 5, 3, 2, 2.0
#: Discounts of words and of pairs.
DISCOUNTS = tuple((word, pair) for word in (5, 10, 20, 40) for pair in (word, 4 * word))

_SEPARATOR = _SPACE.copy()
_SEPARATOR[[c for c in range(128) if not chr(c).isalnum()]] = True


def _tokens(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Token hashes, and the hash of the token before (0 at a text's start)."""
    words = Words(texts, lower=True, separators=_SEPARATOR)
    h = words.hashes(STEM)
    before = np.zeros_like(h)
    before[1:] = h[:-1]
    before[words.first[:-1][words.counts > 0]] = 0
    return words, h, before


def _pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(before + np.uint64(1)) ^ h)


class Counts:
    """Sorted keys with values; zero for other keys."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.values = np.bincount(inverse, weights, minlength=len(self.keys)).astype(np.float64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)


class ClassCounts:
    """Continuation counts of one class: different places of words and of pairs, on the side where they have fewer."""

    def __init__(self, before: np.ndarray, h: np.ndarray) -> None:
        """Tokens, text after text, each with the token before it (0 at a text's start)."""
        starts = before == 0
        earlier, later = np.zeros_like(h), np.zeros_like(h)
        earlier[1:], later[:-1] = before[:-1], h[1:]
        earlier[starts] = 0
        later[:-1][starts[1:]] = 0
        pair = _pair(before, h)
        self.words = self._places(h, before, later)
        self.pairs = self._places(pair, earlier, later)
        _, first = np.unique(pair, return_index=True)
        self.pair_before, self.pair_word = before[first], h[first]
        self.contexts = Counts(self.pair_before, self.pairs[pair[first]])

    @staticmethod
    def _places(key: np.ndarray, left: np.ndarray, right: np.ndarray) -> Counts:
        sides = []
        for side in (left, right):
            _, first = np.unique(_pair(side, key), return_index=True)
            sides.append(Counts(key[first]))
        sides[0].values = np.minimum(sides[0].values, sides[1].values)
        return sides[0]


class KneserNey:
    """One class's distribution for a discount, over a shared continuation distribution."""

    def __init__(self, own: ClassCounts, shared: Counts, by_word: float, by_pair: float) -> None:
        self.own, self.shared, self.by_word, self.by_pair = own, shared, by_word, by_pair
        self.shared_total = shared.values.sum()
        self.n = own.words.values.sum()
        self.spare = np.minimum(own.words.values, by_word).sum()
        if not self.n:  # a class without words is the shared distribution
            self.n = self.spare = 1.0
        freed = np.minimum(own.pairs[_pair(own.pair_before, own.pair_word)], by_pair)
        self.freed = Counts(own.pair_before, freed)

    def word(self, h: np.ndarray) -> np.ndarray:
        # one more kind of word stands for the unseen
        base = (self.shared[h] + 0.5) / (self.shared_total + 0.5 * (len(self.shared.keys) + 1))
        return (np.maximum(self.own.words[h] - self.by_word, 0) + self.spare * base) / self.n

    def left(self, before: np.ndarray) -> np.ndarray:
        """The share of a context's mass that goes to the words."""
        total = self.own.contexts[before]
        return np.where(total > 0, self.freed[before] / np.maximum(total, 1), 1.0)

    def after(self, before: np.ndarray, h: np.ndarray) -> np.ndarray:
        own = np.maximum(self.own.pairs[_pair(before, h)] - self.by_pair, 0)
        return own / np.maximum(self.own.contexts[before], 1) + self.left(before) * self.word(h)


class Evidence:
    """Log-likelihood ratios of tokens, from tables of what is seen more often than the discount; all else has the ratio ``rest``."""

    def __init__(self, sides: tuple[ClassCounts, ClassCounts], by_word: float, by_pair: float) -> None:
        shared = Counts(np.concatenate([x.words.keys for x in sides]), np.concatenate([x.words.values for x in sides]))
        zero, one = (KneserNey(x, shared, by_word, by_pair) for x in sides)
        self.rest = float(np.log(one.spare / one.n) - np.log(zero.spare / zero.n))
        words = shared.keys[np.maximum(*(x.words[shared.keys] for x in sides)) > by_word]
        self.words = Slots(words, np.log(one.word(words) / zero.word(words)))
        contexts = np.unique(np.concatenate([x.contexts.keys for x in sides]))
        lean = np.log(one.left(contexts) / zero.left(contexts))
        self.contexts = Slots(contexts[lean != 0], lean[lean != 0])
        before, h = (np.concatenate([getattr(x, n) for x in sides]) for n in ("pair_before", "pair_word"))
        key, first = np.unique(_pair(before, h), return_index=True)
        often = np.maximum(*(x.pairs[key] for x in sides)) > by_pair
        b, w = before[first][often], h[first][often]
        self.pairs = Slots(key[often], np.log(one.after(b, w) / zero.after(b, w)))

    def ratios(self, before: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = self.pairs.get(_pair(before, h), np.nan)
        rest = np.flatnonzero(np.isnan(out))
        out[rest] = self.words.get(h[rest], self.rest) + self.contexts.get(before[rest], 0.0)
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text (mean, peak), and its tokens."""
        words, h, before = _tokens(texts)
        x = self.ratios(before, h)
        summed = np.concatenate((x, np.zeros(WINDOW)))
        size = words.counts[words.doc_of_word()]
        place = np.arange(len(x)) - words.first[:-1][words.doc_of_word()]
        window = sum(np.where(place + k < size, summed[k : k + len(x)], 0.0) for k in range(WINDOW))
        whole = place <= np.maximum(size - WINDOW, 0)  # a text shorter than a window is one
        some = words.counts > 0
        out = np.zeros((words.n_docs, 2))
        if some.any():
            starts = words.first[:-1][some]
            out[some, 0] = np.add.reduceat(x, starts) / words.counts[some]
            raised = np.where(whole, np.exp(np.clip(SHARP * window, -60, 200)), 0.0)
            out[some, 1] = np.log(np.add.reduceat(raised, starts) / np.maximum(words.counts[some] - WINDOW + 1, 1))
        return out, words.counts


class ToxicityModel:
    """Two classes, and a logistic curve over what their log-likelihoods say of a text."""

    def __init__(self, texts: list[str], toxic: np.ndarray, folds: np.ndarray, share: float | None = None) -> None:
        """``folds``: a fold for each text; ``share``: the share of toxic rows among all labelled ones, if the sample's own isn't it."""
        # fold by fold: the counts of one are held at a time
        found = {d: (np.zeros((len(texts), 2)), np.zeros(len(texts))) for d in DISCOUNTS}
        for k in np.unique(folds):
            rows = folds == k
            own, sides = pa.array([t for t, x in zip(texts, rows, strict=True) if x], pa.string()), self._sides(texts, toxic, ~rows)
            for discount, (x, n) in found.items():
                x[rows], n[rows] = Evidence(sides, *discount)(own)
            del own, sides
        curves = {d: self._fit(x[n > 0], toxic[n > 0], share) for d, (x, n) in found.items()}
        self.discount = min(curves, key=lambda d: curves[d][0])
        self.weights = curves[self.discount][1]
        self.evidence = Evidence(self._sides(texts, toxic, np.ones(len(texts), dtype=bool)), *self.discount)

    @staticmethod
    def _sides(texts: list[str], toxic: np.ndarray, used: np.ndarray) -> tuple[ClassCounts, ClassCounts]:
        sides = []
        for label in (0, 1):
            _, h, before = _tokens(pa.array([t for t, x in zip(texts, used & (toxic == label), strict=True) if x], pa.string()))
            sides.append(ClassCounts(before, h))
        return sides[0], sides[1]

    @staticmethod
    def _columns(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x[:, 0], x[:, 1], np.ones(len(x))])

    def _fit(self, found: np.ndarray, y: np.ndarray, share: float | None) -> tuple[float, np.ndarray]:
        """Newton steps for a logistic regression with a light ridge; classes weigh as they do among all labelled rows. The log loss,
        and the weights."""
        if not len(y) or y.min() == y.max():
            return np.inf, np.array([0.0, 1.0, 0.0])
        x, own = self._columns(found), float(y.mean())
        share = own if share is None else share
        weight = np.where(y == 1, share / own, (1 - share) / (1 - own))
        b, ridge = np.zeros(x.shape[1]), 0.1
        p = np.full(len(y), 0.5)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(b)), x.T @ (weight * (y - p)) - ridge * b)
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        return float(-(weight * np.log(np.where(y == 1, p, 1 - p))).mean()), b

    def score(self, texts: pa.Array) -> np.ndarray:
        found, n = self.evidence(texts)
        s = 1 / (1 + np.exp(-np.clip(self._columns(found) @ self.weights, -60, 60)))
        return np.where(n > 0, s, np.minimum(s, 0.49))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> ToxicityModel | None:
    """A model of the bounded sample of labelled rows; None without both classes. Reads the texts twice: for their lengths, and for the sample."""
    known = labels.filter("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y")).groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("_id"), F.length("text").alias("_n"))
    labelled = stored(rows.join(known, "_id").groupBy("_id", "_y").agg(F.max("_n").alias("_n"), F.count("*").alias("_rows")))
    total = {r["_y"]: r["n"] for r in labelled.groupBy("_y").agg(F.sum("_rows").alias("n")).collect()}
    chosen = []
    for label in (0, 1):
        own = labelled.filter(F.col("_y") == label)
        fits = own.filter(F.col("_n") <= sample_chars).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs).collect()
        left, taken = sample_chars, []
        for row in fits:
            if row["_n"] <= left:
                left -= row["_n"]
                taken.append(row["_id"])
        if not fits:
            taken = [row["_id"] for row in own.orderBy("_n", F.xxhash64("_id"), "_id").limit(1).collect()]
        chosen += [(i, label) for i in taken]
    if len({y for _, y in chosen}) < 2:
        if total.get(0) and total.get(1):
            raise RuntimeError("the sample lacks a class that has labelled documents")
        return None
    wanted = docs.sparkSession.createDataFrame(chosen, "_id long, _y int")
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("_id"), F.substring(F.col("text").cast("string"), 1, sample_chars).alias("text")).join(F.broadcast(wanted), "_id")
    texts = texts.groupBy("_id").agg(F.max("_y").alias("_y"), F.min("text").alias("text"), F.abs(F.xxhash64("_id")).alias("_h")).orderBy("_id").collect()
    model = ToxicityModel([r["text"] for r in texts], np.array([r["_y"] for r in texts]), np.array([r["_h"] % FOLDS for r in texts]), total[1] / (total[0] + total[1]))
    del texts
    given_back()
    return model


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on)."""
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    given = free_name(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, given):
            s = model.score(batch.column(given)) if model is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*columns, "score", "predicted"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*columns).dtypes)
    return docs.select(*columns, F.col("text").cast("string").alias(given)).mapInArrow(run, f"{schema}, score double, predicted int")
