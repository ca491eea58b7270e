"""Toxicity: non-negative positive-unlabelled learning of a linear word classifier.

Confirmed toxic documents are the positives; all documents, whatever their labels, are the unlabelled set.
Spark counts in how many positives and in how many of all documents each word is; that chooses the words and
bounds the share of toxic documents (the class prior). The risk estimator of Kiryo et al. (2017) takes that
prior and corrects the unlabelled risk for the positives hidden in it, held at zero from below. Its gradient
steps run in numpy: the first ones over a bounded sample, to start from, the last ones in tasks over all
documents, as distinct lists of chosen words with their counts. The cut is set on the scores of all documents.
No text reaches the driver, and no label but "toxic" is learned from. The model scores every row in Arrow
batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import forget, id_sample, labelled_sample, written

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that may be learned from, and documents that the steps start on. Counts, last steps and the cut cover all rows.
LABELLED_ROWS, START_ROWS = 8000, 5000
#: Gradient steps over all documents, each a Spark job.
WHOLE_STEPS = 20
#: Positives that a word must be in, and words that a task remembers before it hands its counts on.
LEAST_DOCS, HELD_WORDS = 3, 50_000
#: Sums of gradients and losses are added as integers of this unit, so that the order of tasks doesn't matter; scores are binned at it to be counted.
UNIT, BINS = 1 / 65_536, 256
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Evidence (squared log ratio times positives) that a word needs, and the share of positives that set the cut and not the weights.
EVIDENCE, CUT_SHARE = 15, 0.3


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float


def _words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def document_counts(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(word, n): in how many texts of ``docs`` each word is, of all words or of a bounded list; the empty word counts the texts."""
    wanted = docs.sparkSession.sparkContext.broadcast(None if words is None else frozenset(words))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        only, n = wanted.value, Counter()
        for b in batches:
            for text in b["text"]:
                found = _words(text)
                n.update(found if only is None else found & only)
                n[""] += 1
            if len(n) > HELD_WORDS:  # what a task remembers is bounded; the sums are the same
                yield pd.DataFrame(list(n.items()), columns=["word", "n"])
                n = Counter()
        yield pd.DataFrame(list(n.items()), columns=["word", "n"])

    return docs.select("text").mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def chosen_words(in_p: dict[str, int], n_p: int, in_u: dict[str, int], n_u: int) -> list[str]:
    """The words that positives hold more often than chance allows for their frequency, best first."""
    lift = {w: np.log((n + 0.5) / (n_p + 1)) - np.log((in_u.get(w, 0) + 0.5) / (n_u + 1)) for w, n in in_p.items()}
    return sorted((w for w in lift if lift[w] > 0 and lift[w] ** 2 * in_p[w] > EVIDENCE), key=lambda w: (-lift[w] * in_p[w], w))


def class_prior(in_p: dict[str, int], n_p: int, in_u: dict[str, int], n_u: int) -> float:
    """The share of toxic documents, from above.

    A word's share among all documents is at least the prior times its share among positives, so the least
    ratio of the two bounds the prior. Only words of a tenth of the positives count, or of fewer where there
    are none, as the least of many noisy ratios is too small; a standard error is added.
    """
    for share in (0.1, 0.05, 0.02):
        if found := [(in_u.get(w, 0) / n_u) / (n / n_p) * (1 + 1 / np.sqrt(n)) for w, n in in_p.items() if n >= max(10, share * n_p)]:
            return float(np.clip(min(found), 0.005, 0.9))
    return 0.05


def _pairs(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of all words in ``rows``."""
    if not len(rows):
        return np.zeros(0, int), np.zeros(0, int)
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.asarray(r, int) for r in rows])


class Sample:
    """Texts, as arrays of word indices, that are at hand."""

    def __init__(self, rows: list[np.ndarray]):
        (self.i, self.j), self.n = _pairs(rows), len(rows)

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.i, w[self.j], self.n) + b

    def gradient(self, by_row: np.ndarray, words: int) -> np.ndarray:
        """By word, and for the constant, from what each row's score adds."""
        return np.r_[np.bincount(self.j, by_row[self.i], words), by_row.sum()]

    def negative(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        """The mean loss of these rows as negatives, and its gradient."""
        z = self.scores(w, b)
        return np.logaddexp(0, z).mean(), self.gradient(_sigmoid(z) / self.n, len(w))

    def spread(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and how many rows have each."""
        return self.scores(w, b), np.ones(self.n)


class Everywhere:
    """All texts of a table, as a stored table of distinct lists of word indices with counts; sums come back, never rows."""

    def __init__(self, docs: DataFrame, words: list[str], n: int):
        self.n, self.words = n, len(words)
        self.lists = written(docs.select(_finder(docs, words)("text").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")))

    def _added(self, w: np.ndarray, b: float, part, unit: float) -> tuple[np.ndarray, np.ndarray]:
        """Sums, by key, of what ``part(scores, counts, rows)`` gives as (keys, values) for a batch."""
        shared = self.lists.sparkSession.sparkContext.broadcast((w, b))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            forget()
            w, b = shared.value
            total: pd.Series | None = None
            for batch in batches:
                rows = Sample(list(batch["at"]))
                keys, values = part(rows.scores(w, b), batch["n"].to_numpy(float), rows)
                found = pd.Series(values, index=keys)
                total = found if total is None else total.add(found, fill_value=0)
            if total is not None:
                yield pd.DataFrame({"key": total.index.astype("int64"), "value": np.round(total.to_numpy() / unit).astype("int64")})

        out = self.lists.mapInPandas(work, "key bigint, value bigint").groupBy("key").agg(F.sum("value").alias("value")).orderBy("key").toPandas()
        shared.unpersist()
        return out["key"].to_numpy(), out["value"].to_numpy() * unit

    def negative(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        def part(z: np.ndarray, n: np.ndarray, rows: Sample) -> tuple[np.ndarray, np.ndarray]:
            values = np.r_[rows.gradient(n * _sigmoid(z), len(w)), (n * np.logaddexp(0, z)).sum()]
            return np.arange(len(values)), values

        _, sums = self._added(w, b, part, UNIT)
        return sums[-1] / self.n, sums[:-1] / self.n

    def spread(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        def part(z: np.ndarray, n: np.ndarray, rows: Sample) -> tuple[np.ndarray, np.ndarray]:
            bins, at = np.unique(_binned(z), return_inverse=True)
            return bins, np.bincount(at, n)

        bins, n = self._added(w, b, part, 1.0)
        return (bins + 0.5) / BINS, n


def _binned(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -40, 40) * BINS).astype(int)


def learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], words: list[str], prior: float, everywhere: Everywhere | None = None, steps: int = 400, rate: float = 0.1, decay: float = 1e-2, seed: int = 1) -> ToxicityModel:
    """Minimises ``prior * R_p+ + max(0, R_u- - prior * R_p-)`` with the logistic loss and Adam steps.

    A text is the array of the indices of ``words`` in it. The ``steps`` go over ``unlabelled``, and from where
    they end ``WHOLE_STEPS`` shorter ones over ``everywhere``, where that is given. Of 20 positives or more, some
    are kept out of the steps, so that the cut isn't set by scores that the weights were fitted to.
    """
    if not positive or not unlabelled:
        return ToxicityModel({}, -4.0)
    out = np.random.default_rng(seed).random(len(positive)) < CUT_SHARE if len(positive) >= 20 else np.zeros(len(positive), bool)
    kept_out, positive = [r for r, o in zip(positive, out, strict=True) if o], [r for r, o in zip(positive, out, strict=True) if not o]
    p, u = Sample(positive), Sample(unlabelled)
    w, b = np.zeros(len(words)), -1.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for t in range(1, steps + (WHOLE_STEPS if everywhere else 0) + 1):
        # The last steps shrink, so that they end where all documents have them end.
        length = rate if t <= steps else rate * (1 - (t - steps) / (WHOLE_STEPS + 1))
        zp = p.scores(w, b)
        loss, gu = (u if t <= steps else everywhere).negative(w, b)
        gp_pos, gp_neg = p.gradient(-prior * (1 - _sigmoid(zp)) / p.n, len(words)), p.gradient(-prior * _sigmoid(zp) / p.n, len(words))
        # Where the corrected risk fell below zero, the step goes back up it and leaves the rest alone.
        g = gp_pos + gp_neg + gu if loss >= prior * np.logaddexp(0, zp).mean() else -gp_neg - gu
        g[:-1] += decay * w / max(1, len(words)) * 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = length * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    model = ToxicityModel({k: float(x) for k, x in zip(words, w, strict=True)}, float(b))
    cut = Sample(kept_out or positive).scores(w, b)
    if everywhere:
        cut = (_binned(cut) + 0.5) / BINS
    return calibrated(model, cut, *(everywhere or u).spread(w, b), prior)


def calibrated(model: ToxicityModel, positive: np.ndarray, unlabelled: np.ndarray, counts: np.ndarray, prior: float) -> ToxicityModel:
    """Moves the constant so that ``THRESHOLD`` lies at the cut with the largest recall squared over share of rows found.

    ``counts`` says how many rows have each score of ``unlabelled``. The measure (Lee and Liu, 2003) orders cuts as F1 would and needs positives and unlabelled rows alone.
    No fewer rows can be toxic than the prior times the recall, so a sample that has fewer counts as that
    many. The cut is put in the middle of the gap between scores that it lies in.
    """
    z = np.unique(np.r_[positive, unlabelled])
    cuts = (z[1:] + z[:-1]) / 2
    if not len(cuts):
        return model
    p, order, n_u = np.sort(positive), np.argsort(unlabelled), counts.sum()
    recall = 1 - np.searchsorted(p, cuts) / len(p)
    below = np.r_[0, np.cumsum(counts[order])]
    found = 1 - below[np.searchsorted(unlabelled[order], cuts)] / n_u
    worth = recall**2 / np.maximum(np.maximum(found, prior * recall), 1 / n_u)
    cut = float(cuts[int(worth.argmax())])
    return ToxicityModel(model.weights, model.bias - cut + float(np.log(THRESHOLD / (1 - THRESHOLD))))


def raw(model: ToxicityModel, text: str | None) -> float:
    get = model.weights.get
    return model.bias + sum(sorted(x for x in map(get, _words(text)) if x is not None))


def _finder(docs: DataFrame, words: list[str]):
    """A column function: the indices of ``words`` in a text, ascending."""
    shared = docs.sparkSession.sparkContext.broadcast({w: j for j, w in enumerate(words)})

    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        at = shared.value
        return pd.Series([sorted(at[w] for w in _words(t) if w in at) for t in texts])

    return find


def _indices(docs: DataFrame, words: list[str]) -> list[np.ndarray]:
    """The indices of ``words`` in each text, in order of the texts' doc_id."""
    found = docs.select("doc_id", _finder(docs, words)("text").alias("at")).collect()
    return [np.array(r["at"], int) for r in sorted(found, key=lambda r: r["doc_id"])]


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, labelled_rows: int = LABELLED_ROWS, start_rows: int = START_ROWS) -> ToxicityModel:
    """Learns from documents labelled toxic and from all others alike. ``where`` restricts the labels that may be learned from.

    At most ``labelled_rows`` labelled documents are learned from. Any word of ``LEAST_DOCS`` positives is counted
    over all of ``docs``, and all of ``docs`` are in the last steps and the cut; the first steps start on ``start_rows``
    of them. Without positives or without documents all scores are low.
    """
    positive = written(labelled_sample(docs, labels, "toxic", labelled_rows, where).where("label = 1"))
    found = {r["word"]: r["n"] for r in document_counts(positive).where(f"word = '' OR n >= {LEAST_DOCS}").collect()}
    n_p = found.pop("", 0)
    if not n_p:
        return ToxicityModel({}, -4.0)
    in_u = {r["word"]: r["n"] for r in document_counts(docs, list(found)).collect()}
    n_u = in_u.pop("")
    words = chosen_words(found, n_p, in_u, n_u)
    ids = id_sample(docs.where(F.col("doc_id").isNotNull()).select("doc_id"), start_rows, "unlabelled")
    others = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return learn(_indices(positive, words), _indices(others, words), words, class_prior(found, n_p, in_u, n_u), Everywhere(docs, words, n_u))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD``).

    A null or empty text gets the constant's score; equal texts get equal scores; a score at the threshold
    counts as toxic; an empty table gives no rows. Columns named like an added one are replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    # Only texts go to Python and only scores come back. A filter on the score mustn't compute it once more.
    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        known = ToxicityModel(*shared.value)
        for texts in batches:
            yield pd.Series(np.round(_sigmoid(np.array([raw(known, t) for t in texts], float)), 9))

    scored = docs.drop("score", "predicted").withColumn("score", rate.asNondeterministic()("text"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
